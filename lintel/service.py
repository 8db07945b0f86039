"""The HTTP service: health, and the analysis of a portal's package with the caller's token."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from lintel.config import Config
from lintel.plans import render
from lintel.plans.scan import scan
from lintel.sources import ckan

VERSION = "1.0.0"


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


def bearer(header: str | None) -> str:
    """The token of an Authorization header; the scheme's case does not matter."""
    if not header:
        raise Refused(401, "missing_token", "an Authorization header is required")
    scheme, _, token = header.partition(" ")
    if scheme.lower() != "bearer" or not _:
        raise Refused(401, "invalid_auth_format", "the Authorization header is to be 'Bearer <token>'")
    if not token.strip():
        raise Refused(401, "empty_token", "the token is empty")
    return token.strip()


@dataclass(frozen=True)
class ServerConfig:
    """What the server itself says; a request's URL comes before it, the scan's configuration after."""

    ckan_url: str = ""
    verify_tls: bool | None = None

    def url(self, config: Config) -> str:
        return self.ckan_url or str(config.collector("CkanCollector").get("url", ""))

    def verify(self, config: Config) -> bool:
        if self.verify_tls is not None:
            return self.verify_tls
        return config.collector("CkanCollector").get("verify", True) not in (False, "false")


def check_access(url: str, package: str, token: str, verify: bool) -> str:
    """The package's document, if the token may read it."""
    try:
        return ckan.request(ckan.package_url(url, package), token, verify)
    except ckan.PortalError as e:
        known = {401: (401, "unauthorized", "Invalid or expired token"), 403: (403, "forbidden", f"No access to package '{package}'"), 404: (404, "not_found", f"Package '{package}' not found")}
        if e.status in known:
            raise Refused(*known[e.status]) from None
        raise Refused(502 if e.status else 500, "ckan_error", str(e)) from None


def analyze(spark: SparkSession, config: Config, server: ServerConfig, body: bytes, token: str) -> str:
    """The report of a package as JSON. Each request has its own configuration and state."""
    try:
        request = json.loads(body)
        if not isinstance(request, dict):
            raise ValueError("the body is no object")
    except ValueError as e:
        raise Refused(400, "invalid_json", f"Invalid JSON body: {e}") from None
    package = request.get("package_id")
    if not isinstance(package, str) or not package:
        raise Refused(400, "missing_package_id", "package_id is required")
    if not token:
        raise Refused(401, "no_token", "a token is required")
    url = request.get("ckan_url") or server.url(config)
    if not url:
        raise Refused(500, "no_ckan_url", "no URL is configured")
    document = check_access(url, package, token, server.verify(config))
    own = config.with_collector("CkanCollector", token=token, url=url)
    try:
        from lintel.cli import with_content

        files = with_content(ckan.package_files(spark, document, str(own.collector("CkanCollector").get("ckan_storage_path", ""))), own)
        some = bool(files.take(1))
    except Exception as e:  # noqa: BLE001
        raise Refused(500, "collector_error", f"Failed to collect files: {e}") from e
    if not some:
        raise Refused(404, "no_files", f"No files found in package '{package}'")
    try:
        return render.as_json(scan(files, own))
    except Exception as e:  # noqa: BLE001
        raise Refused(500, "format_error", f"Failed to format results: {e}") from e


#: A request is to be read, and its answer written, in so many seconds; a server that stops waits so long for requests under way.
READ_SECONDS, WRITE_SECONDS, DRAIN_SECONDS = 30, 300, 30


class _Server(ThreadingHTTPServer):
    """Knows how many requests are under way."""

    def __init__(self, *args) -> None:  # noqa: ANN002
        super().__init__(*args)
        self.under_way, self.changed = 0, threading.Condition()

    @contextmanager
    def counted(self) -> Iterator[None]:
        with self.changed:
            self.under_way += 1
        try:
            yield
        finally:
            with self.changed:
                self.under_way -= 1
                self.changed.notify_all()


def stop(server: _Server, seconds: float = DRAIN_SECONDS) -> bool:
    """Take no more requests, wait for those under way, and close; whether all of them ended in time."""
    server.shutdown()
    with server.changed:
        ended = server.changed.wait_for(lambda: server.under_way == 0, seconds)
    server.server_close()
    return ended


def make_server(spark: SparkSession, config: Config, server: ServerConfig = ServerConfig(), host: str = "127.0.0.1", port: int = 0, run: Callable[..., str] = analyze) -> _Server:
    """GET /health, POST /api/v1/analyze."""

    class Handler(BaseHTTPRequestHandler):
        timeout = READ_SECONDS

        def handle_one_request(self) -> None:
            with self.server.counted():
                super().handle_one_request()

        def _answer(self, status: int, text: str) -> None:
            data = text.encode()
            self.connection.settimeout(WRITE_SECONDS)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._answer(200, json.dumps({"status": "ok", "version": VERSION, "timestamp": render.now()}))
            else:
                self._answer(404, json.dumps({"error": "no such page", "code": "not_found"}))

        def do_POST(self) -> None:
            try:
                if self.path != "/api/v1/analyze":
                    raise Refused(404, "not_found", "no such page")
                token = bearer(self.headers.get("Authorization"))
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                self._answer(200, run(spark, config, server, body, token))
            except Refused as e:
                self._answer(e.status, json.dumps({"error": str(e), "code": e.code}))

        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

    return _Server((host, port), Handler)


def serve_in_thread(server: ThreadingHTTPServer) -> threading.Thread:
    t = threading.Thread(target=server.serve_forever, daemon=True)
    t.start()
    return t
