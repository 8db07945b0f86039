"""python -m lintel.cli: scan a folder or a portal's package, and print or write the report."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lintel.config import Config, ConfigError, find, load
from lintel.plans import render
from lintel.plans.scan import scan
from lintel.session import local_session
from lintel.sources import ckan, local


class ScanError(RuntimeError):
    """What a scan cannot do, with the kind that the error envelope names."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def collect(spark: SparkSession, config: Config, location: str) -> DataFrame:
    """The files of a location, by the collector that the configuration's main operation names."""
    name = config.operations.get("main", "")
    attrs = config.collector(name)
    try:
        if name == "LocalCollector":
            files = local.local_files(spark, location, attrs.get("includeFolders", False), True, config.general.max_content_scan_file_size)
        elif name == "CkanCollector":
            if location == ".":
                raise ScanError("collector_error", "Please give the name of a package as the location")
            files = with_content(ckan.collect(spark, location, dict(attrs)), config)
        else:
            raise ScanError("collector_error", "Unknown collector")
    except (local.InvalidPath, ckan.PortalError, KeyError, ValueError) as e:
        raise ScanError("collector_error", str(e)) from e
    if not files.take(1):
        raise ScanError("no_files", f"No files found in location: {location}")
    return files


def with_content(files: DataFrame, config: Config) -> DataFrame:
    """files with what is at their paths (lintel.sources.local.with_content)."""
    return local.with_content(files.repartition("path"), config.general.max_content_scan_file_size)


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lintel")
    p.add_argument("--config", default=None)
    p.add_argument("--location", default=".")
    p.add_argument("--html", default="")
    p.add_argument("--plain", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--summary", action="store_true")
    a = p.parse_args(argv)
    try:
        path = a.config or find()
        if path is None:
            raise ConfigError("no configuration file found")
        config = load(path)
    except ConfigError as e:
        print(render.error_envelope("config_error", f"Error loading config: {e}"))
        return 0
    try:
        spark = SparkSession.getActiveSession() or local_session("scan")
        result = scan(collect(spark, config, a.location), config)
        text = render.as_json(result)
        if a.html:
            try:
                render.as_html(text, a.html)
            except OSError as e:
                raise ScanError("html_error", f"Error generating HTML: {e}") from e
        print(render.as_plain(result, a.location) if a.plain else render.as_summary(result, a.location) if a.summary else text)
    except ScanError as e:
        print(render.error_envelope(e.kind, str(e)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
