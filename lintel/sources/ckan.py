"""Packages of a CKAN portal: the package's document fetched by the driver, its resources as a files table."""

from __future__ import annotations

import json
import ssl
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.model import with_derived

RESOURCES = "result struct<resources: array<struct<name: string, url: string, url_type: string, size: double>>>"


class PortalError(RuntimeError):
    """The portal's answer is not 200; status is None if there was no answer."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def request(url: str, token: str = "", verify: bool = True, timeout: float = 60) -> str:
    """The body of a GET. Messages of errors never hold the token."""
    context = ssl.create_default_context()
    if not verify:
        context.check_hostname = False
        context.verify_mode = ssl.CERT_NONE
    headers = {"Authorization": token} if token else {}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout, context=context) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        raise PortalError(f"request to {url} failed with status {e.code}", e.code) from None
    except (urllib.error.URLError, OSError) as e:
        raise PortalError(f"request to {url} failed: {getattr(e, 'reason', e)}") from None


def package_url(base: str, package: str) -> str:
    return f"{base.rstrip('/')}/api/3/action/package_show?id={urllib.parse.quote(package)}"


def storage_path(url: Column, storage: str) -> Column:
    """Where a portal keeps an uploaded resource: from the id in its URL, cut after 3 and 6 bytes; empty if the URL has none."""
    base = storage.removesuffix("/")
    if base:
        base += "/" if base.endswith("resources") else "/resources/"
    parts = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    own = F.get(parts, F.lit(4))
    path = F.concat(F.lit(base), F.substring(own, 1, 3), F.lit("/"), F.substring(own, 4, 3), F.lit("/"), F.substr(own, F.lit(7)))
    return F.when((F.size(parts) > 4) & (F.octet_length(own) >= 6), path).otherwise("")


def resources(documents: DataFrame, column: str = "document") -> DataFrame:
    """(name, url, size) of the uploaded resources in package documents; sizes lose their fraction. Documents that are no JSON give nothing."""
    parsed = documents.select(F.from_json(column, RESOURCES, {"mode": "PERMISSIVE"}).alias("d"))
    rows = parsed.select(F.inline("d.result.resources"))
    return rows.where(F.coalesce(F.col("url_type") == "upload", F.lit(False))).select("name", "url", F.col("size").cast("bigint").alias("size"))


def package_files(spark: SparkSession, document: str, storage: str) -> DataFrame:
    """A files table of one package's document. Resources whose URL has no id have no path, and are left out."""
    json.loads(document)
    rows = resources(spark.createDataFrame([(document,)], "document string"))
    files = rows.select(storage_path(F.col("url"), storage).alias("path"), "name", F.col("name").alias("display_name"), "size")
    return with_derived(files).withColumn("ord", F.monotonically_increasing_id())


def collect(spark: SparkSession, package: str, attrs: dict) -> DataFrame:
    """The files of a package, as its collector's attributes say: url, token, verify, ckan_storage_path."""
    text = request(package_url(attrs["url"], package), attrs.get("token", ""), attrs.get("verify", True) not in (False, "false"))
    return package_files(spark, text, attrs.get("ckan_storage_path", ""))
