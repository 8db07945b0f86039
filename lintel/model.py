"""Schemas of the tables that flow through a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row a file (or member, or folder).
FILES = "path string, name string, display_name string, size bigint, suffix string, is_archive boolean, archive_name string"
#: One row a finding.
MESSAGES = "test_name string, content string, source_kind string, path string, name string, display_name string, archive_name string, ord bigint"
#: One row a member of an archive; content is null where only the list is read.
MEMBERS = "archive_path string, archive_name string, archive_label string, ord int, member string, size bigint, is_dir boolean, content binary, error string"
#: One row a blob of an office document.
BODIES = "path string, name string, display_name string, archive_name string, idx int, content string, error string"
#: One row a line of the log.
LOG = "level string, message string, name string, path string, reason string"

ARCHIVE_SUFFIXES = (".7z", ".gz", ".tar", ".zip")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix_of(name: Column) -> Column:
    """The last dot of the last path element and what follows it; empty without a dot."""
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def is_archive(name: Column) -> Column:
    return suffix_of(name).isin(*ARCHIVE_SUFFIXES)


def with_derived(df: DataFrame) -> DataFrame:
    """A table with at least `path` made a files table: what is missing, null or empty is derived from the path.

    A null or empty path is an error of the caller's; such rows are dropped.
    """
    have = set(df.columns)
    given = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    out = df.where(F.coalesce(F.length("path"), F.lit(0)) > 0)
    name = F.coalesce(F.nullif(given("name", "string"), F.lit("")), base_name(F.col("path")))
    return (
        out.withColumn("name", name)
        .withColumn("display_name", F.coalesce(F.nullif(given("display_name", "string"), F.lit("")), F.col("name")))
        .withColumn("size", F.coalesce(given("size", "bigint"), F.lit(0).cast("bigint")))
        .withColumn("suffix", F.coalesce(F.nullif(given("suffix", "string"), F.lit("")), suffix_of(F.col("name"))))
        .withColumn("is_archive", is_archive(F.col("name")))
        .withColumn("archive_name", F.nullif(given("archive_name", "string"), F.lit("")))
    )
