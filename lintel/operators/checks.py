"""Checks of files: registries of named checks, and plans that evaluate them in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.config import Config
from lintel.functions import names, text
from lintel.operators.filters import wanted

#: A check of names: the findings' texts, as an array.
NameCheck = Callable[[Column, Config], Column]


def _single(found: Column) -> Column:
    return F.array_compact(F.array(found))


def _invalid(name: Column, config: Config) -> Column:
    return names.invalid_names(name, [d for s in config.test("IsValidName").arguments for d in s.disallowed_names])


NAME_CHECKS: dict[str, NameCheck] = {
    "HasOnlyASCII": lambda n, _: _single(names.non_ascii(n)),
    "HasNoWhiteSpace": lambda n, _: _single(names.white_space(n)),
    "HasFileNameSpecialChars": lambda n, _: _single(names.special_characters(n)),
    "IsFileNameTooLong": lambda n, _: _single(names.too_long(n)),
    "IsValidName": _invalid,
}
#: The registries, which scans go by: checks of files, of archives' lists of members, of members' contents, and of packages.
#: A check of names is also in NAME_CHECKS; one of contents of files or members, or of packages, in the table of its kind
#: (lintel.plans.scan.CONTENT_CHECKS, MEMBER_CHECKS and REPOSITORY_CHECKS). To add one, put it there and its name here.
BY_FILE = ["HasOnlyASCII", "HasNoWhiteSpace", "IsFreeOfKeywords", "IsValidName", "HasFileNameSpecialChars", "IsFileNameTooLong"]
BY_MEMBER_NAME = ["HasOnlyASCII", "HasNoWhiteSpace", "IsValidName"]
BY_MEMBER_CONTENT = ["IsArchiveFreeOfKeywords"]
BY_REPOSITORY = ["HasReadme", "ReadMeContainsTOC"]

_SOURCE = ("path", "name", "display_name", "archive_name")


def as_messages(df: DataFrame) -> DataFrame:
    """Rows with test_name, content and a file's columns as messages."""
    return df.select("test_name", "content", F.lit("file").alias("source_kind"), *_SOURCE)


def _labelled(check: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(check).alias("test_name"), x.alias("content"))


def _one_by_one(info: str) -> Callable[[Column], Column]:
    return lambda k: F.concat(F.lit(info + " '"), k, F.lit("'"))


def name_messages(files: DataFrame, config: Config, checks: Iterable[str] = tuple(NAME_CHECKS)) -> DataFrame:
    """All name checks in one pass: an array of findings a row, then exploded; each check sees the names that its section admits."""
    found = [F.array().cast("array<struct<test_name:string,content:string>>")]
    for c in checks:
        hits = F.transform(NAME_CHECKS[c](F.col("name"), config), _labelled(c))
        found.append(F.when(wanted(config, c, F.col("name")), hits).otherwise(F.slice(hits, 1, 0)))
    return as_messages(files.select(*_SOURCE, F.inline(F.concat(*found))))


def _info(info: str, found: Column) -> Column:
    return F.concat(F.lit(info + " "), text.listed(found))


def keyword_findings(content: Column, size: Column, config: Config, check: str = "IsFreeOfKeywords") -> Column:
    """Findings in a text: for each set of keywords one with all of them as the text spells them; in a large text
    (over 1 MiB) one for each keyword as it is configured."""
    small, large = [], []
    for s in config.test(check).arguments:
        got = text.matched(content, s.keywords)
        small.append(F.when(F.size(got) > 0, _info(s.info, got)))
        large.append(F.transform(text.matched_configured(content, s.keywords), _one_by_one(s.info)))
    if not small:
        return F.array().cast("array<string>")
    return F.when(size > config.general.large_text_bytes, F.concat(*large)).otherwise(F.array_compact(F.array(*small)))


def keyword_messages(files: DataFrame, config: Config, check: str = "IsFreeOfKeywords") -> DataFrame:
    """files with a column `text`; sizes are those of the column `size`."""
    admitted = files.where(wanted(config, check, F.col("name")) & (F.col("size") <= config.general.max_content_scan_file_size))
    rows = admitted.select(*_SOURCE, F.explode(keyword_findings(F.col("text"), F.col("size"), config, check)).alias("content"))
    return as_messages(rows.withColumn("test_name", F.lit(check)))


def chunk_messages(chunks: DataFrame, config: Config, check: str = "IsFreeOfKeywords") -> DataFrame:
    """Findings in large texts that come in overlapping chunks (lintel.sources.local.text_chunks): for each keyword, as configured, one a file, however many chunks have it."""
    large = F.lit(config.general.large_text_bytes + 1)
    rows = chunks.where("error is null").where(wanted(config, check, F.col("name"))).select(*_SOURCE, F.explode(keyword_findings(text.as_text(F.col("content")), large, config, check)).alias("content")).distinct()
    return as_messages(rows.withColumn("test_name", F.lit(check)))


def large_file_warnings(files: DataFrame, limit: int, message: str) -> DataFrame:
    """(message): a warning for each file of more than `limit` bytes."""
    return files.where(F.col("size") > limit).select(F.concat(F.lit("Warning for file '"), F.col("name"), F.lit(f"': {message}")).alias("message"))


def blob_messages(bodies: DataFrame, config: Config, check: str = "IsFreeOfKeywords") -> DataFrame:
    """Findings in the blobs of office files: rows of a file's columns, idx and content; one for each blob and set of keywords."""
    found = []
    for s in config.test(check).arguments:
        got = text.matched(F.col("content"), s.keywords)
        found.append(F.when(F.size(got) > 0, F.concat(_info(s.info, got), F.lit(" in sheet/paragraph/table "), F.col("idx").cast("string"))))
    hits = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    rows = bodies.where(wanted(config, check, F.col("name"))).select(*_SOURCE, F.explode(hits).alias("finding"))
    return as_messages(rows.select(*_SOURCE, F.col("finding").alias("content"), F.lit(check).alias("test_name")))
