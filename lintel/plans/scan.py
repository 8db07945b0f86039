"""A scan: files in, messages and log out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.config import Config, load
from lintel.functions import names, text
from lintel.operators import archives as arch
from lintel.operators import checks, repository
from lintel.operators.filters import wanted
from lintel.operators.report import pdf_files
from lintel.sources.archive_readers import read_members, read_office
from lintel.sources.local import text_chunks

#: A collector gives a files table with `content`.
Collector = Callable[[SparkSession, Config], DataFrame]


@dataclass(frozen=True)
class Contents:
    """What checks of contents look at: tables of one scan."""

    texts: DataFrame
    chunks: DataFrame | None
    blobs: DataFrame


#: Checks of files' contents, of members' contents and of packages, by the names in lintel.operators.checks' registries.
CONTENT_CHECKS: dict[str, Callable[[Contents, Config], DataFrame]] = {}
MEMBER_CHECKS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"IsArchiveFreeOfKeywords": lambda members, config: arch.member_messages(members, config, unpacked=True)}
REPOSITORY_CHECKS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"HasReadme": lambda package, _: repository.has_readme(package), "ReadMeContainsTOC": lambda package, _: repository.readme_contents(package)}


def _keywords(contents: Contents, config: Config) -> DataFrame:
    out = checks.keyword_messages(contents.texts, config).unionByName(checks.blob_messages(contents.blobs, config))
    return out if contents.chunks is None else out.unionByName(checks.chunk_messages(contents.chunks, config))


CONTENT_CHECKS["IsFreeOfKeywords"] = _keywords


@dataclass(frozen=True)
class ScanResult:
    """Lazy tables of one scan; nothing is kept between scans. log: lintel.model.LOG; skipped and warnings are parts of it."""

    files: DataFrame
    messages: DataFrame
    skipped: DataFrame
    warnings: DataFrame
    pdf_files: DataFrame
    log: DataFrame
    #: (what runs, how many evaluations of checks that is, its messages), in order.
    steps: tuple[tuple[str, Callable[[], int], DataFrame], ...] = ()

    @property
    def errors(self) -> DataFrame:
        return self.log.where("level = 'error'").select("message").distinct()


def _logged(df: DataFrame, level: str, message: Column, reason: str | None = None) -> DataFrame:
    have = set(df.columns)
    own = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    return df.select(F.lit(level).alias("level"), message.alias("message"), own("name"), own("path"), F.lit(reason).cast("string").alias("reason"))


def scan(files: DataFrame, config: Config, across_files: bool = True) -> ScanResult:
    """All checks of the registries over one package.

    files: lintel.model.FILES with `ord` and `content` (null where it is not read) and, where large
    texts are to be read by chunks, `whole` (lintel.sources.local). The order of messages is that of
    the kinds of checks (files, lists of members, members, package), of files and of members.

    Checks of names do not read contents. Archives, office files and texts each read only theirs.
    """
    limit = config.general.max_content_scan_file_size
    readable = files.where("not coalesce(is_dir, false)") if "is_dir" in files.columns else files
    whole = F.coalesce(F.col("whole"), F.lit(False)) if "whole" in files.columns else F.lit(True)
    archive_rows = readable.where(F.col("is_archive"))
    judged = readable.where((F.col("size") <= limit) & F.col("content").isNotNull()).withColumn("__text", text.is_text(F.col("path"), F.col("content")))
    texts = judged.where(F.col("__text") & whole).withColumn("text", text.as_text(F.col("content")))
    chunks = text_chunks(judged.where(F.col("__text") & ~whole)) if "whole" in files.columns else None
    binary = judged.where("not __text")
    office = read_office(binary)
    blobs = office.where("error is null")
    supported = archive_rows.where(names.is_supported_archive(F.col("name")))
    listing = read_members(supported)
    contents = read_members(archive_rows.where(wanted(config, "IsArchiveFreeOfKeywords", F.col("name"))), arch.gate_of(config))

    number = lambda df, n: (lambda: df.count() * n)
    of_names = [c for c in checks.BY_FILE if c in checks.NAME_CHECKS]
    found = Contents(texts, chunks, blobs)
    steps = [("Running file tests...", number(files, len(checks.BY_FILE)), [checks.name_messages(files, config, of_names), *(CONTENT_CHECKS[c](found, config) for c in checks.BY_FILE if c in CONTENT_CHECKS)])]
    steps += [("Running archive file list tests...", number(archive_rows, len(checks.BY_MEMBER_NAME)), [checks.name_messages(arch.listed_files(listing), config, checks.BY_MEMBER_NAME)])]
    steps += [("Running archive content tests...", number(archive_rows, len(checks.BY_MEMBER_CONTENT)), [MEMBER_CHECKS[c](contents, config) for c in checks.BY_MEMBER_CONTENT])]
    if across_files:
        readme, kept = F.coalesce(names.is_readme(F.col("name")), F.lit(False)), ["name", "ord"]
        own = files.where(readme).select(*kept, text.as_text(F.col("content")).alias("text"))  # no other file is read for it
        package = own.unionByName(files.where(~readme).select(*kept, F.lit(None).cast("string").alias("text"))).withColumn("package_id", F.lit(1))
        steps += [("Running repository tests...", lambda: len(checks.BY_REPOSITORY), [REPOSITORY_CHECKS[c](package, config) for c in checks.BY_REPOSITORY])]
    place = ["__kind", F.coalesce("path", F.lit("")), F.coalesce("name", F.lit("")), "test_name", "content"]
    tables = [t.withColumn("__kind", F.lit(k)) for k, (_, _, own) in enumerate(steps) for t in own]
    messages = reduce(DataFrame.unionByName, tables)
    # Range-sorted, numbers that rise with the order: no task sees all findings.
    messages = messages.orderBy(*place).withColumn("ord", F.monotonically_increasing_id()).drop("__kind")

    no_reader = ~(F.endswith("path", F.lit(".xlsx")) | F.endswith("path", F.lit(".docx"))) & ~names.is_supported_archive(F.col("name"))
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    name, path, size = F.col("name"), F.col("path"), F.col("size")
    log = [
        _logged(readable.where(size > limit), "info", q("Skipping content scan of file: '", name, "' (path: '", path, "'). File size (", size, f" bytes) exceeds maximum ({limit} bytes)."), "File too large for content scanning"),
        _logged(binary.where(no_reader & wanted(config, "IsFreeOfKeywords", name)), "info", q("Not checking contents of file: '", name, "' (path: '", path, "'). The file seems to be binary."), "Binary file detected"),
        _logged(archive_rows.where(~names.is_supported_archive(name)), "warning", q("Unsupported archive type: ", name)),
        _logged(contents.where("error is not null"), "warning", F.col("error")),
        _logged(office.where("error is not null"), "warning", F.col("error")),
    ]
    if "whole" in files.columns:
        log.append(_logged(chunks.where("error is not null"), "warning", F.col("error")))
        log.append(_logged(readable.where((size <= limit) & F.col("content").isNull()), "warning", q("Error reading file '", path, "'")))
    log = reduce(DataFrame.unionByName, log)
    skipped = log.where("reason is not null").select(F.col("name").alias("filename"), "path", "reason").distinct()
    everything = files.select("name", "suffix", "archive_name").unionByName(arch.listed_files(listing).select("name", "suffix", "archive_name"))
    warned = log.where("level = 'warning'").select("message").distinct()
    return ScanResult(files, messages, skipped, warned, pdf_files(everything), log, tuple((what, n, reduce(DataFrame.unionByName, own)) for what, n, own in steps))


def with_progress(result: ScanResult, report: Callable[[int, int, str], None]) -> int:
    """Evaluate a scan's checks kind by kind, and tell how many of all evaluations are done; the number of findings."""
    sizes = [n() for _, n, _ in result.steps]
    done, findings = 0, 0
    for (what, _, messages), n in zip(result.steps, sizes, strict=True):
        report(done, sum(sizes), what)
        findings += messages.count()
        done += n
    report(done, sum(sizes), "Finalizing results...")
    return findings


def scan_with(spark: SparkSession, config: Config | str, collector: Collector, across_files: bool = True) -> ScanResult:
    """A scan of what a collector gives. A configuration that cannot be read raises."""
    settings = load(config) if isinstance(config, str) else config
    return scan(collector(spark, settings), settings, across_files)
