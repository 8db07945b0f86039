"""Aggregates of the messages table: what the reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import messages as m
from lintel.functions import names

MAX_SHOWN = 5


def _named(messages: DataFrame) -> DataFrame:
    return messages.withColumn("test_name", F.coalesce(F.nullif("test_name", F.lit("")), F.lit("Unknown")))


def scanned(messages: DataFrame) -> DataFrame:
    """(filename, checkname, issue_count): findings of files, by subject and check; files without findings are not there."""
    rows = _named(messages).where("source_kind = 'file'")
    return rows.groupBy(m.subject_key().alias("filename"), F.col("test_name").alias("checkname")).agg(F.count(F.lit(1)).alias("issue_count"))


def by_subject(messages: DataFrame) -> DataFrame:
    """(subject, path, archive_name, issues): for each subject its findings in order; the path is that of the last."""
    rows = _named(messages).withColumn("__s", m.subject_key())
    shown = F.when(F.col("source_kind") == "file", m.shown_name()).otherwise("repository")
    own = F.max_by(F.struct(shown.alias("subject"), F.coalesce("path", F.lit("")).alias("path"), F.nullif("archive_name", F.lit("")).alias("archive_name")), "ord")
    issues = F.array_sort(F.collect_list(F.struct("ord", F.col("test_name").alias("checkname"), F.col("content").alias("message"))))
    grouped = rows.groupBy("__s").agg(own.alias("own"), issues.alias("i"))
    return grouped.select("own.*", F.transform("i", lambda x: F.struct(x.checkname.alias("checkname"), x.message.alias("message"))).alias("issues"))


def by_check(messages: DataFrame) -> DataFrame:
    """(checkname, issues): for each check its findings, in order."""
    shown = F.when(F.col("source_kind") == "file", m.shown_name()).otherwise("repository")
    issue = F.struct("ord", shown.alias("subject"), F.coalesce("path", F.lit("")).alias("path"), F.nullif("archive_name", F.lit("")).alias("archive_name"), F.col("content").alias("message"))
    grouped = _named(messages).groupBy(F.col("test_name").alias("checkname")).agg(F.array_sort(F.collect_list(issue)).alias("i"))
    return grouped.select("checkname", F.transform("i", lambda x: F.struct(x.subject.alias("subject"), x.path.alias("path"), x.archive_name.alias("archive_name"), x.message.alias("message"))).alias("issues"))


def issue_rows(messages: DataFrame) -> DataFrame:
    """(checkname, subject, path, archive_name, message), a row a finding, sorted by check and order: what by_check gathers, for readers that take rows one by one."""
    shown = F.when(F.col("source_kind") == "file", m.shown_name()).otherwise("repository")
    rows = _named(messages).orderBy("test_name", "ord")
    return rows.select(F.col("test_name").alias("checkname"), shown.alias("subject"), F.coalesce("path", F.lit("")).alias("path"), F.nullif("archive_name", F.lit("")).alias("archive_name"), F.col("content").alias("message"))


def first_subject(messages: DataFrame) -> DataFrame:
    """(subject): that of the first finding, which viewers begin with; no row without findings."""
    return messages.orderBy("ord").limit(1).select(m.subject_key().alias("subject"))


def totals(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: total_issues, files_with_issues (the package counts as one if it has any), total_files."""
    keyed = messages.agg(F.count(F.lit(1)).alias("total_issues"), F.count_distinct(m.subject_key()).alias("files_with_issues"))
    if files is None:
        return keyed
    return keyed.crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("total_files"))))


def subject_details(messages: DataFrame, keys: DataFrame, key: str = "subject") -> DataFrame:
    """keys with what the last finding of their subject says: (key, test_name, content), nulls where the subject has none. Of a key's findings the last counts."""
    last = _named(messages).groupBy(m.subject_key().alias("__s")).agg(F.max_by(F.struct("test_name", "content"), "ord").alias("__d"))
    return keys.join(last, F.col(key) == F.col("__s"), "left").select(F.col(key), F.col("__d.test_name").alias("test_name"), F.col("__d.content").alias("content"))


def check_counts(messages: DataFrame) -> DataFrame:
    return _named(messages).groupBy(F.col("test_name").alias("checkname")).agg(F.count(F.lit(1)).alias("issue_count"))


def summary_totals(messages: DataFrame) -> DataFrame:
    """One row: total issues, and distinct subjects whatever archive they are in."""
    shown = F.when(F.col("source_kind") == "file", m.shown_name()).otherwise("repository")
    return messages.agg(F.count(F.lit(1)).alias("total_issues"), F.count_distinct(shown).alias("subjects"))


def pdf_files(files: DataFrame) -> DataFrame:
    """(entry): PDF files, those in archives with the archive's name before."""
    note = F.coalesce(F.concat(F.nullif("archive_name", F.lit("")), F.lit(" -> ")), F.lit(""))
    return files.where(names.is_pdf(F.col("name"), F.col("suffix"))).select(F.concat(note, F.col("name")).alias("entry"))


def progress_total(files: DataFrame, by_file: int = 6, by_archive: int = 4, by_repository: int = 2) -> DataFrame:
    """One row: how many evaluations of checks a scan is made of."""
    n = F.count(F.lit(1)) * by_file + F.count(F.when(F.col("is_archive"), 1)) * by_archive + by_repository
    return files.agg(n.alias("total"))


def truncate_by_type(messages: DataFrame, most: int) -> DataFrame:
    """messages with at most `most` rows of each type: of larger groups the first most - 1, in order, and a row that says how many more.

    most <= 0 leaves all.
    """
    if most <= 0:
        return messages
    rows = messages.withColumn("__type", m.message_type(F.col("content")))
    counts = rows.groupBy(F.col("__type").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    # A pure bound on the rank: each task keeps `most` rows a type before any is shuffled.
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__type").orderBy("ord"))).where(F.col("__k") <= most)
    first = first.join(counts, F.col("__type") == F.col("__t"))
    kept = first.where((F.col("__n") <= most) | (F.col("__k") < most))
    more = first.where((F.col("__n") > most) & (F.col("__k") == 1)).withColumn("content", F.concat(F.lit("... and "), (F.col("__n") - (most - 1)).cast("string"), F.lit(" more similar messages (truncated)")))
    return kept.unionByName(more).select(*messages.columns)


def summary_lines(messages: DataFrame, most: int = MAX_SHOWN) -> DataFrame:
    """(checkname, place, line): what a summary lists of each check, in the order of `place`.

    Up to `most` findings of a check are all listed. Otherwise they are grouped by parent folder
    and message; of groups of more than `most` the first ones are listed and one line counts the
    rest. Groups come in the order of their first finding.
    """
    subject = F.when(F.col("source_kind") == "file", m.shown_name()).otherwise("repository")
    full = F.coalesce(F.concat(F.nullif("archive_name", F.lit("")), F.lit(" -> "), subject), subject)
    rows = _named(messages).select("ord", F.col("test_name").alias("checkname"), m.parent_path(full).alias("parent"), m.message_key(F.col("content")).alias("key"), m.issue_line(subject, F.col("archive_name"), F.col("content")).alias("line"))
    group = ["checkname", "parent", "key"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    all_ = groups.groupBy(F.col("checkname").alias("__c")).agg(F.sum("n").alias("all"))
    groups = groups.join(F.broadcast(all_), F.col("checkname") == F.col("__c")).select(*[F.col(c).alias(f"__{c}") for c in group], "n", "first", "all")  # a row a check
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("ord"))).where(F.col("k") <= most)
    rows = rows.join(groups, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
    short = F.col("all") <= most
    place = lambda k: F.when(short, F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.col("first").alias("a"), k.alias("b")))
    shown = rows.where(short | (F.col("n") <= most) | (F.col("k") <= most)).select("checkname", place(F.col("k")).alias("place"), "line")
    rest = rows.where(~short & (F.col("n") > most) & (F.col("k") == 1))
    rest = rest.select("checkname", place(F.col("n").cast("int")).alias("place"), F.concat(F.lit("  ... and "), (F.col("n") - most).cast("string"), F.lit(" more in "), m.group_title(F.col("parent"), F.col("key"))).alias("line"))
    return shown.unionByName(rest)
