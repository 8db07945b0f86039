"""Line dedup by site-relative frequency: a line found on too large a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import PRIVATE, checkpointed, sized

RATIO = 0.1
#: A line that no other page of its host has is no boilerplate, however few pages the host has.
MIN_PAGES = 2
#: What is cut off both ends of a line before it is compared: all white space of Unicode, carriage returns and tabs included.
WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
P = PRIVATE


def _trimmed(line):
    return F.btrim(line, F.lit(WHITE))


def _hashes(line):
    """128 bits of a line; lines are compared by them."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("lintel"), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, a, b, pages, total): lines, as 128-bit hashes, on more than `ratio` of their host's pages.

    A page is a row. A line counts once a page however often it is there; lines are trimmed of
    white space (WHITE), and blank ones do not count. A line of a single page is not repeated: it
    stays even where that page is more than `ratio` of a small host (min_pages). The host null is
    a host like any other. There are at most (lines a page) / ratio such lines a host, however
    large the host is.
    """
    rows = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _trimmed)).alias("lines"))
    marked = rows.select("host", F.explode(F.filter("lines", lambda x: x != "")).alias("line")).select("host", _hashes(F.col("line")).alias("h"))
    counts = marked.groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("t_host")).agg(F.count(F.lit(1)).alias("total"))
    at = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host")))
    return at.where(F.col("pages") > F.lit(float(ratio)) * F.col("total")).select("host", "h.a", "h.b", "pages", "total")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", n_chars: str | None = "n_chars", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs, its columns as they are, with boilerplate lines cut from `text` (and `n_chars`, if it is a column, set to the new length).

    All rows stay, repeated ones too (each is a page); a text whose lines are all boilerplate becomes empty. A null
    text stays null. The order of the remaining lines and blank lines do not change. An empty
    table gives an empty one. Each host's boilerplate lines are gathered into one array, joined to
    its rows by broadcast if they are measured to be small, else by a sort-merge join.
    """
    lines = boilerplate(docs, host, text, ratio, min_pages)
    lists = checkpointed(lines.groupBy(F.col("host").alias(f"{P}host")).agg(F.collect_set(F.struct("a", "b")).alias(f"{P}cut"), F.sum(F.lit(24)).alias(f"{P}bytes")))
    weight = lists.agg(F.coalesce(F.sum(f"{P}bytes"), F.lit(0)).alias("n")).first()["n"]
    side = lists.select(f"{P}host", f"{P}cut")
    side = sized(side) if weight <= 16 << 20 else side.hint("merge")
    joined = docs.join(side, docs[host].eqNullSafe(F.col(f"{P}host")), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x: (_trimmed(x) == "") | ~F.array_contains(f"{P}cut", _hashes(_trimmed(x))))
    new = F.when(F.col(f"{P}cut").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn(text, new)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WHITE = " || ".join(f"chr({ord(c)})" for c in WHITE)
OP7_SQL = f"""
WITH l AS (SELECT doc_id, source, trim(line, {_WHITE}) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
c AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT c.source, list(c.line) AS cut FROM c JOIN t USING (source) WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total GROUP BY c.source),
o AS (SELECT d.doc_id, CASE WHEN b.cut IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: trim(x, {_WHITE}) = '' OR NOT list_contains(b.cut, trim(x, {_WHITE}))), chr(10)) END AS text, d.lang, d.source
FROM documents d LEFT JOIN b USING (source))
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM o
"""
