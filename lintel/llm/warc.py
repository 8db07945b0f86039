"""WARC revisits of "not modified" answers, resolved against the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import PRIVATE, checkpointed

P = PRIVATE
#: Headers that a 304 answer may carry and that replace the stored response's (RFC 9111, 3.2 and 4.3.4).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url):
    """Scheme, `www.`, default port, fragment, tracking parameters, trailing slashes and the host's case do not tell URLs apart."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i:https?)://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*(.*)$", 1), r"(?<=[?&])(utm_[^=&]*|ref|fbclid|gclid)=[^&]*(&|$)", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/+$", ""))


def lower_names(headers):
    """Headers by lower-case name, as names differ by case in the wild only; of names that are then equal the last in byte order counts, as a map has no order. Null: none."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"), e.key.alias("name")))
    kept = F.filter(pairs, lambda e: ~F.exists(pairs, lambda x: (x["key"] == e["key"]) & (x["name"] > e["name"])))
    return F.coalesce(F.map_from_entries(F.transform(kept, lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, ranges: int | None = None, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Each revisit of `records` with what it resolves to.

    records: record_id BIGINT, ts TIMESTAMP, url STRING, kind STRING ('response' or 'revisit'),
    status INT, headers MAP<STRING, STRING> (names of any case), digest STRING; other columns are
    ignored. A full response is one of kind 'response' and status 200.

    Result, a row for each record of kind 'revisit': record_id, url_key, refers_to (the full
    response's record_id), digest (its payload), headers (by lower-case name; of the full response,
    the permitted ones replaced by the revisit's), outcome:

    - 'resolved': the validators that both carry agree, and there is one;
    - 'unvalidated': there is an earlier response, but no validator that both carry;
    - 'mismatch': a validator (etag, by weak comparison; last-modified) differs: refers_to stays, headers and digest are null;
    - 'orphan': no earlier full response, or url or ts is null.

    "Earlier" is by (ts, record_id); a response at the revisit's very ts is earlier if its
    record_id is smaller. Of repeated rows (the same record_id) each gives a row. Null headers
    count as none, and a validator that is null as none. An empty url is one like any other; an
    empty table gives an empty one.

    Captures are range-sorted by URL, time and record, so that a URL with most of all rows is many
    tasks' work. Each range is searched alone; what a URL's last response is where a range ends is
    carried to the next ranges by a table of one row a range.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    r = records.where(F.col("kind").isin("response", "revisit") & (full | (F.col("kind") == "revisit"))).select(
        "record_id", "ts", canonical_url(F.col("url")).alias("url_key"), "kind", lower_names(F.col("headers")).alias("headers"), "digest"
    )
    dated = r.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    order = [F.col("ts"), F.col("record_id").asc_nulls_first()]
    sorted_ = dated.repartitionByRange(ranges or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url_key", *order)
    # A row of a range is known by where it is; the ranges stay as they are once they are written.
    sorted_ = checkpointed(sorted_.withColumn("part", F.spark_partition_id()))
    answer = F.struct("record_id", "digest", "headers")
    before = Window.partitionBy("part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = sorted_.withColumn("got", F.last(F.when(F.col("kind") == "response", answer), ignorenulls=True).over(before)).where("kind = 'revisit'")
    # Of each range its last URL's last response, if it has one, and its first URL: what came before it, ranges back, ends there.
    ends = sorted_.groupBy("part").agg(F.max("url_key").alias("u"), F.min("url_key").alias("first"))
    at_end = F.broadcast(ends)  # a row a range
    last = sorted_.where("kind = 'response'").join(at_end.select(F.col("part").alias("e"), "u"), (F.col("part") == F.col("e")) & (F.col("url_key") == F.col("u"))).groupBy("part").agg(F.max_by(answer, F.struct("ts", "record_id")).alias("last"))
    ends = checkpointed(ends.join(last, "part", "left"))
    asked = ends.select("part", F.col("first").alias("u"), F.lit(None).cast(last.schema["last"].dataType).alias("last"), F.lit(0).alias("asks"))
    # In order of range, a range's question comes before its own answer.
    chain = Window.partitionBy("u").orderBy("part", "asks").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "u", "last", F.lit(1).alias("asks")).unionByName(asked).withColumn("before", F.last("last", ignorenulls=True).over(chain))
    carried = carried.where("asks = 0 and before is not null").select(F.col("part").alias(f"{P}p"), F.col("u").alias(f"{P}u"), "before")
    found = inside.join(carried, (F.col("part") == F.col(f"{P}p")) & (F.col("url_key") == F.col(f"{P}u")) & F.col("got").isNull(), "left")
    found = found.select("record_id", "url_key", "headers", F.coalesce("got", "before").alias("to"))
    undated = r.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("ts").isNull())).select("record_id", "url_key", "headers", F.lit(None).cast(last.schema["last"].dataType).alias("to"))

    def compared(name: str, value):
        mine, theirs = value(F.col("headers")[name]), value(F.col("to.headers")[name])
        return F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs)

    etag = compared("etag", lambda v: F.regexp_replace(F.trim(v), r"^W/", ""))
    date = compared("last-modified", F.trim)
    outcome = (
        F.when(F.col("to").isNull(), "orphan")
        .when(~F.coalesce(etag, F.lit(True)) | ~F.coalesce(date, F.lit(True)), "mismatch")
        .when(etag.isNull() & date.isNull(), "unvalidated")
        .otherwise("resolved")
    )
    merged = F.map_concat(
        F.map_filter("to.headers", lambda k, _: ~(k.isin(*permitted) & F.map_contains_key("headers", k))),
        F.map_filter("headers", lambda k, _: k.isin(*permitted)),
    )
    good = F.col("outcome").isin("resolved", "unvalidated")
    return (
        found.unionByName(undated)
        .withColumn("outcome", outcome)
        .select("record_id", "url_key", F.col("to.record_id").alias("refers_to"), F.when(good, F.col("to.digest")).alias("digest"), F.when(good, merged).alias("headers"), "outcome")
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log made of `pages`: each page is a full response of its URL, and is asked for again later with its validators.

    Page n is answered in full at second 600 n and not modified a day and a half later. Of every 5
    pages one is asked for with an outdated etag; of every 7 one answers without validators; of
    every 11 one is not modified an hour before it was first seen. Header names differ in case.
    """
    n = F.col("page_id")
    etag, moment = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')), F.col("page_id") * 600
    stored = F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.when(n % 7 == 0, F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"))).otherwise(
        F.create_map(F.lit("Etag"), F.when(n % 5 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), etag)), F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"))
    )
    later = moment + F.when(n % 11 == 0, -3600).otherwise(129600)
    first = F.struct((n * 2).alias("record_id"), F.timestamp_seconds(moment).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), stored.alias("headers"), F.md5("html").alias("digest"))
    second = F.struct((n * 2 + 1).alias("record_id"), F.timestamp_seconds(later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return pages.select("url", F.explode(F.array(first, second)).alias("r")).select("url", "r.*")


def op4_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Headers as `name: value` lines in order of name; refers_to is -1 for an orphan."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value))), "\n")
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumn("headers", lines)
    return out.withColumn("refers_to", F.coalesce("refers_to", F.lit(-1)))


OP4_SQL = r"""
WITH p AS (SELECT page_id n, url, html, md5(html) d,
  regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^(?i:https?)://', '') u FROM pages),
k AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') h,
  regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(utm_[^=&]*|ref|fbclid|gclid)=[^&]*(&|$)', '\1', 'g'), '[?&]+$', '') r FROM p),
c AS (SELECT n, h || regexp_replace(r, '/+$', '') url_key, d, '"' || substr(d, 1, 16) || '"' tag, strlen(html) size FROM k),
f AS (SELECT 2 * n record_id, 600 * n ts, url_key, d, tag, size FROM c),
v AS (SELECT 2 * n + 1 record_id, 600 * n + CASE WHEN n % 11 = 0 THEN -3600 ELSE 129600 END ts, url_key, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '"old"' ELSE tag END tag FROM c),
m AS (SELECT v.record_id, v.url_key, f.record_id refers_to, f.d, f.size, v.tag vtag, f.tag ftag,
  row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) k
  FROM v LEFT JOIN f ON v.url_key = f.url_key AND (f.ts < v.ts OR f.ts = v.ts AND f.record_id < v.record_id)),
o AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'orphan' WHEN vtag <> ftag THEN 'mismatch' WHEN vtag IS NULL THEN 'unvalidated' ELSE 'resolved' END outcome FROM m WHERE k = 1)
SELECT record_id, url_key, coalesce(refers_to, -1) AS refers_to, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN d END digest,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN vtag IS NULL THEN ftag ELSE 'W/' || vtag END END headers
FROM o
"""
