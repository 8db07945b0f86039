"""URL filter by link-graph propagation: trust from trusted hosts along links, distrust from blocked hosts against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_BYTES, PRIVATE, checkpointed, sized

DAMPING = 0.85
#: A round that moves less than this of the ranks, whose sum is 1, is the last one.
TOLERANCE = 1e-6
#: A host is dropped if its distrust is at least this much of trust and distrust together.
THRESHOLD = 0.5
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?([^\"'\s>]*)"
TRUSTED = r"^blog\.|\.example\.org$"
BLOCKED = r"(^|[.-])(ads?|bets?|casino|porn|spam|track(er)?)([.-]|\d|$)"


def host_of(url):
    """The lower-case host of an absolute or scheme-relative URL, without port and user; null if there is none."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(h != "", h)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): how many pages of host src refer to host dst.

    A page refers to the hosts of its href and src attributes (a relative one is its own host). A
    page counts once for each dst. Pages without a host, and null or empty html, give nothing.
    """
    targets = F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda t: F.coalesce(host_of(t), F.col("src")))
    rows = pages.select(host_of(F.col(url)).alias("src"), F.coalesce(F.col(html), F.lit("")).alias(html)).where("src is not null")
    return rows.select("src", F.explode(F.array_distinct(targets)).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def walks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(walk, host, rank): the personalised PageRanks of several walks at once; hosts with rank 0 are not there.

    edges: (walk, src, dst, weight), weights over 0; seeds: (walk, host). A walk follows weighted
    edges, and starts again evenly from its seeds, after a step by chance (1 - damping) or where a
    host has no edges out. A walk without seeds has no ranks.

    The ranks are r = c * (y0 + y1 + ...): y0 is even over the seeds, each further y is what the
    one before sends along the edges, damped, and c makes their sum 1. (What does not move on goes
    back to the seeds, so the limit of the power iteration is this series.) A round adds one y. They
    go on until a y sums to less than `tolerance` over all walks and reaches no new host: where all
    walks end they end with the longest, else a y falls by damping at least, and what is left off
    is below tolerance * damping / (1 - damping). The table of hosts is shuffled by host in each
    round, unless it is measured to be small; the edges are shuffled once each round only then;
    lineage is cut every round.
    """
    seeds = checkpointed(seeds.select("walk", "host").where("host is not null").distinct())
    number = seeds.groupBy("walk").agg(F.count(F.lit(1)).alias("seeds")).withColumnRenamed("walk", "w")
    edges = edges.where("src is not null and dst is not null and weight > 0").groupBy("walk", "src", "dst").agg(F.sum("weight").alias("weight"))
    out = edges.groupBy(F.col("walk").alias("o_walk"), F.col("src").alias("o_src")).agg(F.sum("weight").alias("total"))
    steps = edges.join(out, (F.col("walk") == F.col("o_walk")) & (F.col("src") == F.col("o_src")))
    steps = checkpointed(steps.select(F.col("walk").alias("s_walk"), "src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")))
    state = checkpointed(seeds.join(F.broadcast(number), F.col("walk") == F.col("w")).select("walk", "host", (1.0 / F.col("seeds")).alias("flow"), (1.0 / F.col("seeds")).alias("rank")))
    # Columns are made once, as making them takes longer than a round over few hosts.
    meets, sums = F.expr("s_walk = walk and src = host"), [F.expr(f"sum({c}) AS {c}") for c in ("flow", "rank")]
    totals = [F.expr(x) for x in ("coalesce(sum(flow), 0) AS flow", "count(1) AS hosts", "coalesce(sum(octet_length(host) + 48), 0) AS size")]
    reached = -1
    while True:
        s = state.agg(*totals).first()
        if not s["flow"] or s["flow"] < tolerance and s["hosts"] <= reached:
            break
        reached = s["hosts"]
        side = state.where("flow > 0").select("walk", "host", "flow")
        side = F.broadcast(side) if s["size"] <= BROADCAST_BYTES else side.hint("merge")
        moved = steps.join(side, meets).selectExpr("walk", "dst AS host", "share * flow AS flow", "share * flow AS rank")
        state = checkpointed(moved.union(state.selectExpr("walk", "host", "0D AS flow", "rank")).groupBy("walk", "host").agg(*sums))
    every = state.groupBy(F.col("walk").alias("w")).agg(F.sum("rank").alias("total"))
    return state.join(F.broadcast(every), F.col("walk") == F.col("w")).select("walk", "host", (F.col("rank") / F.col("total")).alias("rank"))  # a row a walk


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) of one walk (see walks); edges: (src, dst, weight), seeds: (host)."""
    one = F.lit(0).alias("walk")
    return walks(edges.select(one, "src", "dst", "weight"), seeds.select(one, "host"), damping, tolerance).select("host", "rank")


def propagate(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, isolated: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust, badness, allowed) for every host of the edges, the seeds and `isolated`, whose hosts need no edges.

    trust: personalised PageRank from the trusted hosts along the edges, without the edges of a
    host to itself; distrust: from the blocked hosts along the reversed edges, so that hosts that
    lead to blocked ones get some. A host of both lists counts as blocked. badness = distrust /
    (trust + distrust), 0 where both are 0; a host is allowed if badness < threshold (at the very
    threshold it is not) and it is not blocked. A null host is none.
    """
    links = checkpointed(edges.select("src", "dst", "weight").where("src is not null and dst is not null"))
    blocked = checkpointed(blocked.select("host").where("host is not null").distinct())
    trusted = checkpointed(trusted.select("host").where("host is not null").distinct().join(blocked, "host", "left_anti"))
    other = links.where("src <> dst")
    both = other.select(F.lit(0).alias("walk"), "src", "dst", "weight").unionByName(other.select(F.lit(1).alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ranks = walks(both, trusted.select(F.lit(0).alias("walk"), "host").unionByName(blocked.select(F.lit(1).alias("walk"), "host")), damping, tolerance)
    hosts = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).unionByName(trusted).unionByName(blocked)
    if isolated is not None:
        hosts = hosts.unionByName(isolated.select("host").where("host is not null"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    of = lambda walk: F.when(F.col("walk") == walk, F.col("rank"))
    scored = ranks.select("host", of(0).alias("t"), of(1).alias("d"), F.lit(0).alias("listed"))
    scored = scored.unionByName(hosts.select("host", none.alias("t"), none.alias("d"), F.lit(0).alias("listed"))).unionByName(blocked.select("host", none.alias("t"), none.alias("d"), F.lit(1).alias("listed")))
    scored = scored.groupBy("host").agg(F.coalesce(F.max("t"), zero).alias("trust"), F.coalesce(F.max("d"), zero).alias("distrust"), F.max("listed").alias("listed"))
    scored = scored.withColumn("badness", F.when(F.col("trust") + F.col("distrust") > 0, F.col("distrust") / (F.col("trust") + F.col("distrust"))).otherwise(zero))
    return scored.select("host", "trust", "distrust", "badness", ((F.col("badness") < threshold) & (F.col("listed") == 0)).alias("allowed"))


def filter_urls(pages: DataFrame, trusted: str = TRUSTED, blocked: str = BLOCKED, url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """pages with trust, distrust, badness and allowed of their hosts in the columns host_trust, host_distrust, host_badness, url_allowed.

    Seeds are the hosts of pages and links that match the patterns. A host that neither links nor
    is linked to is judged like any other. A page without a host (its url is null, empty or
    relative) gets nulls and is not allowed. Null, empty and very long html is read like any other,
    whole. An empty table gives an empty one. Repeated pages each stay, and count as pages. Columns of `pages` with these names are replaced.
    """
    edges = checkpointed(host_edges(pages, url, html))
    own = pages.select(host_of(F.col(url)).alias("host")).where("host is not null")
    hosts = checkpointed(edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(own).distinct())
    scores = checkpointed(propagate(edges, hosts.where(F.col("host").rlike(trusted)), hosts.where(F.col("host").rlike(blocked)), damping, tolerance, threshold, hosts))
    out = ("host_trust", "host_distrust", "host_badness", "url_allowed")
    own = [f"{PRIVATE}{c}" for c in ("host", *out)]
    side = sized(scores.toDF(*own), own[0])
    joined = pages.join(side, host_of(pages[url]) == F.col(own[0]), "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in out]
    return joined.select(*kept, *[F.col(f"{PRIVATE}{c}").alias(c) for c in out[:3]], F.coalesce(f"{PRIVATE}url_allowed", F.lit(False)).alias("url_allowed"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = filter_urls(pages).select("page_id", "url", "host_trust", "host_distrust", "host_badness", "url_allowed")
    return out.select("page_id", "url", *[F.round(c, 9).alias(c) for c in ("host_trust", "host_distrust", "host_badness")], "url_allowed")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP6_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, nullif(lower(regexp_extract(url, {_sql(_HOST)}, 1)), '') AS h FROM pages),
l AS (SELECT h AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, {_sql(_LINK)}, 1), lambda t: coalesce(nullif(lower(regexp_extract(t, {_sql(_HOST)}, 1)), ''), h)))) AS dst FROM p WHERE h IS NOT NULL),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM l GROUP BY src, dst),
hosts AS (SELECT src AS host FROM e UNION SELECT dst FROM e UNION SELECT h FROM p WHERE h IS NOT NULL),
b AS (SELECT host FROM hosts WHERE regexp_matches(host, {_sql(BLOCKED)})),
t AS (SELECT host FROM hosts WHERE regexp_matches(host, {_sql(TRUSTED)}) AND host NOT IN (SELECT host FROM b)),
s AS (SELECT 0 AS walk, src, dst, {DAMPING} * w / sum(w) OVER (PARTITION BY src) AS share FROM e WHERE src <> dst
  UNION ALL SELECT 1, dst, src, {DAMPING} * w / sum(w) OVER (PARTITION BY dst) FROM e WHERE src <> dst),
f AS (SELECT * FROM (SELECT 0 AS k, 0 AS walk, host, 1.0::DOUBLE / (SELECT count(*) FROM t) AS flow FROM t UNION ALL SELECT 0, 1, host, 1.0::DOUBLE / (SELECT count(*) FROM b) FROM b)
  UNION ALL SELECT f.k + 1, f.walk, s.dst, sum(f.flow * s.share) FROM f JOIN s ON f.walk = s.walk AND f.host = s.src WHERE f.k < 200 GROUP BY f.k, f.walk, s.dst),
r AS (SELECT walk, host, sum(flow) / sum(sum(flow)) OVER (PARTITION BY walk) AS rank FROM f GROUP BY walk, host),
g AS (SELECT host, coalesce(a.rank, 0) AS trust, coalesce(c.rank, 0) AS distrust, host IN (SELECT host FROM b) AS listed
  FROM hosts LEFT JOIN (SELECT * FROM r WHERE walk = 0) a USING (host) LEFT JOIN (SELECT * FROM r WHERE walk = 1) c USING (host)),
v AS (SELECT *, CASE WHEN trust + distrust > 0 THEN distrust / (trust + distrust) ELSE 0 END AS badness FROM g)
SELECT page_id, url, round(trust, 9) AS host_trust, round(distrust, 9) AS host_distrust, round(badness, 9) AS host_badness, coalesce(badness < {THRESHOLD} AND NOT listed, false) AS url_allowed
FROM p LEFT JOIN v ON p.h = v.host
"""
