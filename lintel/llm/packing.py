"""Best-fit packing in supersteps: documents and gaps are range-sorted together, matched by successor sweeps, and gaps updated."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import checkpointed, ship

#: Bytes of a training sequence.
CAPACITY = 8192
_ITEMS = "size long, gap boolean, bin string, doc_id long, occurrence long, piece int"
_NAMES = ["size", "gap", "bin", "doc_id", "occurrence", "piece"]
#: Rows of a range, about, and ranges at most (a row of each goes to the driver).
_RANGE_ROWS = 1 << 14
_MOST_RANGES = 1 << 13
#: Rows of one id and size that are told apart together.
_ALIKE = 1 << 20


def pieces(docs: DataFrame, doc_id: str = "doc_id", size=None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, occurrence, piece, start, size): each row's text cut into pieces of `capacity`, the last one smaller.

    size is a column expression, by default the text's UTF-8 bytes. occurrence tells rows apart
    that repeat a doc_id: 1, 2, ... by size. A null or zero size gives one piece of size 0.
    """
    n = F.octet_length("text") if size is None else size
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    # Rows of one id and size are alike: they are counted, which takes a hot id (null, say) to one row a size before it is shuffled by id.
    rows = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("before", F.sum("c").over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(_ALIKE).cast("long")))).hint("rebalance", "doc_id", "n", "k")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.col("before") + F.col("k") + 1, F.col("before") + F.least(F.col("k") + _ALIKE, F.col("c")))).alias("occurrence"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")
    rows = rows.select("doc_id", "occurrence", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return rows.select("doc_id", "occurrence", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("size"))


def _name(b: str = ""):
    return F.concat_ws(":", F.coalesce(F.col(f"{b}doc_id").cast("string"), F.lit("null")), f"{b}occurrence", f"{b}piece")


def _sweep(batches, capacity: int | None = None):
    """Best fit decreasing within one range: rows come by size downwards, gaps before documents of their size.

    A document takes the smallest gap that holds it; what remains of the gap is a gap again, for
    this range's smaller documents too. Given a capacity, a document that no gap holds opens a bin;
    else it waits. Out: what was placed, what waits, what gaps are left and how the left gaps rank
    within the range, upwards. A rest that is smaller than the range's last row might not hold a
    later range's document: it has no rank and waits for the next superstep.

    The rows stay in their columns; a gap is one number, its size and then its row.
    """
    task = TaskContext.get().partitionId()
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    rows = pa.Table.from_batches(own).combine_chunks()
    gaps = array("q")
    waiting, placed, places = array("i"), array("i"), array("i")
    n = 0
    for k, (n, gap) in enumerate(zip(rows.column(0).to_numpy().tolist(), rows.column(1).to_numpy().tolist(), strict=True)):
        if gap:
            insort(gaps, n << 32 | k)
            continue
        at = bisect_left(gaps, n << 32)
        if at < len(gaps):
            room, where = divmod(gaps.pop(at), 1 << 32)
        elif capacity is None:
            waiting.append(k)
            continue
        else:
            room, where = capacity, k
        placed.append(k)
        places.append(where)
        if room > n:
            insort(gaps, (room - n) << 32 | where)

    def batch(what: str, part: pa.Table, rank: np.ndarray, **changed):
        for b in part.to_batches():
            columns = [changed.get(c, b.column(c)) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([what] * b.num_rows, pa.string()), pa.array(rank), pa.array(np.full(b.num_rows, task, np.int32))], names=[*_NAMES, "what", "rank", "task"])

    left, small = np.frombuffer(gaps, np.int64), bisect_left(gaps, n << 32)
    took, wait = np.frombuffer(placed, np.int32), np.frombuffer(waiting, np.int32)
    zeros = np.zeros(max(len(took), len(wait), small), np.int64)
    yield from batch("placed", rows.take(pa.array(took)).combine_chunks(), zeros[: len(took)], bin=rows.column("bin").take(pa.array(np.frombuffer(places, np.int32))).combine_chunks())
    yield from batch("doc", rows.take(pa.array(wait)).combine_chunks(), zeros[: len(wait)])
    for what, part, rank in (("rest", left[:small], zeros[:small]), ("gap", left[small:], np.arange(len(left) - small))):
        own = rows.take(pa.array(part & 0xFFFFFFFF)).combine_chunks()
        blank = {c: pa.nulls(len(part), t) for c, t in (("doc_id", pa.int64()), ("occurrence", pa.int64()), ("piece", pa.int32()))}
        yield from batch(what, own, rank, size=pa.array(part >> 32), gap=pa.array(np.ones(len(part), bool)), **blank)


def _allot(counts: dict[int, tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (task of gaps, first rank, number, task of documents): which larger ranges' gaps go to a range whose documents wait.

    Ranges come from the largest sizes down, so that all gaps of earlier ranges hold the documents
    of later ones. A range takes the smallest gaps of the nearest range, as many as its documents
    need if each gap holds a whole number of documents of mean size, then those of the next; what
    they leave of a gap is for smaller documents, a superstep later. Each gap is given once, to the
    range of larger documents first. counts: task to (waiting documents, their size, number of
    gaps, their size); one entry a range.
    """
    runs, stack = [], []
    for task in sorted(counts):
        docs, size, gaps, room = counts[task]
        mean = size / max(1, docs)
        while docs > 0 and stack:
            other, first, left, each = stack.pop()
            holds = max(1, int(each // mean))
            k = min(left, -(-docs // holds))
            runs.append((other, first, k, task))
            docs -= k * holds
            if left > k:
                stack.append((other, first + k, left - k, each))
        if gaps:
            stack.append((task, 0, gaps, room / gaps))
    return runs


def pack(docs: DataFrame, doc_id: str = "doc_id", size=None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, occurrence, piece, start, size, bin): where each piece of each document goes; no bin holds more than `capacity`.

    Pieces of size 0 (null and empty texts) take no room and get bin null. A full piece is a bin by
    itself. The others are packed in supersteps, until none waits:

    1. If waiting documents exceed the gaps' room, the largest open bins for the excess: each opens
       one, and its rest is a gap. Where fragments hold up the rest (a superstep placed less than a
       tenth of what waited), bins for all that wait are opened. Documents over half of the
       capacity all open bins at the start, as no two share one; their gaps are swept before any
       other document opens one.
    2. Documents and gaps are range-sorted by size, and each range swept (`_sweep`).
    3. Documents whose successor gap lies in a larger range get gaps of it, by rank (`_allot`,
       which sees four numbers a range), and are swept against them; gaps are updated.

    What one range holds is swept to the end: who finds no gap opens a bin. So a small table is
    packed by best fit decreasing; of a larger one the last superstep is. Ranges have some
    _RANGE_ROWS rows, more where there would be over _MOST_RANGES of them.

    Gaps smaller than the smallest waiting document are closed. Bins are named by the piece that
    opens them, "doc_id:occurrence:piece". Ties go by doc_id, occurrence and piece. Rows that
    repeat a doc_id are told apart by occurrence, null ids too; other columns are ignored. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    every = checkpointed(pieces(docs, doc_id, size, capacity))
    none = F.lit(None)
    blank = [none.cast("long").alias("doc_id"), none.cast("long").alias("occurrence"), none.cast("int").alias("piece")]
    at_once = every.select("size", F.when(F.col("size") == 0, none.cast("string")).otherwise(_name()).alias("bin"), "doc_id", "occurrence", "piece").where(f"size = 0 or 2 * size > {capacity}")
    done = [at_once.select("doc_id", "occurrence", "piece", "size", "bin")]
    docs_left = every.where(f"size > 0 and 2 * size <= {capacity}").select("size", F.lit(False).alias("gap"), _name().alias("bin"), "doc_id", "occurrence", "piece")
    gaps_left = at_once.where(f"size > 0 and size < {capacity}").select((F.lit(capacity) - F.col("size")).alias("size"), F.lit(True).alias("gap"), "bin", *blank)
    items = checkpointed(docs_left.unionByName(gaps_left))
    order = (F.col("size").desc(), F.col("gap").desc(), F.col("doc_id").asc_nulls_first(), "occurrence", "piece", "bin")
    out = _ITEMS + ", what string, rank long, task int"
    before, first = None, True
    while True:
        s = items.groupBy().agg(
            F.count(F.when(~F.col("gap"), 1)).alias("docs"), F.coalesce(F.sum(F.when(~F.col("gap"), F.col("size"))), F.lit(0)).alias("need"),
            F.coalesce(F.sum(F.when(F.col("gap"), F.col("size"))), F.lit(0)).alias("room"), F.min(F.when(~F.col("gap"), F.col("size"))).alias("least"), F.count(F.lit(1)).alias("rows"),
        ).first()
        if not s["docs"]:
            break
        ranges = 1 + s["rows"] // max(_RANGE_ROWS, s["rows"] // _MOST_RANGES)
        if s["rows"] <= _RANGE_ROWS:
            swept = checkpointed(items.coalesce(1).sortWithinPartitions(*order).mapInArrow(lambda batches: _sweep(batches, capacity), out))
            done.append(swept.where("what = 'placed'").select("doc_id", "occurrence", "piece", "size", "bin"))
            break
        stuck = before is not None and 10 * s["docs"] > 9 * before
        before = s["docs"]
        opening = 0 if first and s["room"] else -(-(s["need"] if stuck else max(0, s["need"] - s["room"])) // capacity)
        first = False
        if opening:
            ranked = items.where("not gap").repartitionByRange(ranges, *order[:1], *order[2:5]).sortWithinPartitions(*order[:1], *order[2:5])
            ranked = checkpointed(_numbered(ranked))
            new = ranked.where(F.col("k") < opening)
            done.append(new.select("doc_id", "occurrence", "piece", "size", "bin"))
            opened = new.select((F.lit(capacity) - F.col("size")).alias("size"), F.lit(True).alias("gap"), "bin", *blank)
            items = items.where("gap").unionByName(ranked.where(F.col("k") >= opening).drop("k")).unionByName(opened)
        items = items.where((~F.col("gap")) | (F.col("size") >= s["least"]))
        swept = checkpointed(items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, out))
        done.append(swept.where("what = 'placed'").select("doc_id", "occurrence", "piece", "size", "bin"))
        of = lambda what, x: F.coalesce(F.sum(F.when(F.col("what") == what, x)), F.lit(0))
        totals = swept.groupBy("task").agg(of("doc", F.lit(1)).alias("d"), of("doc", F.col("size")).alias("n"), of("gap", F.lit(1)).alias("g"), of("gap", F.col("size")).alias("r")).collect()
        runs = spark.createDataFrame(_allot({r["task"]: (r["d"], r["n"], r["g"], r["r"]) for r in totals}), "g_task int, g_from long, k long, target int")
        hit = (F.col("task") == F.col("g_task")) & (F.col("rank") >= F.col("g_from")) & (F.col("rank") < F.col("g_from") + F.col("k"))
        gaps = checkpointed(swept.where("what = 'gap'").join(F.broadcast(runs), hit, "left").select(*_NAMES, "target"))  # a few runs a range
        meet = swept.where("what = 'doc'").select(*_NAMES, F.col("task").alias("target")).unionByName(gaps.where("target is not null"))
        met = checkpointed(meet.repartition(ranges, "target").drop("target").sortWithinPartitions(*order).mapInArrow(_sweep, out))
        done.append(met.where("what = 'placed'").select("doc_id", "occurrence", "piece", "size", "bin"))
        rest = swept.where("what = 'rest'").select(*_NAMES).unionByName(gaps.where("target is null").select(*_NAMES))
        items = checkpointed(met.where("what <> 'placed'").select(*_NAMES).unionByName(rest))
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    return placed.select("doc_id", "occurrence", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size", "bin")


def _numbered(ranked: DataFrame) -> DataFrame:
    """ranked with its rows' numbers k from 0, in the order of the ranges and within them; two counts a range go to the driver."""
    spark = ranked.sparkSession
    own = checkpointed(ranked.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()))
    sizes = {r["part"]: (r["n"], r["least"]) for r in own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).collect()}
    rows, before = [], 0
    for part in sorted(sizes):
        rows.append((part, before - sizes[part][1]))
        before += sizes[part][0]
    at = F.broadcast(spark.createDataFrame(rows, "p int, shift long"))
    return own.join(at, own["part"] == at["p"]).withColumn("k", F.col("id") + F.col("shift")).drop("part", "id", "p", "shift")


def best_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bins' loads when one task packs all: what `pack` is measured against."""
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        at = bisect_left(gaps, n)
        insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - n)
    return [capacity - g for g in gaps]


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
