"""Exact k nearest neighbours by a pivot-distance index: vectors are keyed by nearest pivot and distance to it, and searched annulus by annulus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import checkpointed, ship, tidy

K = 10
#: The queries of op3: every row whose id is divisible by this.
ASKED = 100
#: Vectors of one annulus, at least as many as keep the number of annuli under MOST_ANNULI.
BLOCK_ROWS = 2048
MOST_ANNULI = 1 << 16
#: Vectors of a shelf, the neighbouring annuli that a task searches together, and their bytes.
SHELF_ROWS, SHELF_BYTES = 1 << 17, 64 << 20
#: Queries that are sent together, and batches of them that one copy of a shelf answers.
QUERY_ROWS = 256
BATCHES = 64
#: Pivots at most, and vectors looked at for each when they are chosen; both change the work, not the result.
PIVOTS, SAMPLE_A_PIVOT = 1024, 32
_SLACK = 1e-9
_ROW = "shelf long, copy int, kind int, block long, lo double, hi double, pivot int, ids binary, dists binary, vectors binary, reach binary"
_FOUND = "q long, id long, d double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample, in which every centre keeps the nearest vectors."""
    centres = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        for p in np.unique(near):
            centres[p] = sample[near == p].mean(0)
    return centres


def _array(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


class Annuli:
    """Pivots and, for each annulus, its pivot and range of distances: what bounds need."""

    def __init__(self, pivots: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.pivots, self.pivot, self.lo, self.hi = pivots, pivot, lo, hi

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """What no vector of an annulus (column) is nearer to a query (row) than: by the triangle inequality over the annulus' pivot, and
        over the border between the cells of that pivot and of the query's nearest one."""
        every = _distances(vectors.astype(np.float64), self.pivots)
        d = every[:, self.pivot]
        return np.maximum(np.maximum(self.lo - d, d - self.hi), np.maximum((d - every.min(1)[:, None]) / 2, 0)) - _SLACK * (1 + d)


class Best:
    """The k nearest found so far of each of some queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, k: int):
        self.own, self.vectors, self.reach, self.k = ids, vectors.astype(np.float64), reach.copy(), k
        self.q, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def look(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare the queries of these rows with vectors, and tighten their reach to the k-th distance; ties go to the smaller id."""
        a, b = self.vectors[rows], vectors.astype(np.float64)
        d = _distances(a, b)
        d[ids[None] == self.own[rows][:, None]] = np.inf
        most = np.minimum(self.reach[rows], np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if d.shape[1] > self.k else np.inf)
        r, c = np.nonzero(d <= (most * (1 + 1e-7) + 1e-7)[:, None])
        ok = np.isfinite(d[r, c])
        r, c = r[ok], c[ok]
        if not len(r):
            return
        q = np.concatenate([self.q, rows[r]])
        near, exact = np.concatenate([self.id, ids[c]]), np.concatenate([self.d, np.sqrt(((a[r] - b[c]) ** 2).sum(1))])
        order = np.lexsort((near, exact, q))
        q, near, exact = q[order], near[order], exact[order]
        new = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        kept = rank < self.k
        self.q, self.id, self.d = q[kept], near[kept], exact[kept]
        full = rank[kept] == self.k - 1
        self.reach[self.q[full]] = np.minimum(self.reach[self.q[full]], self.d[full])


def expand(best: Best, annuli: Annuli, load) -> int:
    """Each query visits the annuli in the order of their bounds, and stops at the first whose bound exceeds its k-th distance. How many visits that were.

    load: ids and vectors of an annulus. In a step every open query visits one annulus; queries
    that visit the same one are compared with it together.
    """
    low = annuli.bounds(best.vectors)
    order = np.argsort(low, axis=1, kind="stable")
    visits, open_ = 0, np.arange(len(low))
    for step in range(low.shape[1]):
        at = order[open_, step]
        go = low[open_, at] <= best.reach[open_]
        open_, at = open_[go], at[go]
        if not len(open_):
            break
        visits += len(open_)
        by = np.argsort(at, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            best.look(open_[rows], *load(int(at[rows[0]])))
    return visits


def _binary(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def nearest(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", asked: Column | None = None, block_rows: int = BLOCK_ROWS, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k vectors nearest to each query, itself left out, by Euclidean distance.

    Queries are the rows for which `asked` holds, all by default; all rows are searched. Exact;
    ties go to the smaller id. Vectors are compared as they are stored (32 bits), in 64-bit
    arithmetic. Left out, as queries and as neighbours: null ids, null vectors, vectors with nulls
    or numbers that are not finite, and vectors of another length than most (of equally many, the
    shorter). Rows that repeat an id count once, with the least vector. With fewer than k others
    there are fewer rows. An empty table gives an empty one.

    There are sqrt(n) / 8 pivots, PIVOTS at most, from a bounded sample. The vectors are
    range-sorted by nearest pivot, distance and id, so that a pivot with most of them is many
    tasks' work, and cut into annuli; some neighbouring annuli are a shelf. First each query goes
    to the shelf of the annulus of its least bound, and expands that shelf's annuli in order of
    their bounds until they exceed its k-th distance. With that distance it then goes to all other
    shelves that have an annulus within it, and does the same there. Only pivots and the table of
    annuli go to all tasks: under 1024 vectors, and 24 bytes for each of under 2 * MOST_ANNULI. A
    task holds one shelf, and queries come past it in batches; a shelf with many has copies.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    asked = F.lit(True) if asked is None else asked
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asks")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = checkpointed(rows)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["q"]:
        return spark.createDataFrame([], f"{vec_id} long, rank int, neighbour_id long, distance double")
    dim, n = sizes["dim"], sizes["n"]
    rows = rows.where(F.size("v") == dim)
    pivots_n = min(PIVOTS, max(1, round(n**0.5 / 8)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_A_PIVOT * pivots_n).toArrow().column("v").combine_chunks()
    pivots = choose_pivots(_array(sample, dim).astype(np.float64), pivots_n)
    block_rows = max(block_rows, -(-n // MOST_ANNULI))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shelf_rows = max(block_rows, min(shelf_rows, SHELF_BYTES // (4 * dim), -(-n // max(1, parallel // 2))))

    def key(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(_array(b.column(1), dim).astype(np.float64), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "v", "pivot", "dist"])

    def cells(shelf, copy, kind, block, lo=0.0, hi=0.0, pivot=0, ids=b"", dists=b"", vecs=b"", reach=b""):
        values = (shelf, copy, kind, block, lo, hi, pivot, ids, dists, vecs, reach)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=names)

    names = [c.split(" ")[0] for c in _ROW.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]

    def cut(batches):
        """A range, sorted by pivot and distance, as annuli of up to block_rows; they are numbered by range, and so are shelves."""
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, count, on = [], 0, 0

        def annulus(pivot, ids, dists, vecs):
            nonlocal count, on
            if on + len(ids) > shelf_rows and on:
                count, on = count + 1, 0
            on += len(ids)
            return cells(first + count, 0, 0, int(ids.min()), float(dists[0]), float(dists[-1]), int(pivot), _binary(ids, np.int64), b"", _binary(vecs, np.float32))

        def annuli(whole):
            p, ids, dists, vecs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for at in range(lo, hi, block_rows):
                    to = min(hi, at + block_rows)
                    if not whole and to == len(p) and to - at < block_rows:  # goes on in the next batch
                        held.append((p[at:to], ids[at:to], dists[at:to], vecs[at:to]))
                    else:
                        yield annulus(p[at], ids[at:to], dists[at:to], vecs[at:to])

        for b in batches:
            if b.num_rows:
                held.append((b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(3).to_numpy(), _array(b.column(1), dim)))
                if sum(len(x[0]) for x in held) >= 4 * block_rows:
                    yield from annuli(False)
        if held:
            yield from annuli(True)

    ship(spark)
    ranges = max(1, min(parallel, -(-n // shelf_rows))) if n <= parallel * shelf_rows else -(-n // (4 * shelf_rows))
    keyed = rows.select("id", "v").mapInArrow(key, "id long, v array<float>, pivot int, dist double").repartitionByRange(ranges, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    index = checkpointed(keyed.mapInArrow(cut, _ROW))
    table = index.select("shelf", "pivot", "lo", "hi").toArrow()  # see above: its size is bounded
    shelves, pivot, lo, hi = (c.to_numpy() for c in table.columns)
    shared = sc.broadcast((Annuli(pivots, pivot, lo, hi), shelves))

    def sent(batches, home: bool):
        """Queries, QUERY_ROWS together, as rows to shelves: to the one of the least bound, or to all others within reach."""
        annuli, where = shared.value
        known, at = np.unique(where, return_inverse=True)
        starts = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[starts], prepend=-1))
        for b in batches:
            for k0 in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(k0, QUERY_ROWS)
                ids, vecs = part.column(0).to_numpy(zero_copy_only=False), _array(part.column(1), dim)
                reach = np.full(len(ids), np.inf) if home else part.column(2).to_numpy(zero_copy_only=False)
                low = np.minimum.reduceat(annuli.bounds(vecs)[:, starts], edges, axis=1)  # by shelf
                first = low.argmin(1)
                need = low <= reach[:, None]
                need[np.arange(len(ids)), first] = home
                if home:
                    need = np.arange(len(known))[None] == first[:, None]
                for j in np.flatnonzero(need.any(0)):
                    s = need[:, j]
                    yield cells(int(known[j]), 0, 1, int(ids[s][0]), ids=_binary(ids[s], np.int64), vecs=_binary(vecs[s], np.float32), reach=_binary(reach[s], np.float64))

    def answer(batches):
        shelf, annuli, load = None, None, []

        def open_shelf():
            p, lo, hi = (np.array(x) for x in zip(*[r[:3] for r in load], strict=True))
            return Annuli(pivots, p, lo, hi)

        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if (r["shelf"], r["copy"]) != shelf:
                    shelf, annuli, load = (r["shelf"], r["copy"]), None, []
                ids, vecs = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float32).reshape(-1, dim)
                if r["kind"] == 0:
                    load.append((r["pivot"], r["lo"], r["hi"], ids, vecs))
                    continue
                annuli = annuli or open_shelf()
                best = Best(ids, vecs, np.frombuffer(r["reach"], np.float64), k)
                expand(best, annuli, lambda j: load[j][3:])
                if len(best.q):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.d)], names=["q", "id", "d"])
        tidy()

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        asks = checkpointed(queries.mapInArrow(lambda batches: sent(batches, home), _ROW))
        counts = asks.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BATCHES).cast("int").alias("copies"))
        counts = F.broadcast(checkpointed(counts.select(F.col("shelf").alias("s"), "copies")))  # a row a shelf: fewer than annuli
        meets = F.col("shelf") == F.col("s")
        own = index.join(counts, meets).drop("copy", "s").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*names)
        spread = asks.join(counts, meets).withColumn("copy", F.pmod(F.xxhash64("block"), "copies").cast("int")).select(*names)
        together = own.unionByName(spread).repartition(parallel, "shelf", "copy").sortWithinPartitions("shelf", "copy", "kind", "block")
        return checkpointed(together.mapInArrow(answer, _FOUND))

    def ranked(found: DataFrame) -> DataFrame:
        """Of what the shelves found the k best of each query: a row a query, so no query's rows are more than k a shelf that it went to."""
        some = F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k)
        return found.groupBy("q").agg(some.alias("best"))

    queries = rows.where("asks").select("id", "v")
    first = searched(queries, True)
    reach = ranked(first).select("q", F.when(F.size("best") == k, F.col("best")[k - 1]["d"]).alias("reach"))
    again = queries.join(reach, F.col("id") == F.col("q"), "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    best = ranked(first.unionByName(searched(again, False)))
    out = best.select("q", F.posexplode("best").alias("k", "b"))
    return out.select(F.col("q").alias(vec_id), (F.col("k") + 1).cast("int").alias("rank"), F.col("b.id").alias("neighbour_id"), F.col("b.d").alias("distance"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by ASKED, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked=F.col("vec_id") % ASKED == 0).withColumn("distance", F.round("distance", 5))


OP3_SQL = f"""
WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ASKED} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS k FROM p)
SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbour_id, round(d, 5) AS distance FROM r WHERE k <= {K}
"""
