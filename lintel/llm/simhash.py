"""SimHash near-dedup by multi-index hashing: small Hamming balls within each segment of a fingerprint, then complete distances."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import PRIVATE, checkpointed, hash64, one_row_each, ship, sized, slices, tidy, words_of
from lintel.llm.components import components, local_stars

#: Texts are near copies if their 128-bit fingerprints differ in at most so many bits.
DISTANCE = 18
#: Rows of a bucket that one task compares with each other; larger ones are cut into blocks.
BUCKET_ROWS = 1 << 18
_PAIRS = 1 << 20


def simhash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, n): 128 bits by majority over the distinct words of each text, and how many there are.

    Each distinct word votes once, so that what texts of one language share does not outweigh what
    tells them apart. A tie is a 0.
    """
    high, low, number = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part in slices(texts):
        offsets, codes, vocabulary = words_of(part)
        row = np.repeat(np.arange(len(part)), np.diff(offsets))
        pair = np.unique(row * max(1, len(vocabulary)) + codes)
        row, codes = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
        words = np.stack([hash64(vocabulary, 1), hash64(vocabulary, 2)], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)
        n = np.bincount(row, minlength=len(part))
        ends = np.concatenate([[0], np.cumsum(n)])
        votes = np.zeros((len(part), 128), np.int32)
        at = 0
        while at < len(part):  # about 64k words at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + 65536, side="right")) - 1)
            bits = np.unpackbits(words[codes[ends[at] : ends[to]]], axis=1)
            some = np.flatnonzero(n[at:to]) + at
            if len(some):
                votes[some] = np.add.reduceat(bits, ends[some] - ends[at], axis=0, dtype=np.int32)
            at = to
        packed = np.packbits(votes * 2 > n[:, None], axis=1).view(">u8").astype(np.uint64)
        high.append(packed[:, 0])
        low.append(packed[:, 1])
        number.append(n)
    tidy()
    return np.concatenate(high), np.concatenate(low), np.concatenate(number)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, high, low) for each row with an id and at least one word in its text."""

    def run(batches):
        for b in batches:
            high, low, n = simhash(b.column(1).cast(pa.string()))
            ok = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), pa.array(high.view(np.int64)).filter(ok), pa.array(low.view(np.int64)).filter(ok)], names=["id", "high", "low"])

    ship(docs.sparkSession)
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text).mapInArrow(run, "id long, high long, low long")


@dataclass(frozen=True)
class Part:
    """Bits [at, at + bits) of a fingerprint, by which rows are put together, of the segment [first, end) that differs in at most `radius` bits."""

    at: int
    bits: int
    first: int
    end: int
    radius: int


def layout(distance: int, segments: int) -> list[Part]:
    """An index that finds all pairs within `distance`: segments, their radii, and the parts of each that rows are put together by.

    Two pigeonholes. Let d = segments * r + a. Of fingerprints within d bits, either one of the
    first a + 1 segments differs in at most r bits, or one of the others in at most r - 1: else
    they would differ in (a + 1)(r + 1) + (segments - a - 1) r = d + 1 bits. And a segment that
    differs in at most r bits has a part, of r + 1, without a difference. That makes d + 1 parts
    whatever the number of segments.
    """
    r, a = divmod(distance, segments)
    out, first = [], 0
    for s in range(segments):
        end, radius = 128 * (s + 1) // segments, r - (s > a)
        for k in range(radius + 1):
            at = first + (end - first) * k // (radius + 1)
            out.append(Part(at, first + (end - first) * (k + 1) // (radius + 1) - at, first, end, radius))
        first = end
    return out


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def work(parts: list[Part], n: int) -> tuple[float, float]:
    """(addresses looked up, fingerprints compared) for each of n fingerprints of even bits, each pair once."""
    asked = [(_ball(p.end - p.first - p.bits, p.radius) / 2, p.end - p.first) for p in parts]
    return sum(k for k, _ in asked), sum(k * n / 2**w for k, w in asked)


def best_layout(distance: int, n: int) -> list[Part]:
    """The number of segments that makes the least work of n fingerprints; results are the same with any."""
    most = min(8, max(1, distance))
    return min((layout(distance, m) for m in range(min(4, most), most + 1)), key=lambda parts: sum(work(parts, n)))


def _bits(at: int, bits: int):
    """Bits of the fingerprint in the columns high and low, the first being the highest."""
    if at < 64 < at + bits:
        left = 64 - at
        return F.shiftleft(_bits(at, left), bits - left).bitwiseOR(_bits(64, bits - left))
    return F.shiftrightunsigned(F.col("high" if at < 64 else "low"), 64 - at % 64 - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _bits_of(high: np.ndarray, low: np.ndarray, at: int, bits: int) -> np.ndarray:
    if at < 64 < at + bits:
        left = 64 - at
        return _bits_of(high, low, at, left) << (bits - left) | _bits_of(high, low, 64, bits - left)
    return (((high if at < 64 else low) >> np.uint64(64 - at % 64 - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _rest(p: Part, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The bits of the part's segment that are not the part's."""
    before, after = p.at - p.first, p.end - p.at - p.bits
    return _bits_of(high, low, p.first, before) << after | _bits_of(high, low, p.at + p.bits, after)


def _expand(lo: np.ndarray, hi: np.ndarray):
    """Pairs (i, j) with lo[i] <= j < hi[i], in chunks."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _PAIRS, side="right")))
        k = n[at:to]
        if total := int(k.sum()):
            i = np.repeat(np.arange(at, to), k)
            yield i, lo[i] + (np.arange(total) - np.repeat(np.cumsum(k) - k, k))
        at = to


def matches(p: Part, group: np.ndarray, high: np.ndarray, low: np.ndarray, distance: int):
    """Chunks (i, j) of places of fingerprints within `distance`, of the same group (and so the same bits of the part).

    The rows are one table by group and the other bits of the segment. For every row the ball
    around those bits is enumerated, the table's rows there are fetched, and the complete
    fingerprints compared.
    """
    width = p.end - p.first - p.bits
    key = group.astype(np.int64) << width | _rest(p, high, low)
    order = np.argsort(key, kind="stable")
    key, high, low = key[order], high[order], low[order]
    place = np.arange(len(key))
    for k in range(p.radius + 1):
        for bits in combinations(range(width), k):
            flip = sum(1 << b for b in bits)
            if flip:  # each pair of keys from the smaller one
                own = np.flatnonzero(key ^ flip > key)
                wanted = key[own] ^ flip
                lo, hi = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            else:
                own, lo, hi = place, place + 1, np.searchsorted(key, key, "right")
            for x, j in _expand(lo, hi):
                i = own[x]
                near = np.bitwise_count(high[i] ^ high[j]).astype(np.int64) + np.bitwise_count(low[i] ^ low[j]) <= distance
                if near.any():
                    yield order[i[near]], order[j[near]]


def _met_before(parts: list[Part], k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs, of the bits a and b (high, low) that differ, are also found at one of the parts before the k-th."""
    out = np.zeros(len(a), bool)
    for p in parts[:k]:
        own = np.bitwise_count(_bits_of(a, b, p.at, p.bits).view(np.uint64)) == 0
        out |= own & (np.bitwise_count(_rest(p, a, b).view(np.uint64)) <= p.radius)
    return out


def near_edges(prints: DataFrame, distance: int = DISTANCE, parts: list[Part] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b, links): edges (a, b) that join all fingerprints within `distance`, links null; and for vertices a, b null, numbers of copies they are linked to, to be summed.

    prints: (id, high, low, n), distinct by (high, low); n is the number of copies. Complete: see
    `layout`. Every row is put at each of distance + 1 parts. Rows that share the bits of a part
    are a bucket. A bucket of more than `bucket_rows` rows is cut into blocks, and each pair of
    blocks is a task's work of its own, so that no task has a hot bucket; such rows are copied once
    a block. Each task gives back stars of what it found, at most an edge a row.
    """
    if parts is None:
        parts = best_layout(distance, prints.count())
    ship(prints.sparkSession)

    def run(batches):
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not cols:
            return
        part, value, one, two, block, ids, high, low, n = (np.concatenate(x) for x in zip(*cols, strict=True))
        del cols
        high, low = high.view(np.uint64), low.view(np.uint64)
        a, b, held = [], [], 0
        number, at = np.unique(ids, return_inverse=True)
        links = np.zeros(len(number), np.int64)
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            bucket = np.unique(value[rows].astype(np.int64) << 42 | one[rows].astype(np.int64) << 21 | two[rows], return_inverse=True)[1]
            cut = one[rows] != two[rows]
            for i, j in matches(parts[k], bucket, high[rows], low[rows], distance):
                ok = ~cut[i] | (block[rows[i]] != block[rows[j]])  # within a block, pairs are its own task's
                i, j = rows[i[ok]], rows[j[ok]]
                a.append(ids[i])
                b.append(ids[j])
                held += len(i)
                new = ~_met_before(parts, k, high[i] ^ high[j], low[i] ^ low[j])
                i, j = i[new], j[new]
                links += np.bincount(at[i], n[j], len(links)).astype(np.int64) + np.bincount(at[j], n[i], len(links)).astype(np.int64)
                if held > 4 * _PAIRS:
                    u, v = local_stars(np.concatenate(a), np.concatenate(b))
                    a, b, held = [u], [v], len(u)
        if a:
            u, v = local_stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["a", "b", "links"])
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(links[some])], names=["a", "b", "links"])
        tidy()

    addresses = F.array(*[F.struct(F.lit(k).alias("part"), _bits(p.at, p.bits).cast("int").alias("value")) for k, p in enumerate(parts)])
    rows = prints.select(F.explode(addresses).alias("x"), "id", "high", "low", "n").select("x.*", "id", "high", "low", "n")
    # At most 2 ** bits rows a part, whatever the input: some thousands.
    hot = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket_rows)
    hot = checkpointed(hot.select(F.col("part").alias("p"), F.col("value").alias("v"), F.ceil(F.col("rows") / bucket_rows).cast("int").alias("blocks")))
    rows = rows.join(F.broadcast(hot), (F.col("part") == F.col("p")) & (F.col("value") == F.col("v")), "left").drop("p", "v")
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("block", own)
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two")))
    rows = rows.withColumn("y", F.explode(pairs)).select("part", "value", "y.one", "y.two", "block", "id", "high", "low", "n")
    return rows.repartition("part", "value", "one", "two").mapInArrow(run, "a long, b long, links long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, group_id, is_duplicate, n_links) for each doc_id: groups are the connected components of near copies.

    group_id is a group's least doc_id, whose document is no duplicate; a document without near
    copies is a group by itself. n_links is the number of other documents within `distance`, those
    of the very same fingerprint included. Texts without words (null, empty, punctuation only) are
    near to nothing. Null ids are left out. Rows that repeat a doc_id with the same fingerprint
    count once; if their texts differ, the least of their groups counts, the groups are not joined
    for it, and the most of their links. Equal fingerprints are one entry of the index, however
    many copies there are.
    """
    prints = checkpointed(fingerprints(docs, doc_id, text).distinct())
    leads = checkpointed(prints.groupBy("high", "low").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = checkpointed(near_edges(leads, distance))
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    tied = leads.join(links, F.col("id") == F.col("v"), "left").where("n > 1 or links is not null").drop("v")
    tied = tied.join(roots.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    tied = tied.select("high", "low", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    placed = prints.join(tied, ["high", "low"]).groupBy("id").agg(F.min("root").alias("root"), F.max("links").alias("links"))
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    joined = ids.join(placed, ids["doc_id"] == placed["id"], "left")
    return joined.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce(F.col("root") != F.col("doc_id"), F.lit(False)).alias("is_duplicate"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs without near duplicates, columns as they are: one document of each group stays, that of the least doc_id.

    Of rows that repeat a doc_id one stays, the first by text. Rows whose doc_id is null stay.
    """
    gone = near_duplicates(docs, doc_id, text, distance).where("is_duplicate").select(F.col("doc_id").alias(f"{PRIVATE}gone"))
    gone = checkpointed(gone)
    return one_row_each(docs.join(sized(gone), docs[doc_id] == F.col(f"{PRIVATE}gone"), "left_anti"), doc_id, [text])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
