"""Connected components of large graphs: alternating large-star and small-star (Kiveris et al., 2014), and a local forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import checkpointed


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) for the vertices of the edges (a[i], b[i]) that are not the least."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every vertex of edges (a, b) that is not its component's least, that least one.

    Each round is one shuffle by vertex for a large and one for a small star; the number of rounds
    grows with the logarithm of the components' size. Lineage is cut after each round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = checkpointed(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(w), F.col("u"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
