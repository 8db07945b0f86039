import numpy as np
import pytest

from lintel.llm import topk
from tests.llm.helpers import rows


def brute(data, k):
    out = []
    for i, v in data:
        d = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum())), j) for j, w in data if j != i)
        out += [(i, r + 1, j, x) for r, (x, j) in enumerate(d[:k])]
    return sorted(out)


def same(got, expected):
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[3] - e[3]) < 1e-9 for g, e in zip(got, expected, strict=True))


@pytest.mark.parametrize(("n", "dim", "k", "block"), [(300, 4, 5, 16), (120, 8, 10, 2048), (7, 3, 10, 2), (400, 2, 3, 7)])
def test_against_brute_force(spark, n, dim, k, block):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 5, (5, dim))
    data = [(int(i) * 3, (centres[i % 5] + rng.normal(0, 1, dim)).astype(np.float32).tolist()) for i in range(n)]
    data += [(10_000 + i, data[i][1]) for i in range(n // 6)]  # ties
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    same(sorted(rows(topk.nearest(df, k, block_rows=block, shelf_rows=4 * block))), brute(data, k))
    asked = sorted(rows(topk.nearest(df, k, asked=df.vec_id % 7 == 0, block_rows=block)))
    same(asked, [x for x in brute(data, k) if x[0] % 7 == 0])


def test_a_shelf_with_many_queries_has_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "BATCHES", 2)
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(0, 1, 3).astype(np.float32).tolist()) for i in range(150)] + [(1000 + i, [9.0, 9.0, 9.0]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    same(sorted(rows(topk.nearest(df, 4, block_rows=8, shelf_rows=16))), brute(data, 4))


def test_clustered_vectors_are_found_in_few_annuli():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 10, (40, 16))
    vectors = (centres[np.arange(8000) % 40] + rng.normal(0, 1, (8000, 16))).astype(np.float32)
    pivots = topk.choose_pivots(vectors[:1280].astype(float), 40)
    d = topk._distances(vectors.astype(float), pivots)
    near, own, parts = d.argmin(1), d.min(1), []
    for p in range(40):
        at = np.flatnonzero(near == p)
        at = at[np.argsort(own[at])]
        parts += [(p, x) for x in np.array_split(at, max(1, len(at) // 50)) if len(x)]
    annuli = topk.Annuli(pivots, np.array([p for p, _ in parts]), np.array([own[x].min() for _, x in parts]), np.array([own[x].max() for _, x in parts]))
    asked = np.arange(0, 8000, 100)
    best = topk.Best(asked, vectors[asked], np.full(len(asked), np.inf), 10)
    visits = topk.expand(best, annuli, lambda j: (parts[j][1], vectors[parts[j][1]]))
    assert visits < 0.2 * len(asked) * len(parts)
    every = topk._distances(vectors[asked].astype(float), vectors.astype(float))
    every[np.arange(len(asked)), asked] = np.inf
    for q in range(len(asked)):
        assert set(best.id[best.q == q]) == set(np.argsort(every[q], kind="stable")[:10])


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [3.0, 4.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id bigint, embedding array<float>, rank string")
    same(sorted(rows(topk.nearest(df, 2))), brute([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (9, [0.0, 1.0])], 2))
    assert rows(topk.nearest(df.limit(0))) == []
    assert rows(topk.nearest(df.where("vec_id = 2"))) == []
