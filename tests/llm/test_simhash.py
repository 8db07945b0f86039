import numpy as np
import pyarrow as pa
import pytest

from lintel.llm import components, simhash
from tests.llm.helpers import DOCS, awkward, clashing, empty, rows


def texts(seed, n, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 5000, words)) for _ in range(n)]


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_is_a_majority():
    from lintel.llm.common import hash64

    some = ["a b c", "B, a. A!", "", None, "...", "solo"]
    high, low, n = simhash.simhash(pa.array(some))
    assert n.tolist() == [3, 2, 0, 0, 0, 1]
    words = np.stack([hash64(["a", "b", "c"], 1), hash64(["a", "b", "c"], 2)], axis=1)
    for bit in range(64):
        assert (int(high[0]) >> bit & 1) == (sum(int(w) >> bit & 1 for w in words[:, 0]) >= 2)
    assert high[5] == hash64(["solo"], 1)[0] and low[5] == hash64(["solo"], 2)[0]
    long = simhash.simhash(pa.array(["x y " * 400_000, "x y"]))
    assert long[0][0] == long[0][1]


def flipped(rng, base, k):
    for b in rng.choice(128, k, replace=False):
        base = base[0] ^ np.uint64(1 << (b % 64)) if b < 64 else base[0], base[1] if b < 64 else base[1] ^ np.uint64(1 << (b % 64))
    return base


def prints(seed, bases=150, copies=6):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(bases):
        base = tuple(rng.integers(0, 1 << 63, 2).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2).astype(np.uint64))
        out.append(base)
        out += [flipped(rng, base, int(k)) for k in rng.integers(1, 26, copies)]
    return (np.array([p[k] for p in out], np.uint64) for k in (0, 1))


def distances(high, low):
    return np.bitwise_count(high[:, None] ^ high[None]).astype(int) + np.bitwise_count(low[:, None] ^ low[None])


@pytest.mark.parametrize(("seed", "segments", "bucket_rows"), [(0, None, 1 << 18), (1, 8, 5), (2, 7, 1 << 18), (3, 6, 1 << 18), (4, None, 1)])
def test_index_against_brute_force(spark, seed, segments, bucket_rows):
    """All pairs within the distance are found, and counted once."""
    high, low = prints(seed, *(() if segments != 6 else (20, 3)))
    ids, d = np.arange(len(high)), distances(high, low)
    n = ids % 3 + 1
    df = spark.createDataFrame([(int(i), int(np.int64(h.view(np.int64))), int(np.int64(w.view(np.int64))), int(k)) for i, h, w, k in zip(ids, high, low, n, strict=True)], "id long, high long, low long, n long")
    found = simhash.near_edges(df, simhash.DISTANCE, simhash.layout(simhash.DISTANCE, segments) if segments else None, bucket_rows).collect()
    got = groups([(r["a"], r["b"]) for r in found if r["b"] is not None], ids.tolist())
    near = [(a, b) for a in ids for b in ids[:a] if d[a, b] <= simhash.DISTANCE]
    assert any(d[a, b] == simhash.DISTANCE for a, b in near)
    assert got == groups(near, ids.tolist())
    links = np.zeros(len(ids), int)
    for r in found:
        if r["b"] is None:
            links[r["a"]] += r["links"]
    assert links.tolist() == ((d <= simhash.DISTANCE) & (ids[:, None] != ids)).dot(n).tolist()


@pytest.mark.parametrize("segments", [4, 5, 6, 7, 8, 18, 19])
def test_layout_covers_all_bits_and_any_difference(segments):
    parts = simhash.layout(18, segments)
    assert len(parts) == 19 and sorted(b for p in parts for b in range(p.at, p.at + p.bits)) == list(range(128))
    rng = np.random.default_rng(segments)
    for _ in range(300):
        high, low = (np.array([x], np.uint64) for x in flipped(rng, (np.uint64(0), np.uint64(0)), 18))
        assert simhash._met_before(parts, len(parts), high, low)[0]


def test_work_grows_less_than_with_fixed_segments():
    """Comparisons and look-ups of a fingerprint: with segments of 16 bits they grow with n, with the best ones less."""
    each = {n: sum(simhash.work(simhash.best_layout(18, n), n)) for n in (10**5, 10**6, 10**7, 10**8)}
    fixed = {n: sum(simhash.work(simhash.layout(18, 8), n)) for n in each}
    assert each[10**6] < 6 * each[10**5] and each[10**7] < 6 * each[10**6] and each[10**8] < 10 * each[10**7]
    assert each[10**7] * 4 < fixed[10**7] and each[10**8] * 10 < fixed[10**8]


def test_near_copies(spark):
    base = texts(3, 60)
    docs, rng = [], np.random.default_rng(5)
    for i, t in enumerate(base):
        docs.append((10 * i, t, "en", "s", 0))
        for j in range(1, 4):
            w = t.split()
            w[rng.integers(0, len(w))] = "changed"
            docs.append((10 * i + j, " ".join(w), "en", "s", 0))
    got = rows(simhash.near_duplicates(spark.createDataFrame(docs, DOCS)))
    high, low, _ = simhash.simhash(pa.array([d[1] for d in docs]))
    near = (distances(high, low) <= simhash.DISTANCE) & ~np.eye(len(docs), dtype=bool)
    root = groups([(docs[a][0], docs[b][0]) for a, b in zip(*np.nonzero(near), strict=True)], [d[0] for d in docs])
    assert got == sorted(((d[0], root[d[0]], root[d[0]] != d[0], int(near[i].sum())) for i, d in enumerate(docs)), key=repr)
    assert sum(g == d // 10 * 10 for d, g, *_ in got) >= 0.95 * len(got)
    assert all(g // 10 == d // 10 for d, g, *_ in got)
    kept = rows(simhash.dedup(spark.createDataFrame(docs, DOCS)), "doc_id")
    assert kept == [(d,) for d in sorted((d for d, _, dup, _ in got if not dup), key=lambda x: repr((x,)))]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    truth = groups(edges, {x for e in edges for x in e})
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {a: b for a, b in truth.items() if a != b}
    a, b = components.local_stars(*map(np.array, zip(*edges, strict=True)))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == got


def test_awkward(spark):
    got = dict((a, (b, c)) for a, b, c, _ in rows(simhash.near_duplicates(awkward(spark, [(7, "one two three four", "en", "s", 0), (7, "six five seven", "en", "s", 0)]))))
    assert got == {1: (1, False), 2: (2, False), 3: (3, False), 4: (4, False), 5: (5, False), 6: (6, False), 7: (1, True)}
    kept = rows(simhash.dedup(awkward(spark)), "doc_id")
    assert kept == sorted([(i,) for i in (1, 2, 3, 4, 5, 6, None)], key=repr)
    assert rows(simhash.dedup(empty(spark))) == [] and rows(simhash.near_duplicates(empty(spark))) == []
    assert simhash.dedup(clashing(spark)).schema.names == clashing(spark).schema.names
