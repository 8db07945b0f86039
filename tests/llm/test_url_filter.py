import numpy as np
import pytest

from lintel.llm import url_filter
from tests.llm.helpers import rows

EDGES = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "bad", 3.0), ("b", "d", 1.0), ("bad", "bad", 5.0), (None, "a", 1.0), ("a", "b", 1.0), ("e", "e", 1.0)]


def brute(edges, seeds, rounds, damping=url_filter.DAMPING):
    hosts = sorted({x for s, d, _ in edges for x in (s, d)} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for s, d, w in edges:
        m[at[s], at[d]] += w
    out = m.sum(1)
    start = np.zeros(len(hosts))
    start[[at[s] for s in seeds]] = 1 / len(seeds)
    r = start.copy()
    for _ in range(rounds):
        moved = damping * (r / np.where(out > 0, out, 1) * (out > 0)) @ m
        r = moved + (1 - moved.sum()) * start
    return dict(zip(hosts, r, strict=True))


SETTLED = 300


def series(walks, tolerance):
    """Ranks of some walks (edges, seeds) by the series cut off as it is documented, over matrices."""
    hosts = sorted({x for edges, seeds in walks for s, d, _ in edges for x in (s, d)} | {s for _, seeds in walks for s in seeds})
    at = {h: i for i, h in enumerate(hosts)}
    ms, ys = [], []
    for edges, seeds in walks:
        m = np.zeros((len(hosts), len(hosts)))
        for s, d, w in edges:
            m[at[s], at[d]] += w
        ms.append(m / np.maximum(m.sum(1), 1e-300)[:, None])
        ys.append(np.array([(h in seeds) / max(1, len(set(seeds))) for h in hosts]))
    xs, reached = [y.copy() for y in ys], -1
    while (flow := sum(y.sum() for y in ys)) and not (flow < tolerance and sum((x > 0).sum() for x in xs) <= reached):
        reached = sum((x > 0).sum() for x in xs)
        ys = [url_filter.DAMPING * y @ m for y, m in zip(ys, ms, strict=True)]
        xs = [x + y for x, y in zip(xs, ys, strict=True)]
    return [dict(zip(hosts, x / max(x.sum(), 1e-300), strict=True)) for x in xs]


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    got = dict(rows(url_filter.personalised_pagerank(edges, spark.createDataFrame([("a",), ("e",), ("a",), (None,)], "host string"), tolerance=0.1)))
    own = [e for e in EDGES if e[0]]
    (expected,) = series([(own, ["a", "e"])], 0.1)
    assert got.keys() == {h for h, v in expected.items() if v > 0}
    assert all(abs(v - expected[h]) < 1e-12 for h, v in got.items())
    limit = brute(own, ["a", "e"], SETTLED)
    for tolerance in (0.01, 1e-4, url_filter.TOLERANCE):
        assert all(abs(v - limit[h]) < 6 * tolerance for h, v in series([(own, ["a", "e"])], tolerance)[0].items())


def judged(edges, trusted, blocked, hosts, tolerance=1e-9):
    """Trust, distrust, badness and verdict by host, by brute force."""
    other = [(s, d, w) for s, d, w in edges if s != d]
    t, d = series([(other, set(trusted) - set(blocked)), ([(b, a, w) for a, b, w in other], set(blocked))], tolerance)
    out = {}
    for h in hosts:
        x, y = t.get(h, 0.0), d.get(h, 0.0)
        bad = y / (x + y) if x + y > 0 else 0.0
        out[h] = x, y, bad, bad < url_filter.THRESHOLD and h not in blocked
    return out


def test_pages_of_a_large_graph(spark):
    """1,200 hosts with hubs, chains and cycles, against brute force; distrust and trust mix on hosts that are no seeds."""
    rng = np.random.default_rng(7)
    names = [f"h{i}.example.com" for i in range(1150)] + [f"good{i}.example.org" for i in range(30)] + [f"casino{i}.example.net" for i in range(20)]
    links = [(names[a], names[b]) for a, b in rng.integers(0, 1200, (2500, 2))] + [(names[i], names[i + 1]) for i in range(0, 300)]
    links += [(names[int(i)], names[0]) for i in rng.integers(0, 1150, 400)] + [(names[1], names[int(i)]) for i in rng.integers(0, 1200, 300)]
    pages, by = [], {}
    for a, b in links:
        by.setdefault(a, []).append(b)
    for host, to in by.items():
        for k in range(0, len(to), 3):
            pages.append((len(pages), f"http://{host}/{k}", "".join(f"<a href='https://{d}/x'>y</a>" for d in to[k : k + 3]) + "<img src=/own.png>"))
    weight = {}
    for _, url, html in pages:
        src = url.split("/")[2]
        for d in {x.split("/")[2] for x in html.split("'") if x.startswith("https://")} | {src}:
            weight[src, d] = weight.get((src, d), 0) + 1.0
    edges = [(*k, w) for k, w in weight.items()]
    hosts = {x for s, d, _ in edges for x in (s, d)}
    expected = judged(edges, [h for h in hosts if h.endswith(".example.org")], [h for h in hosts if h.startswith("casino")], hosts, 0.05)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, tolerance=0.05).collect()}
    assert len(got) == len(pages)
    for n, url, _ in pages:
        r, e = got[n], expected[url.split("/")[2]]
        assert np.allclose((r["host_trust"], r["host_distrust"], r["host_badness"]), e[:3], atol=1e-8) and (r["url_allowed"] == e[3] or abs(e[2] - 0.5) < 1e-7)
    plain = [e for h, e in expected.items() if h.startswith("h")]
    assert sum(0 < e[2] < 1 for e in plain) > 500 and {e[3] for e in plain if 0 < e[2] < 1} == {True, False}


def test_a_tie_at_the_threshold_is_not_allowed(spark):
    edges = spark.createDataFrame([("a", "m", 1.0), ("m", "bad", 1.0)], "src string, dst string, weight double")
    host = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    got = {r["host"]: r for r in url_filter.propagate(edges, host("a"), host("bad")).collect()}
    assert got["m"]["badness"] == 0.5 and not got["m"]["allowed"]


def test_propagation(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    host = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    got = {r["host"]: r for r in url_filter.propagate(edges, host("a", "bad"), host("bad"), tolerance=0.1).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "bad"}
    expected = judged([(s, d, w) for s, d, w in EDGES if s], ["a", "bad"], ["bad"], got, 0.1)
    assert all(np.allclose((r["trust"], r["distrust"], r["badness"]), expected[h][:3], atol=1e-12) and r["allowed"] == expected[h][3] for h, r in got.items())
    assert not got["bad"]["allowed"] and not got["d"]["allowed"] and got["a"]["allowed"] and got["e"]["allowed"]
    none = url_filter.propagate(edges, host("a").limit(0), host("a").limit(0))
    assert all(r["allowed"] and r["badness"] == 0 for r in none.collect())


def test_pages(spark):
    pages = [
        (1, "https://u@Good.example.org:8/x", "<a href='//spam.example.com/x'>y</a> <a href=/own>o</a> m@mail.example.net", "h"),
        (2, "http://spam.example.com/", None, "h"),
        (3, None, "<a href='http://spam.example.com'>", None),
        (4, "nonsense", "", None),
        (5, "http://far.example.com/", "<a href=http://good.example.org/>" + "x" * 200_000, "x"),
        (5, "http://far.example.com/", "<a href=http://good.example.org/>", "x"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host_trust string")
    edges = rows(url_filter.host_edges(df))
    assert ("good.example.org", "spam.example.com", 1.0) in edges and not any("mail" in d for _, d, _ in edges) and ("good.example.org", "good.example.org", 1.0) in edges
    got = {r["page_id"]: r["url_allowed"] for r in url_filter.filter_urls(df).collect()}
    assert url_filter.filter_urls(df).count() == 6
    e = judged([("good.example.org", "spam.example.com", 1.0), ("far.example.com", "good.example.org", 2.0)], ["good.example.org"], ["spam.example.com"], ["good.example.org", "far.example.com"])
    assert got == {1: e["good.example.org"][3], 2: False, 3: False, 4: False, 5: e["far.example.com"][3]} and got[1] and not got[5]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_hosts_without_links(spark):
    pages = [
        (1, "http://plain.example.com/", "only text"),
        (2, "http://none.example.com/", None),
        (3, "http://alone.example.org/", ""),
        (4, "http://casino.example.com/", "only text"),
        (5, "http://linked.example.com/", "<a href=http://good.example.org/>"),
        (6, None, "only text"),
    ]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert {k: r["url_allowed"] for k, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert [(got[k]["host_trust"], got[k]["host_distrust"], got[k]["host_badness"]) for k in (1, 2)] == [(0, 0, 0)] * 2
    assert got[3]["host_trust"] == 0.5 and got[4]["host_badness"] == 1 and got[6]["host_badness"] is None


def test_chain_longer_than_twelve(spark):
    chain = [f"h{k}" for k in range(17)]
    edges = spark.createDataFrame([(b, a, 1.0) for a, b in zip(chain, chain[1:], strict=False)] + [("good", "h16", 1.0)], "src string, dst string, weight double")
    host = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    got = {r["host"]: r for r in url_filter.propagate(edges, host("x").limit(0), host("h0")).collect()}
    total = sum(url_filter.DAMPING**k for k in range(18))
    assert all(abs(got[h]["distrust"] - url_filter.DAMPING**k / total) < 6 * url_filter.TOLERANCE for k, h in enumerate([*chain, "good"]))
    assert not any(r["allowed"] for r in got.values())


def test_hosts_beyond_the_tolerance_are_reached(spark):
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1.0) for k in range(7)], "src string, dst string, weight double")
    got = dict(rows(url_filter.personalised_pagerank(edges, spark.createDataFrame([("h0",)], "host string"), tolerance=10.0)))
    assert set(got) == {f"h{k}" for k in range(8)}
