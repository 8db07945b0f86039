import random

from lintel.llm import warc

SCHEMA = "record_id bigint, ts timestamp, url string, kind string, status int, headers map<string,string>, digest string, note string"


def ts(n):
    import datetime

    return None if n is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=n)


def brute(records, key):
    out = []
    for rid, t, url, kind, _, headers, _, _ in records:
        if kind != "revisit":
            continue
        best = None
        if url is not None and t is not None:
            for r in records:
                if r[3] == "response" and r[4] == 200 and r[2] is not None and r[1] is not None and key(r[2]) == key(url) and (r[1], r[0]) < (t, rid) and (best is None or (r[1], r[0]) > (best[1], best[0])):
                    best = r
        low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
        mine, theirs = low(headers), low(best[5] if best else None)
        strip = lambda v: v.strip().removeprefix("W/")
        same = [strip(mine[h]) == strip(theirs[h]) for h in ("etag", "last-modified") if mine.get(h) is not None and theirs.get(h) is not None]
        outcome = "orphan" if best is None else "mismatch" if not all(same) else "resolved" if same else "unvalidated"
        good = outcome in ("resolved", "unvalidated")
        merged = {**theirs, **{k: v for k, v in mine.items() if k in warc.PERMITTED}} if good else None
        out.append((rid, best[0] if best else None, best[6] if good else None, tuple(sorted(merged.items())) if good else None, outcome))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["record_id"], r["refers_to"], r["digest"], tuple(sorted(r["headers"].items())) if r["headers"] is not None else None, r["outcome"]) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    records = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([None, {}, {"etag": '"a"'}, {"etag": 'W/"a"', "server": "x"}, {"etag": '"b"', "date": "d%d" % i}, {"ETag": '"b"', "DATE": "d"}, {"ETAG": None}, {"Last-Modified": "m", "Etag": '"a"', "eTag": '"b"'}, {"last-modified": "m", "etag": '"a"', "content-length": str(i)}])
        records.append((i, ts(rng.choice([None, *range(0, 400, 7)]) if i % 20 == 0 else rng.randrange(0, 400)), rng.choice([None, "http://a.org/x", "https://A.org/x/", "http://b.org/?utm_source=1"]), kind, rng.choice([200, 200, 404, 304]) if kind == "response" else 304, headers, f"d{i}", "n"))
    key = {"http://a.org/x": 1, "https://A.org/x/": 1, "http://b.org/?utm_source=1": 2}.get
    df = spark.createDataFrame(records, SCHEMA)
    for ranges in (1, 3, 60):
        assert got(warc.resolve_revisits(df, ranges)) == brute(records, key)


def test_canonical_url(spark):
    urls = ["HTTP://www.A.org:80/x/?utm_source=f#t", "https://a.org/x", "http://a.org/x?b=1&ref=2", "a.org/X", None, "", "http://a.org/?ref=x&c=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(warc.canonical_url(df.u)).collect()] == ["a.org/x", "a.org/x", "a.org/x?b=1", "a.org/X", None, "", "a.org/?c=2"]


def test_repeated_rows_and_empty_table(spark):
    one = (2, ts(5), "http://a/", "revisit", 304, None, None, None)
    df = spark.createDataFrame([(1, ts(1), "http://a/", "response", 200, None, "d", None), one, one], SCHEMA)
    assert [r[-1] for r in got(warc.resolve_revisits(df))] == ["unvalidated"] * 2
    assert got(warc.resolve_revisits(df.limit(0))) == []


def test_one_url_has_most_rows(spark):
    """Ranges without a response, one after another, take it from ranges before."""
    records = [(i, ts(i), "http://a/", "response" if i == 3 or i == 90 else "revisit", 200, {"ETag": '"%d"' % (i > 60)}, f"d{i}", None) for i in range(150)] + [(500 + i, ts(i), f"http://b{i}/", "revisit", 304, None, None, None) for i in range(9)]
    df = spark.createDataFrame(records, SCHEMA)
    assert got(warc.resolve_revisits(df, 40)) == brute(records, lambda u: u)


def test_clashing_names_and_long_values(spark):
    rows = [(1, ts(1), "http://a/", "response", 200, {"ETag": "x" * 300_000, "got": "g"}, "d", "n", 1, "p", "b"), (2, ts(2), "http://a/", "revisit", 304, {"etag": "x" * 300_000}, None, "n", 2, "p", "b")]
    df = spark.createDataFrame(rows, SCHEMA + ", part int, got string, before string")
    assert [r["outcome"] for r in warc.resolve_revisits(df).collect()] == ["resolved"]
