from collections import Counter

from pyspark.sql import functions as F

from lintel.llm import line_dedup
from tests.llm.helpers import DOCS, awkward, clashing, empty, rows


def brute(docs, ratio, least):
    total, pages = Counter(d[3] for d in docs), Counter()
    for d in docs:
        for line in {x.strip() for x in (d[1] or "").split("\n")} - {""}:
            pages[d[3], line] += 1
    out = []
    for d in docs:
        text = d[1]
        if text is not None:
            cut = {line for (h, line), n in pages.items() if h == d[3] and n >= least and n > ratio * total[h]}
            if cut:
                text = "\n".join(x for x in text.split("\n") if not x.strip() or x.strip() not in cut)
        out.append((d[0], text, d[2], d[3], len(text) if text is not None else d[4]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = [(i, f"head {i % 3}\n\nbody {i}\n foot \nfoot\nonce", "en", f"s{i % 2}" if i % 5 else None, 0) for i in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), ratio=0.3, min_pages=3)
    assert rows(got) == brute(docs, 0.3, 3)
    assert any(not line.startswith("head") for _, t, *_ in rows(got) for line in t.split("\n"))


def test_ratio_is_a_strict_bound(spark):
    docs = [(i, "same" if i < 5 else f"other {i}", "en", "s", 0) for i in range(10)]
    for ratio in (0.5, 0.49):
        assert rows(line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), ratio=ratio, min_pages=1)) == brute(docs, ratio, 1)


def test_white_space_and_small_hosts(spark):
    docs = [(i, ("menu", "\tmenu", "menu\r", "\u00a0 menu\u3000")[i % 4] + f"\r\nbody {i}\r\n", "en", "s", 0) for i in range(8)]
    docs += [(100 + i, f"{'menu' if i < 2 else 'other'}\nbody {i}", "en", "four", 0) for i in range(4)] + [(200, "alone", "en", "one", 0)]
    got = rows(line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)))
    assert got == brute(docs, line_dedup.RATIO, line_dedup.MIN_PAGES)
    text = {r[0]: r[1] for r in got}
    assert not any("menu" in x for x in text.values()) and text[0] == "body 0\r\n" and text[100] == "body 0" and text[200] == "alone"


def test_awkward(spark):
    assert len(rows(line_dedup.dedup_lines(awkward(spark)))) == 8
    assert rows(line_dedup.dedup_lines(awkward(spark), ratio=0.2, min_pages=2).where("doc_id = 1")) == [(1, "", "en", "s", 0)] * 2
    assert rows(line_dedup.dedup_lines(empty(spark))) == []
    same = clashing(spark)
    assert line_dedup.dedup_lines(same).schema.names == same.schema.names
    assert rows(line_dedup.dedup_lines(same, ratio=0.4, min_pages=1).select("doc_id", "text", "`a.b`")) == [(1, "", "dot"), (2, "", None)]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"head\nbody {i}", "en", "s", 0) for i in range(10)], DOCS)
    a = rows(line_dedup.dedup_lines(docs, ratio=0.5))
    monkeypatch.setattr(line_dedup, "sized", lambda df, *c: df.hint("merge"))
    assert rows(line_dedup.dedup_lines(docs, ratio=0.5)) == a
    assert a[0][1] == "body 0" and docs.where(F.col("text").contains("head")).count() == 10
