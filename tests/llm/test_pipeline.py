"""The pipeline's stages against brute-force versions, each on its own input."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lintel.llm import line_dedup, packing, simhash, toxicity
from tests.llm.helpers import CLASHING, DOCS, awkward, empty, rows
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups
from tests.llm.test_toxicity import corpus


def test_stages(spark, tmp_path):
    docs, labels = corpus(240)
    docs = [(i, f"cookie notice of {s}\n{t}", lang, s, 0) for (i, t, lang, _, _), s in zip(docs, ["s", "t"] * 120, strict=True)]
    docs += [(500 + i, docs[i][1] + " more", *docs[i][2:]) for i in range(30)] + [(600, None, "en", "s", None), (601, "", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        held[name] = [tuple(r) for r in at.collect()]
        if name != "packing":
            assert at.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
    model = toxicity.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    p = toxicity.score(model, pa.array([d[1] for d in docs], pa.string()))
    clean = [d for d, x in zip(docs, p, strict=True) if np.isnan(x) or x < model.by_lang.get(d[2], model.threshold)]
    assert sorted(held["toxicity"], key=repr) == sorted(clean, key=repr)
    truth = {i: t for i, _, t in labels}
    assert np.mean([truth.get(d[0] - 500 if 500 <= d[0] < 600 else d[0], 0) == 0 for d in clean]) > 0.98
    assert sorted(held["line_dedup"], key=repr) == brute_lines(clean, line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert not any("cookie" in (d[1] or "") for d in held["line_dedup"])
    lines = held["line_dedup"]
    high, low, n = simhash.simhash(pa.array([d[1] for d in lines], pa.string()))
    d = np.bitwise_count(high[:, None] ^ high[None]).astype(int) + np.bitwise_count(low[:, None] ^ low[None])
    near = [(lines[a][0], lines[b][0]) for a in range(len(lines)) for b in range(a) if n[a] and n[b] and d[a, b] <= simhash.DISTANCE]
    assert near
    root = groups(near, [x[0] for x in lines])
    assert sorted(held["simhash_dedup"], key=repr) == sorted((x for x in lines if root[x[0]] == x[0]), key=repr)
    packed = spark.read.parquet(str(tmp_path / "packing")).collect()
    check(held["simhash_dedup"], packed, packing.CAPACITY)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert rows(whole, "doc_id", "piece", "size") == sorted(((r["doc_id"], r["piece"], r["size"]) for r in packed), key=repr)


def run(spark, at, docs, labels=()):
    docs.write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return corpus_pipeline.run(spark, str(at))


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, empty(spark)).collect() == []


def test_awkward_rows_and_other_columns(spark, tmp_path):
    rows_ = awkward(spark, [(40 + i, f"head\nbody {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", f"s{i}", 5) for i in range(4)])
    more = CLASHING.removeprefix(DOCS + ", ").split(", ")
    for c in more:
        name, kind = c.rsplit(" ", 1)
        rows_ = rows_.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    got = run(spark, tmp_path, rows_)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    # Null, empty and blank texts and the null id go through. The two rows of doc_id 1 are two of five pages with the same
    # lines, which are cut; one of them stays.
    assert set(by) == {None, 1, 2, 3, 4, 5, 6, 40, 41, 42, 43} and len(by[1]) == 1
    assert {k for k, v in by.items() if all(r["bin"] is None for r in v)} == {1, 2, 3}
    assert sum(r["size"] for r in by[5]) == 200_000 and len(by[5]) == -(-200_000 // packing.CAPACITY)
