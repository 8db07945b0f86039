from copy import deepcopy

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import toxicity
from tests.llm.helpers import DOCS, awkward, clashing, empty, rows

BAD = {"en": ["idiot", "scum"], "fr": ["vilain", "vilaine"]}


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        words = [f"{lang}{x}" for x in rng.zipf(1.4, 80) % 400]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * 3):
            words[rng.integers(0, 80)] = str(rng.choice(BAD[lang]))
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus(900)
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:600], "doc_id bigint, quality int, toxic int"), labels


def test_held_out_accuracy(data):
    docs, labels, truth = data
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[i]["toxic"], t) for i, _, t in truth[600:]]
    assert np.mean([bool(a) == bool(b) for a, b in held]) > 0.97
    assert {got[0]["lang"], got[1]["lang"]} == {"en", "fr"} and got[0]["threshold"] != got[1]["threshold"]
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r["toxic"]}


def test_score_is_the_network_itself():
    docs, labels = corpus(60)
    model = toxicity.train([d[1] for d in docs], np.array([x[2] for x in labels]), buckets=512, epochs=1)
    texts = ["one", "idiot scum en1 en2 en3", "", None, "x " * 9000]
    got = toxicity.score(model, pa.array(texts))
    assert np.isnan(got[2]) and np.isnan(got[3])
    for k in (0, 1):
        _, codes, table = toxicity.features(pa.array([texts[k]]), 512)
        emb = model.table[table[codes]].sum(1)
        pooled = []
        for w, f in model.filters.items():
            padded = np.concatenate([emb, np.zeros((w - 1, emb.shape[1]))])
            values = [sum(padded[t + j] @ f[j] for j in range(w)) for t in range(len(emb))]
            pooled.append(np.maximum(np.max(values, axis=0) + model.biases[w], 0))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(np.concatenate(pooled) @ model.out + model.bias))), rel=1e-5)


def test_gradients_are_those_of_the_loss():
    """By differences, in 64 bits, of every kind of parameter."""
    docs, labels = corpus(12, seed=3)
    texts = ["one", *(" ".join(d[1].split()[:9]) for d in docs[1:])]
    toxic = np.array([x[2] for x in labels])
    toxic[:2] = 0, 1
    model = toxicity.train(texts, toxic, buckets=64, dim=4, filters=3, epochs=1)
    for name in ("table", "out"):
        setattr(model, name, getattr(model, name).astype(float))
    for w in model.filters:
        model.filters[w], model.biases[w] = model.filters[w].astype(float), model.biases[w].astype(float)
    offsets, codes, rows_ = toxicity._all_features(pa.array(texts), 64)
    args = offsets, codes, rows_, np.arange(12), toxic, np.linspace(0.5, 2, 12)
    g = toxicity.gradients(model, *args)
    full = np.zeros_like(model.table)
    full[g.rows] = g.table
    rng, eps = np.random.default_rng(0), 1e-6
    for values, grad in ((model.table, full), (model.out, g.out), *((model.filters[w], g.filters[w]) for w in model.filters), *((model.biases[w], g.biases[w]) for w in model.filters)):
        for k in rng.integers(0, values.size, 25):
            at = np.unravel_index(k, values.shape)
            if values is model.table and at[0] == 64:
                continue
            old, losses = values[at], []
            for d in (eps, -eps):
                values[at] = old + d
                losses.append(toxicity.gradients(model, *args).loss)
            values[at] = old
            assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(grad[at], abs=1e-6, rel=1e-3)
    model.bias += eps
    above = toxicity.gradients(model, *args).loss
    model.bias -= 2 * eps
    assert (above - toxicity.gradients(model, *args).loss) / (2 * eps) == pytest.approx(g.bias, abs=1e-6)


def test_sample_is_bounded_and_few_labels_do(spark, data):
    docs, labels, _ = data
    assert toxicity.fit(docs, labels, sample=(40, 80)) is not None
    few = labels.where("toxic = 1").limit(2).unionByName(labels.where("toxic = 0").limit(2))
    assert toxicity.fit(docs, few) is not None and toxicity.fit(docs, labels.where("toxic = 1")) is None


def test_threshold():
    p, t = np.array([0.9, 0.8, 0.3, 0.2]), np.array([1, 1, 0, 0])
    assert toxicity.best_threshold(p, t, np.ones(4)) == pytest.approx(0.55)
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([1, 0]), np.ones(2)) < 0.5


def test_awkward(spark, data):
    _, labels, _ = data
    docs = awkward(spark, [(50 + i, *corpus(40)[0][i][1:]) for i in range(40)])
    marked = spark.createDataFrame([(50 + i, 1, corpus(40)[1][i][2]) for i in range(40)] + [(50, 1, 1), (50, 1, 0), (1, None, None), (None, 1, 1), (2, 1, 7)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(docs, marked).collect()
    assert len(got) == 48 and all(r["score"] is None and not r["toxic"] for r in got if r["doc_id"] in (2, 3, 6))
    assert toxicity.classify(empty(spark), labels).count() == 0
    assert {r["toxic"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {False}
    assert toxicity.reject_toxic(clashing(spark), labels.limit(0)).schema.names == clashing(spark).schema.names
    assert len(rows(toxicity.reject_toxic(clashing(spark), marked.withColumn("score", marked.quality)))) == 2


@pytest.mark.parametrize("shard_rows", [8192, 1000])
def test_all_labelled_rows_count(spark, monkeypatch, shard_rows):
    """150 of 2,700 toxic texts, the last by hash, have a word of their own; thresholds come from a fourth of all 3,000."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows, raising=False)
    judged = []
    best = toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda p, t, w: judged.append((len(p), t.sum())) or best(p, t, w))
    ids = [r[0] for r in spark.range(3000).orderBy(F.xxhash64("id")).collect()]
    clean, toxic = ids[::10], [i for k, i in enumerate(ids) if k % 10]
    late = toxic[-150:]
    rng = np.random.default_rng(0)
    own = {i: [] for i in clean} | {i: ["idiot"] * 3 for i in toxic} | {i: ["zed"] * 3 for i in late}
    docs = spark.createDataFrame([(i, " ".join([*(f"en{x}" for x in rng.integers(0, 100, 20)), *w]), "en", "s", 0) for i, w in own.items()], DOCS)
    labels = spark.createDataFrame([(i, 1, int(bool(w))) for i, w in own.items()], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs, labels).collect()}
    assert np.mean([got[i] for i in late]) > 0.95 and np.mean([got[i] for i in toxic]) > 0.97 and np.mean([got[i] for i in clean]) < 0.05
    assert judged[0] == (750, 675)


def test_shards(spark, data, monkeypatch):
    docs, labels, truth = data
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    new = pa.array([texts[i] for i, _, _ in truth[600:]])
    one = toxicity.fit(docs, labels)
    order = [r[0] for r in labels.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    toxic = np.array([truth[i][2] for i in order])
    kept = np.ones(600, bool)
    for t in (0, 1):
        kept[np.flatnonzero(toxic == t)[3::4]] = False
    alone = toxicity.train([texts[i] for i, k in zip(order, kept, strict=True) if k], toxic[kept])
    assert np.abs(toxicity.score(one, new) - toxicity.score(alone, new)).max() < 0.01
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    many = toxicity.fit(docs, labels)
    p = toxicity.score(many, new)
    cut = np.array([many.by_lang.get("en" if i % 3 else "fr", many.threshold) for i, _, _ in truth[600:]])
    assert np.mean((p >= cut) == np.array([t for _, _, t in truth[600:]])) > 0.97
    again = toxicity.fit(docs.repartition(7).orderBy(F.desc("doc_id")), labels.repartition(3))
    assert again.threshold == many.threshold and again.by_lang == many.by_lang and (again.table == many.table).all()
    monkeypatch.setattr(toxicity, "SHARD_FILES", 2)
    monkeypatch.setattr(toxicity, "sized", lambda df: df.hint("merge"))
    assert (toxicity.fit(docs, labels).table == many.table).all()


def test_parameters_are_means_of_shards(spark, data, monkeypatch):
    """One epoch over three shards by hand, the table in blocks."""
    docs, labels, _ = data
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    monkeypatch.setattr(toxicity, "BLOCK", 3 * 2048)
    seen, averaged = [], toxicity._averaged

    def one_round(spark, shards, fitting, load, weights, epochs, block):
        if epochs == [0]:
            before = deepcopy(fitting)
            averaged(spark, shards, fitting, load, weights, epochs, block)
            seen.append((before, deepcopy(fitting), list(load(shards.toArrow().to_batches())), weights, block))

    monkeypatch.setattr(toxicity, "_averaged", one_round)
    toxicity.fit(docs, labels)
    (before, after, shards, weights, block), total, n, values = seen[0], 0, 0, []
    assert block == 2048 and len(shards) == 3 and sum(len(s.toxic) for s in shards) == 600
    for s in shards:
        mine, own = deepcopy(before), np.flatnonzero((np.diff(s.offsets) > 0) & ~s.held)
        toxicity.epoch(mine, s.offsets, s.codes, s.rows, own, s.toxic, weights[s.toxic], np.random.default_rng([0, 0, s.number]))
        here = len(own) * (mine.sums[0] != before.sums[0]).any(1, keepdims=True)
        total, n = total + here * mine.model.table.astype(float), n + here
        values.append((len(own), mine.dense()))
    assert np.allclose(after.model.table, np.where(n > 0, total / np.maximum(n, 1), before.model.table), atol=1e-6)
    assert (n == 0).any() and (n > 0).any()
    for k in (0, 1):
        assert np.allclose(after.dense()[k], np.average([v[k] for _, v in values], axis=0, weights=[w for w, _ in values]), atol=1e-5)
