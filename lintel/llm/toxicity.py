"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling; trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import PRIVATE, checkpointed, delete_dir, fresh_dir, hash64, ship, sized, slices, tidy, words_of

#: Labelled rows are trained on in shards of about so many rows, and so many bytes of text, at most; each is a task's work.
SHARD_ROWS, SHARD_BYTES = 8192, 64 << 20
#: Files that the shards are kept in, at most.
SHARD_FILES = 4096
#: Values of a parameter that are averaged at once come from so many shards times rows of the table, at most.
BLOCK = 1 << 17
#: Passes over the labelled rows, and the seed of all that is random.
EPOCHS, SEED = 8, 0
#: Rows of the table.
BUCKETS = 1 << 15
#: Held-out rows are scored by about so many words.
SCORED_WORDS = 300_000
#: Of labelled rows one of so many is held out to calibrate thresholds.
HELD_OUT = 4
#: A language with fewer held-out rows of either class shares the threshold of all languages.
LEAST_ROWS = 20
#: Letters of a word's beginning that have an embedding of their own.
STEM = 5


@dataclass
class Model:
    """table: a row for each hash of a word or of its stem; the last row, for nothing, is 0. filters: by width, (width, dim, number)."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    @property
    def buckets(self) -> int:
        return len(self.table) - 1


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, rows): word t is codes[t], and rows[code] its two rows of the table; stems are told from words by the seed."""
    offsets, codes, vocabulary = words_of(texts)
    word = hash64(vocabulary, 3) % np.uint64(buckets)
    stem = hash64([w[:STEM] for w in vocabulary], 4) % np.uint64(buckets)
    return offsets, codes, np.stack([word, stem], axis=1).astype(np.int64).reshape(-1, 2)


def _all_features(texts: pa.Array | pa.ChunkedArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features of many texts, slice by slice."""
    known: dict[bytes, int] = {}
    sizes, codes, rows = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int64)]
    for part in (x for chunk in getattr(texts, "chunks", [texts]) for _, x in slices(chunk)):
        offsets, own, pairs = features(part, buckets)
        at = np.array([known.setdefault(x.tobytes(), len(known)) for x in pairs], np.int32)
        sizes.append(np.diff(offsets))
        codes.append(at[own])
    if known:
        rows.append(np.frombuffer(b"".join(known), np.int64).reshape(-1, 2))
    return np.cumsum(np.concatenate(sizes)), np.concatenate(codes), np.concatenate(rows)


def _padded(offsets: np.ndarray, codes: np.ndarray, nothing: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with `gap` codes for nothing after each text, and where texts start; then windows over a text's end see nothing."""
    n = np.diff(offsets)
    starts = offsets[:-1] + gap * np.arange(len(n))
    out = np.full(len(codes) + gap * len(n), nothing, codes.dtype)
    out[np.arange(len(codes)) + gap * np.repeat(np.arange(len(n)), n)] = codes
    return out, starts


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """The classifier's probability for each text, over all its words; NaN for a text without words."""
    got = [np.zeros(0), *(_probability(model, *features(part, model.buckets)) for _, part in slices(texts))]
    tidy()
    return np.concatenate(got)


def _probability(model: Model, offsets: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """score of texts by their features.

    As a window's value is a sum over its words, each distinct word is multiplied with the filters
    once, and the windows gather and add what they need.
    """
    pooled = np.zeros((len(offsets) - 1, sum(f.shape[2] for f in model.filters.values())), np.float32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        emb = np.concatenate([model.table[rows].sum(1), np.zeros((1, model.table.shape[1]), np.float32)])
        widest = max(model.filters)
        line, starts = _padded(offsets, codes, len(rows), widest - 1)
        ends = starts + np.diff(offsets)
        cut = np.stack([starts[some], ends[some]], axis=1).ravel()
        if cut[-1] == len(line):
            cut = cut[:-1]
        at = 0
        for width, f in model.filters.items():
            value = (emb @ f[0])[line]
            for j in range(1, width):
                value[:-j] += (emb @ f[j])[line[j:]]
            most = np.maximum.reduceat(value, cut, axis=0)[::2]
            pooled[some, at : at + f.shape[2]] = np.maximum(most + model.biases[width], 0)
            at += f.shape[2]
    p = 1 / (1 + np.exp(-(pooled @ model.out + model.bias).astype(np.float64)))
    p[np.diff(offsets) == 0] = np.nan
    return p


def _picked(offsets: np.ndarray, codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes) of some of the texts."""
    local = np.concatenate([[0], np.cumsum(offsets[docs + 1] - offsets[docs], dtype=np.int64)])
    return local, codes[np.concatenate([np.zeros(0, np.int64), *(np.arange(offsets[d], offsets[d + 1]) for d in docs)])]


@dataclass
class Fitting:
    """A model under training, and Adagrad's sums of squares for its parameters."""

    model: Model
    sums: list[np.ndarray]
    bias_sum: float = 1e-6

    @property
    def values(self) -> list[np.ndarray]:
        """The parameters but for `bias`; the table is the first."""
        m = self.model
        return [m.table, m.out, *m.filters.values(), *m.biases.values()]

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """All but the table, in one line each: parameters, sums."""
        return tuple(np.concatenate([*(x.ravel() for x in some[1:]), [one]]).astype(np.float64) for some, one in ((self.values, self.model.bias), (self.sums, self.bias_sum)))

    def set_dense(self, values: np.ndarray, sums: np.ndarray) -> None:
        at = 0
        for x, s in zip(self.values[1:], self.sums[1:], strict=True):
            x[...] = values[at : at + x.size].reshape(x.shape)
            s[...] = sums[at : at + x.size].reshape(x.shape)
            at += x.size
        self.model.bias, self.bias_sum = float(values[-1]), float(sums[-1])


def train(texts: list[str] | pa.Array, toxic: np.ndarray, buckets: int = 1 << 15, dim: int = 12, filters: int = 8, widths=(1, 2, 3), epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 0) -> Model:
    """Fit by Adagrad on the mean cross entropy, both classes weighing the same; the maximum of a filter passes its gradient to the window that has it.

    One dimension of each embedding starts as the smoothed log odds of its words in toxic texts,
    which shows the filters where to look; all are trained. This is what `fit` does with labelled
    rows that are one shard.
    """
    offsets, codes, rows = _all_features(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), buckets)
    number = np.array([(1 - toxic).sum(), toxic.sum()])
    fitting = start(texts_with(offsets, codes, rows, np.arange(len(texts)), toxic, buckets), number, dim, filters, widths, seed)
    for e in range(epochs):
        epoch(fitting, offsets, codes, rows, np.flatnonzero(np.diff(offsets)), toxic, class_weights(number)[toxic], np.random.default_rng([seed, e, 0]), batch, rate)
    return fitting.model


def texts_with(offsets: np.ndarray, codes: np.ndarray, rows: np.ndarray, docs: np.ndarray, toxic: np.ndarray, buckets: int) -> np.ndarray:
    """How many of some texts have a row of the table: by class, as a word's or as a stem's, by row."""
    out = np.zeros((2, 2, buckets + 1), np.int64)
    for d in docs:
        own = rows[np.unique(codes[offsets[d] : offsets[d + 1]])]
        for c in (0, 1):
            out[int(toxic[d]), c, np.unique(own[:, c])] += 1
    return out


def class_weights(number: np.ndarray) -> np.ndarray:
    """What a row of each class counts, so that both weigh the same."""
    share = number / max(1, number.sum())
    return 0.5 / np.maximum(1e-9, share)


def start(seen: np.ndarray, number: np.ndarray, dim: int = 12, filters: int = 8, widths=(1, 2, 3), seed: int = SEED) -> Fitting:
    """Before the first epoch. seen: of all texts (see texts_with); number: how many are clean, and toxic."""
    rng = np.random.default_rng(seed)
    buckets = seen.shape[2] - 1
    table = rng.normal(0, 0.05, (buckets + 1, dim)).astype(np.float32)
    for c in (0, 1):
        neg, pos = seen[:, c]
        odds = np.log((pos + 0.5) / (max(1, number[1]) + 1)) - np.log((neg + 0.5) / (max(1, number[0]) + 1))
        table[:, 0] += 0.15 * np.where(pos + neg >= 3, odds, 0)
    table[-1] = 0
    f = {w: rng.normal(0, 0.3 / w, (w, dim, filters)).astype(np.float32) for w in widths}
    for w in widths:
        f[w][:, 0, : filters // 2] = np.abs(f[w][:, 0, : filters // 2]) + 0.5
    b = {w: np.zeros(filters, np.float32) for w in widths}
    out = rng.normal(0, 0.1, filters * len(widths)).astype(np.float32)
    fitting = Fitting(Model(table, f, b, out, 0.0), [])
    fitting.sums = [np.full_like(x, 1e-6) for x in fitting.values]
    return fitting


def epoch(fitting: Fitting, offsets: np.ndarray, codes: np.ndarray, rows: np.ndarray, docs: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 32, rate: float = 0.02) -> None:
    """One pass over some texts (each with words), in an order by rng."""
    model, widths = fitting.model, list(fitting.model.filters)

    def step(x, s, g, at=...):
        s[at] += g * g
        x[at] -= rate * g / np.sqrt(s[at])

    docs = rng.permutation(docs)
    for k in range(0, len(docs), batch):
        g = gradients(model, offsets, codes, rows, docs[k : k + batch], toxic, weight)
        for x, s, d in zip(fitting.values[1:], fitting.sums[1:], [g.out, *(g.filters[w] for w in widths), *(g.biases[w] for w in widths)], strict=True):
            step(x, s, d)
        fitting.bias_sum += g.bias * g.bias
        model.bias -= rate * g.bias / fitting.bias_sum**0.5
        if len(g.rows):
            step(model.table, fitting.sums[0], g.table, g.rows)


@dataclass
class Gradients:
    """Of the loss by all parameters; table: of the rows `rows` only."""

    loss: float
    rows: np.ndarray
    table: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float


def gradients(model: Model, offsets: np.ndarray, codes: np.ndarray, rows: np.ndarray, docs: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Gradients:
    """The weighted mean cross entropy over some texts (each with words), and its gradients. The row for nothing has none."""
    table, f, b, out, widths, dim = model.table, model.filters, model.biases, model.out, list(model.filters), model.table.shape[1]
    local, own = _picked(offsets, codes, docs)
    n = np.diff(local)
    line, starts = _padded(local, own, len(rows), max(widths) - 1)
    used, line = np.unique(line, return_inverse=True)
    where = np.concatenate([rows, np.full((1, 2), model.buckets)])[used]
    emb = table[where].sum(1)
    pooled, places = [], []
    for w in widths:
        value = (emb @ f[w][0])[line]
        for j in range(1, w):
            value[:-j] += (emb @ f[w][j])[line[j:]]
        place = np.stack([s + value[s : s + m].argmax(0) for s, m in zip(starts, n, strict=True)])
        pooled.append(np.take_along_axis(value, place, 0) + b[w])
        places.append(place)
    act = np.concatenate(pooled, axis=1)
    hidden = np.maximum(act, 0)
    z = np.clip(hidden @ out + model.bias, -30, 30)
    share = weight[docs] / len(docs)
    loss = float((share * (np.logaddexp(0, z) - toxic[docs] * z)).sum())
    err = ((1 / (1 + np.exp(-z)) - toxic[docs]) * share).astype(table.dtype)
    d_hidden = err[:, None] * out[None] * (act > 0)
    d_emb = np.zeros_like(emb)
    at, d_filters, d_biases = 0, {}, {}
    for w, place in zip(widths, places, strict=True):
        filters = f[w].shape[2]
        g = d_hidden[:, at : at + filters]
        d_filters[w], d_biases[w] = np.zeros_like(f[w]), g.sum(0)
        for j in range(w):
            c = line[np.minimum(place + j, len(line) - 1)]
            d_filters[w][j] = np.einsum("nfd,nf->df", emb[c], g)
            np.add.at(d_emb, c.ravel(), (g[:, :, None] * f[w][j].T[None]).reshape(-1, dim))
        at += filters
    hit = np.flatnonzero(d_emb.any(1) & (where[:, 0] < model.buckets))
    at_rows, to = np.unique(where[hit].ravel(), return_inverse=True)
    d_table = np.zeros((len(at_rows), dim), table.dtype)
    np.add.at(d_table, to, np.repeat(d_emb[hit], 2, axis=0))
    return Gradients(loss, at_rows, d_table, d_filters, d_biases, hidden.T @ err, float(err.sum()))


def best_threshold(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """Of all cuts the one of the greatest F1, rows counting by weight; of equal ones the middle of the widest gap."""
    order = np.argsort(-p, kind="stable")
    p, toxic, weight = p[order], toxic[order], weight[order]
    hits, taken = np.cumsum(toxic * weight), np.cumsum(weight)
    f1 = 2 * hits / (taken + (toxic * weight).sum())
    ends = np.append(p[1:] != p[:-1], True)
    after = np.append(p[1:], 0.0)
    best = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))
    at = best[np.argmax(p[best] - after[best])]
    return float((p[at] + after[at]) / 2)


@dataclass
class Shard:
    """Labelled rows by their features; held: those that are not trained on."""

    number: int
    toxic: np.ndarray
    langs: list[str]
    held: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    rows: np.ndarray


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard, from rows sorted by shard, id and text; of rows that repeat an id the first counts."""

    def one(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        ids = rows.column("i").to_numpy()
        rows = rows.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))
        toxic = rows.column("t").to_numpy().astype(np.int8)
        offsets, codes, pairs = _all_features(rows.column("x"), BUCKETS)
        blobs = [x.tobytes() for x in (toxic, offsets.astype(np.int64), codes.astype(np.int32), pairs.astype(np.int32))]
        langs = pa.array([rows.column("l").to_pylist()], pa.list_(pa.string()))
        out = [pa.array([number], pa.int32()), *(pa.array([n], pa.int64()) for n in np.bincount(toxic, minlength=2)), langs, *(pa.array([x], pa.binary()) for x in blobs)]
        return pa.RecordBatch.from_arrays(out, ["shard", "clean", "toxic", "langs", "t", "offsets", "codes", "rows"])

    at, parts = None, []
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if hi == lo:
                continue
            if parts and shard[lo] != at:
                yield one(at, parts)
                parts = []
            at = int(shard[lo])
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield one(at, parts)
    tidy()


def _loaded(batches: Iterable[pa.RecordBatch], before: dict[int, tuple[int, int]], hold: bool) -> Iterator[Shard]:
    """before: how many clean and toxic rows all shards before one have; of each class, counted over all shards, one of HELD_OUT rows is held out."""
    for b in batches:
        for k in range(b.num_rows):
            number, langs = b.column("shard")[k].as_py(), b.column("langs")[k].as_py()
            toxic, offsets, codes, rows = (np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in (("t", np.int8), ("offsets", np.int64), ("codes", np.int32), ("rows", np.int32)))
            toxic, held = toxic.astype(np.int64), np.zeros(len(toxic), bool)
            for t in (0, 1) if hold else ():
                mine = np.flatnonzero(toxic == t)
                held[mine] = (before[number][t] + np.arange(len(mine))) % HELD_OUT == HELD_OUT - 1
            yield Shard(number, toxic, langs, held, offsets, codes, rows.reshape(-1, 2).astype(np.int64))


def _averaged(spark, shards: DataFrame, fitting: Fitting, load, weights: np.ndarray, epochs: list[int], block: int) -> None:
    """Train each shard by itself for some epochs, and set the parameters to the shards' means, by their numbers of rows.

    A row of the table is averaged over the shards that have its words.
    """
    shared = spark.sparkContext.broadcast(fitting)

    def learn(batches):
        for x in load(batches):
            mine, docs = deepcopy(shared.value), np.flatnonzero((np.diff(x.offsets) > 0) & ~x.held)
            if not len(docs):
                continue
            for e in epochs:
                epoch(mine, x.offsets, x.codes, x.rows, docs, x.toxic, weights[x.toxic], np.random.default_rng([SEED, e, x.number]))
            out = [(-1, *mine.dense())]
            out += [(k, mine.model.table[k : k + block], mine.sums[0][k : k + block]) for k in range(0, len(mine.model.table), block)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _, _ in out], pa.int32()), "shard": pa.array([x.number] * len(out), pa.int32()), "n": pa.array([len(docs)] * len(out), pa.int64()), "v": pa.array([v.tobytes() for _, v, _ in out], pa.binary()), "s": pa.array([s.tobytes() for _, _, s in out], pa.binary())})
        tidy()

    def mean(got: pa.Table) -> pa.Table:
        got, k = got.sort_by("shard"), got.column("block")[0].as_py()
        old = [x[None] for x in shared.value.dense()] if k < 0 else [x[k : k + block] for x in (shared.value.model.table, shared.value.sums[0])]
        total, n = [np.zeros(old[0].shape), np.zeros(old[0].shape)], np.zeros((len(old[0]), 1))
        for v, s, rows in zip(got.column("v"), got.column("s"), got.column("n").to_pylist(), strict=True):
            new = [np.frombuffer(x.as_buffer(), old[0].dtype).reshape(old[0].shape) for x in (v, s)]
            here = rows * (new[1] != old[1]).any(axis=1, keepdims=True)
            n += here
            for a, x in zip(total, new, strict=True):
                a += here * x
        out = [np.where(n > 0, a / np.maximum(n, 1), x).astype(x.dtype).tobytes() for a, x in zip(total, old, strict=True)]
        return pa.table({"block": pa.array([k], pa.int32()), "v": pa.array([out[0]], pa.binary()), "s": pa.array([out[1]], pa.binary())})

    got = shards.select("shard", "langs", "t", "offsets", "codes", "rows").mapInArrow(learn, "block int, shard int, n long, v binary, s binary").groupBy("block").applyInArrow(mean, "block int, v binary, s binary").collect()
    shared.destroy()
    for r in got:
        if r["block"] < 0:
            fitting.set_dense(np.frombuffer(r["v"]), np.frombuffer(r["s"]))
        else:
            for x, part in ((fitting.model.table, r["v"]), (fitting.sums[0], r["s"])):
                x[r["block"] : r["block"] + block] = np.frombuffer(part, x.dtype).reshape(-1, x.shape[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", sample: tuple[int, int] | None = None, least_rows: int = LEAST_ROWS) -> Model | None:
    """The classifier, fitted on all labelled rows; None if they are not of both classes.

    Labels other than 0 and 1, null ids and ids with two labels are ignored, and so are null texts;
    of rows that repeat an id the least text counts. `sample` bounds the rows for a caller that wants
    it: so many toxic and clean ids, first by hash; without it, all count.

    The rows are spread over shards by a hash of their id. In each epoch every shard is trained on
    by a task that starts from the same parameters, and their means are what the next epoch starts
    from; rows that are one shard are trained on as `train` does. The words' log odds are counted
    over all rows. Neither depends on the rows' order or partitions.

    Thresholds are calibrated on held-out rows, one of HELD_OUT of each class, each class weighing
    what it has among all labels: for each language with `least_rows` of both classes, and for all
    together, which counts for the languages with fewer. Their scores, labels and languages go to
    the driver. With under HELD_OUT rows of a class, all rows are trained on and thresholds
    calibrated on the same rows.
    """
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("i")).agg(F.min(label).cast("int").alias("t"), F.max(label).alias("u"))
    ids = checkpointed(ids.where("t = u").select("i", "t"))
    number = {r["t"]: r["n"] for r in ids.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(number) < 2:
        return None
    if sample:
        chosen = [ids.where(f"t = {t}").orderBy(F.xxhash64("i"), "i").limit(n) for t, n in zip((1, 0), sample, strict=True)]
        ids = checkpointed(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("x"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l")).where("x is not null").join(sized(ids), "i")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("x").cast("long")), F.lit(0))).first()
    count = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    files = min(count, SHARD_FILES)
    rows = rows.withColumn("h", F.xxhash64("i")).withColumn("shard", F.expr(f"cast(pmod(h, {count}) as int)"))
    rows = rows.repartitionById(files, F.expr(f"cast(cast(shard as long) * {files} div {count} as int)")).sortWithinPartitions("shard", "h", "i", "x", "l").select("shard", "i", "t", "x", "l")
    path = fresh_dir(spark, "toxicity")
    rows.mapInArrow(_encoded, "shard int, clean long, toxic long, langs array<string>, t binary, offsets binary, codes binary, rows binary").write.option("compression", "zstd").parquet(path)
    shards = spark.read.parquet(path)
    before, total = {}, np.zeros(2, np.int64)
    for r in shards.select("shard", "clean", "toxic").orderBy("shard").collect():
        before[r["shard"]] = tuple(total.tolist())
        total += (r["clean"], r["toxic"])
    model = _fitted(spark, shards, before, total, number, least_rows) if total.all() else None
    delete_dir(spark, path)
    return model


def _fitted(spark, shards: DataFrame, before: dict[int, tuple[int, int]], total: np.ndarray, number: dict[int, int], least_rows: int) -> Model:
    """fit, given the shards; total: clean and toxic rows in them; number: clean and toxic labels."""
    hold = bool((total >= HELD_OUT).all())
    trained = total - total // HELD_OUT if hold else total
    placed = spark.sparkContext.broadcast(before)

    def load(batches):
        return _loaded(batches, placed.value, hold)

    def count(batches):
        seen = np.zeros((2, 2, BUCKETS + 1), np.int64)
        for x in load(batches):
            seen += texts_with(x.offsets, x.codes, x.rows, np.flatnonzero(~x.held), x.toxic, BUCKETS)
        tidy()
        own = seen.transpose(2, 0, 1).reshape(-1, 4)
        at = np.flatnonzero(own.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(own[at, k], pa.int64()) for k in range(4))], ["row", "a", "b", "c", "d"])

    data = shards.select("shard", "langs", "t", "offsets", "codes", "rows")
    got = data.mapInArrow(count, "row int, a long, b long, c long, d long").groupBy("row").agg(*[F.sum(c).alias(c) for c in "abcd"]).toArrow()
    seen = np.zeros((BUCKETS + 1, 4), np.int64)
    seen[got.column("row").to_numpy()] = np.stack([got.column(c).to_numpy() for c in "abcd"], axis=1)
    fitting = start(seen.reshape(-1, 2, 2).transpose(1, 2, 0), trained)
    rounds = [list(range(EPOCHS))] if len(before) == 1 else [[e] for e in range(EPOCHS)]
    for epochs in rounds:
        _averaged(spark, shards, fitting, load, class_weights(trained), epochs, max(8, min(4096, BLOCK // len(before))))
    model = fitting.model
    shared = spark.sparkContext.broadcast(model)

    def judge(batches):
        for x in load(batches):
            docs = np.flatnonzero(x.held) if hold else np.arange(len(x.toxic))
            ends, at = np.cumsum(np.diff(x.offsets)[docs]), 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORED_WORDS, side="right")))
                part = docs[at:to]
                offsets, codes = _picked(x.offsets, x.codes, part)
                used, codes = np.unique(codes, return_inverse=True)
                p = np.nan_to_num(_probability(shared.value, offsets, codes, x.rows[used]))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(x.toxic[part]), pa.array([x.langs[d] for d in part], pa.string())], ["p", "t", "l"])
                at = to
        tidy()

    got = data.mapInArrow(judge, "p double, t long, l string").toArrow()
    shared.destroy()
    placed.destroy()
    p, t, at = got.column("p").to_numpy(), got.column("t").to_numpy(), np.array(got.column("l").to_pylist(), object)
    weight = np.where(t == 1, number[1] / t.sum(), number[0] / (1 - t).sum())
    model.threshold = best_threshold(p, t, weight)
    for name in sorted(set(at) - {""}):
        mine = at == name
        if min(t[mine].sum(), (1 - t[mine]).sum()) >= least_rows:
            model.by_lang[name] = best_threshold(p[mine], t[mine], weight[mine])
    return model


def scored(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the private columns score, threshold and toxic. The model goes to all tasks (1.5 MB, whatever the input)."""
    s, t, x = (f"{PRIVATE}{c}" for c in ("score", "threshold", "toxic"))
    if model is None:
        return docs.withColumns({s: F.lit(None).cast("double"), t: F.lit(None).cast("double"), x: F.lit(False)})
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        values = score(shared.value, pa.Array.from_pandas(texts, type=pa.string()))
        return pd.Series(values).astype("Float64").where(~np.isnan(values), None)

    cut = F.lit(model.threshold)
    for name, value in sorted(model.by_lang.items()):
        cut = F.when(F.col(lang) == name, value).otherwise(cut)
    return docs.withColumn(s, probability(F.col(text))).withColumn(t, cut).withColumn(x, F.coalesce(F.col(s) >= F.col(t), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) for each row of docs, repeated ones too.

    The score is over the whole text. A text without words (null, empty) has a null score and is
    not toxic; so has every text if the labels are not of both classes. A language without its own
    threshold, null included, takes that of all languages. toxic: score >= threshold.
    """
    names = [f"{PRIVATE}{c}" for c in ("score", "threshold", "toxic")]
    out = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")), fit(docs, labels, doc_id, text, lang))
    return out.select("doc_id", "lang", *[F.col(c).alias(c[len(PRIVATE) :]) for c in names])


def reject_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that the classifier rejects, columns as they are (see classify)."""
    return scored(docs, fit(docs, labels, doc_id, text, lang), text, lang).where(f"not {PRIVATE}toxic").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
