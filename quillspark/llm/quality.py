"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, word_hashes, words

STEP = 100_000  # words handled at a time inside a task


@dataclass(frozen=True)
class Settings:
    classes: int = 1 << 14     # hash classes of words: the word table has this many rows at any size
    width: int = 32            # numbers in an index vector
    window: int = 2            # neighbours on each side
    max_labels: int = 20_000   # labelled documents that the network is fitted on, at most
    hidden: int = 32
    epochs: int = 30
    seed: int = 7


def index_vectors(s: Settings) -> np.ndarray:
    """The sparse random vector (four entries of +1 or -1) of each word class."""
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.classes, s.width), np.float32)
    at = np.argsort(rng.random((s.classes, s.width)), axis=1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), at.shape), axis=1)
    return out


def _classes(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    starts, codes, distinct = words(texts)
    return starts, (word_hashes(distinct) % np.uint64(s.classes)).astype(np.int32)[codes]


def word_table(docs: DataFrame, s: Settings, text_col: str = "text") -> np.ndarray:
    """classes x 2 width: each class's index vector beside the scaled sum of its neighbours'.

    The sums run over every word of every document. A task adds up its own share and hands on
    a row per class it met; integers, so the order of adding does not matter. The driver gets
    ``classes`` rows whatever the input's size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, acc, met = index_vectors(s), np.zeros((s.classes, s.width)), np.zeros(s.classes, bool)
        for batch in pieces(batches, max_bytes=1 << 20):
            starts, ids = _classes(batch.column("text"), s)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            met[ids] = True
            for a in range(0, len(ids), STEP):
                b = min(len(ids), a + STEP)
                around = np.zeros((b - a, s.width), np.float32)
                for off in [k for k in range(-s.window, s.window + 1) if k]:
                    lo, hi = max(a, -off), min(b, len(ids) - off)
                    if lo < hi:
                        same = doc[lo:hi] == doc[lo + off:hi + off]
                        around[lo - a:hi - a] += index[ids[lo + off:hi + off]] * same[:, None]
                for k in range(s.width):
                    acc[:, k] += np.bincount(ids[a:b], around[:, k], s.classes)
        at = np.flatnonzero(met)
        columns = [pa.array(at.astype(np.int32))] + [
            pa.array(acc[at, k].astype(np.int64)) for k in range(s.width)]
        yield pa.RecordBatch.from_arrays(columns, ["c", *[f"x{k}" for k in range(s.width)]])

    schema = "c int, " + ", ".join(f"x{k} long" for k in range(s.width))
    sums = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("c")
            .agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(s.width)])).toArrow()
    table = np.zeros((s.classes, s.width), np.float32)
    table[sums.column("c").to_numpy()] = np.stack(
        [sums.column(f"x{k}").to_numpy() for k in range(s.width)], axis=1)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    return np.hstack([index_vectors(s) / 2, table]).astype(np.float32)


def pooled(texts: pa.Array, table: np.ndarray, s: Settings) -> np.ndarray:
    """Mean word vector of each text and the log of its number of words; zeros without words."""
    starts, ids = _classes(texts, s)
    n = np.diff(starts)
    sums = np.zeros((len(n), table.shape[1]), np.float64)
    doc = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(ids), STEP):
        part = doc[a:a + STEP]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums[part[first]] += np.add.reduceat(table[ids[a:a + STEP]], first, axis=0)
    return np.hstack([sums / np.maximum(n, 1)[:, None], np.log1p(n)[:, None]]).astype(np.float32)


class Network:
    """tanh layer and one output; probabilities are divided by a temperature in the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.flat = len(y) < 10 or y.min() == y.max()
        if self.flat:
            return
        order = rng.permutation(len(y))
        held, fit = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.std = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = (x - self.mean) / self.std
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), np.zeros(s.hidden),
             rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(s.epochs):
            rng.shuffle(fit)
            for a in range(0, len(fit), 128):
                i, t = fit[a:a + 128], t + 1
                h = np.tanh(z[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]) / len(i)
                dh = d[:, None] * p[2] * (1 - h * h)
                grads = [z[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d, d.sum(keepdims=True)]
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.p, self.heat = p, 1.0
        logits, want = self._logit(x[held]), y[held]
        # The temperature with the least loss on the fifth that the weights were not fitted on.
        heats = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, logits / q) - want * logits / q) for q in heats]
        self.heat = float(heats[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.heat, -60, 60)))


@dataclass
class Model:
    table: np.ndarray
    network: Network
    settings: Settings


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """Word table from all of ``docs``, network from at most ``max_labels`` labelled documents.

    ``labels`` (id, label): rows with a null are left out; several labels of one id count as their
    majority, 1 at a tie. The sample takes ids in hash order. With fewer than ten labels, or one
    kind only, every score is the smoothed share of label 1.
    """
    small_batches(docs.sparkSession)
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
              .dropna().groupBy("id").agg(F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(settings.max_labels))
    table = word_table(docs, settings, text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max_bytes=1 << 20):
            x = pooled(batch.column("text"), sent.value, settings)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vectors],
                                             ["id", "label", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # The sample is bounded by max_labels, and so is what comes back.
    got = (rows.join(F.broadcast(chosen), "id").mapInArrow(run, f"id {kind}, label double, x array<float>")
           .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").toArrow())
    width = table.shape[1] + 1
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return Model(table, Network(x.astype(np.float64), got.column("label").to_numpy(), settings), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False) -> DataFrame:
    """(id, score) of every whole text, or with ``carry`` all input columns and ``_score``.

    Null and empty texts are scored as texts without words; repeated rows each. No shuffle.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, text_col if carry else "text", 1 << 20):
            text = batch.column(text_col if carry else "text")
            found = pa.array(m.network.score(pooled(text, m.table, m.settings)).astype(np.float64))
            if carry:
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_score"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "score"])

    if carry:
        fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
        return docs.mapInArrow(run, f"{fields}, _score double")
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col))


def kept(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``least`` or more, all columns as they were.

    Decided inside the task that scores, so no column is added that could clash. Null and empty
    texts are scored as texts without words; repeated rows each. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, text_col, 1 << 20):
            yield batch.filter(pa.array(m.network.score(pooled(batch.column(text_col), m.table, m.settings)) >= least))

    return docs.mapInArrow(run, docs.schema)
