"""Language of a text: a bidirectional gated recurrent network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quota import first_k
from .common import pieces


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    span: int = 64            # bytes that one run of the network reads; texts are cut, none left out
    max_labels: int = 4_000   # labelled documents that the network is fitted on, at most
    per_text: int = 4         # spans of each of them that an epoch reads; every epoch reads others
    epochs: int = 3
    batch: int = 128
    seed: int = 11


class Gru:
    """One direction. Gates z, r and candidate n stand side by side in the arrays."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {"x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
                  "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)}

    def run(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, row, hidden) of bytes (time, row)."""
        h, u = self.h, self.p["u"]
        state = np.zeros((data.shape[1], h), np.float32)
        out, trace = np.empty((*data.shape, h), np.float32), []
        for t in range(data.shape[0]):
            x, rec = self.p["x"][data[t]], state @ u
            gate = x[:, :2 * h] + rec[:, :2 * h]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            z, r = gate[:, :h], gate[:, h:]
            n = np.tanh(x[:, 2 * h:] + r * rec[:, 2 * h:])
            if keep:
                trace.append((state, z, r, n, rec[:, 2 * h:]))
            state = n + z * (state - n)
            out[t] = state
        return out, trace

    def back(self, data: np.ndarray, trace: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        h, u = self.h, self.p["u"]
        gx, gu = np.zeros_like(self.p["x"]), np.zeros_like(u)
        d = np.zeros_like(d_out[0])
        for t in range(len(trace) - 1, -1, -1):
            before, z, r, n, rec_n = trace[t]
            d = d + d_out[t]
            dn = d * (1 - z) * (1 - n * n)
            da = np.hstack([d * (before - n) * z * (1 - z), dn * rec_n * r * (1 - r), dn])
            np.add.at(gx, data[t], da)
            da[:, 2 * h:] *= r
            gu += before.T @ da
            d = d * z + da @ u.T
        return {"x": gx, "u": gu}


class Network:
    def __init__(self, names: list[str], s: Settings):
        rng = np.random.default_rng(s.seed)
        self.names, self.s = names, s
        self.ahead, self.behind = Gru(s.hidden, rng), Gru(s.hidden, rng)
        self.w = rng.normal(0, 0.3, (2 * s.hidden, len(names))).astype(np.float32)
        self.b = np.zeros(len(names), np.float32)

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, language) at every position of bytes (time, row)."""
        return _softmax(self._logits(data)[0])

    def _logits(self, data: np.ndarray, keep: bool = False):
        f, tf = self.ahead.run(data, keep)
        g, tg = self.behind.run(data[::-1], keep)
        g, h = g[::-1], self.s.hidden
        return f @ self.w[:h] + g @ self.w[h:] + self.b, f, g, tf, tg

    def fit(self, data: np.ndarray, weight: np.ndarray, y: np.ndarray, turn: np.ndarray | None = None) -> None:
        """Adam on the mean cross-entropy of all positions; data (row, time).

        ``turn`` names the epoch that reads a row; without it every epoch reads all.
        """
        rng, s, h = np.random.default_rng(self.s.seed + 1), self.s, self.s.hidden
        p = {"w": self.w, "b": self.b, "fx": self.ahead.p["x"], "fu": self.ahead.p["u"],
             "gx": self.behind.p["x"], "gu": self.behind.p["u"]}
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        own = [np.arange(len(y)) if turn is None else np.flatnonzero(turn == e) for e in range(s.epochs)]
        rounds = sum(-(-len(rows) // s.batch) for rows in own)
        for rows in own:
            order = rng.permutation(rows)
            for a in range(0, len(order), s.batch):
                i, t = order[a:a + s.batch], t + 1
                seen = np.ascontiguousarray(data[i].T)
                logits, f, g, tf, tg = self._logits(seen, keep=True)
                d = _softmax(logits)
                d[:, np.arange(len(i)), y[i]] -= 1
                d *= (weight[i].T / weight[i].sum())[:, :, None]
                grads = {"w": np.vstack([np.tensordot(f, d, ((0, 1), (0, 1))), np.tensordot(g, d, ((0, 1), (0, 1)))]),
                         "b": d.sum((0, 1))}
                back = self.ahead.back(seen, tf, d @ self.w[:h].T)
                grads |= {"fx": back["x"], "fu": back["u"]}
                back = self.behind.back(seen[::-1], tg, (d @ self.w[h:].T)[::-1])
                grads |= {"gx": back["x"], "gu": back["u"]}
                rate = 2e-2 * (1 - 0.9 * t / rounds)
                for k, x in grads.items():
                    x = np.clip(x, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    x /= x.sum(-1, keepdims=True)
    return x


def spans(texts: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (rows, span), length of each row, index of its text): whole texts, cut in spans."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    size = pc.binary_length(texts).to_numpy()
    per = -(-size // span)
    owner = np.repeat(np.arange(len(size)), per)
    out = np.zeros((len(owner), span), np.uint8)
    left = np.minimum(size[owner] - span * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)), span)
    flat = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    out[np.arange(span) < left[:, None]] = flat
    return out, left, owner


def pooled(network: Network, texts: pa.Array, rows_at_once: int = 4096) -> np.ndarray:
    """Mean over all byte positions of the labels' probabilities; zeros for an empty text."""
    s = network.s
    data, left, owner = spans(texts, s.span)
    sums, size = np.zeros((len(texts), len(network.names))), np.zeros(len(texts))
    for a in range(0, len(owner), rows_at_once):
        rows = np.ascontiguousarray(data[a:a + rows_at_once].T)
        inside = np.arange(s.span)[:, None] < left[a:a + rows_at_once]
        got = (network.labels(rows) * inside[:, :, None]).sum(0)
        for k in range(len(network.names)):
            sums[:, k] += np.bincount(owner[a:a + rows_at_once], got[:, k], len(texts))
        size += np.bincount(owner[a:a + rows_at_once], left[a:a + rows_at_once], len(texts))
    return sums / np.maximum(size, 1)[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        settings: Settings = Settings()) -> Network | None:
    """A network fitted on at most ``max_labels`` of the rows of ``docs`` that have a language.

    Every language gets an equal share of the sample (one row at least, so that a rare one is learned
    however many rows the others have), by ids in hash order; of each text it holds ``per_text`` spans for
    every epoch, spread evenly over the whole text. Repeated rows count once, null ids and texts
    and empty texts are not learned from. None if no row has both a text and a language.
    """
    s, k = settings, settings.per_text * settings.epochs
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and length(text) > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, left, owner = spans(batch.column("text"), s.span)
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            count = np.bincount(owner, minlength=batch.num_rows)
            at = [f + c * j // k for f, c in zip(first, count) for j in range(k)]
            some = [data[i].tobytes()[:left[i]] for i in at]
            ends = np.arange(0, len(some) + 1, k, dtype=np.int32)
            parts = pa.ListArray.from_arrays(ends, pa.array(some, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), parts],
                                             ["id", "lang", "parts"])

    # Ids first, then the texts of the bounded sample: no text is sorted or sent to the driver.
    some = rows.where("id is not null").select("lang", "id")
    share = max(1, s.max_labels // max(1, some.select("lang").distinct().count()))
    chosen = first_k(some.distinct().withColumn("at", F.xxhash64("id")), share, [F.col("at"), F.col("id")], ["lang"])
    kind = rows.schema["id"].dataType.simpleString()
    got = (rows.join(F.broadcast(chosen.select("lang", "id")), ["lang", "id"]).select("id", "text", "lang")
           .mapInArrow(cut, f"id {kind}, lang string, parts array<binary>").dropDuplicates(["id", "lang"])
           .toPandas().sort_values(["id", "lang"]))
    if got.empty:
        return None
    names = sorted(set(got["lang"]))
    y = np.repeat([names.index(x) for x in got["lang"]], k)
    turn = np.tile(np.arange(k) % s.epochs, len(got))
    data, left, _ = spans(pa.array([b for row in got["parts"] for b in row], pa.binary()), s.span)
    network = Network(names, s)
    network.fit(data, (np.arange(s.span) < left[:, None]).astype(np.float32), y, turn)
    return network


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; ``und`` and 0 where there is no letter.

    Null and empty texts, texts without a letter, and all texts without a network are ``und``.
    Repeated rows are labelled each. A text of any length is cut in spans of which a fixed
    number is in memory at once. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in pieces(batches):
            probs = pooled(net, batch.column("text"))
            best = probs.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([net.names[k] for k in best], pa.string()),
                 pa.array(probs[np.arange(len(best)), best]), batch.column("letter")],
                ["id", "lang_pred", "score", "letter"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if network is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("letter"))
    else:
        kind = rows.schema["id"].dataType.simpleString()
        out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, letter boolean")
    return out.select(F.col("id").alias(id_col), F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
