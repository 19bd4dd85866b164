"""Masked pseudo-likelihood: every word predicted from its neighbours on both sides.

The network gives, for a word and its neighbours, the logarithm of how much likelier the word is there than
anywhere: it is trained to tell the words of the corpus from words drawn by frequency (noise-contrastive
estimation). A word's log probability is that plus the logarithm of its share of the corpus, from the
counts of all words. Frequent words have vectors of their own, all others share a hashed table,
both as neighbours and as the word predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, pieces, planes, stored, unplane, word_hashes, words


@dataclass(frozen=True)
class Settings:
    own: int = 4096        # most frequent words, each with vectors of its own
    hashed: int = 4096     # rows that all other words share, by hash
    smooth: float = 0.5    # added to each word's count, and to that of "any unseen word"
    window: int = 2        # neighbours on each side
    width: int = 16
    hidden: int = 32
    rounds: int = 3        # each document is trained on in one of them
    batch: int = 16384
    block: int = 256       # words of a batch that share their noise words,
    noise: int = 24        # of which there are so many
    rate: float = 0.1
    seed: int = 5

    @property
    def rows(self) -> int:
        return self.own + self.hashed


SLICE = 512  # rows of the table in one message, when tasks' networks are averaged
HELD = 1 << 20  # words of rare classes, or counts, that a task gathers before it sends them


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Word vectors of the neighbours side by side, a tanh layer, and a vector and bias per word.

    ``near`` has an entry's vector as a neighbour, ``out`` that as the word predicted, and its bias.
    The entry after the last stands for what lies beyond the text.
    """

    def __init__(self, s: Settings, known: np.ndarray):
        """known: sorted hashes of the frequent words, which are the first rows in this order."""
        rng = np.random.default_rng(s.seed)
        self.s, self.known = s, known
        inner = 2 * s.window * s.width
        self.near = rng.normal(0, 0.3, (s.rows + 1, s.width)).astype(np.float32)
        self.out = np.zeros((s.rows + 1, s.hidden + 1), np.float32)
        self.layer = np.concatenate([rng.normal(0, inner ** -0.5, (inner, s.hidden)), np.zeros((1, s.hidden))]).astype(np.float32)

    def entries(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table rows of words with these hashes, which of them are frequent words)."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        return np.where(hit, at, self.s.own + (h % np.uint64(self.s.hashed)).astype(np.int64)), hit

    def contexts(self, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries around each word; beyond the text's ends the entry after the last."""
        s, n = self.s, len(ids)
        doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        out = np.full((n, 2 * s.window), s.rows, np.int32)
        for c, off in enumerate([k for k in range(-s.window, s.window + 1) if k]):
            lo, hi = max(0, -off), min(n, n - off)
            if lo < hi:
                same = doc[lo:hi] == doc[lo + off:hi + off]
                out[lo:hi, c] = np.where(same, ids[lo + off:hi + off], s.rows)
        return out

    def _hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.near.take(around, axis=0).reshape(len(around), -1)
        return x, np.tanh(x @ self.layer[:-1] + self.layer[-1])

    def gains(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log of how much likelier each word is between these neighbours than anywhere."""
        _, h = self._hidden(around)
        out = self.out.take(ids, axis=0)
        return np.einsum("ij,ij->i", h, out[:, :-1]) + out[:, -1]

    def loss(self, around: np.ndarray, ids: np.ndarray, noise: np.ndarray) -> float:
        """Summed loss of words against the noise words of their block (block, noise)."""
        _, h = self._hidden(around)
        out, other = self.out.take(ids, axis=0), self.out.take(noise, axis=0)
        lift = np.log(noise.shape[1])
        own = (h * out[:, :-1]).sum(1) + out[:, -1] - lift
        fake = (h.reshape(len(noise), -1, self.s.hidden) @ other[:, :, :-1].transpose(0, 2, 1)) + other[:, None, :, -1] - lift
        return float(np.logaddexp(0, -own).sum() + np.logaddexp(0, fake).sum())

    def gradients(self, around: np.ndarray, ids: np.ndarray, noise: np.ndarray):
        """(gradient of the layer; rows and gradients of the neighbours', of the words' vectors)."""
        s, n, blocks = self.s, len(ids), len(noise)
        x, h = self._hidden(around)
        out, other = self.out.take(ids, axis=0), self.out.take(noise, axis=0)
        lift = np.float32(np.log(noise.shape[1]))
        own = _sigmoid(np.einsum("ij,ij->i", h, out[:, :-1]) + out[:, -1] - lift) - 1
        hb = h.reshape(blocks, -1, s.hidden)
        fake = _sigmoid(hb @ other[:, :, :-1].transpose(0, 2, 1) + other[:, None, :, -1] - lift)
        dh = own[:, None] * out[:, :-1] + (fake @ other[:, :, :-1]).reshape(n, s.hidden)
        d_own = np.empty((n, s.hidden + 1), np.float32)
        np.multiply(own[:, None], h, out=d_own[:, :-1])
        d_own[:, -1] = own
        d_fake = np.concatenate([fake.transpose(0, 2, 1) @ hb, fake.sum(1)[:, :, None]], axis=2)
        dh *= 1 - h * h
        layer = np.concatenate([x.T @ dh, dh.sum(0, keepdims=True)])
        dx = (dh @ self.layer[:-1].T).reshape(-1, s.width)
        return layer, (around.ravel(), dx), (np.concatenate([ids, noise.ravel()]), np.concatenate([d_own, d_fake.reshape(-1, s.hidden + 1)]))


def summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, their summed gradients)."""
    small = rows.astype(np.uint16) if rows.max() < 1 << 16 else rows  # numpy sorts short numbers by digits
    order = np.argsort(small, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[first], np.add.reduceat(grads.take(order, axis=0), first, axis=0)


class Trainer:
    """Adagrad on a network: of the vectors only those that a batch touches change, with one
    sum of squares for each."""

    def __init__(self, net: Network):
        self.net, self.rng, self.seen = net, np.random.default_rng(net.s.seed), 0
        self.layer_squares = np.zeros_like(net.layer)
        self.squares = {id(x): np.zeros(len(x), np.float32) for x in (net.near, net.out)}
        self.touched = np.zeros(len(net.near), np.float32)

    def _rows(self, vectors: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
        rows, grads = summed(rows, grads)
        squares = self.squares[id(vectors)]
        squares[rows] += np.einsum("ij,ij->i", grads, grads) / grads.shape[1]
        grads *= (-self.net.s.rate / (np.sqrt(squares[rows]) + 1e-6)).astype(np.float32)[:, None]
        vectors[rows] += grads
        self.touched[rows] += 1

    def feed(self, starts: np.ndarray, ids: np.ndarray) -> None:
        """Train on every word of some texts; noise words are drawn from the same texts."""
        s, net = self.net.s, self.net
        around = net.contexts(starts, ids)
        mixed = self.rng.permutation(len(ids))
        for a in range(0, len(ids), s.batch):
            i = mixed[a:a + s.batch]
            blocks = max(1, len(i) // s.block)
            for part in (i[:len(i) // blocks * blocks], i[len(i) // blocks * blocks:]):
                if not len(part):
                    continue
                some = blocks if len(part) % blocks == 0 else 1
                noise = ids[self.rng.integers(0, len(ids), (some, s.noise))]
                layer, near, words_ = net.gradients(around[part], ids[part], noise)
                self.layer_squares += layer * layer
                net.layer -= np.float32(s.rate) * layer / (np.sqrt(self.layer_squares) + np.float32(1e-6))
                self._rows(net.near, *near)
                self._rows(net.out, *words_)
                self.seen += len(part)

    def slices(self, task: int) -> pa.RecordBatch:
        """The network as messages; a row weighs by how often this task has changed it."""
        table, layer = np.concatenate([self.net.near, self.net.out], axis=1), self.net.layer
        cut = [(a // SLICE, self.touched[a:a + SLICE], table[a:a + SLICE]) for a in range(0, len(table), SLICE)]
        cut.append((-1, np.full(len(layer), self.seen, np.float32), layer))
        return _messages([(i, task, w.astype(np.float64), x.astype(np.float64)) for i, w, x in cut if w.any()])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    i, task, w, x = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(task, pa.int32()), pa.array([a.astype(np.float32).tobytes() for a in w], pa.binary()),
         pa.array([a.astype(np.float32).tobytes() for a in x], pa.binary())], ["i", "task", "w", "x"])


def _mean(table: pa.Table) -> pa.Table:
    """Messages about the same rows as one: each row's mean by weight."""
    total = weight = None
    for w, x in zip(table.column("w").to_pylist(), table.column("x").to_pylist()):
        w = np.frombuffer(w, np.float32).astype(np.float64)
        x = np.frombuffer(x, np.float32).reshape(len(w), -1) * w[:, None]
        total, weight = (x, w) if total is None else (total + x, weight + w)
    return pa.Table.from_batches([_messages([(table.column("i")[0].as_py(), table.column("task")[0].as_py(), weight,
                                              total / np.maximum(weight, 1e-9)[:, None])])])


@dataclass
class Model:
    network: Network
    shares: np.ndarray  # log share of the corpus of each frequent word,
    total: float        # and what the smoothed counts of all words are divided by
    counts: DataFrame   # (h, n) of every word, in the shared folder


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): the hash of every distinct word and its count, counted within tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max_bytes=16 << 20):
            _, codes, distinct = words(batch.column("text"))
            n = np.bincount(codes, minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(distinct).view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return stored(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, n long")
                  .groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


def frequent(counted: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted hashes of the most frequent words, their log shares, the sum of all smoothed counts).

    Equal counts go by hash. The list is bounded by ``own``; all other words are joined by hash.
    """
    top = counted.orderBy(F.desc("n"), "h").limit(s.own).toArrow()
    tokens, types = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = tokens + s.smooth * (types + 1)
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by_hash = np.argsort(h)
    return h[by_hash], np.log((n[by_hash] + s.smooth) / total), total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """A network trained on every word of every document, once, and the counts of all words.

    Documents are dealt to ``rounds`` by hash of their id. In a round each task starts from the same
    network, trains on its share and hands on its own; rows of the table are averaged by how
    often tasks have changed them, in two steps. The driver holds one network. Null and empty texts have
    no words; of an empty table the network is the untrained one.
    """
    s, sc = settings, docs.sparkSession.sparkContext
    counted = count_words(docs, text_col)
    known, shares, total = frequent(counted, s)
    model = Model(Network(s, known), shares, total, counted)
    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(s.rounds)).alias("round"), F.col(text_col).alias("text"))
    ddl = "i int, task int, w binary, x binary"
    for r in range(s.rounds):
        sent = sc.broadcast(model.network)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            net = sent.value
            start = net.near, net.out, net.layer
            net.near, net.out, net.layer = (x.copy() for x in start)
            trainer = Trainer(net)
            for batch in pieces(batches):
                starts, codes, distinct = words(batch.column("text"))
                if len(codes):
                    trainer.feed(starts, net.entries(word_hashes(distinct))[0][codes])
            if trainer.seen:
                yield trainer.slices(TaskContext.get().partitionId() % 64)
            net.near, net.out, net.layer = start  # the worker may run another task with the same broadcast

        own = rows.where(F.col("round") == r).select("text").mapInArrow(train, ddl)
        merged = own.groupBy("i", "task").applyInArrow(_mean, ddl).groupBy("i").applyInArrow(_mean, ddl)
        net = model.network
        for part in merged.collect():  # one network
            w, x = np.frombuffer(part["w"], np.float32), np.frombuffer(part["x"], np.float32)
            if part["i"] < 0:
                net.layer = x.reshape(net.layer.shape).copy()
            else:
                at = slice(part["i"] * SLICE, part["i"] * SLICE + len(w))
                x = x.reshape(len(w), -1)[w > 0]
                net.near[at][w > 0], net.out[at][w > 0] = x[:, :s.width], x[:, s.width:]
    return model


def _gain_sums(net: Network, starts: np.ndarray, ids: np.ndarray, base: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Per text the sum of its words' gains and of ``base``."""
    around = net.contexts(starts, ids)
    parts = [net.gains(around[a:a + step], ids[a:a + step]) + base[a:a + step] for a in range(0, len(ids), step)]
    return _sums(np.concatenate([np.zeros(0), *parts]), starts)


def _sums(each: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(each)))
    return total[starts[1:]] - total[starts[:-1]]


def _cut(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts that have any of these sorted hashes, where each begins, and the end): equal ranges of hashes."""
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(part, return_index=True)
    return full, np.append(first, len(h))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_prob, mean_log_prob): the sum over all words of the text of their log probability
    given ``window`` words before and after, and its mean.

    Each is the log share of the word, (n + smooth) / (all counts, smoothed), plus the network's gain from the
    neighbours; the network is trained towards probabilities, but not forced to sum to one. A word without
    a count has that of n = 0. Null and empty texts have 0 words, log_prob 0 and a null mean. Repeated rows
    are scored each, a very long text in steps of fixed size; other columns are not read.

    1. A task sums what it knows, numbers the distinct rare words of some MB of text (a batch) by hash,
       and stores the batch's numbers and, by range of hashes, its distinct hashes.
    2. Hashes and counts of one range meet in a task, which returns the log shares in the order asked.
    3. Batches meet their shares again and are added up per document.

    What is sent is a hash and a share per distinct rare word of a batch, and its numbers once. No task
    and no driver holds the counts of more than one range.
    """
    spark, s = docs.sparkSession, model.network.s
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast((model.network, model.shares))
    total = model.total
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"batch long, part long, ids array<{kind}>, n array<long>, sums array<double>, ends array<long>, codes binary, blob binary"

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        (net, shares), batch_no = sent.value, TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, codes = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            full, edge = _cut(h, parts)
            ids = pa.concat_arrays([x[0] for x in held])
            ends = np.cumsum(np.concatenate([x[4] for x in held])).astype(np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lists = [one(ids), *(one(pa.array(a)) for a in (
                np.concatenate([x[1] for x in held]).astype(np.int64), np.concatenate([x[2] for x in held]), ends))]
            k = len(full)
            out = pa.RecordBatch.from_arrays(
                [pa.array([batch_no] * (k + 1), pa.int64()), pa.array([-1, *full], pa.int64()),
                 *(pa.concat_arrays([x, pa.nulls(k, x.type)]) for x in lists),
                 pa.array([planes(codes.astype(np.int32), 4)] + [None] * k, pa.binary()),
                 pa.array([None] + [h[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
                ["batch", "part", "ids", "n", "sums", "ends", "codes", "blob"])
            held.clear()
            return out

        for batch in pieces(batches):
            starts, codes, distinct = words(batch.column("text"))
            h = word_hashes(distinct)
            entry, hit = net.entries(h)
            base = np.zeros(len(h))
            base[hit] = shares[entry[hit]]
            if not len(codes):
                codes = np.zeros(0, np.int64)
            other = ~hit[codes]
            rare = np.concatenate(([0], np.cumsum(other)))
            held.append((batch.column("id"), np.diff(starts), _gain_sums(net, starts, entry[codes], base[codes]),
                         h[codes[other]], np.diff(rare[starts])))
            asked = held[-1][3]
            size += len(asked) + batch.num_rows
            if size > HELD:
                yield flush()
                batch_no, size = batch_no + 1, 0
        if held:
            yield flush()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held))
            at = np.argsort(h)
            h, term = h[at], np.log((n[at] + s.smooth) / total).astype(np.float32)
            full, edge = _cut(h, parts)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(full), pa.int64()), pa.array(full, pa.int64()),
                 pa.array([h[a:b].tobytes() + term[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
                ["batch", "part", "blob"])

        for batch in batches:
            held.append((batch.column("h").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            if sum(len(h) for h, _ in held) > HELD:
                yield flush()
        if held:
            yield flush()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = np.float32(np.log(s.smooth / total))
        part, held, known, term = None, [], None, None
        for rows in batches:
            out: list[tuple] = []
            for p, b, blob in zip(*(rows.column(c).to_pylist() for c in ("part", "batch", "blob"))):
                if p != part:
                    part, held, known = p, [], None
                if b < 0:  # counts come before what is asked
                    held.append(blob)
                    continue
                if known is None:
                    known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64, len(x) // 12) for x in held)])
                    term = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32, offset=len(x) // 12 * 8) for x in held)])
                    at, held = np.argsort(known), []
                    known, term = known[at], term[at]
                h = np.frombuffer(blob, np.uint64)
                found = np.full(len(h), unseen)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    found = np.where(known[at] == h, term[at], found)
                out.append((b, p, found.tobytes()))
            if out:
                b, p, blob = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int64()), pa.array(blob, pa.binary())],
                                                 ["batch", "part", "blob"])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, terms = None, []

        def finish() -> pa.RecordBatch:
            ids, n, sums, ends, codes = row
            codes = unplane(codes, len(codes) // 4, 4, np.int32)
            term = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in terms)])
            total = sums + _sums(term[codes].astype(np.float64), np.append(0, ends))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)],
                ["id", "n_words", "log_prob", "mean_log_prob"])

        for rows in batches:
            for i, p in enumerate(rows.column("part").to_pylist()):
                if p < 0:
                    if row is not None:
                        yield finish()
                    lists = [rows.column(c)[i].values for c in ("ids", "n", "sums", "ends")]
                    row, terms = (lists[0], *(x.to_numpy() for x in lists[1:]), rows.column("codes")[i].as_py()), []
                else:
                    terms.append(rows.column("blob")[i].as_py())
        if row is not None:
            yield finish()

    with batch_bytes(spark):
        entered = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(enter, ddl), "lm-entered")
        asked = entered.where("part >= 0").select("batch", "part", "blob")
        terms = (asked.unionAll(model.counts.mapInArrow(counts, "batch long, part long, blob binary"))
                 .repartition(parts, "part").sortWithinPartitions("part", "batch")
                 .mapInArrow(look, "batch long, part long, blob binary"))
        both = entered.where("part < 0").drop("blob").unionByName(terms, allowMissingColumns=True)
        scored = stored(both.repartition(parts, "batch").sortWithinPartitions("batch", "part")
                        .mapInArrow(leave, f"id {kind}, n_words long, log_prob double, mean_log_prob double"), "lm-scored")
    return scored.withColumnRenamed("id", id_col)
