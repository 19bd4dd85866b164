"""Fingerprints by a randomised embedding of edit distance into Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, smallest_linked, stored

SLOTS = 128       # sampled positions, one hexadecimal digit each
PERIOD = 4096     # steps after which the shared random bits repeat
BLOCK = 256       # steps between two looks at which walks have ended
SEED = 17
BLOCK_ROWS = 512  # fingerprints of one band's key in a block

_rng = np.random.default_rng(SEED)
# Whether the walk moves on after step j on a character of class c: the same for every text.
MOVE = _rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
MOVE_BYTES = [bytes(row.astype(np.uint8)) for row in MOVE]
_ODD = (_rng.integers(1, 1 << 31, SLOTS) * 2 + 1).astype(np.uint64)


def _records() -> np.ndarray:
    """Per slot the positions that are its sample for some walk length.

    The slot samples the last record below the length: uniform over the walk, and the same
    position for nearly equal lengths.
    """
    rng, out = np.random.default_rng(SEED + 1), np.full((SLOTS, 80), 1 << 62, np.int64)
    for k in range(SLOTS):
        at, i = 0, 0
        while at < 1 << 40 and i < 80:
            out[k, i] = at
            at, i = int((at + 1) / (1 - rng.random())), i + 1
    return out


RECORDS = _records()


def sampled(length: np.ndarray) -> np.ndarray:
    """(text, slot) -> step whose character is sampled, for texts of these lengths."""
    steps = 2 * length + (4 * np.sqrt(length)).astype(np.int64) + 8
    return np.stack([r[np.searchsorted(r, steps) - 1] for r in RECORDS], axis=1)


def fingerprints(texts: list[str]) -> list[str]:
    """A digit per slot: a hash of the two characters under the walk at the sampled step, or
    ``-`` where the walk had left the text. Empty texts have dashes only."""
    if not texts:
        return []
    length = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.zeros(len(points) + 2 * BLOCK, np.uint8)
    classes[:len(points)] = (points * np.uint32(2654435761)) >> np.uint32(24)
    start = np.cumsum(length) - length
    end, steps = start + length, sampled(length)
    at = np.full(steps.shape, -1, np.int64)  # index under the walk at the sampled step
    order = np.argsort(steps, axis=1)
    ranked = np.take_along_axis(steps, order, axis=1)
    taken = np.zeros(len(texts), np.int64)
    live, where, j = np.flatnonzero(length > 0), start.copy(), 0
    while len(live) >= 12:
        trace, w = np.empty((BLOCK, len(live)), np.int64), where[live]
        for b in range(BLOCK):
            trace[b] = w
            w = w + MOVE[(j + b) % PERIOD][classes[w]]
        where[live] = w
        upto = np.array([np.searchsorted(r, j + BLOCK) for r in ranked[live]])
        col, rank = _ragged(taken[live], upto)
        row = live[col]
        slot = order[row, rank]
        at[row, slot] = trace[ranked[row, rank] - j, col]
        taken[live] = upto
        j += BLOCK
        live = live[(where[live] < end[live]) & (upto < SLOTS)]
    flat = classes.tobytes()
    for i in live:  # the few longest: one by one
        w, last, step, todo = int(where[i]), int(end[i]), j, ranked[i, taken[i]:].tolist()
        for k, goal in enumerate(todo, int(taken[i])):
            while step < goal and w < last:
                w += MOVE_BYTES[step % PERIOD][flat[w]]
                step += 1
            at[i, order[i, k]] = w if w < last else -1
    at[at >= end[:, None]] = -1
    pair = classes[at].astype(np.uint64) * np.uint64(256) + np.where(
        at + 1 < end[:, None], classes[at + 1], 0).astype(np.uint64) + np.uint64(1)
    digit = ((pair * _ODD) >> np.uint64(20)) & np.uint64(15)
    letters = np.frombuffer(b"0123456789abcdef", np.uint8)[digit.astype(np.int64)]
    letters = np.where(at >= 0, letters, ord("-")).astype(np.uint8)
    return [row.tobytes().decode() for row in letters]


def _ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value in low[row]..high[row]-1."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal digits among slots that both texts reach, less what chance gives: 0 to 1.

    1 for equal fingerprints, 0 where no slot is reached by both.
    """
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(
        (x == "-") | (y == "-") | (x == ""), F.lit(None)).otherwise((x == y).cast("int")))
    both = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda s, p: F.struct(
        (s["n"] + F.when(p.isNull(), 0).otherwise(1)).alias("n"), (s["e"] + F.coalesce(p, F.lit(0))).alias("e")))
    share = F.when(both["n"] > 0, both["e"] / both["n"]).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (share - 1 / 16) * (16 / 15)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every whole text; null counts as empty. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints(texts))],
                ["id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows of (part, last, k, id, text), and the number of parts: each document stands right
    before the next one (ascending id, then text hash; a null id first) of the same part.

    Parts are ranges of ids between approximate quantiles. The first document of each part is
    copied behind the last of the part before it, the very first behind the last part, so
    texts are shuffled once and no task needs another's rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    wide = max(1, int(len(cuts) ** 0.5))
    # Two short looks instead of one along all cuts: which stretch, then where in it.
    coarse = F.array(*[F.lit(c) for c in cuts[wide - 1::wide]]) if len(cuts) >= wide and cuts else F.array().cast("array<bigint>")
    fine = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    below = F.size(F.filter(coarse, lambda c: c <= F.col("k"))) * wide
    part = below + F.size(F.filter(F.slice(fine, below + 1, wide), lambda c: c <= F.col("k")))
    rows = rows.withColumn("part", part).withColumn("h", F.xxhash64("text"))
    firsts = rows.groupBy("part").agg(F.min(F.struct("k", "h")).alias("f")).orderBy("part").collect()  # a row per part
    moved = [(r["f"]["k"], r["f"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    copies = F.broadcast(spark.createDataFrame(moved, "k long, h long, into int"))
    both = rows.join(copies, ["k", "h"], "left").withColumn("p", F.explode(F.array(
        F.struct(F.col("part").alias("part"), F.lit(0).alias("last")), F.struct(F.col("into").alias("part"), F.lit(1).alias("last")))))
    both = both.where("p.part is not null").select("p.part", "p.last", "k", "h", "id", "text")
    return both.repartition(parts, "part").sortWithinPartitions("part", "last", "k", "h"), parts


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) per row.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many
    (or all) of the next document in order of id; the last document is followed by the first, a
    single one by itself. Null text counts as empty; of repeated ids one follows the other.
    """
    rows, _ = with_next(docs, id_col, text_col)

    def edited(text: str, after: str) -> str:
        q = len(text) // 4
        return text[:len(text) - q] + after[:q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        queue: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, texts, new, after = zip(*queue)
            marks = fingerprints([*texts, *new, queue[-1][3]])
            n, own = len(ids), {}
            own = dict(zip(texts, marks))
            following = [own[t] if t in own else marks[-1] for t in after]
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind_arrow), pa.array([len(t) for t in texts], pa.int64()), pa.array(new), pa.array(marks[:n]),
                 pa.array(marks[n:2 * n]), pa.array(following)],
                ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"])
            queue.clear()
            return out

        kind_arrow, held = pa.int64(), 0
        for batch in batches:
            kind_arrow = batch.schema.field("id").type
            for part, last, i, text in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "id", "text"))):
                if before is not None and before[0] == part:
                    queue.append((before[1], before[2], edited(before[2], text), text))
                    held += len(before[2])
                before = None if last else (part, i, text)
                if queue and (last or held > 1 << 20):
                    yield flush()
                    held = 0
        if queue:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("part", "last", "id", "text").mapInArrow(
        run, f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    ).withColumnRenamed("id", id_col)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                   bands: int = 16) -> DataFrame:
    """(id, fingerprint, class_id): documents joined by verified likeness of at least ``threshold``.

    Each band samples digits of the fingerprint; of fingerprints that agree in a band every pair is
    compared, and those alike enough are linked. Many in one band are cut in blocks, and each pair of
    blocks is a piece of work of its own: the work of a band's key grows with the square of its rows,
    what comes out is at most a row per fingerprint and piece.
    Equal fingerprints are one row from the start. Approximate: a pair at likeness 0.8 agrees
    in one of the bands, and is then compared, with probability 0.95. Null ids link with nothing.
    """
    marks = stored(fingerprint(docs, id_col, text_col), "prints")
    heads = marks.groupBy("fingerprint").agg(F.min(id_col).alias("head"))
    kind = heads.schema["head"].dataType.simpleString()
    width = SLOTS // bands
    rows = heads.where("head is not null and fingerprint rlike '[0-9a-f]'").select("head", "fingerprint", F.explode(F.array(*[F.struct(
        F.lit(b).alias("band"), F.concat(*[F.substring("fingerprint", 1 + b + bands * i, 1) for i in range(width)]).alias("key"))
        for b in range(bands)])).alias("b")).select("head", "fingerprint", "b.*").where("not key rlike '^-*$'")
    shape = stored(rows.groupBy("band", "key").agg(F.count("*").alias("rows")).where("rows > 1")
                   .select("band", "key", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks")), "print-bands")
    zero = F.lit(0).cast("long")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(zero.alias("x"), zero.alias("y")))).otherwise(
        F.transform(F.filter(F.sequence(zero, F.col("blocks") - 1), lambda j: j != F.col("blk")),
                    lambda j: F.struct(F.least(j, F.col("blk")).alias("x"), F.greatest(j, F.col("blk")).alias("y"))))
    work = (rows.join(shape, ["band", "key"]).withColumn("blk", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
            .withColumn("p", F.explode(pairs)).select("band", "key", "p.x", "p.y", "head", "fingerprint"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, prints, head_type = None, [], [], pa.int64()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], head_type), pa.array([b for _, b in out], head_type)], ["a", "b"])
            out.clear()
            return made

        for batch in batches:
            head_type = batch.schema.field("head").type
            for *k, i, mark in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "x", "y", "head", "fingerprint"))):
                if k != last:
                    out += _linked(ids, prints, threshold)
                    last, ids, prints = k, [], []
                ids.append(i)
                prints.append(mark)
            if len(out) > 1000:
                yield flush()
        out += _linked(ids, prints, threshold)
        yield flush()

    good = (work.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y")
            .mapInArrow(compare, f"a {kind}, b {kind}"))
    roots = smallest_linked(good, "prints")
    named = heads.join(roots, heads["head"] == roots["id"], "left").select(
        "fingerprint", F.coalesce("root", "head").alias("class_id"))
    return marks.join(named, "fingerprint").select(id_col, "fingerprint", "class_id")


def alike(prints: list[str], threshold: float) -> np.ndarray:
    """(row, row): whether the ``likeness`` of two fingerprints is at least ``threshold``."""
    raw = np.frombuffer("".join(prints).encode(), np.uint8).reshape(len(prints), SLOTS)
    there = (raw != ord("-")).astype(np.float32)
    both, same = there @ there.T, np.zeros((len(prints), len(prints)), np.float32)
    for digit in b"0123456789abcdef":
        has = (raw == digit).astype(np.float32)
        same += has @ has.T
    share = same.astype(np.float64) / np.maximum(both, 1).astype(np.float64)
    score = np.where(both > 0, np.maximum(0.0, (share - 1 / 16) * (16 / 15)), 0.0)
    return score >= threshold


def _linked(ids: list, prints: list[str], threshold: float) -> list[tuple]:
    """(id, smallest id of those it is linked to through others here), every pair compared."""
    if len(ids) < 2:
        return []
    near, left, out = alike(prints, threshold), np.ones(len(ids), bool), []
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        if left[i]:
            group, edge = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            edge[i] = True
            while edge.any():
                group |= edge
                edge = near[edge].any(0) & ~group
            left &= ~group
            out += [(ids[j], ids[i]) for j in np.flatnonzero(group) if ids[j] != ids[i]]
    return out
