"""Debounce of any length, without a list of events or of chunks.

Keys are cut into chunks of time. One pass over the sorted rows of a chunk gives its exit table: for the
last accepted time before the chunk, the last accepted time after it. Exit tables are rows. They are composed
pairwise, level by level, and going down again every chunk learns the time through which
it is really entered; a second pass then accepts the rows of each chunk on its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quota import materialise
from .timeline import Timeline

DEBOUNCE_US = 150_000  # fixed value: production time constant in microseconds
_NEVER = -(1 << 62)  # entered without influence
_ALWAYS = 1 << 62    # threshold of the row for entries that block the whole chunk
_CHAIN = ["_k", "_run", "_j"]


class _Exits:
    """The exit table of one chunk, from its times in order.

    A chunk is entered at one of the times of its first gap, or at the first time after that. The chains
    from all these are followed at once; those that accept the same time are one from there on. As
    chains wait in the order of their last time, only their number is ever held, not their length.
    """

    def __init__(self, gap: int):
        self.gap, self.first, self.last, self.entries = gap, None, None, []
        self.chains: deque[tuple[int, list[list[int]]]] = deque()

    def _enter(self, t: int, joined: list[list[int]]) -> None:
        self.entries.append(t)
        number = len(self.entries) - 1
        if joined and joined[-1][1] == number - 1:
            joined[-1][1] = number
        else:
            joined.append([number, number])

    def feed(self, times: np.ndarray) -> None:
        if self.first is None:
            self.first = int(times[0])
        edge, gap, at = self.first + self.gap, self.gap, 0
        if self.last is None or self.last < edge:
            at = int(np.searchsorted(times, edge))
            for t in np.unique(times[:at]).tolist():
                if not self.entries or t > self.entries[-1]:
                    self.chains.append((t, []))
                    self._enter(t, self.chains[-1][1])
        while self.chains:
            at += int(np.searchsorted(times[at:], self.chains[0][0] + gap))
            if at >= len(times):
                break
            t, joined = int(times[at]), []
            while self.chains and self.chains[0][0] + gap <= t:
                for span in self.chains.popleft()[1]:
                    if joined and joined[-1][1] + 1 == span[0]:
                        joined[-1][1] = span[1]
                    else:
                        joined.append(span)
            if self.entries[-1] < edge:
                self._enter(t, joined)
            self.chains.append((t, joined))
        self.last = int(times[-1])

    def rows(self) -> list[tuple[int, int | None]]:
        """(largest entry time, exit) in order; the exit None leaves the entry as it is."""
        spans = sorted((span[1], exit_) for exit_, joined in self.chains for span in joined)
        table = [(self.entries[hi] - self.gap, exit_) for hi, exit_ in spans]
        return table if self.entries[-1] >= self.first + self.gap else [*table, (_ALWAYS, None)]


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(key, slot, from, to) of the runs of equal key and slot in a sorted batch."""
    key, slot = batch.column("_k").dictionary_encode(), batch.column("_slot").to_numpy()
    code = key.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (slot[1:] != slot[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield key.dictionary[code[a]].as_py(), int(slot[a]), a, b


_EXIT_SCHEMA = "_k string, _slot bigint, _first bigint, _last bigint, _u bigint, _x bigint"


def _exit_tables(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(at, table):
            rows = table.rows()
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array([table.first] * n, pa.int64()),
                 pa.array([table.last] * n, pa.int64()), pa.array([u for u, _ in rows], pa.int64()),
                 pa.array([x for _, x in rows], pa.int64())],
                names=["_k", "_slot", "_first", "_last", "_u", "_x"])

        at, table = None, None
        for batch in batches:
            times = batch.column("_t").to_numpy()
            for k, slot, a, b in _segments(batch):
                if (k, slot) != at:
                    if table is not None:
                        yield made(at, table)
                    at, table = (k, slot), _Exits(gap)
                table.feed(times[a:b])
        if table is not None:
            yield made(at, table)
    return run


def _accepted(gap: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Accepted rows of sorted chunks; a chunk's first row may be a marker with its entry time."""
        at, last = None, _NEVER
        for batch in batches:
            times, marks = batch.column("_t").to_numpy(), batch.column("_mark").to_numpy(zero_copy_only=False)
            entries = batch.column("_entry")
            keep = np.zeros(batch.num_rows, bool)
            for k, slot, a, b in _segments(batch):
                if (k, slot) != at:
                    at, last = (k, slot), _NEVER
                if marks[a]:
                    last, a = entries[a].as_py(), a + 1
                while a < b:
                    a += int(np.searchsorted(times[a:b], last + gap))
                    if a < b:
                        keep[a], last = True, int(times[a])
                        a += 1
            yield batch.filter(pa.array(keep)).select(columns)
    return run


def _composed(even: DataFrame, odd: DataFrame) -> DataFrame:
    """Exit tables of pairs of neighbouring blocks; a block without a right neighbour stays as it is.

    Every exit of the left block is looked up in the right one: the row with the smallest threshold
    that is not below it. Entries that pass the left block untouched meet the right one's rows.
    """
    asked = even.select(*_CHAIN, F.col("_x").alias("_at"), F.lit(0).alias("_tag"), "_u", "_x", F.lit(None).cast("bigint").alias("_to"))
    offered = odd.select(*_CHAIN, F.col("_u").alias("_at"), F.lit(1).alias("_tag"), F.lit(None).cast("bigint").alias("_u"),
                         F.lit(None).cast("bigint").alias("_x"), F.col("_x").alias("_to"))
    ahead = Window.partitionBy(*_CHAIN).orderBy("_at", "_tag").rowsBetween(0, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("_tag") == 1, F.struct("_to")), ignorenulls=True).over(ahead)
    through = (asked.where("_x IS NOT NULL").unionAll(offered).withColumn("_hit", hit).where("_tag = 0")
               .select(*_CHAIN, "_u", F.coalesce("_hit._to", "_x").alias("_x")))
    # ``_open``: the left block lets late entries pass; ``_from``: those above its last threshold.
    left = even.groupBy(*_CHAIN).agg(F.max(F.when(F.col("_x").isNotNull(), F.col("_u"))).alias("_from"),
                                     F.max(F.col("_x").isNull()).alias("_open")).where("_open")
    right = odd.join(left, _CHAIN).where("_u > _from").select(*_CHAIN, "_u", "_x")
    alone = even.where("_x IS NULL").join(odd.select(*_CHAIN).distinct(), _CHAIN, "left_anti")
    return through.unionAll(right).unionAll(alone.select(*_CHAIN, "_u", "_x"))


def _entry_times(exits: DataFrame, gap: int) -> DataFrame:
    """(_k, _slot, _entry) of the chunks that an accepted time before them influences.

    After a pause of a gap, or after a chunk that all entries leave alike, the entry is known at once.
    Only the runs of chunks between such places are composed.
    """
    slots = exits.groupBy("_k", "_slot").agg(
        F.first("_first").alias("_first"), F.first("_last").alias("_last"),
        F.when(F.count("*") == 1, F.max("_x")).alias("_only"))
    before = Timeline(slots, ["_k"], ["_slot"], 4096, max_rows=None).previous(["_last", "_only"], "_before").result()
    fresh = F.col("_before").isNull() | (F.col("_first") - F.col("_before._last") >= gap)
    placed = materialise(before.select("_k", "_slot", F.when(fresh, F.lit(_NEVER)).otherwise(
        F.col("_before._only")).alias("_known")), "debounce-slots")
    known = placed.where(F.col("_known") > _NEVER).select("_k", "_slot", F.col("_known").alias("_entry"))
    if placed.where("_known IS NULL").isEmpty():
        return known
    # Only keys with an unknown entry go on: their chunks are numbered from the last known one.
    some = placed.join(placed.where("_known IS NULL").select("_k").distinct(), "_k", "left_semi")
    runs = Timeline(some, ["_k"], ["_slot"], 4096, max_rows=None).running(F.lit(1).cast("bigint"), "_n").running_max(
        F.when(F.col("_known").isNotNull(), F.col("_n")), "_run").result()
    runs = runs.select("_k", "_slot", "_known", "_run", (F.col("_n") - F.col("_run")).alias("_j"))
    level = materialise(exits.join(runs, ["_k", "_slot"]), "debounce-runs")
    chain = level.select("_k", "_slot", "_known", "_run", "_j").distinct()
    longest = level.agg(F.max("_j")).first()[0]
    level = level.select(*_CHAIN, "_u", "_x")
    levels, blocks = [], longest + 1
    while blocks > 1:
        levels.append(level)
        halved = level.withColumn("_right", F.col("_j") % 2 == 1).withColumn("_j", F.expr("_j div 2"))
        blocks = -(-blocks // 2)
        if blocks > 1:
            level = materialise(_composed(halved.where("NOT _right"), halved.where("_right")), "debounce-level")
    entered = chain.where("_j = 0").select(*_CHAIN, F.col("_known").alias("_entry"))
    for level in reversed(levels):
        # Of each pair the left block is entered like the pair, the right one through the left's exit.
        left = entered.withColumn("_j", F.col("_j") * 2)
        passed = (left.join(level, _CHAIN).where("_u >= _entry").groupBy(*_CHAIN, "_entry")
                  .agg(F.min(F.struct("_u", "_x")).alias("_hit"))
                  .select("_k", "_run", (F.col("_j") + 1).alias("_j"), F.coalesce("_hit._x", "_entry").alias("_entry")))
        right = passed.join(level.select(*_CHAIN).distinct(), _CHAIN, "left_semi")
        entered = left.unionAll(right)
        if level is not levels[0]:
            entered = materialise(entered, "debounce-entered")
    return chain.join(entered, _CHAIN).where("_j > 0").select("_k", "_slot", "_entry").unionAll(known)


def _key(keys: list[str]) -> Column:
    """One string for the keys: each with its length, or a mark for NULL."""
    texts = [F.col(k).cast("string") for k in keys]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def debounce(df: DataFrame, keys: Sequence[str], t: str, row_id: str, gap_us: int = DEBOUNCE_US,
             chunk: int = 1024) -> DataFrame:
    """Keep events at least ``gap_us`` after the last *accepted* event of their key.

    Of events at one moment the one with the smallest id counts as first. Rows with NULL keys are one key
    of their own, rows without a time are left out. Chunks are ``chunk`` gaps long and pass through tasks as sorted
    rows, so a key of any length spreads over as many tasks as it has chunks. Tasks hold the
    chains of one gap at most. The composition of exit tables takes twice as many rounds as the
    longest run of chunks that keep their entries apart has binary digits.
    """
    if gap_us <= 0:
        return df.where(F.col(t).isNotNull()).select(*keys, t, row_id)
    keys, span = list(keys), gap_us * chunk
    rows = df.where(F.col(t).isNotNull()).select(
        *keys, t, row_id, _key(keys).alias("_k"),
        F.expr(f"`{t}` div {span}L").alias("_slot"), F.col(t).alias("_t"))
    # Of equal times only one can be accepted, and tables need no more than the times.
    sorted_times = rows.select("_k", "_slot", "_t").repartition("_k", "_slot").sortWithinPartitions("_k", "_slot", "_t")
    exits = materialise(sorted_times.mapInArrow(_exit_tables(gap_us), _EXIT_SCHEMA), "debounce-exits")
    marks = _entry_times(exits, gap_us).select("_k", "_slot", F.lit(_NEVER).alias("_t"), "_entry", F.lit(True).alias("_mark"))
    both = rows.withColumns({"_entry": F.lit(None).cast("bigint"), "_mark": F.lit(False)}).unionByName(
        marks, allowMissingColumns=True)
    columns = [*keys, t, row_id]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return (both.repartition("_k", "_slot").sortWithinPartitions("_k", "_slot", "_t", row_id)
            .mapInArrow(_accepted(gap_us, columns), schema))
