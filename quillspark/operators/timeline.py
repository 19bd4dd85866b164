"""Neighbour and running values per key that survive a hot key.

``Window.partitionBy(user)`` puts all events of a user on one task. Here every key is cut
into time chunks: a window runs inside (key, chunk), and what must cross a chunk border is
read from a summary with one row per (key, chunk). A key with a third of all rows is thus
spread over as many tasks as it has chunks. A burst that fills one chunk is cut again by row
count, so no window holds more than a bounded number of rows however the times are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quota import materialise

CHUNK_ROWS = 1_000_000  # rows of one (key, chunk), at most
MAX_CUTS = 4            # times the ranges of bursts are halved until all are within the bound


def micros(ts: str | Column) -> Column:
    """BIGINT microseconds of a timestamp; zone-less values are read in the session zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


class Timeline:
    """Events of ``keys`` ordered by ``order`` (first column: BIGINT micros).

    Chunks are ``chunk_us`` long. Where one holds more than ``max_rows`` rows of a key it is cut
    into ranges of the whole order, at sampled points. Rows that agree in the whole order stay in one
    range, so the bound needs an order that tells rows apart, as one that ends in a row id does.
    ``max_rows=None`` skips the count, for callers whose chunks are bounded by construction. Rows
    with a NULL time are a chunk of their own, before all others.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_us: int,
                 max_rows: int | None = CHUNK_ROWS):
        self.keys, self.order = list(keys), list(order)
        # Structs are never NULL themselves, so rows with NULL keys or times match in the joins too.
        self.df = df.withColumns({"_key": F.struct(*self.keys), "_chunk": F.struct(
            F.expr(f"`{order[0]}` div {chunk_us}L").alias("at"), F.lit(0).alias("cut"))})
        self._part = ["_key", "_chunk"]
        if max_rows is not None:
            self._cut_bursts(max_rows)

    def _cut_bursts(self, max_rows: int) -> None:
        """Give the rows of too large chunks the number of their range as second part of the chunk."""
        heavy = self.df.groupBy(*self._part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
        rows = heavy.agg(F.sum("_n")).first()[0]
        if rows is None:
            return
        heavy = materialise(heavy, "timeline-heavy")
        burst = materialise(self.df.join(heavy.select(*self._part), self._part, "left_semi"), "timeline-burst")
        ranges = 2 * -(-rows // max_rows)
        for _ in range(MAX_CUTS):
            cut = burst.repartitionByRange(ranges, *self._part, *self.order).withColumn(
                "_chunk", F.struct(F.col("_chunk.at").alias("at"), F.spark_partition_id().alias("cut")))
            cut = materialise(cut, "timeline-cut")
            largest = cut.groupBy(*self._part).count().agg(F.max("count")).first()[0]
            if largest <= max_rows:
                break
            ranges *= 2
        calm = self.df.join(heavy.select(*self._part), self._part, "left_anti")
        self.df = calm.unionByName(cut)

    def _pos(self) -> list[Column]:
        return [F.col(c) for c in self.order]

    def _window(self, descending: bool = False):
        order = [c.desc() if descending else c.asc() for c in self._pos()]
        return Window.partitionBy(*self._part).orderBy(*order)

    def _carried(self, summary: Column, carry, local: Column, out: str,
                 descending: bool = False) -> Timeline:
        across = Window.partitionBy("_key").orderBy(
            F.col("_chunk").desc() if descending else F.col("_chunk").asc())
        table = (self.df.groupBy(*self._part).agg(summary.alias("_s"))
                 .select(*self._part, carry(across).alias("_c")))
        joined = self.df.join(table, self._part, "left")
        self.df = joined.withColumn(out, local).drop("_c")
        return self

    def _packed(self, cols: Sequence[str]) -> tuple[Column, Column]:
        value = F.struct(*[F.col(c) for c in cols])
        return value, F.struct(*self._pos(), value.alias("_v"))

    def _neighbour(self, cols, out, where: Column | None, after: bool) -> Timeline:
        value, placed = self._packed(cols)
        hit = value if where is None else F.when(where, value)
        placed = placed if where is None else F.when(where, placed)
        before = self._window(after).rowsBetween(Window.unboundedPreceding, -1)
        local = F.last(hit, ignorenulls=True).over(before)
        summary = (F.min if after else F.max)(placed)

        def carry(across):
            past = across.rowsBetween(Window.unboundedPreceding, -1)
            return F.last("_s", ignorenulls=True).over(past)["_v"]

        return self._carried(summary, carry, F.coalesce(local, F.col("_c")), out, after)

    def previous(self, cols: Sequence[str], out: str, where: Column | None = None) -> Timeline:
        """Struct of ``cols`` from the nearest earlier row (matching ``where``), or NULL."""
        return self._neighbour(cols, out, where, after=False)

    def following(self, cols: Sequence[str], out: str, where: Column | None = None) -> Timeline:
        """Struct of ``cols`` from the nearest later row (matching ``where``), or NULL."""
        return self._neighbour(cols, out, where, after=True)

    def running(self, amount: Column, out: str) -> Timeline:
        """Running sum of ``amount`` up to and including the row."""
        local = F.sum(amount).over(self._window())

        def carry(across):
            return F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, -1))

        return self._carried(F.sum(amount), carry,
                             local + F.coalesce(F.col("_c"), F.lit(0)), out)

    def running_max(self, value: Column, out: str) -> Timeline:
        """Running maximum of ``value`` up to and including the row."""
        local = F.max(value).over(self._window())

        def carry(across):
            return F.max("_s").over(across.rowsBetween(Window.unboundedPreceding, -1))

        return self._carried(F.max(value), carry, F.greatest(local, F.col("_c")), out)

    def result(self) -> DataFrame:
        return self.df.drop("_key", "_chunk")
