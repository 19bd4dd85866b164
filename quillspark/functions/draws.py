"""Seeded draws that are a pure function of the row.

One md5 digest per (seed, id, tag, position) yields four independent 32-bit draws. A draw
never depends on partitioning, task retries or row order, so every job built on it gives
the same rows on 1 or 10,000 partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAW_SPAN = 1 << 32


def digest(seed: int, row_id: Column, tag: str, pos: Column | int | str = 0) -> Column:
    """md5 of ``seed|id|tag|pos`` in hex, shared by the draws of one decision."""
    head, own = F.lit(f"{seed}|"), row_id.cast("string")
    if isinstance(pos, Column):
        return F.md5(F.concat(head, own, F.lit(f"|{tag}|"), pos.cast("string")))
    return F.md5(F.concat(head, own, F.lit(f"|{tag}|{pos}")))


def _slot(dig: Column, slot: int) -> Column:
    return F.substring(dig, 1 + 8 * slot, 8)


def gate(dig: Column, p: float, slot: int = 0) -> Column:
    """True with probability ``p``: compares hex text, so no number parsing per row."""
    if p >= 1.0:
        return F.lit(True)
    return _slot(dig, slot) < F.lit(f"{round(p * DRAW_SPAN):08x}")


def gate_blocks(seed: int, row_id: Column, tag: str, size: Column) -> Column:
    """Digests for the gates of ``size`` positions, eight positions per digest."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(size, 3)),
                       lambda b: digest(seed, row_id, tag, b))


def gate_at(blocks: Column, pos: Column, p: float) -> Column:
    """Gate of one position, on 16 bits of its digest: one md5 serves eight words."""
    hexes = F.substring(F.get(blocks, F.shiftright(pos, 3)), pos % 8 * 4 + 1, F.lit(4))
    return hexes < F.lit(f"{round(p * (1 << 16)):04x}")


def draw(dig: Column, slot: int = 0) -> Column:
    """Uniform BIGINT in [0, 2^32)."""
    return F.conv(_slot(dig, slot), 16, 10).cast("bigint")


def index(dig: Column, size: Column | int, slot: int = 0) -> Column:
    """Uniform INT in [0, size)."""
    size_col = size if isinstance(size, Column) else F.lit(size)
    return (draw(dig, slot) % size_col.cast("bigint")).cast("int")


def choice(values: list[str] | Column, dig: Column, slot: int = 1) -> Column:
    """Uniform member of an array; slot 1 leaves slot 0 for the gate of the same digest."""
    if isinstance(values, Column):
        return F.get(values, index(dig, F.size(values), slot))
    arr = F.array(*[F.lit(v) for v in values])
    return F.get(arr, index(dig, len(values), slot))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and reuse it inside ``body`` without re-evaluating it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that are evaluated exactly once per row.

    A filter on a plain projected column is pushed below the projection, where Spark
    evaluates the column's expression again for every reference. Generated columns stop
    that, which matters when the expression is a whole text transformation.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def shuffle_key(seed: int, row_id: Column, tag: str = "shuf") -> Column:
    """Persistable random order: sort by this draw, then by id, to shuffle."""
    return draw(digest(seed, row_id, tag))
