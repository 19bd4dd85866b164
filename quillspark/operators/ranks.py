"""Exact order statistics of skewed groups: all wanted ranks of all groups are refined together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quota import materialise

ACCURACY = 10_000
SLACK = 4            # half width of a first bracket, in units of the sketch's rank error
LIMIT = 100_000      # values of a bracket that one window may rank
BUCKETS = 1024       # cells of a bracket in one level of refinement
BROADCAST_BYTES = 8 << 20


def _wide(count: int, limit: int) -> list[Column]:
    """Per rank: its bracket may hold more values than the limit."""
    return [(F.col(f"_m{i}") > limit) & (F.col(f"_lo{i}") < F.col(f"_hi{i}")) for i in range(count)]


def _measured(brackets: DataFrame, wide: list[Column]) -> tuple[bool, bool]:
    """(is any bracket too wide, is the table small enough to broadcast), in one job."""
    rows, widest, any_wide = brackets.agg(
        F.count(F.lit(1)), F.max(F.length(F.to_json("_g"))), F.max(reduce(Column.__or__, wide))).first()
    return bool(any_wide), rows * (4 * (widest or 0) + 64 * (1 + len(wide))) <= BROADCAST_BYTES


def _cell(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """The cell of a value in its bracket. Each step is monotone under rounding, so the cells of
    ascending values ascend; the ends are quartered first, so their difference stays finite."""
    width = hi / 4 - lo / 4
    even = F.least(F.floor((v / 4 - lo / 4) / width * buckets).cast("int"), F.lit(buckets - 1))
    return F.when(width > 0, even).when(v < hi, 0).otherwise(buckets - 1)


def _refined(rows: DataFrame, brackets: DataFrame, count: int, limit: int, buckets: int, small: bool) -> DataFrame:
    """One level: brackets above the limit are cut to the cell that holds their rank. One scan of the rows.

    The histogram has a row per group and cell, combined map-side, with the smallest and largest value of
    the cell, which become the new bracket: a cell never holds both ends of the old one, so every
    level leaves fewer values.
    """
    wide = _wide(count, limit)
    open_ = brackets.where(reduce(Column.__or__, wide)).select(
        "_g", *[F.when(wide[i], F.col(f"_{x}{i}")).alias(f"_{x}{i}") for i in range(count) for x in ("lo", "hi", "r")])
    v = F.col("_v")
    cells = [F.when(v < F.col(f"_lo{i}"), -1).when(v <= F.col(f"_hi{i}"), _cell(v, F.col(f"_lo{i}"), F.col(f"_hi{i}"), buckets))
             for i in range(count)]
    found = (rows.join(F.broadcast(open_) if small else open_, "_g")
             .groupBy("_g", *[F.col(f"_r{i}") for i in range(count)], *[c.alias(f"_b{i}") for i, c in enumerate(cells)])
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    # One row per group, rank and cell; the cells of other ranks' brackets are summed up.
    each = found.select("_g", "_c", "_least", "_most", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_r{i}").alias("_rank"), F.col(f"_b{i}").alias("_b")) for i in range(count)])))
    summed = each.where("_rank IS NOT NULL AND _b IS NOT NULL").groupBy("_g", "_i", "_rank", "_b").agg(
        F.sum("_c").alias("_c"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_i").orderBy("_b"))
    hit = summed.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    cut = hit.groupBy("_g").agg(*[
        F.max(F.when(F.col("_i") == i, F.struct(F.col("_least").alias("lo"), F.col("_most").alias("hi"), F.col("_c").alias("m"))))
        .alias(f"_n{i}") for i in range(count)])
    return brackets.join(cut, "_g", "left").select("_g", *[f"_r{i}" for i in range(count)], *[
        F.coalesce(F.col(f"_n{i}.{x}"), F.col(f"_{x}{i}")).alias(f"_{x}{i}") for i in range(count) for x in ("lo", "hi", "m")])


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, tuple[float, Column]],
                     extra: dict[str, Column] | None = None, limit: int = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """The groups as ``_g``, n, ``extra``, and per entry of ``ranks`` the value at that rank, all exact.

    ``ranks`` maps a name to a share of the rows and to the rank (from 0) as an expression of ``n``; ``extra`` are
    further aggregates of ``_v``. Pass one finds a bracket of values around each rank with a map-side
    combined quantile sketch of guaranteed rank error. While a bracket may hold more than ``limit`` values,
    one more pass cuts all such brackets at once by a histogram. The last pass counts the rows below
    each bracket and ranks the distinct values inside: a window holds ``limit`` values a rank at most.

    Values are finite numbers. NULL groups are groups, NULL values are not counted, a group without
    values has n = 0 and NULL figures; an empty table gives no rows.
    """
    names, count = list(ranks), len(ranks)
    rows = df.select(F.struct(*groups).alias("_g"), F.col(value).cast("double").alias("_v"))
    probs = sorted({min(max(p + s * SLACK / ACCURACY, 0.0), 1.0) for p, _ in ranks.values() for s in (-1, 1)})
    first = rows.groupBy("_g").agg(
        F.count("_v").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", probs, ACCURACY).alias("_q"), *[c.alias(k) for k, c in (extra or {}).items()])
    small = F.col("n") <= max(limit, ACCURACY)  # below that the slack is under a rank

    def edge(p: float, side: int) -> Column:
        at = probs.index(min(max(p + side * SLACK / ACCURACY, 0.0), 1.0))
        return F.when(small, F.col("_most" if side > 0 else "_least")).otherwise(F.get("_q", F.lit(at)))

    share = 4 * SLACK / ACCURACY  # the sketch may miss both edges by its error
    first = materialise(first.select(
        "_g", "n", *(extra or {}), *[c.alias(f"_r{i}") for i, (_, c) in enumerate(ranks.values())],
        *[edge(p, side).alias(f"_{x}{i}") for i, (p, _) in enumerate(ranks.values()) for x, side in (("lo", -1), ("hi", 1))],
        *[F.when(small, F.lit(0)).otherwise(F.ceil(F.col("n") * share)).cast("long").alias(f"_m{i}") for i in range(count)]),
        "ranks-first")
    brackets = first.select("_g", *[f"_{x}{i}" for i in range(count) for x in ("r", "lo", "hi", "m")])
    rows = rows.where("_v IS NOT NULL")
    while True:
        open_, light = _measured(brackets, _wide(count, limit))
        if not open_:
            break
        brackets = materialise(_refined(rows, brackets, count, limit, buckets, light), "ranks-level")

    v = F.col("_v")
    bounds = brackets.select("_g", *[f"_{x}{i}" for i in range(count) for x in ("r", "lo", "hi")])
    inside = [v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(count)]
    cells = rows.join(F.broadcast(bounds) if light else bounds, "_g").groupBy(
        "_g", *[f"_r{i}" for i in range(count)], F.when(reduce(Column.__or__, inside), v).alias("_x"),
        *[inside[i].alias(f"_in{i}") for i in range(count)],
        *[(v < F.col(f"_lo{i}")).alias(f"_low{i}") for i in range(count)]).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_g")

    def counted(flag: str) -> Column:
        return F.when(F.col(flag), F.col("_c")).otherwise(0)

    placed = cells.select(
        "_g", *[f"_r{i}" for i in range(count)], "_x", *[counted(f"_in{i}").alias(f"_c{i}") for i in range(count)],
        *[(F.sum(counted(f"_low{i}")).over(whole) + F.sum(counted(f"_in{i}")).over(whole.orderBy("_x"))).alias(f"_u{i}")
          for i in range(count)])

    def at(i: int) -> Column:
        hit = (F.col(f"_r{i}") < F.col(f"_u{i}")) & (F.col(f"_r{i}") >= F.col(f"_u{i}") - F.col(f"_c{i}"))
        return F.max(F.when(hit, F.col("_x")))

    picked = placed.groupBy("_g").agg(*[at(i).alias(name) for i, name in enumerate(names)])
    return first.join(picked, "_g", "left").select("_g", "n", *(extra or {}), *names)
