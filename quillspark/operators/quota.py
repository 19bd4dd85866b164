"""Exact quotas, shuffles, samples and splits without a global sort on one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as d
from ..session import scratch_dir

# Largest k that Spark's window group limit prunes map-side (its default threshold).
GROUP_LIMIT_MAX_K = 1000
SHARES = 64  # parts of a group that are ranked on their own for a larger k


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used where several passes follow an expensive stage: the later passes prune columns and
    lost executors re-read files instead of recomputing the stage.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_k(df: DataFrame, k: int, key: str, groups: Sequence[str] = (),
               tie: Sequence[str] = (), lo: int | None = 0, hi: int | None = d.DRAW_SPAN - 1,
               buckets: int = 4096, max_cut_rows: int = 1_000_000,
               max_levels: int = 5) -> DataFrame:
    """The rows with the k smallest BIGINT keys per group; exact for any k and any skew.

    A histogram of the key (map-side combined, at most ``buckets`` rows per group) locates
    the bucket that contains the k-th row. Lower buckets are kept whole; only the cut
    bucket is ranked. While a cut bucket is still large it is split again, so one task
    never sorts more than about ``max_cut_rows`` rows unless that many share one key.
    Keys must lie in [lo, hi]; if either is None both are measured first. Rows whose group
    is NULL form a group of their own.
    """
    groups, tie = list(groups), list(tie)
    if k <= 0:
        return df.limit(0)
    if lo is None or hi is None:
        lo, hi = df.agg(F.min(key), F.max(key)).first()
        if lo is None:
            return df
    keep = _cut_by_group if groups else _cut_global
    return keep(df, k, key, groups, tie, lo, hi, buckets, max_cut_rows, max_levels)


def _bucket(key: str, base: str, step: int) -> Column:
    return F.expr(f"(`{key}` - {base}) div {step}L")


def _found(hist: DataFrame, groups: list[str], need: Column) -> DataFrame:
    """The histogram row in which the running count reaches ``need``, per group."""
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_b")
    return hist.withColumn("_cum", F.sum("_n").over(w)).where(
        (F.col("_cum") >= need) & (F.col("_cum") - F.col("_n") < need))


def _cut_global(df, k, key, groups, tie, lo, hi, buckets, max_cut_rows, max_levels):
    """Ungrouped form: the cut is three numbers, pushed back to the scan as literals."""
    start, stop, need, kcol = lo, hi + 1, k, F.col(key)
    for _ in range(max_levels):
        step = max(1, -(-(stop - start) // buckets))
        inside = df.where((kcol >= start) & (kcol < stop))
        hist = inside.groupBy(_bucket(key, f"{start}L", step).alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"))
        row = _found(hist, [], F.lit(need)).first()
        if row is None:
            return df
        start, stop = start + row["_b"] * step, start + (row["_b"] + 1) * step
        need -= row["_cum"] - row["_n"]
        if row["_n"] <= max_cut_rows or step == 1:
            break
    cut = df.where((kcol >= start) & (kcol < stop)).orderBy(key, *tie).limit(need)
    return df.where(kcol < start).unionByName(cut)


def _cut_by_group(df, k, key, groups, tie, lo, hi, buckets, max_cut_rows, max_levels):
    """Grouped form: one cut row per group, joined back by the group.

    The group travels as a struct, which is never NULL itself, so NULL groups match in joins.
    """
    columns, df = df.columns, df.withColumn("_g", F.struct(*groups))
    kcol, cuts, width = F.col(key), None, hi - lo + 1
    for _ in range(max_levels):
        step = max(1, -(-width // buckets))
        if cuts is None:
            hist = df.groupBy("_g", _bucket(key, f"{lo}L", step).alias("_b"))
            base, need = F.lit(lo).cast("bigint"), F.lit(k).cast("bigint")
        else:
            inside = df.join(cuts, "_g").where(
                (kcol >= F.col("_lo")) & (kcol < F.col("_hi")))
            hist = inside.groupBy("_g", "_lo", "_need",
                                  _bucket(key, "_lo", step).alias("_b"))
            base, need = F.col("_lo"), F.col("_need")
        found = _found(hist.agg(F.count(F.lit(1)).alias("_n")), ["_g"], need)
        cuts = materialise(found.select(
            "_g",
            (base + F.col("_b") * step).alias("_lo"),
            (base + (F.col("_b") + 1) * step).alias("_hi"),
            (need - (F.col("_cum") - F.col("_n"))).alias("_need"),
            F.col("_n").alias("_in_cut"),
        ), "quota-cut")
        width = step
        worst = cuts.agg(F.max("_in_cut")).first()[0]
        if worst is None or worst <= max_cut_rows or step == 1:
            break
    marked = df.join(cuts, "_g", "left")
    whole = marked.where(F.col("_lo").isNull() | (kcol < F.col("_lo")))
    cut = marked.where((kcol >= F.col("_lo")) & (kcol < F.col("_hi")))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(key, *tie))
    cut = cut.withColumn("_r", rank).where(F.col("_r") <= F.col("_need"))
    return whole.select(*columns).unionByName(cut.select(*columns))


def first_k(df: DataFrame, k: int, order: Sequence[Column], groups: Sequence[str]) -> DataFrame:
    """First k rows per group, for any k.

    Small ks are pruned map-side by the window group limit. For larger ones shares of each
    group are ranked first, so the last step sorts at most ``SHARES * k`` rows of a group.
    """
    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")

    if k > GROUP_LIMIT_MAX_K:
        share = F.pmod(F.spark_partition_id(), F.lit(SHARES))
        df = ranked(df.withColumn("_share", share), *groups, "_share").drop("_share")
    return ranked(df, *groups)


def shuffled(df: DataFrame, seed: int, row_id: Column) -> DataFrame:
    """Random order, with the draw persisted as column ``shuf``.

    Rows go to a partition by their draw and are ordered by it there: a random permutation
    of the whole, without the extra sampling pass over the input that a range sort needs.
    """
    keyed = df.withColumn("shuf", d.shuffle_key(seed, row_id))
    return keyed.repartition("shuf").sortWithinPartitions("shuf", row_id)


def sample_n(df: DataFrame, n: int, seed: int, row_id: Column, tie: Sequence[str],
             tag: str = "sample") -> DataFrame:
    """Exactly min(n, total) rows without replacement."""
    keyed = df.withColumn("_draw", d.shuffle_key(seed, row_id, tag))
    return smallest_k(keyed, n, "_draw", tie=tie).drop("_draw")


def split_flag(seed: int, row_id: Column, val_fraction: float) -> Column:
    """'val' with probability ``val_fraction``; a row never moves when others are added."""
    return F.when(d.gate(d.digest(seed, row_id, "split"), val_fraction),
                  F.lit("val")).otherwise(F.lit("train"))


def split_exact(df: DataFrame, seed: int, row_id: Column, val_fraction: float,
                tie: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(train, val) with exactly ceil(n * fraction) validation rows."""
    n = df.count()
    k = -int(-(n * val_fraction) // 1)
    keyed = df.withColumn("_draw", d.shuffle_key(seed, row_id, "split"))
    at = F.struct("_draw", *tie)
    last = smallest_k(keyed, k, "_draw", tie=tie).agg(F.max(at)).first()[0]
    chosen = F.lit(False) if last is None else at <= F.struct(*[
        F.lit(last[c]).cast(keyed.schema[c].dataType).alias(c) for c in ("_draw", *tie)])
    return keyed.where(~chosen).drop("_draw"), keyed.where(chosen).drop("_draw")


def with_index(df: DataFrame, key: str, out: str = "idx", bound: int = 1_000_000) -> DataFrame:
    """Position of each row in the order of ``key``, from 0; NULL keys come first.

    Rows are dealt over ranges of the key, cut at sampled points so that a range has about ``bound``
    rows whatever the spread of the keys, and sorted there; a row's position is its place in the range plus
    the prefix sum of the ranges before, one row each. Equal keys get positions beside each other.
    """
    spark = df.sparkSession
    rows = materialise(df, "index-rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // bound))
    ranged = (rows.repartitionByRange(parts, key).sortWithinPartitions(key)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    ranged = materialise(ranged, "index-ranges")
    counts = ranged.groupBy("_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    # One row per range: of a checked size up to many billions of rows.
    offsets = F.broadcast(offsets) if parts <= 100_000 else offsets
    return ranged.join(offsets, "_pid").withColumn(out, F.col("_at") + F.col("_off")).drop("_pid", "_at", "_off")


def cyclic(attempts: DataFrame, attempt: str, items: DataFrame, key: str) -> DataFrame:
    """Reuse ``items`` cyclically: attempt a gets the item at position a mod n."""
    indexed = materialise(with_index(items, key, "_idx"), "cyclic")
    n = indexed.count()
    asked = attempts.withColumn("_idx", F.pmod(F.col(attempt), F.lit(n)).cast("bigint"))
    return asked.join(indexed, "_idx").drop("_idx")
