"""Latency and token statistics; exact order statistics on skewed groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import STAGES
from ..sources.tables import small_table
from .ranks import LIMIT, order_statistics

TOKEN_CAP = 150
TARGET_MS = 400


def stage_stats(timings: DataFrame, stages: Sequence[str] = tuple(STAGES)) -> DataFrame:
    """min/avg/max per stage; a stage without timings keeps a NULL row."""
    dim = small_table(timings.sparkSession, [(s,) for s in stages], "stage string")
    agg = timings.groupBy("stage").agg(
        F.min("ms").alias("min_ms"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))
    return dim.join(agg, "stage", "left")


def with_totals(timings: DataFrame) -> DataFrame:
    """Timings plus one TOTAL row per iteration; a missing stage counts 0."""
    total = timings.groupBy("iter").agg(F.sum(F.coalesce("ms", F.lit(0.0))).alias("ms"))
    return timings.select("stage", "iter", "ms").unionByName(
        total.select(F.lit("TOTAL").alias("stage"), "iter", "ms"))


def latency_summary(df: DataFrame, groups: Sequence[str], value: str = "ms", limit: int = LIMIT) -> DataFrame:
    """n, mean, median, p95, min, max per group, all exact.

    The p95 is the order statistic at ``int(0.95 * (n - 1))``; see :func:`order_statistics` for the passes and
    for NULLs. No window ranks more than ``limit`` values of a group and rank.
    """
    n1 = F.col("n") - 1
    picked = order_statistics(
        df, groups, value, {"_p0": (0.5, F.floor(n1 / 2)), "_p1": (0.5, F.ceil(n1 / 2)), "p95_ms": (0.95, F.floor(F.lit(0.95) * n1))},
        {"avg_ms": F.avg("_v"), "min_ms": F.min("_v"), "max_ms": F.max("_v")}, limit)
    return picked.select("_g.*", "n", "avg_ms", "min_ms", "max_ms", ((F.col("_p0") + F.col("_p1")) / 2).alias("p50_ms"), "p95_ms")


def token_stats(df: DataFrame, groups: Sequence[str], tokens: str = "n_tok",
                ms: str = "ms") -> DataFrame:
    """Token averages, throughput, cap hit and latency target in one aggregate."""
    agg = df.groupBy(*groups).agg(
        F.avg(tokens).alias("avg_tok"), F.max(tokens).alias("max_tok"),
        F.avg(ms).alias("avg_ms"))
    return agg.select(
        "*", F.when(F.col("avg_ms") > 0, F.col("avg_tok") / (F.col("avg_ms") / 1000))
        .alias("tok_per_s"),
        (F.col("max_tok") >= TOKEN_CAP).alias("hit_cap"),
        (F.col("avg_ms") < TARGET_MS).alias("target_met"))


def first_vs_rest(df: DataFrame, groups: Sequence[str], idx: str = "idx", ms: str = "ms",
                  text: str = "text") -> DataFrame:
    """First call of all cases against the mean of the later non-empty ones.

    The divisor is max(1, n - 1). "First" may be an empty case while "rest" skips the first
    non-empty one; a group without non-empty cases gives no row.
    """
    used = F.col(text) != ""
    agg = df.groupBy(*groups).agg(
        F.min_by(ms, idx).alias("first_ms"),
        F.count_if(used).alias("_n"),
        F.sum(F.when(used, F.col(ms))).alias("_sum"),
        F.min_by(F.when(used, F.col(ms)), F.when(used, F.col(idx))).alias("_head"))
    rest = (F.col("_sum") - F.col("_head")) / F.greatest(F.lit(1), F.col("_n") - 1)
    return agg.where(F.col("_n") > 0).select(
        *groups, "first_ms", F.col("_n").alias("n_nonempty"), rest.alias("rest_avg_ms"))
