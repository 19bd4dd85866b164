"""Evaluation joins and summaries over the fixed suite and over case tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shown
from ..functions.verdict import with_verdict
from ..functions.vocab import EVAL_CASES
from ..sources.tables import small_table


def suite(spark: SparkSession) -> DataFrame:
    """The twelve literal cases."""
    rows = [(i, *case) for i, case in enumerate(EVAL_CASES, 1)]
    return small_table(spark, rows, "case_id int, category string, text string, note string")


def judged(cases: DataFrame, outputs: DataFrame, on: Sequence[str] = ("case_id",)) -> DataFrame:
    return with_verdict(cases.join(outputs, list(on)))


def per_variant(variants: DataFrame) -> DataFrame:
    """Every suite case for every model variant. The suite is a fixed table of twelve rows
    and is attached as a literal array, so there is no join at all."""
    rows = [F.struct(F.lit(i).alias("case_id"), F.lit(c).alias("category"),
                     F.lit(x).alias("text"), F.lit(n).alias("note"))
            for i, (c, x, n) in enumerate(EVAL_CASES, 1)]
    return variants.select("*", F.inline(F.array(*rows)))


def summary(verdicts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Clean, flagged and total counts; the flagged rows themselves stay rows."""
    return verdicts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flagged")).alias("n_flagged"),
        F.count_if(~F.col("flagged")).alias("n_clean"))


def flagged_ids(verdicts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Ordered ids of flagged suite cases, ``[01], [05]``; at most twelve per group."""
    ids = F.sort_array(F.collect_list(F.when(F.col("flagged"), F.col("case_id"))))
    return verdicts.groupBy(*groups).agg(F.array_join(F.transform(
        ids, lambda i: F.format_string("[%02d]", i)), ", ").alias("flagged_cases"))


def compare_variants(verdicts: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One row per case, one verdict column per variant."""
    return verdicts.groupBy("case_id").pivot("variant", list(variants)).agg(
        F.bool_or("flagged"))


def variant_flags(verdicts: DataFrame, unnamed: str = "(none)") -> DataFrame:
    """(case_id, variant, flagged): one row per case and variant, for any number of variants.

    A NULL variant is shown as ``unnamed``. ``compare_variants`` sets a stated list side by side.
    """
    return verdicts.groupBy("case_id", F.coalesce("variant", F.lit(unnamed)).alias("variant")).agg(
        F.bool_or("flagged").alias("flagged"))


def rendered(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumns({"shown_in": shown(F.col("text"), "(empty)"),
                                 "shown_out": shown(F.col("output"), "EMPTY")})
