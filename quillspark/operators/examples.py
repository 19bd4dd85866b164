"""Training-example preparation: token ids, label masks, padded batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws as d
from ..functions.text import prompt, words
from .hooks import worker_model
from .quota import materialise, with_index

IGNORE = -100
PAD_ID, EOS_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2, 3
BATCH = 4
SHARDS = 16
CELL_ROWS = 1_000_000
HEAD_TOKENS = 50_000


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, token_id) ranked by (count desc, token), without a single-task sort.

    The rank is a position over ranges of (count, token) cut at sampled points, so equally frequent
    tokens, however many and whatever they begin with, are dealt over tasks too.
    """
    counted = (texts.select(F.explode(words(F.col(text))).alias("token"))
               .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("_key", F.struct((-F.col("n")).alias("n"), "token")))
    return with_index(counted, "_key", "_rank").select(
        "token", "n", (F.lit(FIRST_ID) + F.col("_rank")).cast("int").alias("token_id"))


def encode(pairs: DataFrame, vocab: DataFrame, row_id: str = "pair_id") -> DataFrame:
    """Default tokenizer: prompt and completion ids through a vocabulary table.

    The ``HEAD_TOKENS`` most frequent tokens are broadcast: a bounded table that resolves
    every hot token map-side. Only the rare rest is joined by a shuffle on the token. NULL
    texts count as empty; pairs of equal id, NULL ids too, are encoded each.
    """
    numbered = materialise(pairs.select(row_id, "input", "output").withColumn(
        "_row", F.monotonically_increasing_id()), "encode-pairs")
    parts = numbered.select(row_id, "_row", F.posexplode(F.concat(
        F.transform(words(prompt(F.coalesce("input", F.lit("")))), lambda w: F.struct(
            F.lit(0).alias("part"), w.alias("token"))),
        F.transform(words(F.coalesce("output", F.lit(""))), lambda w: F.struct(
            F.lit(1).alias("part"), w.alias("token"))))).alias("pos", "_t"))
    parts = parts.select(row_id, "_row", "pos", "_t.part", "_t.token")
    ids = vocab.select("token", "token_id")
    common = F.col("token_id") < FIRST_ID + HEAD_TOKENS
    tried = parts.join(F.broadcast(ids.where(common)), "token", "left")
    found = tried.where(F.col("token_id").isNotNull())
    rest = tried.where(F.col("token_id").isNull()).drop("token_id").join(
        ids.where(~common), "token", "left")
    ordered = F.sort_array(F.collect_list(F.struct(
        "pos", "part", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))))
    rows = found.unionByName(rest).groupBy(row_id, "_row").agg(ordered.alias("_o"))

    def side(part: int) -> Column:
        return F.transform(F.filter("_o", lambda x: x["part"] == part), lambda x: x["id"])

    return rows.select(row_id, side(0).alias("prompt_ids"), side(1).alias("completion_ids"))


def encode_with(pairs: DataFrame, load: Callable[[], Callable[[pd.Series], Iterable[list[int]]]]) -> DataFrame:
    """Caller's tokenizer, called once per Arrow batch of texts; ``load`` runs once per Python worker.

    NULL texts count as empty.
    """
    token = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(list(worker_model(token, load)(texts)), index=texts.index, dtype=object)

    return pairs.select("*", ids(prompt(F.coalesce("input", F.lit("")))).alias("prompt_ids"),
                        ids(F.coalesce("output", F.lit(""))).alias("completion_ids"))


def examples(encoded: DataFrame, max_len: int = 256, eos_id: int | None = EOS_ID,
             row_id: str = "pair_id") -> DataFrame:
    """input_ids, attention_mask and labels; the prompt is masked, long rows are cut."""
    done = F.col("completion_ids")
    if eos_id is not None:
        done = F.concat(done, F.array(F.lit(eos_id)))
    masked = F.array_repeat(F.lit(IGNORE), F.size("prompt_ids"))
    cut = encoded.select(
        row_id, F.slice(F.concat("prompt_ids", done), 1, max_len).alias("input_ids"),
        F.slice(F.concat(masked, done), 1, max_len).alias("labels"))
    return cut.select(row_id, "input_ids",
                      F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
                      "labels")


def batch_numbers(rows: DataFrame, seed: int, row_id: str = "pair_id", shards: int = SHARDS,
                  batch: int = BATCH, bound: int = CELL_ROWS) -> DataFrame:
    """Random (shard, batch) per row, ``batch`` rows each; at most one short batch a shard.

    A row's shard depends on its id and their number only, so adding rows moves no other row to another
    shard. Shards fix the result, not the work: a shard is cut into ranges of the draw of about
    ``bound`` rows, numbered by a task each, and a row's place in the shard is its place in the range plus
    the rows of the ranges before. The numbers are the same for any ``bound``.
    """
    dig = d.digest(seed, F.coalesce(F.col(row_id).cast("string"), F.lit("")), "batch")
    keyed = materialise(rows.select("*", d.index(dig, shards, 0).alias("shard"), d.draw(dig, 1).alias("_draw")),
                        "batch-rows")
    ranges = max(1, -(-keyed.count() // (shards * bound)))
    keyed = keyed.withColumn("_range", F.floor(F.col("_draw") * ranges / d.DRAW_SPAN))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row per range: of a checked size up to many billions of rows.
    offsets = F.broadcast(offsets) if shards * ranges <= 100_000 else offsets
    own = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_draw", row_id)) - 1
    placed = keyed.withColumn("_own", own).join(offsets, ["shard", "_range"]).withColumn("_rn", F.col("_own") + F.col("_off"))
    return placed.select(*rows.columns, "shard", F.floor(F.col("_rn") / batch).cast("int").alias("batch"),
                         (F.col("_rn") % batch).cast("int").alias("slot"))


def padded_batches(rows: DataFrame, seed: int, pad_id: int = PAD_ID, row_id: str = "pair_id",
                   shards: int = SHARDS, batch: int = BATCH) -> DataFrame:
    """One row per batch with right-padded BIGINT matrices and the padded width."""
    numbered = batch_numbers(rows, seed, row_id, shards, batch)
    grouped = numbered.groupBy("shard", "batch").agg(
        F.max(F.size("input_ids")).alias("width"),
        F.sort_array(F.collect_list(F.struct(
            "slot", "input_ids", "attention_mask", "labels"))).alias("_rows"))

    def padded(field: str, value: int) -> Column:
        return F.transform("_rows", lambda r: F.concat(
            r[field].cast("array<bigint>"),
            F.array_repeat(F.lit(value).cast("bigint"), F.col("width") - F.size(r[field]))
        )).alias(field)

    return grouped.select("shard", "batch", "width", padded("input_ids", pad_id),
                          padded("attention_mask", 0), padded("labels", IGNORE))
