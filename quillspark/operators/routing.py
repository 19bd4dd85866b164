"""Two-tier transcript routing with a caller-supplied batch rewriter."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..session import scratch_dir
from .hooks import answers, slices, swept, worker_model

# texts, hints -> rewritten texts; called once per Arrow batch
Rewriter = Callable[[pd.Series, pd.Series], pd.Series]


def resolve_backend(backend: Column, available: Column | bool) -> Column:
    """'local' only if asked for and available; anything else is 'fast'."""
    ok = available if isinstance(available, Column) else F.lit(available)
    return F.when((backend == "local") & ok, F.lit("local")).otherwise(F.lit("fast"))


def tier(words: Column, threshold: Column | int, backend: Column) -> Column:
    """'fast' below the word threshold or with the fast backend, else 'rewrite'."""
    return F.when((words < threshold) | (backend == "fast"),
                  F.lit("fast")).otherwise(F.lit("rewrite"))


def fallback(rewritten: Column, fast: Column) -> Column:
    """Empty rewrites fall back to the fast result."""
    return F.coalesce(F.when(rewritten != "", rewritten), fast)


def rewrite(df: DataFrame, load: Callable[[], Rewriter], text: str = "text",
            hint: str = "hint", isolate_errors: bool = False) -> DataFrame:
    """Append ``rewritten`` through ``mapInArrow``; ``load`` runs once per Python worker.

    A batch that fails is cut in halves until the failing rows are found. A failing row, like an
    empty answer, falls back to its raw text; with ``isolate_errors`` it gets NULL text and an ``error``.
    Only texts and hints become Python objects, a bounded number of bytes at a time.
    """
    extra = [T.StructField("rewritten", T.StringType())]
    if isolate_errors:
        extra.append(T.StructField("error", T.StringType()))
    schema = T.StructType(df.schema.fields + extra)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in swept(slices(batches, text), text):
            texts, hints = (batch.column(name).to_pandas() for name in (text, hint))
            said, errors = (pd.Series(x, dtype=object)
                            for x in answers(worker_model(token, load), texts, hints))
            empty = (said.isna() | (said == "")) & errors.isna()
            said = said.where(~empty, texts)
            made = [said, errors] if isolate_errors else [said.where(errors.isna(), texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.string(), from_pandas=True) for x in made)], schema.names)

    return df.mapInArrow(run, schema)


def route(df: DataFrame, threshold: int = 4, backend: str = "local",
          available: bool = True, text: str = "text") -> DataFrame:
    """Append ``fast`` (always computed) and ``tier``.

    An unavailable local backend still goes through its formatter slot, which is then the
    fast one, so its rows keep the fast result.
    """
    col = F.col(text)
    resolved = resolve_backend(F.lit(backend), available)
    return df.select("*", t.clean(col).alias("fast"),
                     tier(t.word_count(col), threshold, resolved).alias("tier"))


def format_transcripts(df: DataFrame, load: Callable[[], Rewriter], threshold: int = 4,
                       backend: str = "local", available: bool = True,
                       text: str = "text", hint: str = "hint") -> DataFrame:
    """Cleaned ``final`` text per transcript.

    The rows are routed once and stored by tier, so what feeds them is not computed again for
    the second tier. Only escalated rows enter the Python stage; the rest never leave the
    JVM. The two branches are unioned: no join, no shuffle.
    """
    routed = route(df, threshold, backend, available, text)
    path = scratch_dir(df.sparkSession, "routed")
    routed.write.partitionBy("tier").parquet(path)
    stored = df.sparkSession.read.schema(routed.schema).parquet(path).select(*routed.columns)
    fast = stored.where(F.col("tier") == "fast").withColumn("final", F.col("fast"))
    slow = rewrite(stored.where(F.col("tier") == "rewrite"), load, text, hint)
    slow = slow.withColumn("final", fallback(F.col("rewritten"), F.col("fast")))
    return fast.unionByName(slow.drop("rewritten"))


def stitch(segments: DataFrame, utt: str = "conv_id", idx: str = "turn", text: str = "text",
           run: int = 512) -> DataFrame:
    """Ordered segments of an utterance, trimmed and joined by one space.

    Runs of ``run`` consecutive segments are joined first, so a very long utterance is
    assembled by many tasks and the last step only concatenates whole runs.
    """

    def joined(df: DataFrame, keys: list, order: str, out: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"),
                                                       F.col("_s").alias("s"))))
        return df.groupBy(*keys).agg(
            F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias(out))

    base = segments.select(utt, idx, F.floor(F.col(idx) / run).alias("_run"),
                           t.strip(F.col(text)).alias("_s"))
    return joined(joined(base, [utt, "_run"], idx, "_s"), [utt], "_run", "utterance")
