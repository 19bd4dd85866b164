"""Structured Streaming jobs. All of them can be run to the end of the available data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import mining as m
from ..operators import routing as r
from ..session import ROCKSDB, scratch_dir
from ..sources.files import STAMP, HistoryStore
from . import processors
from .processors import AutoReset, BoundedHistory, Debounce, HoldPairs, Quota, Review, Toggle

# Python workers get the processors by value, so they need not import this package.
cloudpickle.register_pickle_by_value(processors)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which custom state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the schema is taken from the files already there.

    ``path`` may be one file or a folder of files. A stream takes a single file only as a
    pattern, so the last character is written as a class of one: nothing else matches.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_files(stream: DataFrame, label: str, fmt: str = "parquet",
                 path: str | None = None) -> DataFrame:
    """Append the stream to a file sink until the available data is used up; read it back."""
    spark = stream.sparkSession
    out = path or scratch_dir(spark, label)
    query = (stream.writeStream.format(fmt).outputMode("append")
             .option("checkpointLocation", f"{out}-checkpoint")
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(out)


def run_batches(stream: DataFrame, label: str, body: Callable[[DataFrame, int], None],
                mode: str = "append") -> None:
    """Apply ``body`` to every micro-batch until the available data is used up."""
    base = scratch_dir(stream.sparkSession, label)
    query = (stream.writeStream.outputMode(mode).foreachBatch(body)
             .option("checkpointLocation", f"{base}-checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def clean_stream(stream: DataFrame, text: str = "text", threshold: int = 4) -> DataFrame:
    """Stateless arrival -> clean -> append."""
    kept = stream.where(t.not_blank(F.col(text)))
    return r.route(kept, threshold=threshold, backend="fast", text=text)


def session_stream(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Utterances by silence gap with the built-in session window."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.unix_micros("w.start").alias("start_us"),
                    F.unix_micros("w.end").alias("end_us"), "n_events"))


def _stateful(stream: DataFrame, key: str, processor, mode: str = "Append",
              time_mode: str = "None") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode=mode,
        timeMode=time_mode)


def _in_order(stream: DataFrame, processor, delay: str | None, key: str, ts: str) -> DataFrame:
    """The rows of each key handed to the processor by event time, as the watermark passes them.

    Rows without a time or key order are left out; ``delay`` is None where the stream already
    carries a watermark on ``ts``.
    """
    timed = stream if delay is None else stream.withWatermark(ts, delay)
    kept = timed.where(F.col("t").isNotNull()).select(key, ts, "t", "event_id", *processor.fields)
    return _stateful(kept, key, processor, time_mode="EventTime")


def debounce_stream(stream: DataFrame, gap_us: int, delay: str | None = None, key: str = "user_id",
                    ts: str = "ts") -> DataFrame:
    """Accepted events, each as soon as the watermark has passed it."""
    return _in_order(stream, Debounce(gap_us), delay, key, ts)


def toggle_stream(stream: DataFrame, gap_us: int, delay: str | None = None, key: str = "user_id",
                  ts: str = "ts") -> DataFrame:
    """Accepted presses as start and stop."""
    return _in_order(stream, Toggle(gap_us), delay, key, ts)


def hold_stream(stream: DataFrame, gap_us: int, delay: str | None = None, key: str = "user_id",
                ts: str = "ts") -> DataFrame:
    """Intervals of hold mode, when the watermark has passed their release."""
    return _in_order(stream, HoldPairs(gap_us), delay, key, ts)


def auto_reset_stream(stream: DataFrame, reset_us: int, delay: str | None, done: str = "done",
                      key: str = "user_id", ts: str = "ts") -> DataFrame:
    """States as they arrive; ``idle`` rows when the watermark has passed their moment."""
    return _in_order(stream, AutoReset(reset_us, done), delay, key, ts)


def watermarked(stream: DataFrame, delay: str, keep: Column, ts: str = "ts") -> DataFrame:
    """The rows matching ``keep``, with a watermark that all rows advance.

    The condition reads the event time because the optimizer would otherwise move it below the
    watermark, and rows of other kinds would no longer advance it.
    """
    return stream.withWatermark(ts, delay).where(F.when(F.col(ts).isNotNull(), keep))


def review_stream(transcripts: DataFrame, decisions: DataFrame, timeout_us: int, delay: str,
                  key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Final pairs of reviewed transcripts: user_id, event_id, input, output, decision.

    Transcripts carry ``raw`` and ``cleaned``, decisions ``decision`` and ``edited``, both ``t`` and ``ts``.
    Both sides are one stream, so either advances the watermark, and one state per key
    decides each transcript once: with the first decision in time, when the watermark has passed
    that, or by acceptance when it has passed the timeout.
    """
    text = F.lit(None).cast("string")
    left = transcripts.select(key, ts, "t", "event_id", F.lit(0).alias("side"), "raw", "cleaned",
                              text.alias("decision"), text.alias("edited"))
    right = decisions.select(key, ts, "t", "event_id", F.lit(1).alias("side"), text.alias("raw"),
                             text.alias("cleaned"), "decision", "edited")
    return _in_order(left.unionByName(right), Review(timeout_us), delay, key, ts)


def collected(pairs: DataFrame) -> DataFrame:
    """Pairs with the time stamp of the log they are appended to."""
    return pairs.select("input", "output", F.date_format(F.current_timestamp(), STAMP).alias("timestamp"))


def run_review(transcripts: DataFrame, decisions: DataFrame, timeout_us: int, delay: str,
               path: str | None = None) -> DataFrame:
    """Review to the end of the available data, chained into the JSON-lines pair log; reads the log."""
    with rocksdb_state(transcripts.sparkSession):
        return run_to_files(collected(review_stream(transcripts, decisions, timeout_us, delay)),
                            "review-log", "json", path)


def run_history(stream: DataFrame, n: int, path: str | None = None) -> DataFrame:
    """Bounded history per user through list state; returns the newest state of each user."""
    spark = stream.sparkSession
    out = path or scratch_dir(spark, "history")
    snapshots = _stateful(stream.select("user_id", "t", "event_id"), "user_id",
                          BoundedHistory(n), mode="Update")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/{batch_id:09d}")

    with rocksdb_state(spark):
        run_batches(snapshots, "history", save, mode="update")
    every = spark.read.parquet(f"{out}/*")
    newest = every.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return every.join(newest, ["user_id", "batch_id"]).drop("batch_id")


def run_history_files(stream: DataFrame, n: int, path: str | None = None) -> DataFrame:
    """Bounded history as versioned files (``foreachBatch`` sink)."""
    spark = stream.sparkSession
    store = HistoryStore(spark, path or scratch_dir(spark, "store"), ["user_id"], "t",
                         "event_id", n)
    run_batches(stream, "store", store.apply)
    return store.read(stream.schema)


def mining_stream(stream: DataFrame, per_group: int, cells: int = 32) -> DataFrame:
    """Sentences taken per spelling group, at most ``per_group`` each, as they come in.

    Two stateful steps. The first runs per group and cell (hash of the sentence), so that a
    group with a third of all hits is dealt over ``cells`` tasks; what the group takes is among the first
    ``per_group`` of a cell, so a cell never lets more through in its whole life, and the second step, per
    group, gets ``cells * per_group`` rows of a group at most. ``stream`` has doc_id and text.
    """
    found = m.good_sentences(stream, max_words=m.SPELLING_MAX_WORDS).select(m.file_order().alias("ord"), "sentence")
    hits = m.spelling_matches(found).select(
        "grp", F.pmod(F.xxhash64("sentence"), F.lit(cells)).alias("cell"), "ord", "sentence")
    rule = Quota(per_group)
    some = hits.groupBy("grp", "cell").transformWithStateInPandas(
        statefulProcessor=rule, outputStructType=rule.output, outputMode="Append", timeMode="None")
    return _stateful(some, "grp", Quota(per_group))


def run_mining(stream: DataFrame, per_group: int, groups: Sequence[str] = tuple(m.GROUPS),
               path: str | None = None, cells: int = 32) -> DataFrame:
    """Mine spelling sources until every group of ``groups`` has its quota or the data ends.

    A batch that is run again overwrites its own folder. Only the per-group counts reach the driver.
    """
    spark = stream.sparkSession
    out = path or scratch_dir(spark, "mined")
    full: list[bool] = []

    def add(batch: DataFrame, batch_id: int) -> None:
        if full:
            return
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id:09d}")
        counts = spark.read.schema(Quota.output).parquet(f"{out}/*").groupBy("grp").count()
        got = {row["grp"]: row["count"] for row in counts.collect()}
        if all(got.get(g, 0) >= per_group for g in groups):
            full.append(True)

    base = scratch_dir(spark, "mining")
    with rocksdb_state(spark):
        query = (mining_stream(stream, per_group, cells).writeStream.foreachBatch(add)
                 .option("checkpointLocation", f"{base}-checkpoint")
                 .trigger(availableNow=True).start())
    try:
        while not query.awaitTermination(1):
            if full:
                query.stop()
                break
    except StreamingQueryException:
        # A batch that the stop broke off would have added nothing: all quotas are met and written.
        if not full:
            raise
    return spark.read.schema(Quota.output).parquet(f"{out}/*")


def run_isolated(stream: DataFrame, load: Callable, text: str = "text", hint: str = "hint",
                 path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rewrite rows; failing ones go to a dead-letter sink while the stream goes on."""
    spark = stream.sparkSession
    out = path or scratch_dir(spark, "isolated")
    done = r.rewrite(stream, load, text, hint, isolate_errors=True)

    def save(batch: DataFrame, batch_id: int) -> None:
        # Both sinks are one partitioned write, so the Python stage runs once per batch.
        batch.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy(
            "failed").parquet(f"{out}/batch={batch_id}")

    run_batches(done, "isolated", save)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields)
    every = spark.read.schema(f"{fields}, batch bigint, failed boolean").parquet(out).drop("batch")
    failed: Column = F.col("failed")
    return every.where(~failed).drop("failed"), every.where(failed).drop("failed")
