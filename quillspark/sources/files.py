"""Pair logs, histories and settings as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import bind
from ..functions.text import strip
from ..operators.events import HISTORY_MAX, last_n
from ..operators.quota import materialise
from ..session import scratch_dir

PAIR = "input string, output string"
LOGGED_PAIR = "input string, output string, timestamp string"
HISTORY = "timestamp string, raw_text string, final_text string"
STAMP = "yyyy-MM-dd'T'HH:mm:ss"
_BAD = "_corrupt_record"


def _missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


def read_pairs_tolerant(spark: SparkSession, path: str, schema: str = LOGGED_PAIR) -> DataFrame:
    """Pair log as rows; blank and corrupt lines are skipped, a missing path is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as exc:
        if _missing(exc):
            return spark.createDataFrame([], schema)
        raise
    parsed = F.from_json("value", f"{schema}, {_BAD} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    # Bound, so that each line is parsed once for the filter and all fields.
    rows = bind(lines.where(strip(F.col("value")) != ""), _p=parsed)
    return rows.where(F.col("_p").isNotNull() & F.col(f"_p.{_BAD}").isNull()).select(
        "_p.*").drop(_BAD)


def read_pairs_strict(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """Pair file as rows; the job fails on a line that is not valid JSON."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_pairs(pairs: DataFrame, path: str) -> bool:
    """Append stamped pairs; a failing write is reported as False, never raised."""
    now = F.date_format(F.current_timestamp(), STAMP)
    try:
        pairs.select("input", "output", now.alias("timestamp")).write.mode("append").json(path)
        return True
    except Exception:
        return False


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Replace a pair file; text is stored as UTF-8, never escaped."""
    pairs.select("input", "output").write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """JSON-array files as rows; a corrupt file, or one that holds no array, is empty.

    Files are checked one by one and are small by nature (a bounded history each).
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if _missing(exc):
            return spark.createDataFrame([], schema)
        raise
    is_list = F.col("value").rlike(r"^\s*\[")
    rows = F.from_json("value", f"array<struct<{_ddl_struct(schema)}>>",
                       {"mode": "PERMISSIVE"})
    return files.where(is_list).select(F.inline(rows))


def _ddl_struct(schema: str) -> str:
    return ", ".join(f"{name}: {typ}" for name, typ in
                     (part.strip().split(" ", 1) for part in schema.split(",")))


POINTER = "batch_id bigint, bucket int, buckets int"
HISTORY_BUCKETS = 64
_BUCKET = "history_bucket"


class HistoryStore:
    """Bounded history per key, kept as versions of the buckets of a parquet folder.

    Keys are dealt over ``buckets`` by hash. A micro-batch rewrites the buckets that it has keys of, into
    a version folder of its own; all others stay as they are, so what is written follows the batch and
    not the store. The pointer table gets a row per rewritten bucket afterwards: the last version of each
    bucket is what counts, a lost job leaves the store readable, and a replayed batch id is applied
    once. Choose ``buckets`` once, for the whole store; another number is refused. NULL keys are a
    key. Batches must not have a column ``history_bucket``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], t: str,
                 row_id: str, n: int = HISTORY_MAX, buckets: int = HISTORY_BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.t, self.row_id, self.n, self.buckets = list(keys), t, row_id, n, buckets

    def versions(self) -> dict[int | None, int]:
        """Last batch id of each written bucket; a batch without rows stands under None."""
        try:
            rows = self.spark.read.schema(POINTER).parquet(f"{self.path}/pointer").groupBy("bucket").agg(
                F.max("batch_id").alias("at"), F.bool_and(F.col("buckets") == self.buckets).alias("same")).collect()
        except AnalysisException as exc:
            if _missing(exc):
                return {}
            raise
        if not all(r["same"] for r in rows):
            raise ValueError(f"the history in {self.path} was not written with {self.buckets} buckets")
        return {r["bucket"]: r["at"] for r in rows}  # a row per bucket

    def version(self) -> int:
        """Last applied batch id, -1 if there is none."""
        return max(self.versions().values(), default=-1)

    def read(self, schema=None, only: set[int] | None = None) -> DataFrame | None:
        """All histories, or those of some buckets; None if nothing was written."""
        paths = [f"{self.path}/v={at}/{_BUCKET}={b}" for b, at in sorted(
            (b, at) for b, at in self.versions().items() if b is not None and (only is None or b in only))]
        if not paths:
            return None if schema is None or self.version() < 0 else self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` body."""
        if batch_id <= self.version():
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = materialise(batch, "history-batch")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most one row per bucket
        old = self.read(batch.schema, touched)
        merged = batch if old is None else old.unionByName(batch)
        kept = last_n(merged, self.keys, self.t, self.row_id, self.n)
        if touched:
            kept.withColumn(_BUCKET, bucket).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(
                _BUCKET).parquet(f"{self.path}/v={batch_id}")
        rows = [(batch_id, b, self.buckets) for b in sorted(touched) or [None]]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")


def round_trip(df: DataFrame, label: str) -> DataFrame:
    """Write pairs as JSON lines to the scratch folder and read them back strictly."""
    path = scratch_dir(df.sparkSession, label)
    write_pairs(df, path)
    return read_pairs_strict(df.sparkSession, path)
