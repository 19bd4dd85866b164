"""Parquet tables of a data folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str,
          spread: str | None = None) -> DataFrame:
    """A table, pruned to ``columns``.

    ``spread`` names a well-distributed key: if the files yield fewer partitions than the
    session has cores (one small file, one row group) the rows are hash-spread once so
    that CPU-heavy text work uses all cores. A real cluster table has many files and is
    read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if spread is not None and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, spread)
    return df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table as a local relation, whose exact size the planner knows.

    A frame made from Python rows has no size estimate and would be joined by shuffling
    the large side.
    """
    names = [part.split()[0] for part in schema.split(",")]
    columns = {n: list(values) for n, values in zip(names, zip(*rows))}
    local = spark.createDataFrame(pa.table(columns))
    casts = [f"CAST({part.split()[0]} AS {part.split()[1]})" for part in schema.split(",")]
    return local.selectExpr(*[f"{cast} AS {n}" for cast, n in zip(casts, names)])
