"""Shared helpers: folds, words of Arrow batches, stored tables, labels of linked rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quota import materialise
from ..sources.tables import table

# The white space that separates words, and a word, in Spark's and DuckDB's patterns.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns, spread="doc_id")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes and lost
    executors read files instead of recomputing."""
    return materialise(df, f"llm-{label}")


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def small_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Limit Arrow batches of the session to ``max_bytes``, unless a lower limit or one with a unit
    (``16m``) is set: by row count alone, a batch of long texts takes tens of megabytes in the JVM
    and again in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
    if now and not 0 < int(now[1]) <= max_bytes:
        spark.conf.set(name, str(max_bytes))


@contextmanager
def batch_bytes(spark: SparkSession, max_bytes: int = 4 << 20) -> Iterator[None]:
    """``small_batches`` for the jobs run inside; the session's own setting comes back after them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    small_batches(spark, max_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(start of each text's words, word codes, distinct words as bytes); null has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    flat, starts = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(full)))[starts - starts[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return starts, coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()


def word_hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct), np.uint64, len(distinct))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; empty if there are fewer."""
    k = len(word_hash) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(k, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[i:i + k])
    return out


def planes(x: np.ndarray, keep: int) -> bytes:
    """The ``keep`` low bytes of integers, all first bytes before all second ones: small numbers
    leave planes of zeros, which Spark's shuffle compression removes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :keep].T.tobytes()


def unplane(raw: bytes, n: int, keep: int, dtype) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :keep] = np.frombuffer(raw, np.uint8).reshape(keep, n).T
    return out.reshape(-1).view(dtype)


def bitmap(ids: DataFrame, column: str, bits: int, placed: bool = False) -> np.ndarray:
    """A bit per hash class of the values in ``column``: ``bits`` / 8 bytes, however many rows.

    With ``placed`` the values are bit numbers already. A set bit means *maybe*: callers check
    survivors exactly.
    """
    at = F.col(column) if placed else F.pmod(F.xxhash64(column), F.lit(bits))
    words_ = (ids.select(at.alias("b"))
              .groupBy((F.col("b") / 32).cast("int").alias("w"))
              .agg(F.expr("bit_or(shiftleft(1L, CAST(b % 32 AS INT)))").alias("m")))
    out = np.zeros(bits // 32, np.uint32)
    got = words_.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def smallest_linked(links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b), roots included: the smallest id reachable.

    Each round every id hands the smallest root it knows of to its neighbours' roots (large and
    small stars), so chains shorten geometrically. The rounds' tables are written to the shared
    folder; nothing but a row count comes to the driver. Both sides are combined map-side, so
    an id with very many links makes no large task.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct(),
                   f"{label}-links")
    for _ in range(max_rounds):
        # Large star: neighbours larger than an id go to the smallest id around it.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = stored(low, f"{label}-low")
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, f"{label}-large")
        # Small star: an id and its smaller neighbours go to the smallest of them.
        floor = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-floor")
        hung = (large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = stored(hung.unionAll(floor.select("a", F.col("m").alias("b"))).distinct(),
                       f"{label}-edges")
        same = (after.count() == edges.count()
                and after.join(edges, ["a", "b"], "left_anti").isEmpty())
        edges = after
        if same:
            roots = edges.groupBy("a").agg(F.min("b").alias("root"))
            own = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            return roots.select(F.col("a").alias("id"), "root").unionAll(own)
    raise RuntimeError(f"{label}: links have not settled after {max_rounds} rounds")
