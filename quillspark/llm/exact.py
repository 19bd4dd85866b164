"""Exact duplicates by progressive refinement; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _marked(rows: DataFrame, keys: list, buckets: int, mark: str) -> DataFrame:
    """``rows`` with ``mark`` true where another row may share ``keys``.

    Keys are counted exactly (combined map-side). The keys met more than once are broadcast as
    hash classes, at most ``buckets`` rows whatever the table's size; a row in the class of a
    repeated key that is not repeated itself merely goes one level further.
    """
    cls = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    repeated = (rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).count()
                .where("count > 1")
                .select(F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keys))]), F.lit(buckets))
                        .alias("_cls"))
                .distinct().withColumn(mark, F.lit(True)))
    return rows.withColumn("_cls", cls).join(F.broadcast(repeated), "_cls", "left").drop("_cls")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix: int = 64, buckets: int = 1 << 16, hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Level 1 groups by length in bytes, level 2 the survivors by a hash of their first ``prefix``
    characters, level 3 reads the full text of the survivors only and groups by length and
    SHA-256. Levels 1 and 2 hand on hash classes of bounded number by broadcast; texts are never
    shuffled. The last join puts a row per group beside rows of (id, hash); Spark splits a
    hot group there.

    Null text counts as empty. Of equal texts the row with the largest id stays; a null id is
    smaller than any. Repeated rows (same id and text) are all kept: they name the same document.
    ``text_sha256`` is null where no full read was needed, unless ``hash_all``. Further columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_len", F.octet_length("_text"))
    by_length = _marked(rows, [F.col("_len")], buckets, "_m1")
    keys = [F.col("_len"), F.xxhash64(F.substring("_text", 1, prefix))]
    level2 = (by_length.where("_m1"))
    cls = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    repeated = (level2.groupBy(keys[0].alias("_a"), keys[1].alias("_b")).count().where("count > 1")
                .select(F.pmod(F.xxhash64("_a", "_b"), F.lit(buckets)).alias("_cls"))
                .distinct().withColumn("_m2", F.lit(True)))
    by_prefix = by_length.withColumn("_cls", F.when(F.col("_m1"), cls)).join(
        F.broadcast(repeated), "_cls", "left")
    full = F.coalesce(F.col("_m2"), F.lit(False))
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    hashed = stored(by_prefix.select("_id", "_len", full.alias("_full"),
                                     (digest if hash_all else F.when(full, digest)).alias("_sha")),
                    "exact-rows")
    groups = stored(hashed.where("_full").groupBy("_len", "_sha")
                    .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1"),
                    "exact-groups")
    several = hashed.where("_full").join(groups, ["_len", "_sha"], "left").select(
        "_id", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("_n"), "_sha")
    alone = hashed.where("not _full").select(
        "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_sha")
    return several.unionAll(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they were.

    Rows that share id and text are one document met twice; one of them stays. The rows that go
    are found by ``exact_dedup`` and taken out by an anti join on id and SHA-256. Null texts count as
    empty; columns of any name travel inside a struct, so none can clash. An empty table stays empty.
    """
    decided = stored(exact_dedup(docs, id_col, text_col), "exact-decided")
    gone = decided.where(~F.col("kept")).select(F.col(id_col).alias("_gid"), F.col("text_sha256").alias("_gsha"))
    twice = (decided.where("kept and group_size > 1").groupBy(F.col(id_col).alias("_gid"), F.col("text_sha256").alias("_gsha"))
             .count().where("count > 1").select("_gid", "_gsha"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_sha") == F.col("_gsha"))
    left = rows.join(gone.distinct(), same, "left_anti")
    if not twice.isEmpty():
        again = left.join(twice, same, "left_semi").dropDuplicates(["_id", "_sha"])
        left = left.join(twice, same, "left_anti").unionByName(again)
    return left.select("_row.*")
