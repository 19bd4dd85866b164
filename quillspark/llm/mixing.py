"""Mixing sources to target weights: blocks apportioned by highest quotients (Sainte-Lague)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .common import SPACES, WORD, stored

STRIDE = 1_000_000_007  # a prime: block * STRIDE + start is a permutation modulo any smaller count


def apportion(rows: DataFrame, groups: Sequence[str], votes: str, seats: str, cap: str,
              tie: str, out: str) -> DataFrame:
    """``rows`` with the integer seats of each, by highest quotients votes / 1, 3, 5, ...

    Rounding votes * seats / sum(votes) gives all quotients above one threshold; the few
    missing (or surplus) seats, at most half the rows of the group, go to the next highest (lowest)
    quotients, ranked among as many candidates per row as can win. Equal quotients go in order
    of ``tie``. No row gets more than ``cap`` seats. Exact, without handing out seats one by one.
    """
    groups = list(groups)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    total = F.sum(votes).over(whole)
    first = rows.withColumn("_total", total).withColumn("_rows", F.count("*").over(whole))
    share = F.when(F.col("_total") > 0, F.col(votes) * F.col(seats) / F.col("_total")).otherwise(0.0)
    first = first.withColumn("_s", F.least(F.floor(share + 0.5), F.col(cap)))
    first = stored(first.withColumn("_d", F.col(seats) - F.sum("_s").over(whole)), f"seats-{out}")
    more = F.when(F.col("_total") > 0, F.ceil(
        (F.abs("_d") + F.col("_rows")) * F.col(votes) / F.col("_total")) + 1).otherwise(F.lit(1))
    tries = first.where("_d <> 0").select(
        *groups, tie, "_d", F.col(votes).alias("_v"), F.col(cap).alias("_cap"), "_s",
        F.explode(F.sequence(F.lit(1).cast("long"), more.cast("long"))).alias("_j"))
    tries = tries.withColumn("_k", F.when(F.col("_d") > 0, F.col("_s") + F.col("_j"))
                             .otherwise(F.col("_s") - F.col("_j") + 1))
    tries = tries.where("_k >= 1 and _k <= _cap").withColumn("_q", F.col("_v") / (2 * F.col("_k") - 1))
    order = [F.when(F.col("_d") > 0, -F.col("_q")).otherwise(F.col("_q")),
             F.when(F.col("_d") > 0, F.col(tie)).otherwise(-F.col(tie)), F.col("_j")]
    won = (tries.withColumn("_r", F.row_number().over(
        Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*order)))
        .where("_r <= abs(_d)").groupBy(*groups, tie).agg(F.count("*").alias("_won")))
    seated = F.col("_s") + F.when(F.col("_d") > 0, 1).otherwise(-1) * F.coalesce("_won", F.lit(0))
    return (first.join(won, [*groups, tie], "left").withColumn(out, seated.cast("long"))
            .drop("_total", "_rows", "_s", "_d", "_won"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2),
                   share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with rank and target.

    Sources in order of code point, null last, weigh ``weights`` in turn and share ``share`` times
    all sizes. A target stops at ``most`` times its source's size and the excess is shared
    again by weight until none is above: target = min(cap, level * weight), and the level is
    the largest of those that hold if the sources with the smallest caps a weight are full.
    One row per source goes through one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(after))
    level = F.max("_level").over(all_rows)
    return rows.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).drop("_w", "_cap", "_level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block: int = 16, shards: int = 256, seed: str = "mix",
        carry: bool = False) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, takes.

    A source's documents are dealt to ``shards`` by a digest of their id and stand there in digest
    order; laid end to end, shard after shard, their words form the source's stream, cut into
    blocks of ``block`` words. Sources get blocks in proportion to their targets, the shards of
    a source in proportion to the blocks that begin in them, both by highest quotients. A
    shard's quota is whole passes over its blocks plus a seeded choice of them. ``taken``
    is the number of words that the chosen blocks take from the document, repeats counted;
    ``takes`` lists (from word, to word, times). A source misses its target by less than
    three blocks (its last one is partial); no document exceeds twice its size.

    Null text has size 0 and takes nothing; null source is a source of its own, the last; rows
    with a null id share one shard; repeated rows count each. Documents without words,
    sources without words and an empty table give zeros or no rows. With ``carry`` the input's
    columns follow (as ``_in`` struct). Only counts by (source, shard) are gathered; documents are
    shuffled once, by source and shard, so a hot source is spread over ``shards`` groups.
    """
    word_count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count.alias("size"),
        digest.alias("_order"), *([F.struct(*docs.columns).alias("_in")] if carry else []))
    rows = rows.withColumn("shard", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % shards)
    rows = rows.withColumn("_key", F.when(F.col("source").isNull(), F.lit("n"))
                           .otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
    cells = stored(rows.groupBy("_key", "source", "shard").agg(F.sum("size").alias("words")), "mix-cells")
    plan = _quotas(cells, block, seed)
    at = Window.partitionBy("_key", "shard").orderBy("_order", "_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = rows.drop("source").withColumn("_end", F.sum("size").over(at))
    joined = placed.join(plan, ["_key", "shard"])
    start = F.col("base") + F.col("_end") - F.col("size")
    joined = joined.withColumn("_from", start).withColumn("_to", start + F.col("size"))
    blocks = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))

    def chosen(k: Column) -> Column:
        own = F.col("passes") + F.when(_picked(k - F.col("first")), 1).otherwise(0)
        return F.struct((F.greatest(k * block, F.col("_from")) - F.col("_from")).alias("from_word"),
                        (F.least((k + 1) * block, F.col("_to")) - F.col("_from")).alias("to_word"),
                        F.when(k < F.col("first"), F.col("enter")).otherwise(own).alias("times"))

    takes = F.when(F.col("size") > 0, F.transform(blocks, chosen)).otherwise(
        F.expr("CAST(array() AS array<struct<from_word:bigint,to_word:bigint,times:bigint>>)"))
    taken = F.aggregate("takes", F.lit(0).cast("long"),
                        lambda a, t: a + (t["to_word"] - t["from_word"]) * t["times"])
    out = joined.withColumn("takes", takes).withColumn("taken", taken)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "takes",
                      *(["_in"] if carry else []))


def _picked(j: Column) -> Column:
    """Whether the seeded permutation of the shard's blocks puts block j among the first ``rest``."""
    return (j * STRIDE + F.col("turn")) % F.greatest(F.col("blocks"), F.lit(1)) < F.col("rest")


def _quotas(cells: DataFrame, block: int, seed: str) -> DataFrame:
    """Per (source, shard): base offset, own blocks, passes, rest, turn, enter and the target."""
    sizes = cells.groupBy("_key", "source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(sizes)
    all_rows = Window.partitionBy(F.lit(0))
    targets = targets.withColumn("_seats", F.floor(F.sum("target").over(all_rows) / block + 0.5))
    targets = targets.withColumn("_most", 2 * F.ceil(F.col("source_size") / block))
    seated = apportion(targets, [], "target", "_seats", "_most", "rank", "quota")
    by_shard = Window.partitionBy("_key").orderBy("shard")
    cells = cells.drop("source").withColumn("base", F.sum("words").over(by_shard) - F.col("words"))
    first = F.ceil(F.col("base") / block)
    cells = cells.withColumn("first", first).withColumn(
        "blocks", F.ceil((F.col("base") + F.col("words")) / block) - first)
    cells = cells.join(seated.select("_key", "source", "source_size", "target", "quota"), "_key")
    cells = cells.withColumn("_cap", 2 * F.col("blocks"))
    cells = apportion(cells, ["_key"], "blocks", "quota", "_cap", "shard", "own")
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key"), F.lit("|"), F.col("shard").cast("string"))
                                    .cast("binary")), 1, 8), 16, 10).cast("long")
    some = F.greatest(F.col("blocks"), F.lit(1))
    cells = (cells.withColumn("turn", turn).withColumn("passes", F.floor(F.col("own") / some))
             .withColumn("rest", F.col("own") % some))
    last = F.when(F.col("blocks") > 0, F.col("passes") + F.when(_picked(F.col("blocks") - 1), 1).otherwise(0))
    entering = F.last(last, ignorenulls=True).over(by_shard.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("enter", F.coalesce(entering, F.lit(0).cast("long"))).select(
        "_key", "shard", "base", "first", "blocks", "passes", "rest", "turn", "enter",
        "source_size", "target")


def take_words(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed table itself, with the columns of ``docs``: a row per pass over a document.

    Pass 1 holds the words of all blocks taken at least once, pass 2 those of blocks taken twice.
    A pass over the whole document keeps its text as it is; else the words are joined by one
    space. Documents of which nothing is taken go.
    """
    mixed = mix(docs, text_col=text_col, carry=True, **options)
    text = F.coalesce(F.col("_in")[text_col], F.lit(""))
    tokens = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    passes = mixed.withColumn("_pass", F.explode(F.array(F.lit(1), F.lit(2))))
    passes = passes.withColumn("_runs", F.filter("takes", lambda t: t["times"] >= F.col("_pass")))
    passes = passes.withColumn("_n", F.aggregate(
        "_runs", F.lit(0).cast("long"), lambda a, t: a + t["to_word"] - t["from_word"]))
    # Bound, so the text is split once and not again for every run of blocks.
    passes = draws.bind(passes.where("_n > 0"), _words=F.when(F.col("_n") < F.col("size"), tokens))
    cut = F.array_join(F.flatten(F.transform(
        "_runs", lambda t: F.slice("_words", (t["from_word"] + 1).cast("int"),
                                   (t["to_word"] - t["from_word"]).cast("int")))), " ")
    kept = F.when(F.col("_n") < F.col("size"), cut).otherwise(text)
    return passes.select(*[(kept if c == text_col else F.col("_in")[c]).alias(c) for c in docs.columns])
