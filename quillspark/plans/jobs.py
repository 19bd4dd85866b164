"""End-to-end jobs: corpus to dirty/clean pairs, dataset builds, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import corrupt as c
from ..functions import draws as d
from ..functions import text as t
from ..operators import evaluate as e
from ..operators import generate as g
from ..operators import mining as m
from ..operators.quota import materialise, sample_n, smallest_k
from ..sources.files import write_pairs

SEED_V2, SEED_V3 = 42, 43
PASS_THROUGH = 500
OVERFETCH = 1.25


def mine_and_clean(docs: DataFrame, seed: int = SEED_V2) -> DataFrame:
    """Flagship: mine distinct good sentences, dirty them with fillers, clean them again."""
    corpus = m.unpack_order(m.mine_corpus([docs]))
    dirty = d.bind(corpus, dirty=c.insert_fillers(F.col("sentence"), seed, F.col("ord")))
    return dirty.select("doc_id", "sent_idx", "dirty", t.clean(F.col("dirty")).alias("cleaned"))


def build_v2(sources: list[DataFrame], target: int, seed: int = SEED_V2) -> DataFrame:
    """Pass-through pairs plus real-text pairs, mixed and cut to ``target``."""
    spark = sources[0].sparkSession
    passed = g.pass_through_pairs(spark.range(PASS_THROUGH), seed)
    need = target - 3 * PASS_THROUGH
    corpus = materialise(m.mine_corpus(sources, int(need * OVERFETCH)), "corpus")
    mixed = passed.unionByName(g.real_text_pairs(corpus, need, seed))
    keyed = materialise(mixed.withColumn("shuf", d.shuffle_key(seed, F.col("pair_id"))), "mixed")
    return smallest_k(keyed, target, "shuf", tie=["pair_id"])


def build_v3(sources: list[DataFrame], v2_pairs: DataFrame, per_part: int,
             seed: int = SEED_V3) -> DataFrame:
    """Spelling, cardinal and resampled pairs in equal parts, in random order.

    ``v2_pairs`` needs a unique ``pair_id``.
    """
    spark = sources[0].sparkSession
    sentences = m.mine_corpus(sources, max_words=80)
    resampled = sample_n(v2_pairs, per_part, seed, F.col("pair_id"), ["pair_id"])
    return g.mix_pairs([
        g.spelling_pairs(sentences, per_part, seed),
        g.cardinal_pairs(spark.range(per_part), per_part, seed),
        resampled.select("pair_id", "category", "input", "output"),
    ], seed)


def save(pairs: DataFrame, path: str) -> DataFrame:
    """Write a pair set as JSON lines and return its statistics."""
    stored = materialise(pairs, "pairs")
    write_pairs(stored, path)
    return g.pair_stats(stored)


def evaluation_report(cases: DataFrame, outputs: DataFrame, groups: list[str]) -> DataFrame:
    """Verdict counts of a case table against model outputs."""
    return e.summary(e.judged(cases, outputs), groups)
