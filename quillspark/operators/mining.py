"""Corpus mining: sentence split, quality gate, exact dedupe, spelling-target matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.draws import bind
from ..functions.vocab import SPELLING_TARGETS
from ..sources.tables import small_table
from .quota import GROUP_LIMIT_MAX_K, first_k, materialise, smallest_k, with_index

SPELLING_MAX_WORDS = 80  # fixed value: longest sentence of the spelling stage
IDX_BITS = 20
DOC_BITS = 40
GROUPS = list(dict.fromkeys(g for g, _, _ in SPELLING_TARGETS))


def explode_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence with its position; map-only.

    Sentences are stripped inside the generator, so that the gates above it read a finished
    column instead of repeating the strip.
    """
    parts = t.sentence_parts(F.col(text))
    others = [c for c in docs.columns if c != text]
    return (docs.select(*others, F.posexplode(parts).alias("sent_idx", "sentence"))
            .where(F.col("sentence") != ""))


def good_sentences(docs: DataFrame, text: str = "text", min_words: int = 8,
                   max_words: int = 120) -> DataFrame:
    return explode_sentences(docs, text).where(
        t.good_sentence(F.col("sentence"), min_words, max_words))


def file_order(priority: Column | int = 0, doc: str = "doc_id", idx: str = "sent_idx") -> Column:
    """(priority, document, sentence) order packed in one BIGINT.

    3 + 40 + 20 bits: 8 sources, 10^12 documents, a million sentences each. Ids outside
    that range stop the job instead of wrapping.
    """
    pr = priority if isinstance(priority, Column) else F.lit(priority)
    fits = (F.col(doc).between(0, (1 << DOC_BITS) - 1) & (F.col(idx) < (1 << IDX_BITS))
            & pr.between(0, 7))
    packed = ((pr.cast("bigint") * (1 << DOC_BITS)) + F.col(doc)) * (1 << IDX_BITS) + F.col(idx)
    return F.when(fits, packed).otherwise(
        F.raise_error(F.lit("id outside the packed order range")).cast("bigint"))


def first_occurrence(sentences: DataFrame, order: str = "ord",
                     text: str = "sentence") -> DataFrame:
    """Exact dedupe keeping the first occurrence.

    ``min`` over a BIGINT keeps this a hash aggregate with map-side combine, so a sentence
    that fills a third of the corpus reaches the shuffle as one row per map task.
    """
    return sentences.groupBy(text).agg(F.min(order).alias(order))


def unpack_order(df: DataFrame, order: str = "ord") -> DataFrame:
    """Bring back priority, doc_id and sent_idx from the packed order."""
    o = F.col(order)
    return df.select(
        "*",
        F.shiftright(o, IDX_BITS + DOC_BITS).cast("int").alias("priority"),
        F.shiftright(o, IDX_BITS).bitwiseAND(F.lit((1 << DOC_BITS) - 1)).alias("doc_id"),
        o.bitwiseAND(F.lit((1 << IDX_BITS) - 1)).cast("int").alias("sent_idx"),
    )


def ranked_sources(sources: Sequence[DataFrame], **gate: int) -> DataFrame:
    """Good sentences of all sources; the position in the list is the priority."""
    parts = [good_sentences(df, **gate).select(file_order(p).alias("ord"), "sentence")
             for p, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def mine_corpus(sources: Sequence[DataFrame], target: int | None = None,
                **gate: int) -> DataFrame:
    """Distinct good sentences in source priority order, optionally the first ``target``.

    A later source contributes only what the earlier ones left open, because the quota is
    taken in (priority, document, sentence) order.
    """
    found = first_occurrence(ranked_sources(sources, **gate))
    if target is None:
        return found
    return smallest_k(materialise(found, "corpus"), target, "ord", lo=None)


REPORT = "priority int, status string, n_new long, error string"


def mine_sources(spark: SparkSession, sources: Sequence[Callable[[], DataFrame]], target: int | None = None,
                 doc: str = "doc_id", text: str = "text", **gate: int) -> tuple[DataFrame, DataFrame]:
    """Distinct good sentences of any number of sources in priority order, and a report on the sources.

    Each source is a function that opens it. Sources are read one after another: a later one
    contributes the sentences that no earlier one has, and is not opened once ``target`` is met. A
    source that cannot be opened or read to its end contributes nothing and the next one takes over.
    Rows are (priority, ``doc``, sent_idx, sentence); the last source read is cut by the order of
    (``doc``, sent_idx), so ids may be of any type that has an order, negative or NULL (first) too.

    The report has a row per source: its priority, ``read``, ``failed`` or ``not needed``, the number
    of new sentences and the error. NULL and empty texts have no sentences. Without a readable
    source the corpus is empty and has a BIGINT ``doc``.
    """
    parts: list[DataFrame] = []
    report: list[tuple] = []
    total = 0
    for priority, read in enumerate(sources):
        if target is not None and total >= target:
            report.append((priority, "not needed", 0, None))
            continue
        try:
            found = first_occurrence(good_sentences(read().select(doc, text), text, **gate).select(
                F.struct(F.col(doc).alias("doc"), F.col("sent_idx").alias("idx")).alias("_place"), "sentence"), "_place")
            # Written once, so a source that breaks halfway is known as failed before any row of it counts.
            fresh = materialise(found, "source")
        except (PySparkException, Py4JJavaError, OSError) as exc:
            report.append((priority, "failed", 0, str(exc).split("\n", 1)[0]))
            continue
        if parts:
            fresh = materialise(unseen(fresh, reduce(DataFrame.unionByName, [p.select("sentence") for p in parts])),
                                "source-new")
        n = fresh.count()
        if target is not None and total + n > target:
            n = target - total
            fresh = with_index(fresh, "_place", "_idx").where(F.col("_idx") < n).drop("_idx")
        parts.append(fresh.withColumn("priority", F.lit(priority)))
        total += n
        report.append((priority, "read", n, None))
    told = small_table(spark, report, REPORT) if report else spark.createDataFrame([], REPORT)
    if not parts:
        return spark.createDataFrame([], f"priority int, {doc} bigint, sent_idx int, sentence string"), told
    corpus = reduce(DataFrame.unionByName, parts)
    return corpus.select("priority", F.col("_place.doc").alias(doc), F.col("_place.idx").alias("sent_idx"), "sentence"), told


def unseen(batch: DataFrame, seen: DataFrame, text: str = "sentence") -> DataFrame:
    """Incremental form of the dedupe: rows whose text was not collected before."""
    return batch.join(seen.select(text), text, "left_anti")


def word_runs(s: Column) -> Column:
    """Distinct word tokens (runs of letters, digits and underscores)."""
    return F.array_distinct(F.split(s, f"[^{t.WORD[1:-1]}]+"))


def target_word(s: Column) -> Column:
    """True if any spelling target occurs as a whole word (the semi-join form)."""
    return s.rlike(t.any_word([c for _, c, _ in SPELLING_TARGETS]))


def spelling_matches(sentences: DataFrame, text: str = "sentence") -> DataFrame:
    """Sentence x spelling group with the usable (correct, typo) variants, in list order.

    The target table is a fixed literal of 26 rows, so the join is done inside the row: no
    shuffle, no nested loop. A substring test runs before each whole-word test.
    """
    s = F.col(text)

    def variant(correct: str, typo: str) -> Column:
        hit = F.contains(s, F.lit(correct)) & s.rlike(t.any_word([correct]))
        return F.when(hit, F.struct(F.lit(correct).alias("correct"), F.lit(typo).alias("typo")))

    groups = F.array(*[
        F.struct(F.lit(g).alias("grp"), F.array_compact(F.array(*[
            variant(c, w) for grp, c, w in SPELLING_TARGETS if grp == g])).alias("usable"))
        for g in GROUPS])
    bound = bind(sentences, _hits=F.filter(groups, lambda g: F.size(g["usable"]) > 0))
    return bound.select("*", F.inline("_hits")).drop("_hits")


def match_words(sentences: DataFrame, targets: DataFrame, text: str = "sentence",
                word: str = "correct") -> DataFrame:
    """Equi-join form for a caller-supplied target table of any size.

    Tokens are exploded once; Spark broadcasts the table only if its measured size is under
    the session's threshold and shuffles by token otherwise.
    """
    tokens = sentences.select("*", F.explode(word_runs(F.col(text))).alias(word))
    return tokens.join(targets, word)


def spelling_sources(sentences: DataFrame, per_group: int) -> DataFrame:
    """First ``per_group`` sentences of every spelling group, in packed file order."""
    hits = spelling_matches(sentences)
    if per_group <= GROUP_LIMIT_MAX_K:
        return first_k(hits, per_group, [F.col("ord")], ["grp"])
    return smallest_k(materialise(hits, "hits"), per_group, "ord", ["grp"], lo=None)


def group_counts(hits: DataFrame) -> DataFrame:
    """Rows per spelling group, zero for a group without any."""
    dim = small_table(hits.sparkSession, [(g,) for g in GROUPS], "grp string")
    counted = hits.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counted, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))


def all_quotas_met(counts: DataFrame, k: int) -> DataFrame:
    return counts.agg(F.bool_and(F.col("n") >= k).alias("all_met"))
