"""Registered queries: corpus mining, word joins, quotas, samples, mixes, pair statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as d
from ..functions.text import WORD
from ..functions.vocab import MISSPELLINGS, SPELLING_TARGETS
from ..operators import generate as g
from ..operators import mining as m
from ..operators import quota as o
from ..sources.tables import small_table, table
from . import sqlkit as k
from .text_queries import (PASS_SQL, PLANTED_CORPUS, SEED, cardinal_sql, corpus, docs, good, ids,
                           planted_corpus, spelling_sql)

QUERIES: dict[str, tuple] = {}
TARGET = 9000


def register(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


PRIORITY = "CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END"


def three_sources(spark: SparkSession, sf: str) -> list[DataFrame]:
    base = docs(spark, sf, "source")
    src = F.col("source")
    return [base.where(src == "src0"), base.where(src == "src1"),
            base.where(~src.isin("src0", "src1"))]


@register("multi_source_corpus_s5", f"""WITH {k.corpus(priority=PRIORITY)}
 SELECT ord, sentence FROM corpus ORDER BY ord LIMIT {TARGET}""")
def multi_source_corpus(spark, sf):
    readers = [lambda df=df: df for df in three_sources(spark, sf)]
    found, _ = m.mine_sources(spark, readers, TARGET)
    return found.select(m.file_order(F.col("priority")).alias("ord"), "sentence")


# --- joins -----------------------------------------------------------------------------

REPLACED = dict(reversed([(a, b) for a, b in MISSPELLINGS if " " not in a and "'" not in a]))


@register("token_lookup_j1", f"""SELECT token, coalesce(r.typo, token) AS replacement,
 count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) AS token
 FROM documents) LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in REPLACED.items())})
 r(token, typo) USING (token) GROUP BY ALL""")
def token_lookup(spark, sf):
    tokens = docs(spark, sf).select(
        F.explode(F.split("text", f"[^{WORD[1:-1]}]+")).alias("token")).where("token <> ''")
    lookup = small_table(spark, list(REPLACED.items()), "token string, typo string")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(lookup, "token", "left").select(
        "token", F.coalesce("typo", "token").alias("replacement"), "n")


TARGET_VALUES = ", ".join(f"('{gr}', '{a}', '{b}')" for gr, a, b in SPELLING_TARGETS)


def targets(spark: SparkSession) -> DataFrame:
    return small_table(spark, SPELLING_TARGETS, "grp string, correct string, typo string")


@register("word_match_j2", f"""WITH {PLANTED_CORPUS} SELECT ord, grp, correct, typo FROM
 (SELECT ord, unnest(list_distinct(regexp_extract_all(sentence, '[\\pL\\pN_]+'))) AS correct
 FROM corpus) JOIN (VALUES {TARGET_VALUES}) v(grp, correct, typo) USING (correct)""")
def word_match(spark, sf):
    return m.match_words(planted_corpus(spark, sf), targets(spark)).select("ord", "grp", "correct", "typo")


@register("source_dedupe_j3", f"WITH {k.corpus(priority=PRIORITY)} SELECT ord, sentence FROM corpus")
def source_dedupe(spark, sf):
    return m.mine_corpus(three_sources(spark, sf)).select("ord", "sentence")


@register("incremental_dedupe_j3", f"""WITH {k.good_sents()} SELECT DISTINCT sentence FROM good
 WHERE source <> 'src0' AND sentence NOT IN (SELECT sentence FROM good WHERE source = 'src0')""")
def incremental_dedupe(spark, sf):
    base = m.good_sentences(docs(spark, sf, "source"))
    seen = base.where(F.col("source") == "src0")
    fresh = base.where(F.col("source") != "src0").select("sentence").distinct()
    return m.unseen(fresh, seen)


@register("any_target_semi_j4", f"""WITH {PLANTED_CORPUS} SELECT ord FROM corpus WHERE
 list_has_any(regexp_extract_all(sentence, '[\\pL\\pN_]+'),
 {k.strings([c for _, c, _ in SPELLING_TARGETS])})""")
def any_target_semi(spark, sf):
    return planted_corpus(spark, sf).where(m.target_word(F.col("sentence"))).select("ord")


# --- quotas and windows ------------------------------------------------------------------

@register("first_per_group_w3", f"""WITH {PLANTED_CORPUS}, {spelling_sql(5000, 43)}
 SELECT grp, ord FROM src""")
def first_per_group(spark, sf):
    return m.spelling_sources(planted_corpus(spark, sf), 5000 // len(m.GROUPS) + 50).select("grp", "ord")


@register("large_group_quota_w3", f"""SELECT lang, source, doc_id, sent_idx FROM (WITH {k.good_sents()}
 SELECT lang, source, doc_id, sent_idx, row_number() OVER (PARTITION BY lang
 ORDER BY doc_id * 1048576 + sent_idx) AS rn FROM good) WHERE rn <= 1500""")
def large_group_quota(spark, sf):
    rows = m.good_sentences(docs(spark, sf, "lang", "source")).select(
        "lang", "source", "doc_id", "sent_idx", m.file_order().alias("ord"))
    rows = o.materialise(rows, "good")
    return o.smallest_k(rows, 1500, "ord", ["lang"], lo=None).drop("ord")


@register("global_cap_w4", f"""WITH {k.corpus()} SELECT ord, sentence FROM corpus
 ORDER BY ord LIMIT {TARGET}""")
def global_cap(spark, sf):
    return m.mine_corpus([docs(spark, sf)], TARGET)


@register("cyclic_reuse_w5", f"""WITH {k.corpus()}, n AS (SELECT count(*) AS n FROM corpus),
 r AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS idx FROM corpus)
 SELECT event_id, ord FROM events, n JOIN r ON (event_id * 3) % n.n = r.idx""")
def cyclic_reuse(spark, sf):
    asked = table(spark, sf, "events", "event_id").withColumn("a", F.col("event_id") * 3)
    return o.cyclic(asked, "a", corpus(spark, sf).select("ord"), "ord").select("event_id", "ord")


SHUF = k.draw(k.digest(SEED, "sid", "shuf"))


@register("shuffle_o1", f"WITH {k.good_sents()} SELECT sid, {SHUF} AS shuf FROM good")
def shuffle(spark, sf):
    return o.shuffled(good(spark, sf).select("sid"), SEED, F.col("sid"))


@register("limit_to_target_o2", f"""WITH {k.good_sents()} SELECT sid, {SHUF} AS shuf FROM good
 ORDER BY shuf, sid LIMIT 5000""")
def limit_to_target(spark, sf):
    keyed = good(spark, sf).select("sid", d.shuffle_key(SEED, F.col("sid")).alias("shuf"))
    return o.smallest_k(o.materialise(keyed, "keyed"), 5000, "shuf", tie=["sid"])


@register("sample_n_o3", f"""SELECT doc_id FROM documents
 ORDER BY {k.draw(k.digest(SEED, 'doc_id', 'sample'))}, doc_id LIMIT 300""")
def sample_n(spark, sf):
    rows = table(spark, sf, "documents", "doc_id")
    return o.sample_n(rows, 300, SEED, F.col("doc_id"), ["doc_id"])


EDRAW = k.draw(k.digest(SEED, "event_id", "quota"))


@register("exact_group_quota_o5", f"""SELECT event_type, event_id FROM events
 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {EDRAW}, event_id) <= 1200""")
def exact_group_quota(spark, sf):
    keyed = table(spark, sf, "events", "event_id", "event_type").withColumn(
        "draw", d.shuffle_key(SEED, F.col("event_id"), "quota"))
    return o.smallest_k(keyed, 1200, "draw", ["event_type"], ["event_id"]).select(
        "event_type", "event_id")


# --- aggregates over sentences -----------------------------------------------------------

@register("distinct_sentences_a12", f"""WITH {k.corpus()}
 SELECT ord, sentence, length(sentence) AS n_chars FROM corpus""")
def distinct_sentences(spark, sf):
    return corpus(spark, sf).withColumn("n_chars", F.length("sentence")).select(
        "ord", "sentence", "n_chars")


GROUP_COUNT_SQL = f"""{PLANTED_CORPUS}, hits AS (SELECT DISTINCT ord, grp FROM
 (SELECT ord, unnest(regexp_extract_all(sentence, '[\\pL\\pN_]+')) AS correct FROM corpus)
 JOIN (VALUES {TARGET_VALUES}) v(grp, correct, typo) USING (correct)), counts AS (
 SELECT grp, count(ord) AS n FROM (SELECT DISTINCT grp FROM (VALUES {TARGET_VALUES})
 v(grp, correct, typo)) LEFT JOIN hits USING (grp) GROUP BY grp)"""


@register("group_source_counts_a9", f"WITH {GROUP_COUNT_SQL} SELECT grp, n FROM counts")
def group_source_counts(spark, sf):
    return m.group_counts(m.spelling_matches(planted_corpus(spark, sf)))


@register("all_quotas_met_a10", f"""WITH {GROUP_COUNT_SQL} SELECT quota, bool_and(n >= quota)
 AS all_met FROM counts, (VALUES (1), (20), (454), (5000)) q(quota) GROUP BY quota""")
def all_quotas_met(spark, sf):
    counts = o.materialise(m.group_counts(m.spelling_matches(planted_corpus(spark, sf))), "counts")
    return reduce(DataFrame.unionByName, [
        m.all_quotas_met(counts, quota).withColumn("quota", F.lit(quota)) for quota in (1, 20, 454, 5000)])


# --- pair sets -----------------------------------------------------------------------------

PAIRS_SQL = (f"(SELECT pair_id, category, {k.corrupt_light('output', SEED, 'pair_id')} AS input, "
             f"output FROM ({PASS_SQL}))")


@register("pair_stats_a1", f"""SELECT count(*) AS total, round(avg(length(input)), 6) AS avg_in,
 round(avg(length(output)), 6) AS avg_out,
 round(avg(length(input)) - avg(length(output)), 6) AS overhead FROM {PAIRS_SQL}""")
def pair_stats(spark, sf):
    stats = g.pair_stats(g.pass_through_pairs(ids(spark, sf), SEED))
    return stats.select("total", *[F.round(c, 6).alias(c) for c in ("avg_in", "avg_out", "overhead")])


@register("pair_count_a11", """SELECT role, count(*) AS n FROM conversations
 WHERE text IS NOT NULL GROUP BY role""")
def pair_count(spark, sf):
    return table(spark, sf, "conversations", "role", "text").where(
        F.col("text").isNotNull()).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


MIX_SQL = f"""WITH {PLANTED_CORPUS}, {spelling_sql(5000, 43)}, mixed AS (SELECT * FROM {PAIRS_SQL}
 ORDER BY {k.draw(k.digest(43, 'pair_id', 'sample'))}, pair_id LIMIT 5000),
 pairs AS (SELECT * FROM spelling UNION ALL (SELECT * FROM ({cardinal_sql("SELECT 5000", 43)}))
 UNION ALL SELECT * FROM mixed)"""


def mix_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    pid = F.col("pair_id")
    passed = g.pass_through_pairs(ids(spark, sf), SEED)
    return [
        g.spelling_pairs(planted_corpus(spark, sf), 5000, 43),
        g.cardinal_pairs(ids(spark, sf), 5000, 43),
        o.sample_n(passed, 5000, 43, pid, ["pair_id"]),
    ]


@register("category_union_u1", f"{MIX_SQL} SELECT category, count(*) AS n FROM pairs GROUP BY category")
def category_union(spark, sf):
    one, two, three = mix_parts(spark, sf)
    return one.unionByName(two).unionByName(three).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"))


@register("dataset_mixer_g9", f"""{MIX_SQL} SELECT pair_id, category, input, output,
 {k.draw(k.digest(43, 'pair_id', 'shuf'))} AS shuf FROM pairs""")
def dataset_mixer(spark, sf):
    return g.mix_pairs(mix_parts(spark, sf), 43)


@register("dataset_verify_a8", f"""{MIX_SQL} SELECT
 count(*) FILTER (category = 'spelling') AS n_spelling,
 count(*) FILTER (category = 'spelling' AND {k.has_any_typo('input')}) AS n_with_typo,
 count(*) FILTER (category = 'cardinal') AS n_cardinal,
 count(*) FILTER (category = 'cardinal' AND {k.cardinal_only('input')}) AS n_guarded,
 count(*) FILTER (category NOT IN ('spelling', 'cardinal')) AS n_mixed FROM pairs""")
def dataset_verify(spark, sf):
    return g.verify_pairs(g.mix_pairs(mix_parts(spark, sf), 43))
