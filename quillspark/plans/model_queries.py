"""Registered queries: verdicts, latency statistics, training-example preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corrupt as c
from ..functions import draws as d
from ..functions import text as t
from ..functions import verdict as v
from ..functions.vocab import ANSWER_PHRASES, EVAL_CASES, QUESTION_TELLS
from ..operators import evaluate as e
from ..operators import examples as x
from ..operators import quota as o
from ..operators import stats as s
from ..sources.tables import table
from . import sqlkit as k
from .stand_in import length_tokenizer
from .text_queries import docs, turns

QUERIES: dict[str, tuple] = {}
CATEGORIES = ["NORMAL", "QUESTION", "PROVOCATIVE", "EDGE"]


def register(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


# --- verdicts --------------------------------------------------------------------------
# Every conversation turn is a case; its "model output" is derived from the turn by a draw,
# so that each rule fires: echo, answer phrase, answer fragment, nothing, essay, drift.

def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.concat_ws(":", "conv_id", "turn")
    dig = d.digest(7, rid, "eval")
    base = d.bind(turns(spark, sf), dig=dig,
                  t=t.collapse_spaces(F.col("text"))).drop("text")
    dg, tx = F.col("dig"), F.col("text")
    cased = d.bind(
        base, case_id=rid,
        category=d.choice(CATEGORIES, dg, 1),
        text=F.when(d.gate(dg, 0.15), F.concat(F.lit("explain neural networks "), "t"))
        .when(d.gate(dg, 0.20), F.lit("")).otherwise(F.col("t")))
    kind = d.index(dg, 8, 2)
    output = (F.when(kind == 0, t.clean(tx))
              .when(kind == 1, F.concat(d.choice(ANSWER_PHRASES, dg, 3), F.lit(" "), tx))
              .when(kind == 2, F.concat(tx, F.lit(" "), d.choice(QUESTION_TELLS, dg, 3)))
              .when(kind == 3, F.lit(""))
              .when(kind == 4, F.concat_ws(" ", tx, tx, tx, tx))
              .when(kind == 5, F.lit("no idea at all"))
              .when(kind == 6, c.remove_punctuation(F.lower(tx)))
              .otherwise(F.concat_ws(" ", tx, tx, tx)))
    return d.bind(cased, output=output).select("case_id", "category", "text", "output")


_DIG = k.digest(7, "conv_id || ':' || turn", "eval")
EVAL = f"""evals AS MATERIALIZED (SELECT case_id, category, text, CASE {k.index('dig', 8, 2)}
 WHEN 0 THEN {k.clean('text')} WHEN 1 THEN {k.choice(ANSWER_PHRASES, 'dig', 3)} || ' ' || text
 WHEN 2 THEN text || ' ' || {k.choice(QUESTION_TELLS, 'dig', 3)} WHEN 3 THEN ''
 WHEN 4 THEN concat_ws(' ', text, text, text, text) WHEN 5 THEN 'no idea at all'
 WHEN 6 THEN {k.remove_punctuation('lower(text)')} ELSE concat_ws(' ', text, text, text) END
 AS output FROM (SELECT case_id, dig, {k.choice(CATEGORIES, 'dig', 1)} AS category,
 CASE WHEN {k.gate('dig', 0.15)} THEN 'explain neural networks ' || t
 WHEN {k.gate('dig', 0.20)} THEN '' ELSE t END AS text FROM (SELECT conv_id || ':' || turn AS
 case_id, {_DIG} AS dig, {k.collapse('text')} AS t FROM conversations)))"""


def joined(words):
    return F.array_join(F.sort_array(words), " ")


def sql_joined(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


@register("word_set_e1", f"WITH {EVAL} SELECT case_id, {sql_joined(k.word_set('output'))} AS words FROM evals")
def word_set(spark, sf):
    return eval_rows(spark, sf).select("case_id", joined(v.word_set(F.col("output"))).alias("words"))


@register("word_intersect_u3", f"""WITH {EVAL} SELECT case_id,
 {sql_joined(f"list_intersect({k.word_set('text')}, {k.word_set('output')})")} AS words FROM evals""")
def word_intersect(spark, sf):
    both = F.array_intersect(v.word_set(F.col("text")), v.word_set(F.col("output")))
    return eval_rows(spark, sf).select("case_id", joined(both).alias("words"))


@register("overlap_e2", f"WITH {EVAL}, {k.verdict('evals')} SELECT case_id, round(ov, 9) AS ov FROM v0")
def overlap(spark, sf):
    ov = v.overlap(v.word_set(F.col("text")), v.word_set(F.col("output")))
    return eval_rows(spark, sf).select("case_id", F.round(ov, 9).alias("ov"))


@register("answer_phrase_e3", f"""WITH {EVAL} SELECT case_id,
 {k.first_hit('lower(output)', ANSWER_PHRASES)} AS phrase FROM evals""")
def answer_phrase(spark, sf):
    return eval_rows(spark, sf).select(
        "case_id", v.first_hit(F.lower("output"), ANSWER_PHRASES).alias("phrase"))


@register("question_tell_e4", f"""WITH {EVAL} SELECT case_id,
 trim({k.first_hit('lower(output)', QUESTION_TELLS)}) AS tell FROM evals
 WHERE category = 'QUESTION'""")
def question_tell(spark, sf):
    return eval_rows(spark, sf).where(F.col("category") == "QUESTION").select(
        "case_id", F.trim(v.first_hit(F.lower("output"), QUESTION_TELLS)).alias("tell"))


def _rule(name: str, fragment: str):
    @register(name, f"""WITH {EVAL}, {k.verdict('evals')} SELECT case_id, category, reason
 FROM verdicts WHERE contains(reason, '{fragment}')""")
    def run(spark, sf):
        return v.with_verdict(eval_rows(spark, sf)).where(
            F.contains("reason", F.lit(fragment))).select("case_id", "category", "reason")
    return run


_rule("question_explained_e5", "likely explained")
_rule("low_overlap_e6", "low word overlap")
_rule("too_elaborative_e7", "too elaborative")


@register("verdict_e8", f"""WITH {EVAL}, {k.verdict('evals')}
 SELECT case_id, category, flagged, reason FROM verdicts""")
def verdict(spark, sf):
    return v.with_verdict(eval_rows(spark, sf)).select("case_id", "category", "flagged", "reason")


@register("verdict_summary_a2", f"""WITH {EVAL}, {k.verdict('evals')} SELECT category,
 count(*) AS total, count(*) FILTER (flagged) AS n_flagged,
 count(*) FILTER (NOT flagged) AS n_clean FROM verdicts GROUP BY category""")
def verdict_summary(spark, sf):
    return e.summary(v.with_verdict(eval_rows(spark, sf)), ["category"])


@register("case_output_join_j5", f"""WITH pairs AS (SELECT a.conv_id || ':' || a.turn AS case_id,
 'PROVOCATIVE' AS category, {k.collapse('a.text')} AS text, {k.collapse('b.text')} AS output
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
 WHERE a.role = 'user'), {k.verdict('pairs')} SELECT case_id, flagged, reason FROM verdicts""")
def case_output_join(spark, sf):
    every = turns(spark, sf)
    text = t.collapse_spaces(F.col("text"))
    cases = every.where(F.col("role") == "user").select(
        "conv_id", "turn", F.lit("PROVOCATIVE").alias("category"), text.alias("text"))
    outputs = every.select("conv_id", (F.col("turn") - 1).alias("turn"), text.alias("output"))
    return e.judged(cases, outputs, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("case_id"), "flagged", "reason")


SUITE = "(VALUES " + ", ".join(
    f"({i}, {k.q(a)}, {k.q(b)}, {k.q(n)})" for i, (a, b, n) in enumerate(EVAL_CASES, 1)) + ")"
VRID = "source || ':' || case_id"
VARIANTS = f"""suite(case_id, category, text, note) AS {SUITE}, outs AS (SELECT source, case_id,
 category, text, note, {k.corrupt_light('text', 7, VRID)} AS output FROM
 (SELECT DISTINCT source FROM documents), suite), {k.verdict('outs')}"""


def variant_rows(spark: SparkSession, sf: str) -> DataFrame:
    variants = table(spark, sf, "documents", "source").distinct()
    rows = e.per_variant(variants)
    rid = F.concat_ws(":", "source", "case_id")
    return v.with_verdict(rows.withColumn("output", c.corrupt_light(F.col("text"), 7, rid)))


@register("literal_suite_s10", f"""WITH {VARIANTS} SELECT source, case_id, category, note,
 CASE WHEN text = '' THEN '(empty)' ELSE text END AS shown_in,
 CASE WHEN output = '' THEN 'EMPTY' ELSE output END AS shown_out FROM outs""")
def literal_suite(spark, sf):
    return e.rendered(variant_rows(spark, sf)).select(
        "source", "case_id", "category", "note", "shown_in", "shown_out")


@register("case_variant_cross_j6", f"""WITH {VARIANTS} SELECT case_id,
 coalesce(source, '(none)') AS variant, bool_or(flagged) AS flagged FROM verdicts GROUP BY ALL""")
def case_variant_cross(spark, sf):
    return e.variant_flags(variant_rows(spark, sf).withColumnRenamed("source", "variant"))


@register("flagged_ids_a2", f"""WITH {VARIANTS} SELECT source, coalesce(string_agg('[' ||
 lpad(case_id::VARCHAR, 2, '0') || ']', ', ' ORDER BY case_id) FILTER (flagged), '')
 AS flagged_cases FROM verdicts GROUP BY source""")
def flagged_ids(spark, sf):
    return e.flagged_ids(variant_rows(spark, sf), ["source"])


@register("positional_zip_j7", """SELECT event_id AS idx, value AS ms FROM events
 JOIN documents ON event_id = doc_id WHERE text <> ''""")
def positional_zip(spark, sf):
    cases = table(spark, sf, "documents", "doc_id", "text").where(F.col("text") != "").select(
        F.col("doc_id").alias("idx"))
    return table(spark, sf, "events", "event_id", "value").select(
        F.col("event_id").alias("idx"), F.col("value").alias("ms")).join(cases, "idx")


# --- latency and tokens ----------------------------------------------------------------

STAGE_SQL = """timings AS (SELECT CASE event_type WHEN 'click' THEN 'Whisper transcribe'
 WHEN 'view' THEN 'Formatter (fast)' ELSE 'Text injection' END AS stage, user_id AS iter,
 value AS ms FROM events)"""


def timings(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events", "event_type", "user_id", "value").select(
        F.when(kind == "click", "Whisper transcribe").when(kind == "view", "Formatter (fast)")
        .otherwise("Text injection").alias("stage"),
        F.col("user_id").alias("iter"), F.col("value").alias("ms"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("stage_stats_a3", f"""WITH {STAGE_SQL} SELECT s.stage, min(ms) AS min_ms,
 round(avg(ms), 6) AS avg_ms, max(ms) AS max_ms FROM (VALUES ('Whisper transcribe'),
 ('Formatter (fast)'), ('Formatter (LLM)'), ('Text injection')) s(stage)
 LEFT JOIN timings USING (stage) GROUP BY s.stage""")
def stage_stats(spark, sf):
    return rounded(s.stage_stats(timings(spark, sf)), "avg_ms")


@register("iteration_totals_a6", f"""WITH {STAGE_SQL} SELECT 'TOTAL' AS stage, iter,
 round(sum(coalesce(ms, 0)), 6) AS ms FROM timings GROUP BY iter
 UNION ALL SELECT stage, iter, round(ms, 6) FROM timings""")
def iteration_totals(spark, sf):
    return rounded(s.with_totals(timings(spark, sf)), "ms")


def _latency_sql(source: str, group: str, value: str) -> str:
    return f"""SELECT {group}, count({value}) AS n, round(avg({value}), 6) AS avg_ms,
 min({value}) AS min_ms, max({value}) AS max_ms, round(median({value}), 6) AS p50_ms,
 list_sort(list({value}))[floor(0.95::DOUBLE * (count({value}) - 1))::INT + 1] AS p95_ms
 FROM {source} GROUP BY {group}"""


@register("latency_summary_a4", _latency_sql("events", "event_type", "value"))
def latency_summary(spark, sf):
    rows = table(spark, sf, "events", "event_type", "value")
    return rounded(s.latency_summary(rows, ["event_type"], "value"), "avg_ms", "p50_ms")


@register("skewed_percentile_w8", _latency_sql("lineitem", "l_returnflag", "l_extendedprice"))
def skewed_percentile(spark, sf):
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    return rounded(s.latency_summary(rows, ["l_returnflag"], "l_extendedprice",
                                     limit=10_000), "avg_ms", "p50_ms")


@register("token_stats_a5", """SELECT event_type, round(avg_tok, 6) AS avg_tok, max_tok,
 round(avg_ms, 6) AS avg_ms, round(avg_tok / (avg_ms / 1000), 6) AS tok_per_s,
 max_tok >= 150 AS hit_cap, avg_ms < 400 AS target_met FROM (SELECT event_type,
 avg(least(150, 1 + floor(value / 3))) AS avg_tok, max(least(150, 1 + floor(value / 3)))::INT AS max_tok,
 avg(value * 8) AS avg_ms FROM events GROUP BY event_type)""")
def token_stats(spark, sf):
    made = table(spark, sf, "events", "event_type", "value").select(
        "event_type", F.least(F.lit(150), 1 + F.floor(F.col("value") / 3)).cast("int").alias("n_tok"),
        (F.col("value") * 8).alias("ms"))
    return rounded(s.token_stats(made, ["event_type"]), "avg_tok", "avg_ms", "tok_per_s")


@register("first_vs_rest_a7", """SELECT event_type, first_ms, n_nonempty,
 round((total - head) / greatest(1, n_nonempty - 1), 6) AS rest_avg_ms FROM (SELECT event_type,
 arg_min(value, event_id) AS first_ms, count(*) FILTER (props <> '{"k": 7}') AS n_nonempty,
 sum(value) FILTER (props <> '{"k": 7}') AS total,
 arg_min(value, event_id) FILTER (props <> '{"k": 7}') AS head FROM events GROUP BY event_type)
 WHERE n_nonempty > 0""")
def first_vs_rest(spark, sf):
    made = table(spark, sf, "events", "event_id", "event_type", "value", "props").select(
        "event_type", F.col("event_id").alias("idx"), F.col("value").alias("ms"),
        F.when(F.col("props") == '{"k": 7}', "").otherwise(F.col("props")).alias("text"))
    return rounded(s.first_vs_rest(made, ["event_type"]), "rest_avg_ms")


# --- training examples -----------------------------------------------------------------

PAIRS = """pairs AS (SELECT conv_id || ':' || turn AS pair_id, lower(text) AS input,
 text AS output FROM conversations)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.lower("text").alias("input"),
        F.col("text").alias("output"))


_WS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_PROMPT = _WS.format("'Input: ' || input || chr(10) || 'Output: '")
VOCAB = f"""{PAIRS}, vocab AS (SELECT token, count(*) AS n, (row_number() OVER
 (ORDER BY count(*) DESC, token) + 2)::INT AS token_id FROM (SELECT unnest({_PROMPT}) AS token
 FROM pairs UNION ALL SELECT unnest({_WS.format('output')}) FROM pairs) GROUP BY token)"""
EXAMPLES = f"""{VOCAB}, toks AS (SELECT pair_id, 0 AS part, unnest({_PROMPT}) AS token,
 unnest(range(len({_PROMPT}))) AS pos FROM pairs UNION ALL SELECT pair_id, 1,
 unnest({_WS.format('output')}), unnest(range(len({_WS.format('output')}))) FROM pairs),
 enc AS (SELECT pair_id, list(token_id ORDER BY pos) FILTER (part = 0) AS p,
 coalesce(list(token_id ORDER BY pos) FILTER (part = 1), []) AS o FROM toks JOIN vocab
 USING (token) GROUP BY pair_id),
 examples AS (SELECT pair_id, (list_concat(p, o, [1]))[1:256] AS input_ids,
 (list_concat(list_transform(p, lambda z: -100), o, [1]))[1:256] AS labels FROM enc)"""


def vocab_of(rows: DataFrame) -> DataFrame:
    both = rows.select(F.explode(F.array(t.prompt(F.col("input")), F.col("output"))).alias("text"))
    return x.vocabulary(both)


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf)
    return x.examples(x.encode(rows, vocab_of(rows)))


def ids_text(col: str):
    return F.array_join(F.col(col).cast("array<string>"), ",").alias(col)


@register("vocabulary_l1", f"WITH {VOCAB} SELECT token, n, token_id FROM vocab")
def vocabulary(spark, sf):
    return vocab_of(pairs(spark, sf))


@register("tokenised_pairs_l1", f"""WITH {EXAMPLES} SELECT pair_id,
 array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels
 FROM examples""")
def tokenised_pairs(spark, sf):
    return encoded(spark, sf).select("pair_id", ids_text("input_ids"), ids_text("labels"))


_LEN = "list_transform({}, lambda w: length(w))"


@register("tokenizer_hook_u2", f"""WITH {PAIRS}, enc AS (SELECT pair_id,
 {_LEN.format(_PROMPT)} AS p, {_LEN.format(_WS.format('output'))} AS o FROM pairs)
 SELECT pair_id, array_to_string((list_concat(p, o, [1]))[1:384], ',') AS input_ids,
 array_to_string((list_concat(list_transform(p, lambda z: -100), o, [1]))[1:384], ',') AS labels
 FROM enc""")
def tokenizer_hook(spark, sf):
    made = x.encode_with(pairs(spark, sf), length_tokenizer)
    return x.examples(made, max_len=384).select("pair_id", ids_text("input_ids"), ids_text("labels"))


@register("attention_mask_l2", f"""WITH {EXAMPLES} SELECT pair_id,
 repeat('1', len(input_ids)) AS mask FROM examples""")
def attention_mask(spark, sf):
    return encoded(spark, sf).select("pair_id", F.array_join(
        F.col("attention_mask").cast("array<string>"), "").alias("mask"))


_BDIG = k.digest(42, "pair_id", "batch")
BATCHES = f"""{EXAMPLES}, keyed AS (SELECT *, {k.index(_BDIG, x.SHARDS, 0)} AS shard,
 {k.draw(_BDIG, 1)} AS dr FROM examples), numbered AS (SELECT *, row_number() OVER
 (PARTITION BY shard ORDER BY dr, pair_id) - 1 AS rn FROM keyed),
 widths AS (SELECT shard, rn // 4 AS batch, max(len(input_ids)) AS width FROM numbered GROUP BY ALL)"""


@register("batch_width_a13", f"""WITH {BATCHES} SELECT shard::INT AS shard, batch::INT AS batch,
 width::INT AS width FROM widths""")
def batch_width(spark, sf):
    return x.padded_batches(o.materialise(encoded(spark, sf), "examples"), 42).select(
        "shard", "batch", "width")


def _padded(field: str, value: int) -> str:
    return (f"array_to_string(list_concat({field}, list_transform(range(width - len({field})), "
            f"lambda z: {value})), ',')")


@register("padded_batches_l3", f"""WITH {BATCHES} SELECT shard::INT AS shard, batch::INT AS batch,
 string_agg({_padded('input_ids', 0)}, ';' ORDER BY rn) AS input_ids,
 string_agg({_padded("list_transform(input_ids, lambda q: 1)", 0)}, ';' ORDER BY rn) AS attention_mask,
 string_agg({_padded('labels', -100)}, ';' ORDER BY rn) AS labels
 FROM (SELECT *, rn // 4 AS batch FROM numbered) JOIN widths USING (shard, batch)
 GROUP BY shard, batch""")
def padded_batches(spark, sf):
    def matrix(col: str):
        return F.array_join(F.transform(col, lambda r: F.array_join(
            r.cast("array<string>"), ",")), ";").alias(col)
    made = x.padded_batches(o.materialise(encoded(spark, sf), "examples"), 42)
    return made.select("shard", "batch", matrix("input_ids"), matrix("attention_mask"),
                       matrix("labels"))


_SPLIT = k.digest(42, "doc_id", "split")


@register("split_threshold_l4", f"""SELECT doc_id, CASE WHEN {k.gate(_SPLIT, 0.05)} THEN 'val'
 ELSE 'train' END AS part FROM documents""")
def split_threshold(spark, sf):
    return table(spark, sf, "documents", "doc_id").select(
        "doc_id", o.split_flag(42, F.col("doc_id"), 0.05).alias("part"))


@register("split_exact_l4", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY
 {k.draw(_SPLIT)}, doc_id) <= ceil((SELECT count(*) FROM documents) * 0.2::DOUBLE) THEN 'val'
 ELSE 'train' END AS part FROM documents""")
def split_exact(spark, sf):
    train, val = o.split_exact(table(spark, sf, "documents", "doc_id"), 42, F.col("doc_id"),
                               0.2, ["doc_id"])
    return train.withColumn("part", F.lit("train")).unionByName(
        val.withColumn("part", F.lit("val")))


@register("prediction_listing_l5", f"""SELECT doc_id, substr(text, 1, 120) AS gold,
 substr({k.clean('lower(text)')}, 1, 120) AS predicted FROM (SELECT * FROM documents
 WHERE {k.gate(_SPLIT, 0.2)} ORDER BY {k.draw(k.digest(42, 'doc_id', 'listing'))}, doc_id LIMIT 5)""")
def prediction_listing(spark, sf):
    rows = docs(spark, sf)
    i = F.col("doc_id")
    val = rows.where(o.split_flag(42, i, 0.2) == "val")
    shown = o.sample_n(val.select("doc_id"), 5, 42, i, ["doc_id"], "listing")
    predicted = rows.select("doc_id", t.clean(F.lower("text")).alias("p"))
    return shown.join(rows, "doc_id").join(predicted, "doc_id").select(
        "doc_id", t.preview(F.col("text")).alias("gold"), t.preview(F.col("p")).alias("predicted"))
