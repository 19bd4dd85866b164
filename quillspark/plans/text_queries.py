"""Registered queries: sentence gates, cleaning, routing, corruption, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corrupt as c
from ..functions import draws as d
from ..functions import text as t
from ..functions.vocab import HOMOPHONES, MISSPELLINGS, SPELLING_TARGETS
from ..operators import generate as g
from ..operators import mining as m
from ..operators import routing as r
from ..operators.quota import materialise
from ..sources.tables import table
from . import sqlkit as k
from .stand_in import stand_in_rewriter

SEED = 42
QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def docs(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", *extra, spread="doc_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations", "conv_id", "turn", "role", "text", spread="conv_id")


def good(spark: SparkSession, sf: str) -> DataFrame:
    """Good sentences with a text id ``sid``."""
    return d.bind(m.good_sentences(docs(spark, sf)), sid=F.concat_ws(":", "doc_id", "sent_idx"))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Good sentences with fillers inserted: the raw transcripts of the cleaner queries."""
    return d.bind(good(spark, sf), dirty=c.insert_fillers(S(), SEED, SID()))


# Every document gets one more sentence with a drawn target word and a drawn misspelt word or homophone:
# the prose of the tables holds few of them, and rules that no row meets prove nothing.
CORRECT = [word for _, word, _ in SPELLING_TARGETS]
TYPOS = [typo for _, _, typo in SPELLING_TARGETS]
RULE_WORDS = list(dict.fromkeys([w for group in HOMOPHONES for w in group] + [w for w, _ in MISSPELLINGS]))


def planted(documents: DataFrame) -> DataFrame:
    """Documents with the planted sentence behind their text; NULL texts stay NULL."""
    dig = d.digest(SEED, F.col("doc_id"), "plant")
    more = F.concat(F.lit("\nSomebody wrote "), d.choice(CORRECT, dig, 0), F.lit(" and also "),
                    d.choice(RULE_WORDS, dig, 1), F.lit(" while reading report "), "doc_id", F.lit(" aloud."))
    return documents.withColumn("text", F.concat("text", more))


_PLANT = k.digest(SEED, "doc_id", "plant")
PLANTED = (f"planted AS (SELECT doc_id, source, lang, text || chr(10) || 'Somebody wrote ' || "
           f"{k.choice(CORRECT, _PLANT, 0)} || ' and also ' || {k.choice(RULE_WORDS, _PLANT, 1)} || "
           f"' while reading report ' || doc_id || ' aloud.' AS text FROM documents)")


def good_planted(spark: SparkSession, sf: str) -> DataFrame:
    return d.bind(m.good_sentences(planted(docs(spark, sf))), sid=F.concat_ws(":", "doc_id", "sent_idx"))


GOOD_PLANTED = f"{PLANTED}, {k.good_sents(source='planted')}"


DIRTY = (f"{k.good_sents()}, dirt AS MATERIALIZED (SELECT *, "
         f"{k.insert_fillers('sentence', SEED, 'sid')} AS dirty FROM good)")


def S():
    return F.col("sentence")


def SID():
    return F.col("sid")


def D():
    return F.col("dirty")



# --- projections and gates -----------------------------------------------------------

@register("sentence_split_p1", f"WITH {k.sents()} SELECT doc_id, sent_idx, sentence FROM sents")
def sentence_split(spark, sf):
    return m.explode_sentences(docs(spark, sf))


@register("quality_gate_p2",
          f"WITH {k.good_sents()} SELECT doc_id, sent_idx, sentence FROM good")
def quality_gate(spark, sf):
    return m.good_sentences(docs(spark, sf))


@register("quality_gate_v3_p2",
          f"WITH {k.good_sents(8, 80)} SELECT doc_id, sent_idx, sentence FROM good")
def quality_gate_v3(spark, sf):
    return m.good_sentences(docs(spark, sf), max_words=80)


@register("non_blank_p3", """SELECT conv_id, turn, trim(text, chr(10) || ' ') AS text
 FROM conversations WHERE trim(text, chr(10) || ' ') <> ''""")
def non_blank(spark, sf):
    return turns(spark, sf).where(t.not_blank(F.col("text"))).select(
        "conv_id", "turn", t.strip(F.col("text")).alias("text"))


@register("no_signal_filter_p4", f"""WITH {k.good_sents()}, p AS (SELECT sid,
 {k.number_words('sentence')} AS input, sentence AS output FROM good)
 SELECT * FROM p WHERE {k.has_signal('input', 'output')}""")
def no_signal_filter(spark, sf):
    pairs = d.bind(good(spark, sf), input=c.number_words(S())).select(
        "sid", "input", S().alias("output"))
    return pairs.where(t.has_signal(F.col("input"), F.col("output")))


@register("typo_survived_p5", f"""WITH {k.good_sents()} SELECT sid, typed FROM (SELECT sid,
 {k.replace_first('sentence', 'the', 'teh')} AS typed FROM good)
 WHERE contains(lower(typed), 'teh')""")
def typo_survived(spark, sf):
    typed = d.bind(good(spark, sf), typed=c.force_typo(S(), F.lit("the"), F.lit("teh")))
    return typed.select("sid", "typed").where(t.typo_survived(F.col("typed"), F.lit("teh")))


@register("cardinal_only_p6", f"""SELECT doc_id, seq, {k.cardinal_only('seq')} AS guarded
 FROM (SELECT doc_id, CASE WHEN {k.gate(k.digest(SEED, 'doc_id', 'p6'), 0.5)} THEN s
 ELSE s || ' ' || lang END AS seq FROM (SELECT doc_id, lang,
 {k.cardinal_sequence(SEED, 'doc_id')} AS s FROM documents))""")
def cardinal_only(spark, sf):
    i = F.col("doc_id")
    base = table(spark, sf, "documents", "doc_id", "lang").withColumn(
        "s", g.cardinal_sequence(SEED, i))
    seq = F.when(d.gate(d.digest(SEED, i, "p6"), 0.5), F.col("s")).otherwise(
        F.concat_ws(" ", "s", "lang"))
    return base.select(i, seq.alias("seq")).select(
        "*", t.cardinal_only(F.col("seq")).alias("guarded"))


# The planted word of half of the documents, misspelt in each of their sentences that has it.
_FORCE = k.digest(SEED, "doc_id", "c9")
FORCED = (f"CASE WHEN {k.gate(_FORCE, 0.5)} THEN CASE {k.choice(CORRECT, _PLANT, 0)} " + " ".join(
    f"WHEN {k.q(a)} THEN {k.replace_first('sentence', a, b)}" for a, b in zip(CORRECT, TYPOS))
          + " END ELSE sentence END")


def forced():
    dig = d.digest(SEED, F.col("doc_id"), "plant")
    typed = c.force_typo(S(), d.choice(CORRECT, dig, 0), d.choice(TYPOS, dig, 0))
    return F.when(d.gate(d.digest(SEED, F.col("doc_id"), "c9"), 0.5), typed).otherwise(S())


@register("any_typo_p7", f"""WITH {GOOD_PLANTED} SELECT sid, {k.has_any_typo('typed')} AS has_typo
 FROM (SELECT sid, {FORCED} AS typed FROM good)""")
def any_typo(spark, sf):
    return good_planted(spark, sf).select("sid", forced().alias("typed")).select(
        "sid", t.has_any_typo(F.col("typed")).alias("has_typo"))


@register("column_drop_p8", "SELECT conv_id, turn, length(text) AS n_chars FROM conversations")
def column_drop(spark, sf):
    return turns(spark, sf).withColumn("n_chars", F.length("text")).drop("role", "text")


@register("preview_p9", "SELECT doc_id, substr(text, 1, 120) AS preview FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", t.preview(F.col("text")).alias("preview"))


@register("first_line_p10", """SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS line
 FROM conversations""")
def first_line(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", t.first_line(F.col("text")).alias("line"))


@register("stop_cut_p11", """SELECT conv_id, turn,
 split_part(split_part(role || ' says ' || text || 'Input: next', chr(10), 1), 'Input:', 1) AS cut
 FROM conversations""")
def stop_cut(spark, sf):
    full = F.concat("role", F.lit(" says "), "text", F.lit("Input: next"))
    return turns(spark, sf).select("conv_id", "turn", t.cut_at_stop(full).alias("cut"))


@register("prompt_render_p12", """SELECT conv_id, turn,
 'Input: ' || text || chr(10) || 'Output: ' AS prompt FROM conversations""")
def prompt_render(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", t.prompt(F.col("text")).alias("prompt"))


@register("empty_display_p13", f"""WITH {DIRTY} SELECT sid,
 CASE WHEN x = '' THEN 'EMPTY' ELSE x END AS shown FROM (SELECT sid,
 {k.collapse(k.strip_fillers("dirty"))} AS x FROM dirt)""")
def empty_display(spark, sf):
    return dirty(spark, sf).select("sid", t.shown(
        t.collapse_spaces(t.strip_fillers(D())), "EMPTY").alias("shown"))


@register("pause_label_p14", """SELECT event_id, CASE WHEN value * 10 < 300
 THEN '⚠ May cut off fast speakers' WHEN value * 10 <= 500 THEN '✓ Recommended for most users'
 WHEN value * 10 <= 800 THEN 'Tolerates longer mid-sentence pauses'
 ELSE 'Long pause before transcription triggers' END AS hint FROM events""")
def pause_label(spark, sf):
    return table(spark, sf, "events", "event_id", "value").select(
        "event_id", t.pause_hint(F.col("value") * 10).alias("hint"))


# --- cleaner and routing ---------------------------------------------------------------

@register("filler_strip_t1", f"WITH {DIRTY} SELECT sid, {k.strip_fillers('dirty')} AS x FROM dirt")
def filler_strip(spark, sf):
    return dirty(spark, sf).select("sid", t.strip_fillers(D()).alias("x"))


@register("space_collapse_t2",
          f"WITH {DIRTY} SELECT sid, {k.collapse(k.strip_fillers('dirty'))} AS x FROM dirt")
def space_collapse(spark, sf):
    return dirty(spark, sf).select("sid", t.collapse_spaces(t.strip_fillers(D())).alias("x"))


@register("capitalise_t3", f"WITH {DIRTY} SELECT sid, {k.capitalise('dirty')} AS x FROM dirt")
def capitalise(spark, sf):
    return dirty(spark, sf).select("sid", t.capitalise_first(D()).alias("x"))


@register("terminal_period_t4", f"""WITH {DIRTY} SELECT sid, {k.period('x')} AS x
 FROM (SELECT sid, {k.remove_punctuation('dirty')} AS x FROM dirt
 UNION ALL SELECT sid, dirty FROM dirt)""")
def terminal_period(spark, sf):
    base = dirty(spark, sf)
    both = base.select("sid", F.explode(F.array(t_punct(D()), D())).alias("x"))
    return both.select("sid", t.terminal_period(F.col("x")).alias("x"))


def t_punct(col):
    return c.remove_punctuation(col)


@register("clean_t5", f"WITH {DIRTY} SELECT sid, dirty, {k.clean('dirty')} AS cleaned FROM dirt")
def clean(spark, sf):
    return dirty(spark, sf).select("sid", "dirty", t.clean(D()).alias("cleaned"))


@register("clean_documents_t5", f"""SELECT doc_id, {k.clean('text')} AS cleaned FROM documents""")
def clean_documents(spark, sf):
    return docs(spark, sf).select("doc_id", t.clean(F.col("text")).alias("cleaned"))


@register("word_count_t6", f"WITH {DIRTY} SELECT sid, {k.word_count('dirty')} AS n FROM dirt")
def word_count(spark, sf):
    return dirty(spark, sf).select("sid", t.word_count(D()).alias("n"))


@register("two_tier_route_t7", f"""WITH {DIRTY} SELECT sid, {k.clean('dirty')} AS fast,
 CASE WHEN {k.word_count('dirty')} < 12 THEN 'fast' ELSE 'rewrite' END AS tier FROM dirt""")
def two_tier_route(spark, sf):
    return r.route(dirty(spark, sf).select("sid", D().alias("text")), threshold=12).drop("text")


# A deterministic stand-in for the caller's model: it drops punctuation, and answers nothing
# at all for texts that mention "this".
_STAND_IN = ("CASE WHEN contains(dirty, 'this') THEN '' "
             "ELSE translate(dirty, '.,?!;:', '') END")


@register("fallback_t8", f"""WITH {DIRTY}, a AS (SELECT sid, {k.clean('dirty')} AS fast,
 {_STAND_IN} AS w, {k.word_count('dirty')} AS n FROM dirt)
 SELECT sid, CASE WHEN n < 12 THEN fast ELSE coalesce(nullif(w, ''), fast) END AS final FROM a""")
def fallback(spark, sf):
    routed = r.route(dirty(spark, sf).select("sid", D().alias("text")), threshold=12)
    said = F.when(F.contains("text", F.lit("this")), "").otherwise(
        c.remove_punctuation(F.col("text")))
    return routed.select("sid", F.when(F.col("tier") == "fast", F.col("fast")).otherwise(
        r.fallback(said, F.col("fast"))).alias("final"))


@register("batch_rewriter_t9", f"""WITH {DIRTY}, a AS (SELECT sid, {k.clean('dirty')} AS fast,
 dirty, {_STAND_IN} AS w, {k.word_count('dirty')} AS n FROM dirt)
 SELECT sid, CASE WHEN n < 12 THEN fast ELSE coalesce(nullif(w, ''), dirty) END AS final FROM a""")
def batch_rewriter(spark, sf):
    rows = dirty(spark, sf).select("sid", D().alias("text"), F.lit("").alias("hint"))
    return r.format_transcripts(rows, stand_in_rewriter, threshold=12).select("sid", "final")


@register("backend_resolution_t10", """SELECT event_id, CASE WHEN backend = 'local' AND value > 30
 THEN 'local' ELSE 'fast' END AS backend FROM (SELECT event_id, value, CASE event_type
 WHEN 'click' THEN 'local' WHEN 'view' THEN 'fast' ELSE event_type END AS backend FROM events)""")
def backend_resolution(spark, sf):
    asked = F.when(F.col("event_type") == "click", "local").when(
        F.col("event_type") == "view", "fast").otherwise(F.col("event_type"))
    return table(spark, sf, "events", "event_id", "event_type", "value").select(
        "event_id", r.resolve_backend(asked, F.col("value") > 30).alias("backend"))


@register("segment_stitch_t11", """SELECT conv_id, string_agg(trim(text, chr(10) || ' '), ' '
 ORDER BY turn) AS utterance FROM conversations GROUP BY conv_id""")
def segment_stitch(spark, sf):
    return r.stitch(turns(spark, sf).select("conv_id", "turn", "text"))


# --- corruption ------------------------------------------------------------------------

def _corruption(name: str, op, sql_op, rows=good, ctes: str = k.good_sents()):
    @register(name, f"""WITH {ctes} SELECT sid, {sql_op('sentence', SEED, 'sid')} AS dirty
 FROM good""")
    def run(spark, sf):
        return rows(spark, sf).select("sid", op(S(), SEED, SID()).alias("dirty"))
    return run


_corruption("insert_fillers_c1", c.insert_fillers, k.insert_fillers)
_corruption("insert_fillers_narrow_c1b", c.insert_fillers_narrow, k.insert_fillers_narrow)
_corruption("remove_punctuation_c2", c.remove_punctuation, k.remove_punctuation)
_corruption("spelling_errors_c3", c.spelling_errors, k.spelling_errors, good_planted, GOOD_PLANTED)
_corruption("homophone_swaps_c4", c.homophone_swaps, k.homophone_swaps, good_planted, GOOD_PLANTED)
_corruption("number_words_c5", c.number_words, k.number_words)
_corruption("duplicate_words_c6", c.duplicate_words, k.duplicate_words)
_corruption("drop_words_c7", c.drop_words, k.drop_words)
_corruption("lowercase_c8", c.lowercase, k.lowercase)
_corruption("full_mix_c10", c.corrupt_full, k.corrupt_full)
_corruption("light_mix_c11", c.corrupt_light, k.corrupt_light)
_corruption("guarded_mix_c12", c.corrupt_guarded, k.corrupt_guarded)


@register("force_typo_c9", f"WITH {GOOD_PLANTED} SELECT sid, {FORCED} AS dirty FROM good")
def force_typo(spark, sf):
    return good_planted(spark, sf).select("sid", forced().alias("dirty"))


@register("op_priority_sort_o4", f"""SELECT doc_id, array_to_string(
 {k.light_mix_ops(SEED, 'doc_id')}, ',') AS ops FROM documents""")
def op_priority_sort(spark, sf):
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.array_join(
        c.light_mix_ops(SEED, F.col("doc_id")).cast("array<string>"), ",").alias("ops"))


@register("unchosen_ops_u2", f"""SELECT doc_id, array_to_string(list_filter(range(8),
 lambda o: NOT list_contains({k.full_mix_ops(SEED, 'doc_id')}, o::INT)), ',') AS rest
 FROM documents""")
def unchosen_ops(spark, sf):
    ops = c.full_mix_ops(SEED, F.col("doc_id"))
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.array_join(
        c.unchosen(ops, 8).cast("array<string>"), ",").alias("rest"))


# --- generators ------------------------------------------------------------------------

def _generator(name: str, fn, sql_fn):
    @register(name, f"SELECT doc_id, {sql_fn(SEED, 'doc_id')} AS sentence FROM documents")
    def run(spark, sf):
        return table(spark, sf, "documents", "doc_id").select(
            "doc_id", fn(SEED, F.col("doc_id")).alias("sentence"))
    return run


_generator("math_questions_g1", g.math_question, k.math_question)
_generator("instruction_rows_g2", g.instruction_sentence, k.instruction_sentence)
_generator("technical_rows_g3", g.technical_sentence, k.technical_sentence)
_generator("cardinal_sequences_g4", g.cardinal_sequence, k.cardinal_sequence)

PASS_SQL = " UNION ALL ".join(
    f"SELECT '{cat}:' || doc_id AS pair_id, '{cat}' AS category, "
    f"{fn(SEED, 'doc_id')} AS output FROM documents"
    for cat, fn in (("math", k.math_question), ("instruction", k.instruction_sentence),
                    ("technical", k.technical_sentence)))


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("id"))


@register("pass_through_pairs_g5", f"""SELECT pair_id, category,
 {k.corrupt_light('output', SEED, 'pair_id')} AS input, output FROM ({PASS_SQL})""")
def pass_through_pairs(spark, sf):
    return g.pass_through_pairs(ids(spark, sf), SEED)


def cardinal_sql(target: str, seed: int) -> str:
    """Cardinal pairs of three attempts per document, first ``target`` by attempt."""
    cap = k.capitalise("clean")
    seeded = f"CASE WHEN {k.gate(k.digest(seed, 'a', 'cardcap'), 0.25)} THEN {cap} ELSE clean END"
    return f"""SELECT 'cardinal:' || a AS pair_id, 'cardinal' AS category, input, output
 FROM (SELECT a, {k.corrupt_guarded('seeded', seed, 'a')} AS input, {cap} || '.' AS output
 FROM (SELECT a, clean, {seeded} AS seeded FROM (SELECT a, {k.cardinal_sequence(seed, 'a')} AS clean
 FROM (SELECT r * 1099511627776::BIGINT + doc_id AS a FROM documents, range(3) t(r)))))
 WHERE {k.has_signal('input', 'output')} ORDER BY a LIMIT ({target})"""


@register("cardinal_pairs_g6", cardinal_sql("SELECT count(*) FROM documents", 43))
def cardinal_pairs(spark, sf):
    base = ids(spark, sf)
    return g.cardinal_pairs(base, base.count(), 43)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return m.mine_corpus([docs(spark, sf)])


def real_sql(need: str, seed: int, rounds: int = 3) -> str:
    """Real pairs in (round, draw) order over ``corpus``; three rounds cover the quota."""
    pid = "'real:' || r || ':' || ord"
    return f"""SELECT pair_id, 'real' AS category, input, output FROM (SELECT r, pair_id,
 {k.corrupt_full('sentence', seed, 'pair_id')} AS input, sentence AS output,
 {k.draw(k.digest(seed, 'pair_id', 'round'))} AS dr FROM (SELECT r, {pid} AS pair_id, sentence
 FROM corpus, range({rounds}) t(r))) WHERE {k.has_signal('input', 'output')}
 ORDER BY r, dr, pair_id LIMIT ({need})"""


@register("real_text_pairs_g7", f"""WITH {k.corpus()}
 {real_sql('SELECT (count(*) * 5) // 4 FROM corpus', SEED)}""")
def real_text_pairs(spark, sf):
    base = materialise(corpus(spark, sf), "corpus")
    return g.real_text_pairs(base, base.count() * 5 // 4, SEED)


def planted_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus of the spelling stage over the planted documents; its sentences have at most 80 words."""
    return m.mine_corpus([planted(docs(spark, sf))], max_words=m.SPELLING_MAX_WORDS)


PLANTED_CORPUS = f"{PLANTED}, {k.corpus(8, 80, source='planted')}"


def spelling_sql(target: int, seed: int) -> str:
    groups = {}
    for grp, cor, typ in SPELLING_TARGETS:
        groups.setdefault(grp, []).append((cor, typ))
    table_ = "[" + ", ".join(
        "{'grp': " + k.q(grp) + ", 'vs': [" + ", ".join(
            f"{{'c': {k.q(a)}, 't': {k.q(b)}}}" for a, b in vs) + "]}"
        for grp, vs in groups.items()) + "]"
    quota = target // len(groups)
    pid = "'spelling:' || grp || ':' || ord"
    typed = "CASE pick.c " + " ".join(
        f"WHEN {k.q(a)} THEN {k.replace_first('sentence', a, b)}"
        for _, a, b in SPELLING_TARGETS) + " END"
    return f"""hits AS (SELECT ord, sentence, g.grp AS grp, list_filter(g.vs, lambda x:
 list_contains(runs, x.c)) AS usable FROM (SELECT ord, sentence, runs, unnest({table_}) AS g FROM
 (SELECT ord, sentence, list_distinct(regexp_extract_all(sentence, '[\\pL\\pN_]+')) AS runs
 FROM corpus))), src AS (SELECT * FROM hits WHERE len(usable) > 0
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) <= {quota + 50}),
 picked AS (SELECT {pid} AS pair_id, grp, sentence, usable[{k.index(k.digest(seed, pid, 'variant'),
 'len(usable)', 0)} + 1] AS pick FROM src),
 made AS (SELECT pair_id, grp, pick.t AS typo, {k.corrupt_guarded('typed', seed, 'pair_id')} AS input,
 sentence AS output, {k.draw(k.digest(seed, 'pair_id', 'group'))} AS dr FROM
 (SELECT *, {typed} AS typed FROM picked)),
 spelling AS (SELECT pair_id, 'spelling' AS category, input, output FROM made
 WHERE {k.has_signal('input', 'output')} AND contains(lower(input), lower(typo))
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dr, pair_id) <= {quota})"""


@register("spelling_pairs_g8", f"WITH {PLANTED_CORPUS}, {spelling_sql(5000, 43)} SELECT * FROM spelling")
def spelling_pairs(spark, sf):
    return g.spelling_pairs(planted_corpus(spark, sf), 5000, 43)
