"""Registered queries: streaming jobs run over the tables, file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corrupt as c
from ..functions import text as t
from ..operators.timeline import micros
from ..session import scratch_dir
from ..sources import files
from ..streaming import streams as s
from . import sqlkit as k
from .event_queries import (DEBOUNCE, E, HISTORY_SQL, HOLD_SQL, RESET, REVIEW, REVIEW_SQL,
                            SESSION_SQL, debounced, review_sides)
from .stand_in import failing_rewriter
from .text_queries import PLANTED_CORPUS, SEED, planted, spelling_sql, turns

QUERIES: dict[str, tuple] = {}
DELAY, DELAY_US = "1 hour", 3_600_000_000


def register(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return s.source(spark, f"{sf}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")).withColumn("t", micros("ts"))


def turn_stream(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.concat_ws(":", "conv_id", "turn")
    raw = s.source(spark, f"{sf}/conversations.parquet")
    return raw.select("conv_id", "turn", c.insert_fillers(F.col("text"), SEED, rid).alias("text"))


TURNS = (f"turns AS (SELECT conv_id, turn, "
         f"{k.insert_fillers('replace(text, chr(10), chr(32))', SEED, k.q(':').join(['conv_id || ', ' || turn']))} "
         f"AS text FROM conversations)")
WATERMARK = f"(SELECT max(t) - {DELAY_US} FROM e)"
# Rows that rules decide in order come out when the watermark, in whole milliseconds, has passed them.
PASSED = f"(SELECT max(t) // 1000 * 1000 - {DELAY_US} FROM e)"


# --- streaming ---------------------------------------------------------------------------

@register("stream_clean_st1", f"""WITH {TURNS} SELECT conv_id, turn, {k.clean('text')} AS fast,
 'fast' AS tier FROM turns""")
def stream_clean(spark, sf):
    out = s.clean_stream(turn_stream(spark, sf)).drop("text")
    return s.run_to_files(out, "clean")


@register("stream_sessions_st2", f"""WITH {SESSION_SQL} SELECT * FROM sess
 WHERE end_us <= {WATERMARK}""")
def stream_sessions(spark, sf):
    out = s.session_stream(event_stream(spark, sf), "user_id", "ts", "4 hours", DELAY)
    return s.run_to_files(out, "sessions")


def _custom(out: DataFrame, label: str) -> DataFrame:
    with s.rocksdb_state(out.sparkSession):
        return s.run_to_files(out, label)


@register("stream_debounce_st3", f"""WITH RECURSIVE {E}, {debounced('e', 'acc')}
 SELECT user_id, acc.t, event_id FROM acc JOIN e USING (user_id, t) WHERE acc.t <= {PASSED}""")
def stream_debounce(spark, sf):
    return _custom(s.debounce_stream(event_stream(spark, sf), DEBOUNCE, DELAY), "debounce")


@register("stream_toggle_st4", f"""WITH RECURSIVE {E}, k AS (SELECT * FROM e
 WHERE event_type = 'click'), {debounced('k', 'acc')} SELECT user_id, acc.t, event_id,
 CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY acc.t) % 2 = 1 THEN 'start'
 ELSE 'stop' END AS action FROM acc JOIN k USING (user_id, t) WHERE acc.t <= {PASSED}""")
def stream_toggle(spark, sf):
    presses = s.watermarked(event_stream(spark, sf), DELAY, F.col("event_type") == "click")
    return _custom(s.toggle_stream(presses, DEBOUNCE), "toggle")


@register("stream_hold_st5", f"{HOLD_SQL} SELECT * FROM holds WHERE end_us <= {PASSED}")
def stream_hold(spark, sf):
    kind = F.col("event_type")
    edges = s.watermarked(event_stream(spark, sf), DELAY, kind.isin("click", "purchase")).withColumn(
        "edge", F.when(kind == "click", "press").otherwise("release"))
    return _custom(s.hold_stream(edges, DEBOUNCE), "hold")


@register("stream_auto_reset_st6", f"""WITH {E}, l AS (SELECT user_id, event_id, event_type, t,
 lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM e)
 SELECT user_id, event_id, event_type AS state, t AS at_us FROM l
 UNION ALL SELECT user_id, event_id, 'idle', t + {RESET} FROM l WHERE event_type = 'purchase'
 AND (nx IS NULL OR nx - t > {RESET}) AND t + {RESET} <= {PASSED}""")
def stream_auto_reset(spark, sf):
    rows = event_stream(spark, sf).withColumn("state", F.col("event_type"))
    return _custom(s.auto_reset_stream(rows, RESET, DELAY, "purchase"), "reset")


def review_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, kind = event_stream(spark, sf), F.col("event_type")
    return review_sides(rows.where(kind == "view"), rows.where(kind == "signup"))


STREAM_REVIEW = f"""{REVIEW_SQL}, wm AS (SELECT max(t) // 1000 * 1000 - {DELAY_US} AS at FROM e
 WHERE event_type IN ('view', 'signup')),
 said AS (SELECT v.event_id, min(d.t) AS said FROM e v JOIN d ON d.user_id = v.user_id
 AND d.t BETWEEN v.t AND v.t + {REVIEW} WHERE v.event_type = 'view' GROUP BY 1),
 done AS (SELECT kept.* FROM kept LEFT JOIN said USING (event_id), wm
 WHERE coalesce(said, kept.t + {REVIEW}) <= wm.at)"""


@register("stream_review_st7", f"""WITH {STREAM_REVIEW} SELECT user_id, event_id, input, output,
 decision FROM done""")
def stream_review(spark, sf):
    return _custom(s.review_stream(*review_inputs(spark, sf), REVIEW, DELAY), "review")


@register("stream_review_log_st9", f"WITH {STREAM_REVIEW} SELECT input, output, true AS stamped FROM done")
def stream_review_log(spark, sf):
    stamp = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")
    log = s.run_review(*review_inputs(spark, sf), REVIEW, DELAY)
    return log.select("input", "output", stamp.alias("stamped"))


@register("stream_history_st8", f"""WITH {E} SELECT user_id, event_id, t FROM
 ({HISTORY_SQL.format(n=50)})""")
def stream_history(spark, sf):
    return s.run_history(event_stream(spark, sf), 50)


@register("history_sink_s7", f"WITH {E} {HISTORY_SQL.format(n=50)}")
def history_sink(spark, sf):
    rows = event_stream(spark, sf).select("user_id", "event_id", "t", "props")
    return s.run_history_files(rows, 50)


@register("stream_collect_st9", f"""WITH {TURNS} SELECT text AS input, {k.clean('text')} AS output
 FROM turns""")
def stream_collect(spark, sf):
    pairs = turn_stream(spark, sf).select(
        F.col("text").alias("input"), t.clean(F.col("text")).alias("output"))
    return s.run_to_files(s.collected(pairs), "collect", "json").select("input", "output")


# One file is one batch here; the early stop over several batches is covered by the tests.
@register("stream_mining_st10", f"""WITH {PLANTED_CORPUS}, {spelling_sql(5000, 43)}
 SELECT grp, ord, sentence FROM src""")
def stream_mining(spark, sf):
    rows = s.source(spark, f"{sf}/documents.parquet", 1).select("doc_id", "text")
    return s.run_mining(planted(rows), 504)


@register("stream_isolation_st11", f"""WITH {TURNS} SELECT conv_id, turn,
 CASE WHEN contains(text, 'this') THEN 'ValueError: model refused' END AS error,
 CASE WHEN contains(text, 'this') THEN NULL WHEN translate(text, '.,?!;:', '') = '' THEN text
 ELSE translate(text, '.,?!;:', '') END AS rewritten FROM turns""")
def stream_isolation(spark, sf):
    rows = turn_stream(spark, sf).withColumn("hint", F.lit(""))
    good, dead = s.run_isolated(rows, failing_rewriter)
    return good.unionByName(dead).select("conv_id", "turn", "error", "rewritten")


# --- file sources and sinks ----------------------------------------------------------------

def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select(
        F.col("role").alias("input"), F.col("text").alias("output"), "conv_id", "turn")


@register("tolerant_scan_s1", """SELECT role AS input, text AS output FROM conversations
 WHERE conv_id % 5 <> 3""")
def tolerant_scan(spark, sf):
    path = scratch_dir(spark, "log")
    line = F.to_json(F.struct("input", "output"))
    kind = F.col("conv_id") % 10
    _pairs(spark, sf).select(F.when(kind == 3, F.lit("{bad json}")).when(
        kind == 8, F.lit("   ")).otherwise(line).alias("value")).write.text(path)
    return files.read_pairs_tolerant(spark, path).select("input", "output")


@register("strict_scan_s2", "SELECT role AS input, text AS output FROM conversations")
def strict_scan(spark, sf):
    return files.round_trip(_pairs(spark, sf), "strict")


@register("append_sink_s3", """SELECT role AS input, text AS output, true AS stamped
 FROM conversations""")
def append_sink(spark, sf):
    path = scratch_dir(spark, "append")
    rows = _pairs(spark, sf)
    for part in (rows.where(F.col("turn") == 0), rows.where(F.col("turn") > 0)):
        if not files.append_pairs(part, path):
            raise RuntimeError("append failed")
    stamp = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")
    return files.read_pairs_tolerant(spark, path).select("input", "output", stamp.alias("stamped"))


@register("overwrite_sink_s4", """SELECT role AS input, text || ' é' AS output FROM conversations""")
def overwrite_sink(spark, sf):
    path = scratch_dir(spark, "overwrite")
    rows = _pairs(spark, sf)
    files.write_pairs(rows, path)
    files.write_pairs(rows.withColumn("output", F.concat("output", F.lit(" é"))), path)
    return files.read_pairs_strict(spark, path)


@register("json_array_scan_s6", """SELECT conv_id::VARCHAR AS timestamp, role AS raw_text,
 text AS final_text FROM conversations WHERE conv_id % 7 <> 2""")
def json_array_scan(spark, sf):
    path = scratch_dir(spark, "arrays")
    entry = F.struct(F.col("conv_id").cast("string").alias("timestamp"),
                     F.col("role").alias("raw_text"), F.col("text").alias("final_text"))
    # One history file per conversation; some files are cut off, some hold no array.
    made = turns(spark, sf).groupBy("conv_id").agg(F.to_json(F.sort_array(
        F.collect_list(entry))).alias("value"))
    broken = F.when(F.col("conv_id") % 14 == 2, F.lit('[{"timestamp": ')).otherwise(
        F.lit('{"timestamp": "x"}'))
    made.select("conv_id", F.when(F.col("conv_id") % 7 == 2, broken).otherwise(F.col("value"))
                .alias("value")).write.partitionBy("conv_id").text(path)
    return files.read_history(spark, path).select("timestamp", "raw_text", "final_text")
