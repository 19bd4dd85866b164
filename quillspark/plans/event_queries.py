"""Registered queries: interaction events in batch, layered settings.

The driver's events have hours between them, so the queries pass hours where production
uses milliseconds; the millisecond behaviour is covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import settings as st
from ..operators.timeline import micros
from ..sources.tables import table
from . import sqlkit as k

QUERIES: dict[str, tuple] = {}
HOUR = 3_600 * ev.SECOND
DEBOUNCE, SESSION, RESET, REVIEW = 6 * HOUR, 4 * HOUR, HOUR, 6 * HOUR
CHUNK = 48 * HOUR


def register(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props",
                 "ts").withColumn("t", micros("ts")).drop("ts")


E = "e AS MATERIALIZED (SELECT *, epoch_us(ts) AS t FROM events)"


def debounced(source: str, out: str, keys: str = "user_id", gap: int = DEBOUNCE) -> str:
    """Recursive CTE ``out(keys, t)`` of accepted events of ``source``; needs WITH RECURSIVE."""
    same = " AND ".join(f"s.{c.strip()} = a.{c.strip()}" for c in keys.split(","))
    cols = ", ".join(f"a.{c.strip()}" for c in keys.split(","))
    return (f"{out} AS (SELECT {keys}, min(t) AS t FROM {source} GROUP BY {keys} UNION ALL "
            f"SELECT {cols}, min(s.t) FROM {out} a JOIN {source} s ON {same} "
            f"AND s.t >= a.t + {gap} GROUP BY {cols}, a.t)")


@register("debounce_d1", f"""WITH RECURSIVE {E}, k AS (SELECT * FROM e WHERE event_type IN
 ('click', 'purchase')), {debounced('k', 'acc', 'user_id, event_type')}
 SELECT user_id, event_type, acc.t, event_id FROM acc JOIN k USING (user_id, event_type, t)""")
def debounce(spark, sf):
    keys = events(spark, sf).where(F.col("event_type").isin("click", "purchase"))
    return ev.debounce(keys, ["user_id", "event_type"], "t", "event_id", DEBOUNCE)


@register("debounce_all_users_d1", f"""WITH RECURSIVE {E}, {debounced('e', 'acc')}
 SELECT user_id, acc.t, event_id FROM acc JOIN e USING (user_id, t)""")
def debounce_all(spark, sf):
    return ev.debounce(events(spark, sf), ["user_id"], "t", "event_id", DEBOUNCE)


@register("toggle_parity_w7", f"""WITH RECURSIVE {E}, k AS (SELECT * FROM e WHERE event_type = 'click'),
 {debounced('k', 'acc')} SELECT user_id, acc.t, event_id, CASE WHEN row_number() OVER
 (PARTITION BY user_id ORDER BY acc.t) % 2 = 1 THEN 'start' ELSE 'stop' END AS action
 FROM acc JOIN k USING (user_id, t)""")
def toggle_parity(spark, sf):
    presses = events(spark, sf).where(F.col("event_type") == "click")
    return ev.toggle_actions(presses, ["user_id"], "t", "event_id", DEBOUNCE, CHUNK)


HOLD_SQL = f"""WITH RECURSIVE {E}, k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id
 ORDER BY t, event_id) AS prev FROM e WHERE event_type IN ('click', 'purchase')),
 p AS (SELECT * FROM k WHERE event_type = 'click'),
 r AS (SELECT * FROM k WHERE event_type = 'purchase' AND prev = 'click'),
 {debounced('p', 'ap')}, {debounced('r', 'ar')},
 b AS (SELECT user_id, t, event_id, 'press' AS kind FROM ap JOIN p USING (user_id, t)
 UNION ALL SELECT user_id, t, event_id, 'release' FROM ar JOIN r USING (user_id, t)),
 l AS (SELECT *, lag(kind) OVER w AS pk, lag(t) OVER w AS pt FROM b
 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 holds AS (SELECT user_id, event_id, CASE WHEN pk = 'press' THEN pt END AS start_us, t AS end_us
 FROM l WHERE kind = 'release')"""


def key_edges(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf).where(kind.isin("click", "purchase")).withColumn(
        "edge", F.when(kind == "click", "press").otherwise("release"))


@register("hold_pairing_j11", f"{HOLD_SQL} SELECT * FROM holds")
def hold_pairing(spark, sf):
    return ev.hold_intervals(key_edges(spark, sf), ["user_id"], "t", "event_id", "edge",
                             DEBOUNCE, CHUNK)


SESSION_SQL = f"""{E}, s AS (SELECT user_id, t, sum(CASE WHEN t - p < {SESSION} THEN 0 ELSE 1 END)
 OVER (PARTITION BY user_id ORDER BY t) AS sid FROM (SELECT user_id, t, lag(t) OVER
 (PARTITION BY user_id ORDER BY t) AS p FROM e)), sess AS (SELECT user_id, min(t) AS start_us,
 max(t) + {SESSION} AS end_us, count(*) AS n_events FROM s GROUP BY user_id, sid)"""


@register("silence_sessions_batch_st2", f"WITH {SESSION_SQL} SELECT * FROM sess")
def silence_sessions(spark, sf):
    return ev.sessions(events(spark, sf), ["user_id"], "t", "event_id", SESSION, CHUNK)


@register("state_timeline_w6", f"""WITH {E}, l AS (SELECT user_id, event_id, event_type, t,
 lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM e),
 f AS (SELECT *, event_type = 'purchase' AND (nx IS NULL OR nx - t > {RESET}) AS resets FROM l)
 SELECT user_id, event_id, event_type AS state, t AS at_us,
 CASE WHEN resets THEN {RESET}::BIGINT ELSE nx - t END AS dwell_us FROM f
 UNION ALL SELECT user_id, event_id, 'idle', t + {RESET}, nx - (t + {RESET}) FROM f WHERE resets""")
def state_timeline(spark, sf):
    return ev.state_timeline(events(spark, sf), ["user_id"], "t", "event_id", "event_type",
                             "purchase", RESET, CHUNK)


REVIEW_SQL = f"""{E}, d AS (SELECT user_id, t, CASE WHEN value < 20 THEN 'skip' WHEN value < 60
 THEN 'correct' ELSE 'accept' END AS decision, CASE WHEN value < 40 THEN '  '
 ELSE ' fixed ' || event_id || ' ' END AS edited FROM e WHERE event_type = 'signup'),
 m AS (SELECT v.event_id, v.user_id, v.t, v.props, arg_min(d.decision, d.t) AS decision,
 arg_min(d.edited, d.t) AS edited FROM (SELECT * FROM e WHERE event_type = 'view') v
 LEFT JOIN d ON d.user_id = v.user_id AND d.t BETWEEN v.t AND v.t + {REVIEW} GROUP BY ALL),
 kept AS (SELECT user_id, t, event_id, props AS input, CASE WHEN decision = 'correct'
 AND trim(edited) <> '' THEN trim(edited) ELSE 'view ' || event_id || '.' END AS output,
 coalesce(decision, 'accept') AS decision FROM m WHERE coalesce(decision, 'accept') <> 'skip')"""


def review_sides(views: DataFrame, signups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transcripts and decisions out of event rows (also used by the stream)."""
    transcripts = views.withColumns({
        "raw": F.col("props"),
        "cleaned": F.concat(F.lit("view "), "event_id", F.lit("."))})
    decisions = signups.withColumns({
        "decision": F.when(F.col("value") < 20, "skip").when(F.col("value") < 60, "correct")
        .otherwise("accept"),
        "edited": F.when(F.col("value") < 40, "  ").otherwise(
            F.concat(F.lit(" fixed "), "event_id", F.lit(" ")))})
    return transcripts, decisions


@register("review_timeout_j8", f"WITH {REVIEW_SQL} SELECT * FROM kept")
def review_timeout(spark, sf):
    rows, kind = events(spark, sf), F.col("event_type")
    transcripts, decisions = review_sides(rows.where(kind == "view"), rows.where(kind == "signup"))
    return ev.review_outcomes(transcripts, decisions, ["user_id"], "t", "event_id", REVIEW, CHUNK)


HISTORY_SQL = """SELECT user_id, event_id, t, props FROM e QUALIFY row_number() OVER
 (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= {n}"""


@register("history_last_n_w1", f"WITH {E} {HISTORY_SQL.format(n=50)}")
def history_last_n(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "t", "props")
    return ev.last_n(rows, ["user_id"], "t", "event_id")


@register("history_view_w2", f"""WITH {E} SELECT user_id, event_id, rank() OVER
 (PARTITION BY user_id ORDER BY t DESC) AS newest_first, rank() OVER
 (PARTITION BY user_id ORDER BY t) AS oldest_first FROM ({HISTORY_SQL.format(n=10)})""")
def history_view(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", "t")
    last = ev.last_n(rows, ["user_id"], "t", "event_id", 10)
    w = Window.partitionBy("user_id")
    return last.select(
        "user_id", "event_id",
        F.row_number().over(w.orderBy(F.col("t").desc())).alias("newest_first"),
        F.row_number().over(w.orderBy("t")).alias("oldest_first"))


SNAP = {
    "hotkey": "event_type",
    "recording_mode": "CASE WHEN value > 50 THEN 'hold' ELSE 'toggle' END",
    "formatter_backend": "CASE WHEN value > 80 THEN 'local' ELSE 'fast' END",
    "local_model_path": "CASE WHEN value < 10 THEN NULL ELSE 'm' END",
    "whisper_model": "CASE WHEN value > 30 THEN 'tiny.en' ELSE 'base.en' END",
    "vad_silence_ms": "CAST(floor(value / 20) AS INT) * 100",
}


def _changed(cols: list[str]) -> str:
    return "(po AND (" + " OR ".join(f"{c} IS DISTINCT FROM lag_{c}" for c in cols) + "))"


@register("settings_changes_w9", f"""WITH {E}, s AS (SELECT user_id, event_id, t,
 {', '.join(f'{v} AS {n}' for n, v in SNAP.items())} FROM e), l AS (SELECT *,
 {', '.join(f'lag({n}) OVER w AS lag_{n}' for n in SNAP)}, lag(event_id) OVER w IS NOT NULL AS po
 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, t, event_id,
 {', '.join(f'{_changed(cols)} AS {n}' for n, cols in ev.REACTIONS.items())} FROM l""")
def settings_changes(spark, sf):
    snaps = events(spark, sf).select("user_id", "event_id", "t", *[
        F.expr(v).alias(n) for n, v in SNAP.items()])
    return ev.settings_changes(snaps, ["user_id"], "t", "event_id", CHUNK)


# --- settings ----------------------------------------------------------------------------

_JSON = ("CASE WHEN c_custkey % 11 = 0 THEN '{{oops' WHEN c_custkey % 7 = 0 THEN NULL ELSE "
         "'{{\"hotkey\": \"' || c_mktsegment || '\", \"llm_word_threshold\": ' || c_nationkey || "
         "', \"theme\": \"dark\"}}' END").replace("{{", "{").replace("}}", "}")
_STORED = "c_custkey % 11 <> 0 AND c_custkey % 7 <> 0"


def _setting(name: str, typ: str, default) -> str:
    value = k.q(default) if typ == "string" else str(default)
    if name == "hotkey":
        return f"CASE WHEN {_STORED} THEN c_mktsegment ELSE {value} END AS hotkey"
    if name == "llm_word_threshold":
        return f"CASE WHEN {_STORED} THEN c_nationkey ELSE {value} END AS llm_word_threshold"
    return f"{value} AS {name}"


def configs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey").select(
        "c_custkey", F.expr(_JSON).alias("config"))


_FIELDS = ", ".join(_setting(*f) for f in st.DEFAULTS)


@register("settings_scan_s8", f"SELECT c_custkey, {_FIELDS} FROM customer")
def settings_scan(spark, sf):
    return st.with_settings(configs(spark, sf), "config", ["c_custkey"])


@register("settings_write_s9", f"""SELECT c_custkey, to_json(s)::VARCHAR AS config FROM (SELECT
 c_custkey, struct_pack({', '.join(f'{n} := {n}' for n in st.NAMES)}) AS s FROM (SELECT c_custkey,
 {_FIELDS} FROM customer))""")
def settings_write(spark, sf):
    full = st.with_settings(configs(spark, sf), "config", ["c_custkey"])
    return st.to_text(full, ["c_custkey"])


@register("layered_override_j9", """WITH u AS (SELECT c_custkey AS k, CASE WHEN c_nationkey > 3
 THEN c_mktsegment END AS shk, CASE WHEN c_acctbal > 0 THEN 'base.en' END AS sm,
 CASE WHEN c_acctbal > 5000 THEN 'fast' END AS sb FROM customer),
 e AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey > 12 THEN s_name ELSE '' END AS hk,
 CASE WHEN s_acctbal > 0 THEN 'tiny.en' END AS wm, '' AS fb FROM supplier),
 c AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_brand END AS wm,
 CASE WHEN p_size < 10 THEN 'local' ELSE '' END AS fb FROM part)
 SELECT u.k, coalesce(nullif(e.hk, ''), shk, 'ctrl+shift+space') AS hotkey,
 coalesce(nullif(c.wm, ''), nullif(e.wm, ''), sm, 'medium.en') AS whisper_model,
 coalesce(nullif(c.fb, ''), nullif(e.fb, ''), sb, 'local') AS formatter_backend
 FROM u LEFT JOIN e USING (k) LEFT JOIN c USING (k)""")
def layered_override(spark, sf):
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("hotkey"),
        F.when(F.col("c_acctbal") > 0, "base.en").alias("whisper_model"),
        F.when(F.col("c_acctbal") > 5000, "fast").alias("formatter_backend"))
    env = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"),
        F.when(F.col("s_nationkey") > 12, F.col("s_name")).otherwise("").alias("hotkey"),
        F.when(F.col("s_acctbal") > 0, "tiny.en").alias("whisper_model"),
        F.lit("").alias("formatter_backend"))
    cli = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("whisper_model"),
        F.when(F.col("p_size") < 10, "local").otherwise("").alias("formatter_backend"))
    return st.overlay(stored, env, cli, "k")


@register("latency_hint_j10", """SELECT event_id, CASE event_type WHEN 'click' THEN
 '~50ms GPU / ~400ms CPU' WHEN 'view' THEN '~600ms GPU / ~8s CPU' ELSE '' END AS hint,
 CASE WHEN value > 50 THEN 'Fast only' ELSE '' END AS label FROM events""")
def latency_hint(spark, sf):
    kind = F.col("event_type")
    model = F.when(kind == "click", "tiny.en").when(kind == "view", "large-v3").otherwise(kind)
    backend = F.when(F.col("value") > 50, "fast").otherwise("other")
    return table(spark, sf, "events", "event_id", "event_type", "value").select(
        "event_id", st.latency_hint(model).alias("hint"), st.backend_label(backend).alias("label"))
