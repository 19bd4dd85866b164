"""Interaction events in batch: debounce, toggle, hold pairing, sessions, timers, reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .debounce import DEBOUNCE_US, debounce
from .quota import first_k, materialise
from .timeline import Timeline

MS = 1_000
SECOND = 1_000_000

# Production time constants in microseconds.
SILENCE_US = 400 * MS
DONE_RESET_US = 1_500 * MS
REVIEW_US = 15 * SECOND
HISTORY_MAX = 50
CHUNK_US = 3_600 * SECOND


def toggle_actions(presses: DataFrame, keys: Sequence[str], t: str, row_id: str,
                   gap_us: int = DEBOUNCE_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Accepted presses alternate start / stop."""
    accepted = materialise(debounce(presses, keys, t, row_id, gap_us), "toggle-accepted")
    counted = Timeline(accepted, keys, [t, row_id], chunk_us).running(
        F.lit(1).cast("bigint"), "_n").result()
    return counted.withColumn("action", F.when(F.col("_n") % 2 == 1, "start")
                              .otherwise("stop")).drop("_n")


def hold_intervals(edges: DataFrame, keys: Sequence[str], t: str, row_id: str,
                   edge: str = "edge", gap_us: int = DEBOUNCE_US,
                   chunk_us: int = CHUNK_US) -> DataFrame:
    """Intervals of hold mode: one row per emitted release with the press that started it.

    A release counts only while the combination is active, that is when the event before it
    is a press; presses and releases are debounced on clocks of their own. A release whose
    press was debounced away has a NULL start.
    """
    keys = list(keys)
    seen = Timeline(edges.select(*keys, t, row_id, edge), keys, [t, row_id], chunk_us).previous(
        [edge], "_before").result()
    counted = materialise(seen.where(
        (F.col(edge) == "press") | ((F.col(edge) == "release") & (F.col("_before")[edge] == "press")))
        .select(*keys, t, row_id, F.col(edge).alias("_kind")), "hold-edges")
    # Both clocks in one pass: the kind of edge is part of the key.
    clocked = materialise(debounce(counted, [*keys, "_kind"], t, row_id, gap_us), "hold-clocked")
    both = Timeline(clocked, keys, [t, row_id], chunk_us).previous(["_kind", t], "_before").result()
    began = F.when(F.col("_before._kind") == "press", F.col(f"_before.{t}"))
    return both.where(F.col("_kind") == "release").select(
        *keys, row_id, began.alias("start_us"), F.col(t).alias("end_us"))


def sessions(df: DataFrame, keys: Sequence[str], t: str, row_id: str,
             gap_us: int = SILENCE_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Utterances separated by silence of at least ``gap_us``.

    The last step groups by (key, session), not by key, and combines map-side.
    """
    keys = list(keys)
    line = Timeline(df.select(*keys, t, row_id), keys, [t, row_id], chunk_us)
    line.previous([t], "_before")
    opens = F.col("_before").isNull() | (F.col(t) - F.col("_before")[t] >= gap_us)
    line.df = line.df.withColumn("_open", F.when(opens, F.col(t)))
    line.running_max(F.col("_open"), "start_us")
    return line.result().groupBy(*keys, "start_us").agg(
        (F.max(t) + gap_us).alias("end_us"), F.count(F.lit(1)).alias("n_events"))


def state_timeline(df: DataFrame, keys: Sequence[str], t: str, row_id: str,
                   state: str = "state", done: str = "done", reset_us: int = DONE_RESET_US,
                   chunk_us: int = CHUNK_US) -> DataFrame:
    """States with dwell time; ``done`` falls back to ``idle`` unless a state comes first."""
    keys = list(keys)
    line = Timeline(df, keys, [t, row_id], chunk_us).following([t], "_next").result()
    until = F.col("_next")[t]
    resets = (F.col(state) == done) & (until.isNull() | (until - F.col(t) > reset_us))
    back = F.col(t) + reset_us
    rows = F.array_compact(F.array(
        F.struct(F.col(state).alias("state"), F.col(t).alias("at_us"),
                 (F.when(resets, back).otherwise(until) - F.col(t)).alias("dwell_us")),
        F.when(resets, F.struct(F.lit("idle").alias("state"), back.alias("at_us"),
                                (until - back).alias("dwell_us")))))
    return line.select(*keys, row_id, F.inline(rows))


def review_outcomes(transcripts: DataFrame, decisions: DataFrame, keys: Sequence[str], t: str,
                    row_id: str, timeout_us: int = REVIEW_US,
                    chunk_us: int = CHUNK_US) -> DataFrame:
    """Pairs kept after review: first decision within the timeout, else accept.

    Transcripts carry ``raw`` and ``cleaned``, decisions ``decision`` and ``edited``. Both
    are merged on one timeline and each transcript looks up the next decision, so no pairs
    of a hot key are ever multiplied out.
    """
    keys = list(keys)
    left = transcripts.select(*keys, t, row_id, "raw", "cleaned", F.lit(0).alias("_side"))
    right = decisions.select(*keys, t, row_id, "decision", "edited", F.lit(1).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    line = Timeline(both, keys, [t, "_side", row_id], chunk_us).following(
        [t, "decision", "edited"], "_d", where=F.col("_side") == 1).result()
    in_time = F.col("_d")[t] - F.col(t) <= timeout_us
    decision = F.coalesce(F.when(in_time, F.col("_d.decision")), F.lit("accept"))
    edited = strip(F.col("_d.edited"))
    output = F.when((decision == "correct") & (edited != ""), edited).otherwise(F.col("cleaned"))
    return (line.where(F.col("_side") == 0)
            .select(*keys, t, row_id, F.col("raw").alias("input"), output.alias("output"),
                    decision.alias("decision"))
            .where(F.col("decision") != "skip"))


# Which settings trigger which reaction.
REACTIONS = {
    "re_register": ["hotkey", "recording_mode"],
    "reload_rewriter": ["formatter_backend", "local_model_path"],
    "restart_needed": ["whisper_model", "vad_silence_ms"],
}


def settings_changes(snapshots: DataFrame, keys: Sequence[str], t: str, row_id: str,
                     chunk_us: int = CHUNK_US) -> DataFrame:
    """Per saved settings version: what differs from the version before (NULL-safe)."""
    watched = [c for cols in REACTIONS.values() for c in cols]
    line = Timeline(snapshots, keys, [t, row_id], chunk_us).previous(watched, "_old").result()
    flags = []
    for name, cols in REACTIONS.items():
        differs = F.lit(False)
        for c in cols:
            differs = differs | ~F.col(c).eqNullSafe(F.col("_old")[c])
        flags.append((F.col("_old").isNotNull() & differs).alias(name))
    return line.select(*keys, t, row_id, *flags)


def last_n(entries: DataFrame, keys: Sequence[str], t: str, row_id: str,
           n: int = HISTORY_MAX) -> DataFrame:
    """Newest n entries per key; pruned map-side, so a hot key sends n rows per task."""
    return first_k(entries, n, [F.col(t).desc(), F.col(row_id).desc()], list(keys))
