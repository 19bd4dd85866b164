import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import debounce
from quillspark.operators import events as ev
from quillspark.operators.timeline import Timeline

MS = 1000


def frame(spark, rows, schema="user_id long, t long, event_id long"):
    return spark.createDataFrame(rows, schema).repartition(5)


def fold(times, gap):
    last, kept = None, []
    for t in times:
        if last is None or t - last >= gap:
            last = t
            kept.append(t)
    return kept


def debounced(spark, times, gap=ev.DEBOUNCE_US, chunk=64):
    df = frame(spark, [(1, t, i) for i, t in enumerate(times)])
    return sorted(r.t for r in ev.debounce(df, ["user_id"], "t", "event_id", gap, chunk).collect())


def test_debounce_fixtures(spark):
    assert debounced(spark, [1_000_000, 1_050_000, 1_100_000]) == [1_000_000]
    assert len(debounced(spark, [1_000_000, 1_200_000])) == 2
    assert debounced(spark, [0, 100 * MS, 200 * MS]) == [0, 200 * MS]


def test_debounce_dense_hot_key(spark):
    rng = random.Random(5)
    for chunk in (1, 2, 7, 64):
        t, times = 0, []
        for _ in range(3000):
            t += rng.choice([1, 3, 20, 90, 140, 400]) if rng.random() < 0.99 else 5000
            times.append(t)
        assert debounced(spark, times, gap=150, chunk=chunk) == fold(times, 150)


@pytest.mark.parametrize("seed", range(6))
def test_exit_table_is_the_fold_of_every_entry(seed):
    """For every entry time the table gives the last accepted time, however the rows come in batches."""
    rng, gap = random.Random(seed), 100
    times = sorted(rng.choice([rng.randrange(1000), rng.randrange(1000, 1040)]) + 1000 for _ in range(rng.choice([1, 3, 40, 300])))
    table, at = debounce._Exits(gap), 0
    while at < len(times):
        to = at + rng.randrange(1, 60)
        table.feed(np.array(times[at:to]))
        at = to
    rows = table.rows()
    assert [u for u, _ in rows] == sorted({u for u, _ in rows})
    for entry in [debounce._NEVER, *range(times[0] - 2 * gap, times[0] + 1)]:
        last = entry
        for t in times:
            if t - last >= gap:
                last = t
        got = next(x for u, x in rows if u >= entry)
        assert (entry if got is None else got) == last


def test_debounce_of_a_hot_key_beside_small_ones(spark):
    """A third of all rows in one key without a pause, NULL keys, equal times, rows without time; the plan
    gathers no rows in lists, and tasks see sorted rows of chunks."""
    rng, rows, t = random.Random(3), [], 0
    for i in range(20_000):
        t += rng.choice([0, 10, 40, 70, 120])
        rows.append((1, t, i))
    rows += [(rng.choice([None, *range(2, 400)]), rng.randrange(t), 20_000 + i) for i in range(40_000)]
    df = frame(spark, rows + [(1, None, 99_999)])
    got = ev.debounce(df, ["user_id"], "t", "event_id", 150, 4)
    by_key = {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        last = by_key.setdefault(k, [])
        if not last or at - last[-1][0] >= 150:
            last.append((at, i))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, *r)) for k, kept in by_key.items() for r in kept)
    assert "collect_" not in got._jdf.queryExecution().toString()
    slots = got.sparkSession.createDataFrame(rows, df.schema).where("user_id = 1").selectExpr("t div 600 AS s")
    assert slots.groupBy("s").count().agg(F.max("count")).first()[0] < 100
    every = ev.debounce(df, ["user_id"], "t", "event_id", 0)
    assert every.count() == 60_000


def test_toggle(spark):
    rows = [(1, t, i) for i, t in enumerate([1_000_000, 1_050_000, 2_000_000, 3_000_000])]
    got = ev.toggle_actions(frame(spark, rows), ["user_id"], "t", "event_id", chunk_us=500_000)
    assert [(r.t, r.action) for r in got.orderBy("t").collect()] == [
        (1_000_000, "start"), (2_000_000, "stop"), (3_000_000, "start")]


def holds(events, gap):
    active, start, press, release, out = False, None, None, None, []
    for t, edge in events:
        if edge == "press":
            active = True
            if press is None or t - press >= gap:
                press = start = t
        elif active:
            active = False
            if release is None or t - release >= gap:
                release = t
                out.append((start, t))
                start = None
    return out


def test_hold_intervals(spark):
    rng = random.Random(8)
    t, events = 0, []
    for _ in range(1500):
        t += rng.choice([5, 60, 149, 150, 700])
        events.append((t, rng.choice(["press", "release"])))
    rows = [(1, t, i, e) for i, (t, e) in enumerate(events)]
    df = frame(spark, rows, "user_id long, t long, event_id long, edge string")
    got = ev.hold_intervals(df, ["user_id"], "t", "event_id", "edge", 150, 4000).orderBy("end_us")
    assert [(r.start_us, r.end_us) for r in got.collect()] == holds(events, 150)


def test_timeline_matches_plain_windows(spark):
    rng = random.Random(2)
    rows = [(i % 3, rng.randrange(10_000), i) for i in range(2000)]
    line = Timeline(frame(spark, rows), ["user_id"], ["t", "event_id"], 700)
    line.previous(["event_id"], "p").following(["event_id"], "n", where=F.col("event_id") % 7 == 0)
    line.running(F.lit(1), "c")
    got = {r.event_id: r for r in line.result().collect()}
    for user in range(3):
        own = sorted((t, i) for u, t, i in rows if u == user)
        for pos, (_, i) in enumerate(own):
            later = [x for _, x in own[pos + 1:] if x % 7 == 0]
            assert (got[i].p.event_id if got[i].p else None) == (own[pos - 1][1] if pos else None)
            assert (got[i].n.event_id if got[i].n else None) == (later[0] if later else None)
            assert got[i].c == pos + 1


def test_burst_in_one_chunk_is_cut_by_rows(spark):
    """All events of a key in one hour, a third of them at one microsecond, and a NULL time."""
    rng = random.Random(4)
    times = [rng.choice([77, rng.randrange(5000), rng.randrange(5000)]) for _ in range(6000)]
    rows = [(i % 20 and 1, t, i) for i, t in enumerate(times)] + [(1, None, 6000), (None, 3, 6001)]
    line = Timeline(frame(spark, rows), ["user_id"], ["t", "event_id"], ev.CHUNK_US, max_rows=500)
    assert line.df.groupBy("_key", "_chunk").count().agg(F.max("count")).first()[0] <= 500
    line.previous(["event_id"], "p").following(["event_id"], "n", where=F.col("event_id") % 97 == 0)
    line.running(F.lit(1), "c").running_max(F.when(F.col("event_id") % 5 == 0, F.col("event_id")), "m")
    got = {r.event_id: r for r in line.result().collect()}
    assert len(got) == len(rows)
    for user in (0, 1, None):
        own = sorted(((-1 if t is None else t), i) for u, t, i in rows if u == user)
        before, top = None, None
        for pos, (_, i) in enumerate(own):
            assert (got[i].p and got[i].p.event_id) == before and got[i].c == pos + 1
            before, top = i, max(top or 0, i) if i % 5 == 0 else top
            assert got[i].m == top
        after = None
        for _, i in reversed(own):
            assert (got[i].n and got[i].n.event_id) == after
            after = i if i % 97 == 0 else after


def test_sessions_of_a_burst(spark, monkeypatch):
    """The operators above the timeline give the same rows when every chunk is cut."""
    rng = random.Random(6)
    df = frame(spark, [(1, rng.randrange(200_000), i) for i in range(900)])
    whole = sorted(map(tuple, ev.sessions(df, ["user_id"], "t", "event_id", 900).collect()))
    monkeypatch.setattr(Timeline.__init__, "__defaults__", (100,))
    assert sorted(map(tuple, ev.sessions(df, ["user_id"], "t", "event_id", 900).collect())) == whole
    assert len(whole) > 5


def test_sessions(spark):
    rows = [(1, t * MS, t) for t in (0, 300, 650, 1100, 1400)]
    got = ev.sessions(frame(spark, rows), ["user_id"], "t", "event_id", chunk_us=500 * MS)
    assert [(r.start_us, r.end_us, r.n_events) for r in got.orderBy("start_us").collect()] == [
        (0, 1050 * MS, 3), (1100 * MS, 1800 * MS, 2)]


def test_auto_reset(spark):
    rows = [(1, 0, 1, "recording"), (1, 1_000_000, 2, "done"), (1, 2_000_000, 3, "done"),
            (1, 9_000_000, 4, "recording")]
    df = frame(spark, rows, "user_id long, t long, event_id long, state string")
    got = ev.state_timeline(df, ["user_id"], "t", "event_id", chunk_us=1_500_000).orderBy("at_us")
    assert [(r.state, r.at_us, r.dwell_us) for r in got.collect()] == [
        ("recording", 0, 1_000_000), ("done", 1_000_000, 1_000_000),
        ("done", 2_000_000, 1_500_000), ("idle", 3_500_000, 5_500_000), ("recording", 9_000_000, None)]


def test_reviews(spark):
    s = ev.SECOND
    left = frame(spark, [(1, i * 100 * s, i, f"r{i}", f"c{i}") for i in range(6)],
                 "user_id long, t long, event_id long, raw string, cleaned string")
    right = frame(spark, [(1, 5 * s, 10, "accept", None), (1, 100 * s + 15 * s, 11, "correct", " new "),
                          (1, 203 * s, 12, "skip", None), (1, 204 * s, 13, "accept", None),
                          (1, 310 * s, 14, "correct", "  "), (1, 416 * s, 15, "skip", None)],
                  "user_id long, t long, event_id long, decision string, edited string")
    got = ev.review_outcomes(left, right, ["user_id"], "t", "event_id", chunk_us=50 * s)
    assert {r.event_id: (r.output, r.decision) for r in got.collect()} == {
        0: ("c0", "accept"), 1: ("new", "correct"), 3: ("c3", "correct"), 4: ("c4", "accept"),
        5: ("c5", "accept")}


def test_history_cap(spark):
    df = frame(spark, [(1, n, n) for n in range(5)])
    assert {r.t for r in ev.last_n(df, ["user_id"], "t", "event_id", 3).collect()} == {2, 3, 4}


def test_settings_changes(spark):
    names = [c for cols in ev.REACTIONS.values() for c in cols]
    base = dict(hotkey="a", recording_mode="hold", formatter_backend="fast", local_model_path=None,
                whisper_model="m", vad_silence_ms=1)
    rows = [base, base, {**base, "hotkey": "b"}, {**base, "hotkey": "b", "local_model_path": "p"}]
    df = spark.createDataFrame([(1, i, i, *[r[n] for n in names]) for i, r in enumerate(rows)],
                               "user_id long, t long, event_id long, hotkey string, recording_mode string,"
                               "formatter_backend string, local_model_path string, whisper_model string,"
                               "vad_silence_ms int")
    got = ev.settings_changes(df, ["user_id"], "t", "event_id", 2).orderBy("t").collect()
    assert [(r.re_register, r.reload_rewriter, r.restart_needed) for r in got] == [
        (False, False, False), (False, False, False), (True, False, False), (False, True, False)]


def test_null_keys_are_a_key(spark):
    rows = [(u, t, e) for e, (u, t) in enumerate((u, t) for u in (None, 1) for t in range(0, 5000, 40))]
    df = spark.createDataFrame(rows, "user_id long, t long, event_id long")
    kept = {(r.user_id, r.t) for r in ev.debounce(df, ["user_id"], "t", "event_id", 150, 4).collect()}
    assert {t for u, t in kept if u is None} == {t for u, t in kept if u == 1} == set(range(0, 5000, 160))
    line = Timeline(df, ["user_id"], ["t", "event_id"], 700).previous(["t"], "_b").result()
    got = {(r.user_id, r.t): r._b and r._b.t for r in line.collect()}
    assert got == {(u, t): t - 40 if t else None for u, t, _ in rows}
