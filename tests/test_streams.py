import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import events as ev
from quillspark.operators.timeline import micros
from quillspark.plans.stand_in import failing_rewriter
from quillspark.streaming import processors
from quillspark.streaming import streams as s

START = 1_700_000_000_000_000
SCHEMA = "event_id long, user_id long, state string, text string, t long"


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """Four event files in event-time order, ended by a sentinel far ahead."""
    rng = random.Random(4)
    now, rows = START, []
    for i in range(1200):
        now += rng.choice([20, 70, 140, 160, 700, 2500]) * 1000
        rows.append((i, rng.randrange(3), rng.choice(["press", "release", "done"]),
                     f"um this is text {i}" if i % 10 == 0 else f"um so here is text {i}", now))
    last = now + 3_600_000_000
    folder = str(tmp_path_factory.mktemp("pieces"))
    for n in range(4):
        part = rows[n * 300:(n + 1) * 300] + ([(9999, 99, "press", "um end", last)] if n == 3 else [])
        df = spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_micros("t"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def live(spark, folder):
    return s.source(spark, folder + "/", files_per_trigger=1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module", params=["in order", "late"])
def arrived(request, spark, pieces, tmp_path_factory):
    """The events once in order and once up to 40 s late, spread over five files."""
    if request.param == "in order":
        return pieces
    rng = random.Random(9)
    rows = [tuple(r) for r in spark.read.parquet(pieces).drop("ts").collect()]
    rows.sort(key=lambda r: r[4] + (rng.random() * 40e6 if r[1] < 99 else 0))
    folder = str(tmp_path_factory.mktemp("late"))
    for n in range(5):
        spark.createDataFrame(rows[n * 241:(n + 1) * 241], SCHEMA).withColumn("ts", F.timestamp_micros("t")).coalesce(
            1).write.mode("append").parquet(folder)
    return folder


def test_debounce_toggle_hold(spark, arrived):
    batch = spark.read.parquet(arrived).where("user_id < 99")
    with s.rocksdb_state(spark):
        got = s.run_to_files(s.debounce_stream(live(spark, arrived), ev.DEBOUNCE_US, "45 seconds"), "t-debounce")
        want = ev.debounce(batch, ["user_id"], "t", "event_id")
        assert rows_of(got) == rows_of(want.select("user_id", "t", "event_id"))
        got = s.run_to_files(s.toggle_stream(live(spark, arrived), ev.DEBOUNCE_US, "45 seconds"), "t-toggle")
        want = ev.toggle_actions(batch, ["user_id"], "t", "event_id")
        assert rows_of(got) == rows_of(want.select("user_id", "t", "event_id", "action"))
        edges = F.col("state").isin("press", "release")
        got = s.run_to_files(s.hold_stream(s.watermarked(live(spark, arrived), "45 seconds", edges).withColumnRenamed(
            "state", "edge"), ev.DEBOUNCE_US), "t-hold")
        want = ev.hold_intervals(batch.where(edges).withColumnRenamed("state", "edge"),
                                 ["user_id"], "t", "event_id")
        assert sorted(map(str, rows_of_plain(got))) == sorted(map(str, rows_of_plain(
            want.select("user_id", "event_id", "start_us", "end_us"))))


def rows_of_plain(df):
    return [tuple(r) for r in df.collect()]


def test_auto_reset(spark, arrived):
    with s.rocksdb_state(spark):
        got = s.run_to_files(s.auto_reset_stream(live(spark, arrived), ev.DONE_RESET_US, "45 seconds"),
                             "t-reset")
    want = ev.state_timeline(spark.read.parquet(arrived), ["user_id"], "t", "event_id")
    assert rows_of(got) == rows_of(want.select("user_id", "event_id", "state", "at_us"))
    assert got.where("state = 'idle'").count() > 10


def test_late_release_closes_its_press(spark, tmp_path):
    """Presses at 1 s and 5 s, a release of 2 s in the next batch, then time passes."""
    for part in ([(1, 7, "press", "", 1_000_000), (2, 7, "press", "", 5_000_000)], [(3, 7, "release", "", 2_000_000)],
                 [(4, 8, "press", "", 60_000_000)]):
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    edges = live(spark, str(tmp_path / "in")).withColumnRenamed("state", "edge")
    with s.rocksdb_state(spark):
        got = s.run_to_files(s.hold_stream(edges, ev.DEBOUNCE_US, "10 seconds"), "t-late")
    assert rows_of(got) == [(7, 3, 1_000_000, 2_000_000)]


def test_history(spark, pieces):
    want = rows_of(ev.last_n(spark.read.parquet(pieces), ["user_id"], "t", "event_id", 7)
                   .select("user_id", "event_id", "t"))
    assert rows_of(s.run_history(live(spark, pieces), 7).select("user_id", "event_id", "t")) == want
    files = s.run_history_files(live(spark, pieces).select("user_id", "event_id", "t"), 7)
    assert rows_of(files.select("user_id", "event_id", "t")) == want


def test_sessions(spark, pieces):
    got = s.run_to_files(s.session_stream(live(spark, pieces), "user_id", "ts", "400 milliseconds",
                                          "1 second"), "t-sessions")
    want = ev.sessions(spark.read.parquet(pieces), ["user_id"], "t", "event_id").where("user_id < 99")
    assert rows_of(got.select("user_id", "start_us", "end_us", "n_events")) == rows_of(
        want.select("user_id", "start_us", "end_us", "n_events"))


def test_review(spark, arrived):
    def sides(rows):
        state = F.col("state")
        left = rows.where(state == "done").withColumns({"raw": F.col("text"), "cleaned": F.lit("c")})
        kind = F.when(F.col("event_id") % 3 == 0, "skip").when(F.col("event_id") % 3 == 1, "correct").otherwise("accept")
        edit = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" \t"), "text", F.lit("\u00a0"))).otherwise("  ")
        # The sentinel's press moves the watermark on.
        return left, rows.where(state == "press").withColumns({"decision": kind, "edited": edit})

    batch = spark.read.parquet(arrived)
    want = ev.review_outcomes(*sides(batch), ["user_id"], "t", "event_id", 2 * ev.SECOND)
    names = ["user_id", "event_id", "input", "output", "decision"]
    with s.rocksdb_state(spark):
        got = s.run_to_files(s.review_stream(*sides(live(spark, arrived)), 2 * ev.SECOND, "45 seconds"), "t-review")
    assert rows_of(got.select(*names)) == rows_of(want.select(*names))
    assert {r["decision"] for r in got.select("decision").distinct().collect()} == {"accept", "correct"}
    log = s.run_review(*sides(live(spark, arrived)), 2 * ev.SECOND, "45 seconds")
    assert rows_of(log.select("input", "output")) == rows_of(want.select("input", "output"))
    assert log.where("timestamp IS NULL").isEmpty()


class Store:
    """State and timers of one key, in memory; counts the chunks that wait."""

    def __init__(self):
        self.maps, self.timers, self.reads = {}, set(), []

    def getMapState(self, name, *_):
        held, store = self.maps.setdefault(name, {}), self

        class Map:
            keys = staticmethod(lambda: list(held))
            updateValue = staticmethod(lambda k, v: held.__setitem__(k, v))

            @staticmethod
            def getValue(k):
                store.reads.append(k)
                return held[k]
            removeKey = staticmethod(lambda k: held.pop(k))
        return Map

    def getValueState(self, name, _):
        held = self.maps.setdefault(name, [])

        class Value:
            exists = staticmethod(lambda: bool(held))
            get = staticmethod(lambda: held[0])

            @staticmethod
            def update(v):
                held[:] = [v]
        return Value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("seed", range(4))
def test_backlog_is_released_in_order_chunk_by_chunk(seed, monkeypatch):
    """A hot key's backlog of 3,000 rows, late by up to 200 ms: the outcome of the plain loop, one timer
    at a time, and a chunk is opened only when the rows before it are done."""
    monkeypatch.setattr(processors, "CHUNK_ROWS", 64)
    rng, rows, now = random.Random(seed), [], START
    for i in range(3000):
        now += rng.choice([0, 1, 20, 90, 200]) * 1000
        rows.append((now, i))
    arrival = sorted(rows, key=lambda r: r[0] + rng.random() * 200_000)
    rule, store = processors.Debounce(ev.DEBOUNCE_US), Store()
    rule.init(store)
    got = []
    for at in range(0, len(arrival), 500):
        part = pd.DataFrame(arrival[at:at + 500], columns=["t", "event_id"])
        got += [f for f in rule.handleInputRows((1,), iter([part[:250], part[250:]]), None)]
        seen = max(t for t, _ in arrival[:at + 500]) // 1000 - 200
        while any(ms <= seen for ms in store.timers):
            assert len(store.timers) == 1
            store.timers.clear()
            got += list(rule.handleExpiredTimer((1,), Clock(seen), None))
    list(rule.handleInputRows((1,), iter([]), None))
    got += list(rule.handleExpiredTimer((1,), Clock(now // 1000 + 1), None))
    want, last = [], None
    for t, i in sorted(rows):
        if last is None or t - last >= ev.DEBOUNCE_US:
            last = t
            want.append((1, t, i))
    assert [tuple(r) for f in got for r in f.itertuples(index=False)] == want
    assert not store.maps["rows"] and all(len(f) <= processors.FRAME_ROWS + 1 for f in got)


def test_clean_and_isolation(spark, pieces):
    got = s.run_to_files(s.clean_stream(live(spark, pieces)).select("event_id", "fast"), "t-clean")
    want = spark.read.parquet(pieces).select("event_id", t.clean(F.col("text")))
    assert rows_of(got) == rows_of(want)
    rows = live(spark, pieces).select("event_id", "text").withColumn("hint", F.lit(""))
    good, dead = s.run_isolated(rows, failing_rewriter)
    assert dead.count() == 120 and good.count() == 1081
    assert dead.where("error = 'ValueError: model refused' AND rewritten IS NULL").count() == 120


def test_mining_stops_early(spark, tmp_path):
    text = "Here the sentence number {} is long enough to pass the gate."
    for n in range(4):
        spark.createDataFrame([(n * 10 + i, text.format(chr(65 + n) * (i + 1))) for i in range(10)],
                              "doc_id long, text string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "docs"))
    rows = s.source(spark, str(tmp_path / "docs") + "/", files_per_trigger=1)
    got = s.run_mining(rows, 15, groups=["the"], path=str(tmp_path / "out"))
    assert got.count() == 15
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_micros(spark):
    assert spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:01' AS x").select(
        micros("x")).first()[0] == 1_000_000


def test_mining_takes_no_more_than_its_quota(spark, tmp_path):
    """Four batches, of which the third repeats the first and one group stays open to the end."""
    texts = [[f"Here the {w} sentence number {chr(65 + n)}{chr(97 + i)} is long enough to pass." for i in range(12)]
             for n, w in enumerate(["first", "second", "first", "weird"])]
    texts[2] = texts[0]
    for n, batch in enumerate(texts):
        spark.createDataFrame([(n * 100 + i, text) for i, text in enumerate(batch)], "doc_id long, text string").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "docs"))
    got = s.run_mining(s.source(spark, str(tmp_path / "docs") + "/", files_per_trigger=1), 15,
                       path=str(tmp_path / "out"), cells=3)
    rows = sorted((r["grp"], r["ord"] >> 20) for r in got.collect())
    assert rows == ([("the", i) for i in range(12)] + [("the", 100 + i) for i in range(3)]
                    + [("weir", 300 + i) for i in range(12)])
    last = spark.read.schema(processors.Quota.output).parquet(str(tmp_path / "out" / "000000003"))
    assert {r["grp"] for r in last.collect()} == {"weir"}
