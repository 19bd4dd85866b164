import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import settings as st
from quillspark.sources import files


def test_pair_log(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"input":"ok","output":"Ok."}\n\n{bad json}\n5\n   \n')
    assert [(r.input, r.output) for r in files.read_pairs_tolerant(spark, str(log)).collect()] == [("ok", "Ok.")]
    assert files.read_pairs_tolerant(spark, str(log)).count() == 1
    assert files.read_pairs_tolerant(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        files.read_pairs_strict(spark, str(log)).collect()


def test_append_and_overwrite(spark, tmp_path):
    pairs = spark.createDataFrame([("ün", "Ün.")], "input string, output string")
    path = str(tmp_path / "pairs")
    assert files.append_pairs(pairs, path) and files.append_pairs(pairs, path)
    got = files.read_pairs_tolerant(spark, path)
    assert got.count() == 2 and got.where(F.col("timestamp").rlike(r"^\d{4}-.*T")).count() == 2
    files.write_pairs(pairs, path)
    assert files.read_pairs_strict(spark, path).count() == 1
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "pairs").glob("part-*"))
    assert "ün" in raw
    (tmp_path / "file").write_text("x")
    assert files.append_pairs(pairs, str(tmp_path / "file" / "sub")) is False


def test_history_files(spark, tmp_path):
    entries = [{"timestamp": "t", "raw_text": f"r{n}", "final_text": f"f{n}"} for n in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(entries, indent=2))
    (tmp_path / "b.json").write_text('{"timestamp": "t"}')
    (tmp_path / "c.json").write_text("[{oops")
    got = files.read_history(spark, str(tmp_path))
    assert sorted(r.final_text for r in got.collect()) == ["f0", "f1", "f2"]
    assert files.read_history(spark, str(tmp_path / "none")).count() == 0


def test_history_store(spark, tmp_path):
    store = files.HistoryStore(spark, str(tmp_path / "h"), ["user_id"], "t", "event_id", 3)
    for batch in range(3):
        df = spark.createDataFrame([(1, batch * 2 + i, batch * 2 + i) for i in range(2)],
                                   "user_id long, t long, event_id long")
        store.apply(df, batch)
        store.apply(df, batch)
    assert sorted(r.t for r in store.read().collect()) == [3, 4, 5]


def test_history_store_rewrites_the_touched_buckets_only(spark, tmp_path):
    """Against a plain dictionary; a later batch of one key writes one bucket of many."""
    schema = "user_id long, t long, event_id long"
    store = files.HistoryStore(spark, str(tmp_path / "h"), ["user_id"], "t", "event_id", 4, buckets=16)
    assert store.read() is None and store.version() == -1
    want, at = {}, 0
    for batch, users in enumerate([[*range(200), None], [7] * 6, [], [7, None, 500]]):
        rows = [(u, at + i, at + i) for i, u in enumerate(users)]
        at += len(rows)
        for u, t, _ in rows:
            want[u] = [*want.get(u, []), t][-4:]
        df = spark.createDataFrame(rows, schema)
        store.apply(df, batch)
        store.apply(df, batch)
        got = {}
        for r in store.read(df.schema).orderBy("t").collect():
            got.setdefault(r.user_id, []).append(r.t)
        assert got == want and store.version() == batch
    written = [len(list((tmp_path / "h" / f"v={b}").glob("history_bucket=*"))) for b in (0, 1, 3)]
    assert written[0] == 16 and written[1] == 1 and written[2] <= 3
    with pytest.raises(ValueError):
        files.HistoryStore(spark, str(tmp_path / "h"), ["user_id"], "t", "event_id", 4, buckets=8).read()


def test_settings(spark):
    rows = [(1, '{"hotkey": "f9", "llm_word_threshold": 7, "theme": 1}'), (2, "{oops"), (3, None)]
    df = spark.createDataFrame(rows, "k int, config string")
    got = {r.k: r for r in st.with_settings(df, "config", ["k"]).collect()}
    assert (got[1].hotkey, got[1].llm_word_threshold, got[1].history_max) == ("f9", 7, 50)
    assert got[2].hotkey == got[3].hotkey == "ctrl+shift+space"
    stored = spark.createDataFrame([(1, "a", "m", "b")], "k int, hotkey string, whisper_model string, formatter_backend string")
    env = spark.createDataFrame([(1, "", "envm", "envb")], stored.schema)
    cli = spark.createDataFrame([(1, "clim", "")], "k int, whisper_model string, formatter_backend string")
    row = st.overlay(stored, env, cli, "k").first()
    assert (row.hotkey, row.whisper_model, row.formatter_backend) == ("a", "clim", "envb")
    assert st.to_text(st.with_settings(df, "config", ["k"]), ["k"]).where("config like '%f9%'").count() == 1
