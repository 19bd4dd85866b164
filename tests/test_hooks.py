import math
import os
import uuid

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import examples as x
from quillspark.operators import routing as r
from quillspark.operators.hooks import KEPT_MODELS, SLICE_BYTES, SWEPT_BYTES, answers, slices, worker_model


def calls_for(texts, bad):
    calls = []

    def fn(t, h):
        calls.append(len(t))
        if set(t) & bad:
            raise ValueError("refused")
        return t.str.upper() + h
    got, errors = answers(fn, pd.Series(texts, dtype=object), pd.Series([""] * len(texts), dtype=object))
    return list(got), list(errors), calls


def test_one_bad_row_costs_a_logarithm_of_calls():
    texts = [f"t{i}" for i in range(1000)]
    got, errors, calls = calls_for(texts, {"t613"})
    assert len(calls) <= 2 * math.ceil(math.log2(1000)) + 1
    assert got == [None if t == "t613" else t.upper() for t in texts]
    assert errors == ["ValueError: refused" if t == "t613" else None for t in texts]


@pytest.mark.parametrize("bad", [set(), {"t0"}, {"t0", "t6"}, {f"t{i}" for i in range(7)}])
def test_failures_stay_with_their_rows(bad):
    texts = [f"t{i}" for i in range(7)]
    got, errors, _ = calls_for(texts, bad)
    assert [e is not None for e in errors] == [t in bad for t in texts]
    assert got == [None if t in bad else t.upper() for t in texts]


def test_empty_batch_and_short_answers():
    assert calls_for([], set()) == ([], [], [])
    one = pd.Series(["a", "b"], dtype=object)
    got, errors = answers(lambda t, h: t.iloc[:1] if len(t) > 1 else t, one, one)
    assert list(got) == ["a", "b"] and list(errors) == [None, None]


def test_a_worker_keeps_the_newest_models():
    loads = []
    names = [uuid.uuid4().hex for _ in range(KEPT_MODELS + 1)]
    for name in [*names, names[-1], names[0]]:
        assert worker_model(name, lambda n=name: loads.append(n) or n) == name
    assert loads == [*names, names[0]]


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    def load():
        with open(tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts, hints: texts.str.upper()

    df = spark.range(0, 400, 1, 40).select("id", F.concat(F.lit("word "), "id").alias("text"), F.lit("").alias("hint"))
    assert r.rewrite(df, load).where("rewritten = upper(text)").count() == 400
    pids = [name.split("-")[0] for name in os.listdir(tmp_path)]
    assert 1 <= len(pids) < 40 and len(pids) == len(set(pids))


def test_routing_reads_its_input_once(spark, tmp_path):
    spark.range(50).select("id", F.repeat(F.lit("w "), F.col("id").cast("int") % 9).alias("text"),
                           F.lit("").alias("hint")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out = r.format_transcripts(df, lambda: lambda t, h: t.str.upper(), threshold=5)
    assert str(tmp_path) not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    assert out.columns == ["id", "text", "hint", "fast", "tier", "final"] and out.count() == 50


def test_tokenizer_gets_batches_and_null_texts(spark):
    df = spark.createDataFrame([("1", None, "a bb"), ("2", "ccc", None)], "pair_id string, input string, output string")
    got = {row["pair_id"]: row for row in x.encode_with(
        df, lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]).collect()}
    assert got["1"]["completion_ids"] == [1, 2] and got["2"]["completion_ids"] == []
    assert got["2"]["prompt_ids"] == [6, 3, 7]


def test_batches_do_not_depend_on_the_size_of_a_task(spark):
    rows = spark.range(0, 2000, 1, 7).select(F.col("id").cast("string").alias("pair_id"))
    one, many = ({row["pair_id"]: (row["shard"], row["batch"], row["slot"]) for row in
                  x.batch_numbers(rows, 5, shards=3, bound=bound).collect()} for bound in (10**6, 40))
    assert one == many and len(one) == 2000
    for shard in range(3):
        places = sorted(4 * b + s for sh, b, s in one.values() if sh == shard)
        assert places == list(range(len(places)))


def test_equally_frequent_tokens_of_one_prefix_are_ranked_over_tasks(spark):
    words = [f"common{i:05d}" for i in range(3000)] + ["often"] * 3 + [None]
    v = x.vocabulary(spark.createDataFrame([(w,) for w in words], "text string").repartition(5))
    want = ["often", *sorted(w for w in words if w and w != "often")]
    assert [row["token"] for row in v.orderBy("token_id").collect()] == want
    assert [row["token_id"] for row in v.orderBy("token_id").collect()] == [x.FIRST_ID + i for i in range(len(want))]


def test_texts_of_one_call_are_bounded():
    batch = pa.RecordBatch.from_pydict({"n": list(range(6)), "text": ["aa", None, "a" * 50, "", "aaa", "aa"]})
    got = list(slices([batch, batch.slice(0, 0)], "text", 5))
    assert [b.column("n").to_pylist() for b in got] == [[0, 1], [2], [3, 4, 5]]


def test_columns_of_a_model_do_not_pile_up(spark):
    def load():
        import weakref
        seen = []

        def model(texts, hints):
            seen.append(weakref.ref(texts))
            texts.str.len()
            return pd.Series([str(sum(r() is not None for r in seen))] * len(texts))
        return model

    rows = spark.range(0, 120_000, 1, 1).select("id", F.repeat(F.lit("word "), 400).alias("text"), F.lit(None).cast("string").alias("hint"))
    most = r.rewrite(rows, load).agg(F.max(F.col("rewritten").cast("int")), F.count("*")).first()
    assert most[0] <= SWEPT_BYTES // SLICE_BYTES + 3 and most[1] == 120_000


def test_other_columns_pass_the_rewriter_as_they_are(spark):
    rows = spark.sql("SELECT 7 AS n, array(1.5D, NULL) AS a, TIMESTAMP '2020-01-02 03:04:05' AS at, "
                     "text, hint FROM VALUES ('one', 'x'), (NULL, 'y'), ('', NULL) AS v(text, hint)")
    out = r.rewrite(rows, lambda: lambda t, h: t.fillna("none") + h.fillna("-"))
    assert out.select(*rows.columns).exceptAll(rows).isEmpty()
    assert [x.rewritten for x in out.collect()] == ["onex", "noney", "-"]
