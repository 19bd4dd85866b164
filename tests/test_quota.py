import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import mining as m
from quillspark.operators import quota as q
from quillspark.operators import ranks
from quillspark.operators import stats as s


def skewed(spark, n=9000):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"g{i % 5}", rng.randrange(1 << 32)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, grp string, key long").repartition(9)


def brute(rows, k, by_group):
    out = set()
    for grp in {r[1] for r in rows} if by_group else {None}:
        part = sorted((r[2], r[0]) for r in rows if grp is None or r[1] == grp)
        out |= {i for _, i in part[:k]}
    return out


def test_smallest_k(spark):
    rows, df = skewed(spark)
    for k in (1, 700, 5000, 20000):
        for groups in ([], ["grp"]):
            got = q.smallest_k(df, k, "key", groups, ["id"], buckets=16, max_cut_rows=50)
            ids = [r.id for r in got.select("id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) == brute(rows, k, bool(groups))


def test_smallest_k_with_ties_and_clumps(spark):
    rows = [(i, "a", 7 if i % 3 else (1 << 60) + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, grp string, key long")
    for groups in ([], ["grp"]):
        got = q.smallest_k(df, 2500, "key", groups, ["id"], hi=1 << 61, buckets=8, max_cut_rows=10,
                           max_levels=5)
        assert {r.id for r in got.collect()} == brute(rows, 2500, False)


def test_sample_split_index(spark):
    df = spark.range(1000)
    assert q.sample_n(df, 15, 1, F.col("id"), ["id"]).count() == 15
    assert q.sample_n(df, 5000, 1, F.col("id"), ["id"]).count() == 1000
    train, val = q.split_exact(df, 42, F.col("id"), 0.2, ["id"])
    assert (train.count(), val.count()) == (800, 200) and train.intersect(val).count() == 0
    keys = spark.createDataFrame([(x,) for x in (5, -3, 900, 17, 10**12)], "key long")
    got = {r.key: r.idx for r in q.with_index(keys, "key", bound=3).collect()}
    assert got == {-3: 0, 5: 1, 17: 2, 900: 3, 10**12: 4}


def test_shuffled_keeps_rows(spark):
    out = q.shuffled(spark.range(500), 1, F.col("id"))
    order = [r.id for r in out.collect()]
    assert sorted(order) == list(range(500)) and order != sorted(order)


def test_source_priority_and_quota(spark):
    text = "This sentence has surely more than eight plain words number {}."
    first = spark.createDataFrame([(1, text.format("x")), (2, text.format("y"))], "doc_id long, text string")
    second = spark.createDataFrame([(0, text.format("x") + " " + text.format("z"))], "doc_id long, text string")
    got = m.unpack_order(m.mine_corpus([first, second])).orderBy("ord").collect()
    assert [(r.priority, r.doc_id, r.sent_idx) for r in got] == [(0, 1, 0), (0, 2, 0), (1, 0, 1)]
    assert m.mine_corpus([first, second], 2).count() == 2


SENTENCE = "This sentence has surely more than eight plain words number {}."


def test_nine_sources_any_ids_and_one_unreadable(spark, tmp_path):
    """Nine sources against a plain loop: negative, huge and NULL ids, a missing and a broken source."""
    def docs(p):
        ids = [None, -(1 << 62), -p, 0, (1 << 60) + p]
        return [(i, " ".join(SENTENCE.format(f"{p % 3}x{n % 4}y{p if n > 2 else 0}") for n in range(k, k + 3)))
                for k, i in enumerate(ids)] + [(7, None), (8, "")]

    def source(p):
        def read():
            if p == 3:
                return spark.read.parquet(str(tmp_path / "missing"))
            df = spark.createDataFrame(docs(p), "doc_id long, text string").repartition(3)
            if p == 5:  # opens, but breaks while it is read
                df = df.withColumn("text", F.when(F.col("doc_id") == 0, F.raise_error(F.lit("broken")))
                                   .otherwise(F.col("text")))
            return df
        return read

    want, seen = [], set()
    for p in range(9):
        for i, text in sorted(docs(p), key=lambda r: (r[0] is not None, r[0] or 0)) if p not in (3, 5) else ():
            for at, s in enumerate((text or "").replace(". ", ".|").split("|")):
                if s and s not in seen:
                    seen.add(s)
                    want.append((p, i, at, s))
    found, report = m.mine_sources(spark, [source(p) for p in range(9)])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    states = [r.status for r in report.orderBy("priority").collect()]
    assert [p for p, s in enumerate(states) if s == "failed"] == [3, 5]
    for cut in (1, len(want) // 2, len(want) + 5):
        some, told = m.mine_sources(spark, [source(p) for p in range(9)], cut)
        assert sorted(map(str, map(tuple, some.collect()))) == sorted(map(str, want[:cut]))
        assert told.agg(F.sum("n_new")).first()[0] == min(cut, len(want))
    assert told.where("status = 'not needed'").isEmpty()


def test_sources_with_text_ids_stop_when_the_target_is_met(spark):
    def opened(*names):
        return lambda: spark.createDataFrame([(n, SENTENCE.format(n)) for n in names], "doc_id string, text string")

    def never():
        raise AssertionError("opened")

    found, report = m.mine_sources(spark, [opened("b", "a"), opened("c", "a", "B"), never], 3)
    assert sorted((r.priority, r.doc_id) for r in found.collect()) == [(0, "a"), (0, "b"), (1, "B")]
    assert [(r.status, r.n_new) for r in report.orderBy("priority").collect()] == [
        ("read", 2), ("read", 1), ("not needed", 0)]
    empty, report = m.mine_sources(spark, [])
    assert empty.isEmpty() and report.isEmpty()


def p95(xs):
    return sorted(xs)[int(0.95 * (len(xs) - 1))]


def test_latency_summary(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", 3.0), ("b", 1.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "grp string, ms double")
    got = {r.grp: r for r in s.latency_summary(df, ["grp"]).collect()}
    assert (got["a"].p95_ms, got["a"].p50_ms, got["b"].p50_ms, got["c"].p95_ms) == (18.0, 9.5, 2.0, 5.0)


def test_latency_bracket_path(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.exponential(10, 30_001), np.full(9000, 7.25)]).round(3)
    df = spark.createDataFrame([("h", float(x)) for x in xs], "grp string, ms double").repartition(8)
    got = s.latency_summary(df, ["grp"], limit=10).first()
    assert got.p50_ms == float(np.median(xs)) and got.p95_ms == p95(xs.tolist())
    assert got.n == len(xs) and got.max_ms == xs.max()


def test_stage_and_case_statistics(spark):
    df = spark.createDataFrame([("Formatter (fast)", 0, 10.0), ("Formatter (fast)", 1, 20.0),
                                ("Text injection", 0, None), ("Text injection", 1, 5.0)],
                               "stage string, iter int, ms double")
    got = {r.stage: r for r in s.stage_stats(df).collect()}
    assert got["Formatter (LLM)"].min_ms is None and got["Formatter (fast)"].avg_ms == 15.0
    totals = {r.iter: r.ms for r in s.with_totals(df).where("stage = 'TOTAL'").collect()}
    assert totals == {0: 10.0, 1: 25.0}
    calls = spark.createDataFrame([("v", 1, 100.0, ""), ("v", 2, 4.0, "x"), ("v", 3, 6.0, "y"),
                                   ("w", 1, 9.0, "")], "variant string, idx int, ms double, text string")
    row = s.first_vs_rest(calls, ["variant"]).collect()
    assert [(r.variant, r.first_ms, r.rest_avg_ms) for r in row] == [("v", 100.0, 6.0)]


def test_quota_with_null_groups_at_any_k(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, "a", "b"]), rng.randrange(1 << 32)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, grp string, key long").repartition(6)
    for k in (0, 3, 999, 1000, 1001, 5000):
        want = set()
        for grp in (None, "a", "b"):
            want |= {i for _, i in sorted((key, i) for i, g, key in rows if g == grp)[:k]}
        first = q.first_k(df, k, [F.col("key"), F.col("id")], ["grp"])
        small = q.smallest_k(df, k, "key", ["grp"], ["id"], lo=None, buckets=16, max_cut_rows=50)
        assert {r.id for r in first.collect()} == want == {r.id for r in small.collect()}


def test_latency_of_null_groups_and_values(spark):
    rows = [("a", float(i % 7919)) for i in range(30_000)] + [(None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "grp string, ms double").repartition(5)
    for small in (10, 100_000):
        got = {r.grp: r for r in s.latency_summary(df, ["grp"], limit=small).collect()}
        values = sorted(v for g, v in rows if g == "a")
        assert (got["a"].p50_ms, got["a"].p95_ms) == (np.median(values), values[int(0.95 * (len(values) - 1))])
        assert (got[None].n, got[None].p50_ms) == (2, 6.0)
        assert (got["b"].n, got["b"].avg_ms, got["b"].p95_ms) == (0, None, None)


def test_latency_does_not_shuffle_the_fact(spark):
    df = spark.range(50_000).selectExpr("id % 3 AS grp", "cast(id AS double) AS ms")
    plan = s.latency_summary(df, ["grp"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Range (") == 1


@pytest.mark.parametrize("kind", ["smooth", "orders", "ties", "ends"])
def test_brackets_are_cut_until_a_window_is_bounded(spark, kind, monkeypatch):
    """Groups far above the limit: ranks as in plain sorting, and no bracket keeps more than the limit."""
    rng = np.random.default_rng(8)
    draw = {"smooth": lambda n: rng.normal(0, 50, n), "orders": lambda n: 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n),
            "ties": lambda n: rng.choice([1.0, 1.5, 2.0, 1e9], n), "ends": lambda n: np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308)}[kind]
    groups = {g: draw(n) for g, n in (("hot", 60_000), (None, 21_000), ("small", 30))}
    df = spark.createDataFrame(pd.DataFrame([(g, float(v)) for g, values in groups.items() for v in values], columns=["grp", "ms"])).repartition(6)
    levels, write = [], ranks.materialise

    def spied(frame, label):
        out = write(frame, label)
        if label == "ranks-level":
            levels.append(out)
        return out

    monkeypatch.setattr(ranks, "materialise", spied)
    n1 = F.col("n") - 1
    wanted = {"a": (0.5, F.floor(n1 / 2)), "b": (0.5, F.ceil(n1 / 2)), "c": (0.95, F.floor(F.lit(0.95) * n1)),
              "least": (0.0, F.lit(0)), "most": (1.0, n1)}
    got = {r["_g"][0]: r for r in ranks.order_statistics(df, ["grp"], "ms", wanted, limit=20, buckets=16).collect()}
    for g, values in groups.items():
        ordered, n = sorted(values.tolist()), len(values)
        at = [(n - 1) // 2, -(-(n - 1) // 2), int(0.95 * (n - 1)), 0, n - 1]
        assert [got[g][k] for k in wanted] == [ordered[i] for i in at]
    assert levels or kind in ("ties", "ends")
    for i in range(len(wanted) if levels else 0):
        assert levels[-1].where(f"_m{i} > 20 AND _lo{i} < _hi{i}").isEmpty()


def test_exact_split(spark):
    df = spark.range(1000)
    train, val = q.split_exact(df, 3, F.col("id"), 0.2, ["id"])
    a, b = {r.id for r in train.collect()}, {r.id for r in val.collect()}
    assert len(b) == 200 and not a & b and len(a | b) == 1000
    assert q.split_exact(df, 3, F.col("id"), 0.0, ["id"])[1].count() == 0


def test_index_of_null_and_uneven_keys(spark, monkeypatch):
    """NULL keys first; two far clusters of keys are dealt over many ranges, none of them much above the bound."""
    kept, write = {}, q.materialise
    monkeypatch.setattr(q, "materialise", lambda df, label: kept.update({label: write(df, label)}) or kept[label])
    keys = spark.range(20_000).selectExpr("CASE WHEN id < 10000 THEN id ELSE id + 1000000000000 END AS key").unionAll(
        spark.createDataFrame([(None,)] * 3, "key long"))
    got = q.with_index(keys, "key", bound=1000).collect()
    assert sorted(r["idx"] for r in got if r["key"] is None) == [0, 1, 2] and len(got) == 20_003
    assert [r["key"] for r in sorted(got, key=lambda r: r["idx"])[3:]] == [*range(10_000), *range(10**12 + 10_000, 10**12 + 20_000)]
    assert kept["index-ranges"].groupBy("_pid").count().agg(F.max("count")).first()[0] < 3000
    assert q.with_index(keys.limit(0), "key").count() == 0
