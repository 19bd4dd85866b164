"""Stages on tables with repeated ids, clashing column names and rare languages: values, not counts."""

import random

from pyspark.sql import functions as F

from quillspark.llm import exact, jaccard, langid, quality

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(n))


def test_exact_stage_leaves_clashing_columns_as_they_were(spark):
    rows = [(1, "same", "u", 1), (2, "same", "v", 2), (3, None, "w", 3), (4, "", "x", 4), (5, "other", None, 5), (5, "other", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _gid int").withColumn("_row", F.lit("r"))
    got = sorted((r["doc_id"], r["text"], r["_sha"], r["_gid"], r["_row"]) for r in exact.drop_exact_duplicates(docs).collect())
    assert got == [(2, "same", "v", 2, "r"), (4, "", "x", 4, "r"), (5, "other", None, 5, "r")]
    assert exact.drop_exact_duplicates(docs.limit(0)).columns == docs.columns


def test_quality_stage_agrees_with_the_scores(spark):
    docs = spark.createDataFrame([(i, text(i) if i % 2 else "spam " * 30, 0.1, "k") for i in range(60)] + [(60, None, 0.1, "k"), (61, "", None, None)],
                                 "doc_id long, text string, _score double, score string")
    labels = docs.where("doc_id < 40").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality.fit(docs, labels)
    for least in (0.0, 0.5, 1.1):
        want = {r["doc_id"] for r in quality.score(docs, model).where(F.col("score") >= least).collect()}
        got = quality.kept(docs, model, least)
        assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
        assert all(r["_score"] in (0.1, None) for r in got.collect())
    good = {r["doc_id"] for r in quality.kept(docs, model).where("doc_id < 60").collect()}
    assert all(i % 2 for i in good) and len(good) >= 25


def test_near_stage_with_repeated_ids(spark):
    base, own = text(1), text(2)
    near = base + " tail"
    rows = [(1, base, "a"), (5, near, "b"), (5, own, "c"), (5, own, "c"), (7, own + " end", "d"), (9, near + " more", "e"),
            (None, base, "f"), (11, None, "g"), (11, "", "g"), (12, "  ", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, no string")
    got = sorted((r["doc_id"] or 0, r["no"]) for r in jaccard.drop_near_duplicates(docs).collect())
    assert got == [(0, "f"), (1, "a"), (5, "c"), (11, "g"), (12, "h")]


def test_a_rare_language_is_learned(spark):
    rng = random.Random(4)
    common = [(i, "".join(rng.choice("abcd ") for _ in range(200)), "aa") for i in range(600)]
    rare = [(10_000 + i, "".join(rng.choice("wxyz ") for _ in range(200)), "zz") for i in range(6)]
    docs = spark.createDataFrame(common + rare + rare[:1] * 50, "doc_id long, text string, lang string")
    network = langid.fit(docs, settings=langid.Settings(max_labels=60, epochs=6, batch=16))
    assert network.names == ["aa", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, network).collect()}
    assert all(got[i] == lang for i, _, lang in common[:50] + rare)
