import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import corrupt as c
from quillspark.functions import draws as d
from quillspark.functions import text as t
from quillspark.functions import vocab as v
from quillspark.operators import generate as g
from quillspark.operators import mining as m
from quillspark.sources.tables import table

SF = "/root/testdata/sf0.001"
TEXT = "Because the weather is weird, their 3 friends go to the 21st house by noon and don't hear us."


@pytest.fixture(scope="module")
def noisy(spark):
    """2,000 differently seeded corruptions of one sentence."""
    def run(op):
        df = spark.range(2000).select(op(F.lit(TEXT), 42, F.col("id")).alias("x"))
        return [r.x for r in df.collect()]
    return run


def share(rows, test):
    return sum(1 for r in rows if test(r)) / len(rows)


def test_fillers(noisy):
    rows = noisy(c.insert_fillers)
    prefix = share(rows, lambda r: not r.startswith("Because"))
    assert 0.25 < prefix < 0.35
    for r in rows:
        it = iter(r.split())
        assert all(w in it for w in TEXT.split())
        assert r.split()[-1] == "us."
    extra = sum(len(re.findall(r"\b(?:basically|literally|actually)\b", r)) for r in rows)
    assert 0.8 < extra / (2000 * (16 * 0.15 + 0.3) * 3 / 12) < 1.2


def test_spelling(noisy):
    rows = noisy(c.spelling_errors)
    assert 0.36 < share(rows, lambda r: r.startswith("Becuz")) < 0.44
    assert 0.36 < share(rows, lambda r: "teh" in r) < 0.44
    assert all(r.count("teh") <= 1 for r in rows)


def test_homophones(noisy):
    rows = noisy(c.homophone_swaps)
    assert 0.5 < share(rows, lambda r: "whether" in r) < 0.6
    assert {re.search(r"weird, (\S+) 3", r).group(1) for r in rows} == {"their", "there", "they're"}


def test_numbers(column):
    texts = ["1,000 21ST 10 007 x10 26 1000", "no digits", "3rd."]
    got = column(lambda t: c.number_words(t), texts)
    assert got == ["one,000 twenty first ten 007 x10 26 one thousand", "no digits", "third."]


def test_duplicates_and_drops(noisy, column):
    dup = noisy(c.duplicate_words)
    n = len(TEXT.split())
    assert 0.8 < sum(len(r.split()) - n for r in dup) / (2000 * n * 0.05) < 1.2
    lost = [n - len(r.split()) for r in noisy(c.drop_words)]
    assert set(lost) == {1, 2} and 0.66 < lost.count(1) / 2000 < 0.78
    short = ["a b c d e", "one"]
    assert column(lambda t: c.drop_words(t, 1, F.lit(1)), short) == short


def test_force_typo(column):
    assert column(lambda t: c.force_typo(t, F.lit("the"), F.lit("teh")), [
        "other the the", "then", "éthe the"]) == ["other teh the", "then", "éthe teh"]


def test_mixes(spark):
    ops = [r.o for r in spark.range(4000).select(c.full_mix_ops(1, F.col("id")).alias("o")).collect()]
    assert all(2 <= len(o) <= 4 and len(set(o)) == len(o) for o in ops)
    assert all(3 not in o[1:] for o in ops)
    rows = spark.range(1000).select(
        c.corrupt_light(F.lit(TEXT), 3, F.col("id")).alias("x")).collect()
    plain = {w for w in re.findall(r"[a-z]+", TEXT.lower())} - {
        "because", "the", "weird", "their", "don", "t"}
    for r in rows:
        assert plain <= set(re.findall(r"[a-z]+", r.x.lower()))


@pytest.mark.parametrize("n", [1, 7, 64])
def test_partitioning_does_not_matter(spark, n):
    docs = table(spark, SF, "documents", "doc_id", "text")
    good = m.good_sentences(docs.repartition(n)).select(
        c.corrupt_full(F.col("sentence"), 42, F.concat_ws(":", "doc_id", "sent_idx")).alias("x"))
    ids = spark.range(300).repartition(n)
    both = good.unionByName(g.pass_through_pairs(ids, 5).select(F.col("input").alias("x")))
    total = both.agg(F.sum(F.xxhash64("x").cast("decimal(38,0)"))).first()[0]
    seen = test_partitioning_does_not_matter.__dict__.setdefault("seen", total)
    assert total == seen


def test_generators(spark):
    rows = spark.range(3000).select(
        g.math_question(1, F.col("id")).alias("m"), g.instruction_sentence(1, F.col("id")).alias("i"),
        g.technical_sentence(1, F.col("id")).alias("t"),
        g.cardinal_sequence(1, F.col("id")).alias("c")).collect()
    assert all("{" not in r.m + r.i + r.t for r in rows)
    counted = 0
    for r in rows:
        ws = r.c.split()
        assert 3 <= len(ws) <= 10 and set(ws) <= set(v.CARDINALS)
        counted += ws == v.CARDINALS[:len(ws)]
    assert 0.42 < counted / 3000 < 0.54


def test_bands_corrupt_little_more_than_the_need():
    for need in (2_000, 50_000, 10_000_000):
        assert need <= g.band_end(0, need, 1.0, 10 ** 9) * 10 ** 9 / d.DRAW_SPAN < 1.3 * need
    # A second band takes what the measured rate says is missing, and never more than the rest.
    half = d.DRAW_SPAN // 2
    assert half < g.band_end(half, 1_000, 0.5, 100_000) < d.DRAW_SPAN
    assert g.band_end(half, 60_000, 1.0, 100_000) == d.DRAW_SPAN
    assert g.band_end(0, 5, 1.0, 0) == d.DRAW_SPAN


def test_pair_builders(spark):
    docs = table(spark, SF, "documents", "doc_id", "text")
    corpus = m.mine_corpus([docs])
    n = corpus.count()
    real = g.real_text_pairs(corpus, n + 50, 42)
    assert real.count() == n + 50 and real.select("pair_id").distinct().count() == n + 50
    assert real.where("trim(input) = trim(output)").count() == 0
    # A part of a round is the part with the smallest draws of all usable pairs of the round.
    pid = F.concat_ws(":", F.lit("real"), F.lit("0"), "ord")
    every = d.bind(corpus, input=c.corrupt_full(F.col("sentence"), 42, pid)).where(
        t.has_signal(F.col("input"), F.col("sentence"))).select(
        pid.alias("pair_id"), d.shuffle_key(42, pid, "round").alias("draw")).orderBy("draw", "pair_id")
    some = {r.pair_id for r in g.real_text_pairs(corpus, n // 3, 42).collect()}
    assert some == {r.pair_id for r in every.limit(n // 3).collect()}
    assert g.real_text_pairs(corpus, 0, 42).isEmpty()
    assert g.real_text_pairs(corpus.limit(0), 5, 42).isEmpty()
    card = g.cardinal_pairs(spark.range(200), 200, 43)
    assert card.count() == 200
    made = spark.createDataFrame([(i, f"We believed the weird friend number {i} until now because of it.")
                                  for i in range(40)], "ord long, sentence string")
    spell = g.spelling_pairs(made, 110, 43)
    assert {r.grp for r in spell.selectExpr("split(pair_id, ':')[1] grp").distinct().collect()} == {
        "believe", "the", "weir", "frien", "until", "because"}
    assert spell.count() == 60
    checked = g.verify_pairs(g.mix_pairs([spell, card], 1)).first()
    assert checked.n_spelling == checked.n_with_typo == 60 and checked.n_cardinal == 200


def test_quota_groups():
    assert len(m.GROUPS) == 11


def test_cardinal_pairs_of_any_ids(spark):
    wide = [0, 7, -5, 1 << 40, (1 << 40) + 7, (1 << 62), -(1 << 62), None]
    df = spark.createDataFrame([(i,) for i in wide] * 2, "id long")
    got = g.cardinal_pairs(df, 10**6, 43, attempts=3).collect()
    texts = {}
    for row in got:
        assert texts.setdefault(row["pair_id"], row["output"]) == row["output"]
    names = {r["pair_id"] for r in got}
    assert "cardinal:0" in names or "cardinal:1099511627776" in names
    assert len(names) > 12 and all(sum(r["pair_id"] == n for r in got) == 2 for n in names)
    small = g.cardinal_pairs(df, 5, 43, attempts=3).collect()
    assert len(small) == 5
    assert g.cardinal_pairs(df.limit(0), 5, 43).count() == 0


def test_a_digest_is_made_once_for_its_gates(spark):
    """The gates of the full mix read two digests; each was made for every gate, and all of it twice."""
    plan = spark.range(1).select(c.full_mix_ops(1, F.col("id")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("|full|") == 2
    drop = spark.range(1).select(c.drop_words(F.lit(TEXT), 1, F.col("id")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert drop.count("|drop|") == 1


def test_cheap_tests_in_front_lose_no_word(column):
    texts = ["Right éno no, NO _no", "Know it'sİt", "ITS xto theń", "nothing", "", None]
    assert column(lambda s: c.homophone_swaps(s, 1, F.lit(1), p=1.0), texts) == [
        "Write éno know, know _no", "No itsİt" if False else "No it'sİt", "it's xto thań", "nothing", "", None]
    assert column(lambda s: c.replace_first(s, "don't", "dont"), ["xdon't édon't don't don't", "don't1", None]) == [
        "xdon't édon't dont don't", "don't1", None]
    assert column(c.remove_punctuation, ["a.b,c?!;:é. ", ".,", None]) == ["abcé ", "", None]
