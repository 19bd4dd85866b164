from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import examples as x
from quillspark.plans.stand_in import length_tokenizer

PAIRS = [(str(i), f"the cat {i % 3} sat", f"The cat {'very ' * (i % 5)}sat.") for i in range(30)]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id string, input string, output string").repartition(4)


def vocab(spark):
    both = pairs(spark).select(F.explode(F.array(
        F.concat(F.lit("Input: "), "input", F.lit("\nOutput: ")), "output")).alias("text"))
    return x.vocabulary(both)


def expected_vocab():
    count = Counter()
    for _, a, b in PAIRS:
        count.update(f"Input: {a}\nOutput: ".split() + b.split())
    order = sorted(count, key=lambda w: (-count[w], w))
    return {w: i + x.FIRST_ID for i, w in enumerate(order)}


def test_vocabulary_and_examples(spark, monkeypatch):
    want = expected_vocab()
    v = vocab(spark)
    assert {r.token: r.token_id for r in v.collect()} == want
    monkeypatch.setattr(x, "HEAD_TOKENS", 3)
    rows = {r.pair_id: r for r in x.examples(x.encode(pairs(spark), v), max_len=12).collect()}
    for pid, a, b in PAIRS:
        p = [want[w] for w in f"Input: {a}\nOutput: ".split()]
        o = [want[w] for w in b.split()] + [x.EOS_ID]
        assert rows[pid].input_ids == (p + o)[:12]
        assert rows[pid].labels == ([x.IGNORE] * len(p) + o)[:12]
        assert rows[pid].attention_mask == [1] * len((p + o)[:12])


def test_padded_batches(spark):
    made = x.examples(x.encode_with(pairs(spark), length_tokenizer))
    got = x.padded_batches(made, 1, shards=3).collect()
    assert sum(len(r.input_ids) for r in got) == len(PAIRS)
    assert sum(len(r.input_ids) < x.BATCH for r in got) <= 3
    for r in got:
        assert {len(row) for m in (r.input_ids, r.attention_mask, r.labels) for row in m} == {r.width}
        for ids, mask, lab in zip(r.input_ids, r.attention_mask, r.labels):
            n = sum(mask)
            assert ids[n:] == [x.PAD_ID] * (r.width - n) and lab[n:] == [x.IGNORE] * (r.width - n)


def test_null_texts_and_repeated_ids_are_encoded_each(spark):
    rows = [("1", None, "the cat"), ("2", "the cat", None), ("3", "the cat", "sat."), ("3", "the cat", "sat."), (None, None, None)]
    odd = spark.createDataFrame(rows, "pair_id string, input string, output string").repartition(3)
    got = sorted(((r["pair_id"] or "", len(r["prompt_ids"]), len(r["completion_ids"])) for r in x.encode(odd, vocab(spark)).collect()))
    assert got == [("", 2, 0), ("1", 2, 2), ("2", 4, 0), ("3", 4, 1), ("3", 4, 1)]
