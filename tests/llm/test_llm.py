"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, exact, fingerprint, jaccard, langid, masked_lm, mixing, quality, substring, warc
from quillspark.llm.common import documents, fold, smallest_linked
from quillspark.llm.queries import QUERIES

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FILE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, "en", "s1"), (2, "", "en", None), (3, "  \n\t", None, "s1"), (4, LONG, "en", "s2"), (5, "Hello wide world", "de", "s1"),
       (6, "hello Wide world", "de", "s1"), (6, "hello Wide world", "de", "s1"), (None, "no id here", "en", "s2"), (8, "né <|endoftext|> 漢字 \U0001f600", "en", "s3"),
       (9, LONG, None, "s2"), (10, "123 456 ...", "en", "s1")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names used inside."""
    rows = [(*r, 1, "x", 2.5, "y") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", kept int, id string, score double, fingerprint string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id > 1000")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_against_duckdb(spark, name):
    fn, sql = QUERIES[name]
    status, _ = compare(spark, connect(BIG), BIG, fn, sql)
    assert status == "ok", status


def test_pieces_of_the_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


OPERATORS = {
    "quality": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "mixing": mixing.mix, "bpe": lambda d: bpe.decode(bpe.encode(d, FILE), FILE), "exact": exact.exact_dedup,
    "fingerprint": fingerprint.with_edited, "prints": fingerprint.near_documents,
    "language": lambda d: langid.predict(d, langid.fit(d)), "jaccard": jaccard.jaccard_components,
    "substring": substring.remove_repeats, "lm": lambda d: masked_lm.score(d, masked_lm.fit(d)),
    "warc": lambda d: warc.capture_history(d, id_col="doc_id", url_col="source", html_col="text"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(odd, none, name):
    assert OPERATORS[name](odd).count() == len(ODD)
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    out = stage(spark, docs, SF)
    assert name == "bpe" or out.columns == docs.columns
    assert out.count() > 0 and stage(spark, none.withColumn("n_chars", F.lit(0).cast("long")), SF).count() == 0


def test_quality_on_held_out_labels(spark):
    docs = documents(spark, "/root/testdata/sf0.1", "doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where(fold("doc_id") != 1))
    got = quality.score(docs, model).join(labels, "doc_id").where(fold("doc_id") == 1).toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean(good.values[:, None] > bad.values[None, :]) > 0.97 and (good < 0.5).mean() < 0.03


def test_language_on_held_out_documents(spark):
    docs = documents(spark, BIG, "doc_id", "text", "lang")
    got = langid.predict(docs, langid.fit(docs.where(fold("doc_id") != 1))).join(docs, "doc_id").where(fold("doc_id") == 1)
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_gru_gradient():
    net = langid.Network(["a", "b"], langid.Settings(hidden=3))
    for gru in (net.ahead, net.behind):
        gru.p = {k: v.astype(np.float64) for k, v in gru.p.items()}
    data, push = np.random.default_rng(0).integers(0, 256, (5, 4)), np.random.default_rng(1).normal(size=(5, 4, 3))
    gru = net.ahead
    _, trace = gru.run(data, keep=True)
    grads = gru.back(data, trace, push)
    for k, at in (("u", (1, 2)), ("u", (0, 7)), ("x", (int(data[2, 1]), 4))):
        loss = []
        for step in (1e-3, -1e-3):
            gru.p[k][at] += step
            loss.append((gru.run(data)[0] * push).sum())
            gru.p[k][at] -= step
        assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=2e-3)


def test_mix_targets_and_reruns(odd):
    rows = mixing.mix(odd).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    again = mixing.mix(odd.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, rows[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_apportionment_by_handing_out_seats(spark):
    rng = random.Random(3)
    votes = [rng.randint(0, 60) for _ in range(12)]
    rows = spark.createDataFrame([(i, v, 37, 1000) for i, v in enumerate(votes)], "tie long, v long, seats long, cap long")
    got = {r["tie"]: r["out"] for r in mixing.apportion(rows, [], "v", "seats", "cap", "tie", "out").collect()}
    want = dict.fromkeys(range(12), 0)
    for _ in range(37):
        want[max(want, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == want


def test_bpe_as_the_library(spark):
    lib, rng = Tokenizer.from_file(FILE), random.Random(1)
    texts = [t or "" for _, t, _, _ in ODD] + ["".join(rng.choice("abcehint ABC'019 \n\t.,!?éß漢\U0001F600\x1c\x85") for _ in range(300)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(docs, FILE), FILE).collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["text"] == texts[r["doc_id"]]


def test_bpe_looks_up_a_step_once():
    class Asked(dict):
        n = 0

        def get(self, key, default=None):
            self.n += 1
            return super().get(key, default)

    vocab = bpe.Vocabulary(FILE)
    asked = vocab.rank_of = vocab.steps.rank_of = Asked(vocab.rank_of)
    trie = bpe.Trie(vocab, limit=0)
    first = dict(trie.encode({"therebleing", " thatandou"}))
    n = asked.n
    assert n > 0 and trie.encode({"therebleing", " thatandou"}).items() >= first.items() and asked.n == n


def test_exact_keeps_the_largest(odd):
    rows = exact.exact_dedup(odd).toPandas()
    assert set(rows[rows.group_size == 2].keep_id.dropna()) == {2, 6, 9} or set(rows[rows.kept].doc_id.dropna()) >= {2, 6, 9}
    assert exact.drop_exact_duplicates(odd).count() == len({t or "" for _, t, _, _ in ODD})


def test_fingerprints_tell_edits_from_strangers(spark):
    docs = documents(spark, BIG, "doc_id", "text")
    got = fingerprint.with_edited(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        q = len(texts[i]) // 4
        assert rows[i]["edited"] == texts[i][:len(texts[i]) - q] + texts[j][:q]
        assert rows[i]["next_fingerprint"] == rows[j]["fingerprint"]
    near = got.select(F.avg(fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))),
                      F.avg(fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")))).first()
    assert near[0] > 0.7 and near[1] < 0.1
    assert fingerprint.fingerprints(["abc" * 50] * 20)[3] == fingerprint.fingerprints(["abc" * 50])[0]


def test_near_documents_of_a_template_family(spark, monkeypatch):
    """A third of the rows share a template; pairs of near copies inside it are found all the same."""
    rng = random.Random(8)
    digits = "0123456789abcdef"
    template = rng.choices(digits, k=128)

    def changed(base, share):
        return [rng.choice(digits) if rng.random() < share else c for c in base]
    members = [changed(template, 0.25) for _ in range(1000)]
    copies = [changed(m, 0.17) for m in members[-300:]]
    trios = []  # b and c agree in band 0 only, where the smaller a, unlike both, stands before them
    for _ in range(10):
        a, b = rng.choices(digits, k=128), rng.choices(digits, k=128)
        a[0::16] = b[0::16]
        c = [digits[(digits.index(x) + 1) % 16] if 0 < k < 16 else x for k, x in enumerate(b)]
        trios += [a, b, c]
    prints = ["".join(p) for p in trios + members + copies + [rng.choices(digits, k=128) for _ in range(2600)]]
    near = fingerprint.alike(prints, 0.8)
    pairs = [(i, j) for i, j in zip(*np.nonzero(near)) if i < j]
    share = (np.array([list(p) for p in prints[:40]])[:, None] == np.array([list(p) for p in prints[:40]])).mean(2)
    assert (near[:40, :40] == (np.maximum(0, (share - 1 / 16) * 16 / 15) >= 0.8)).all()
    monkeypatch.setattr(fingerprint, "fingerprint", lambda docs, id_col, text_col: docs.select(
        id_col, F.length(text_col).cast("long").alias("n_chars"), F.col(text_col).alias("fingerprint")))
    docs = spark.createDataFrame(list(enumerate(prints)), "doc_id long, text string").repartition(5)
    found = []
    for rows in (512, 3):  # whole keys, and keys cut in blocks
        monkeypatch.setattr(fingerprint, "BLOCK_ROWS", rows)
        got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_documents(docs).collect()}
        found.append(got)
    recall = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    assert found[0] == found[1] and len(pairs) >= 200 and recall > 0.97
    assert all(got[i] == i and got[i + 1] == got[i + 2] == i + 1 for i in range(0, 30, 3))


def test_loser_tree_and_passes(spark):
    runs = [sorted(random.Random(i).choices(range(50), k=i)) for i in range(9)]
    assert list(warc.LoserTree([iter([(x,) for x in r]) for r in runs])) == sorted((x,) for r in runs for x in r)
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(7)
    archives = warc.write_archives(pages)
    merged = warc.merge_index(spark, archives, fan_in=2, range_rows=20).orderBy("range_no", "seq").toPandas()
    keys = list(zip(merged.url_key, merged.captured, merged.page))
    assert keys == sorted(keys) and len(keys) == pages.count()
    back = {r["page"]: r["payload"] for r in warc.read_archives(spark, archives, payload=True).collect()}
    assert all(back[str(r["page_id"])].decode() == r["html"] for r in pages.collect())


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("num,size", [(90, 3), (80, 5)])
def test_jaccard_against_all_pairs(spark, num, size, monkeypatch):
    rng = random.Random(num)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([2, 9, 14, 25, 60, 120]))] for _ in range(40)]
    texts = []
    for w in base:
        for _ in range(rng.randint(1, 9)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice("xyz")
            texts.append(" ".join(v))
    sets, root = [shingles(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for rows in (512, 3):  # whole groups, and groups cut in blocks
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, num=num, size=size).collect()}
        assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("bits", [64, 12, 3])
def test_substring_against_brute_force(spark, monkeypatch, bits):
    """Also with hashes of so few bits that different windows share them all the time."""
    whole = substring.grams
    monkeypatch.setattr(substring, "grams", lambda h, n: whole(h, n) & np.uint64((1 << bits) - 1))
    second = []
    again = substring.repeated_by_words
    monkeypatch.setattr(substring, "repeated_by_words", lambda *args: second.append(1) or again(*args))
    rng = random.Random(5)
    shared = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(13, 60))] for _ in range(6)]
    texts = []
    for i in range(120):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(w + rng.choice(shared) * rng.randint(0, 2) + w[:20]))
    docs = spark.createDataFrame([(i * 7 % 120, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    first, want = {}, {}
    for i, t in sorted((i * 7 % 120, t) for i, t in enumerate(texts)):
        w = t.split()
        keep = [True] * len(w)
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a:a + 13]), i) < i:
                keep[a:a + 13] = [False] * 13
        want[i] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep) if y))
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500
    assert bool(second) == (bits < 64)  # no second pass over the texts unless hashes clash


def test_lm_beats_word_frequencies(spark):
    docs = documents(spark, BIG, "doc_id", "text")
    model = masked_lm.fit(docs, settings=masked_lm.Settings(batch=512, block=64))
    got = masked_lm.score(docs, model).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    n = np.array([r["n"] for r in model.counts.collect()])
    assert got > (n * np.log((n + 0.5) / model.total)).sum() / n.sum() + 0.1


def test_lm_gains_are_near_probabilities(spark):
    """Summed over all words of a small vocabulary, the probabilities at most places are near one."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    follow = {w: rng.sample(words, 3) for w in words}
    texts = []
    for _ in range(400):
        t = [rng.choice(words)]
        while len(t) < 100:
            t.append(rng.choice(follow[t[-1]]))
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    s = masked_lm.Settings(own=20, hashed=64, rounds=2, batch=512, block=32)
    model = masked_lm.fit(docs, settings=s)
    net, n = model.network, {r["h"] % (1 << 64): r["n"] for r in model.counts.collect()}
    h = masked_lm.word_hashes([w.encode() for w in words])
    rows, _ = net.entries(h)
    share = np.log([(n[x] + s.smooth) / model.total for x in h.tolist()])
    place = {w: i for i, w in enumerate(words)}
    sums, right = [], []
    for t in texts[:20]:
        ids = rows[[place[w] for w in t.split()]]
        around = net.contexts(np.array([0, len(ids)]), ids)
        for i in range(5, 95, 9):
            p = np.exp(share + net.gains(np.repeat(around[i:i + 1], len(rows), axis=0), rows))
            sums.append(p.sum())
            right.append(p[place[t.split()[i]]])
    assert 0.7 < np.median(sums) < 1.4 and np.mean(right) > 0.1


def test_lm_gradients():
    s = masked_lm.Settings(own=6, hashed=5, width=3, hidden=4, noise=2)
    rng = np.random.default_rng(2)
    net = masked_lm.Network(s, np.zeros(0, np.uint64))
    net.near, net.out = rng.normal(0, 0.5, net.near.shape), rng.normal(0, 0.5, net.out.shape)
    net.layer = rng.normal(0, 0.5, net.layer.shape)
    around, ids, noise = rng.integers(0, s.rows + 1, (8, 4)), rng.integers(0, s.rows, 8), rng.integers(0, s.rows, (2, 2))
    layer, near, out = net.gradients(around, ids, noise)
    whole = [np.zeros_like(net.near), np.zeros_like(net.out)]
    for table, (rows, grads) in zip(whole, (near, out)):
        rows, grads = masked_lm.summed(rows, grads)
        table[rows] += grads
    for values, grads in ((net.near, whole[0]), (net.out, whole[1]), (net.layer, layer)):
        for at in zip(*(rng.integers(0, n, 40) for n in values.shape)):
            kept, step = values[at], 1e-5
            values[at] = kept + step
            up = net.loss(around, ids, noise)
            values[at] = kept - step
            down = net.loss(around, ids, noise)
            values[at] = kept
            assert grads[at] == pytest.approx((up - down) / 2 / step, abs=1e-4)


def plain_log_prob(text, model, n):
    """The score of a text word by word."""
    net, s = model.network, model.network.s
    known = {h: i for i, h in enumerate(net.known.tolist())}
    hashes = [masked_lm.word_hashes([w.encode()]).item() for w in WORD.findall(text or "")]
    rows = [known[h] if h in known else s.own + h % s.hashed for h in hashes]
    total = 0.0
    for i, (h, row) in enumerate(zip(hashes, rows)):
        near = [rows[i + k] if 0 <= i + k < len(rows) else s.rows for k in range(-s.window, s.window + 1) if k]
        x = np.concatenate([net.near[r] for r in near]).astype(float)
        hidden = np.tanh(x @ net.layer[:-1] + net.layer[-1])
        out = net.out[row].astype(float)
        total += hidden @ out[:-1] + out[-1] + np.log((n.get(h, 0) + s.smooth) / model.total)
    return len(rows), total


def test_lm_scores_against_plain_python(spark, odd, none, monkeypatch):
    monkeypatch.setattr(masked_lm, "HELD", 3000)  # several batches a task
    docs = documents(spark, BIG, "doc_id", "text").where("doc_id < 300")
    model = masked_lm.fit(docs, settings=masked_lm.Settings(own=500, hashed=300))
    n = {r["h"] % (1 << 64): r["n"] for r in model.counts.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(4)
    more = [(-1, None), (-2, ""), (-3, "zqx " * 40), (-4, " ".join("".join(rng.choices("qxzjkv", k=9)) for _ in range(200))), rows[5], (None, rows[6][1])]
    asked = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = masked_lm.score(asked, model).collect()
    assert len(got) == len(rows) + len(more) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    texts = dict(rows + more[:4] + more[5:])
    for r in got:
        words, want = plain_log_prob(texts[r["doc_id"]], model, n)
        assert r["n_words"] == words and r["log_prob"] == pytest.approx(want, rel=1e-4, abs=1e-2)
        assert r["mean_log_prob"] == (pytest.approx(want / words, rel=1e-4) if words else None)
    mean = {r["doc_id"]: r["mean_log_prob"] for r in got}
    assert mean[-4] < min(v for i, v in mean.items() if v is not None and i not in (-3, -4))
    assert masked_lm.score(odd, model).count() == len(ODD)
    assert masked_lm.score(none, masked_lm.fit(none)).count() == 0


def test_lm_scores_a_rare_word_by_its_neighbours(spark):
    """The same unseen word between other neighbours has another score; the neighbours' order counts too."""
    docs = documents(spark, SF, "doc_id", "text")
    model = masked_lm.fit(docs, settings=masked_lm.Settings(own=50, batch=256, block=32))
    common = [w for w, _ in Counter(w for r in docs.collect() for w in WORD.findall(r["text"] or "")).most_common(4)]
    row = lambda words: masked_lm.Network.entries(model.network, masked_lm.word_hashes([w.encode() for w in words]))
    rows, hit = row(["qqzzunseen", *common])
    assert not hit[0] and hit[1:].all()
    gains = [model.network.gains(np.array([[rows[a], rows[b], rows[b], rows[a]]]), rows[:1])[0] for a, b in ((1, 2), (2, 1), (3, 4))]
    assert len({round(float(g), 6) for g in gains}) == 3


def test_linked_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 700), (600, 700)], "a long, b long")
    got = {r["id"]: r["root"] for r in smallest_linked(links, "test").collect()}
    assert {got[i] for i in range(201)} == {0} and got[500] == 500 and got[700] == 500 and got[600] == 500


def test_digest_columns(spark):
    row = QUERIES["op3_bpe"][0](spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first()["text"]
    ids = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_keys_lose_no_linked_pair():
    rng = np.random.default_rng(2)
    for num, n in [(num, n) for num in (80, 90) for n in (1, 2, 5, 9, 30, 150, 700)]:
        scheme, base = jaccard.Scheme(num, 100), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = [np.unique(base)]
        for _ in range(25):
            cut = rng.permutation(n)[:rng.integers(0, n * (100 - num) // 200 + 2)]
            more = rng.integers(0, 1 << 63, rng.integers(0, len(cut) + 1), dtype=np.uint64)
            sets.append(np.unique(np.r_[np.delete(base, cut), more]))
        keyed = [jaccard.keys_of(t, scheme) for t in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    key, chain = (np.concatenate([keyed[i][x], keyed[j][x]]) for x in (0, 1))
                    ids = np.repeat([i, j], [len(keyed[i][0]), len(keyed[j][0])])
                    assert jaccard.meet(key, chain, ids).tolist() == [[i, j]]


def test_mixed_words_take_time_in_proportion_to_the_text(spark):
    """The text is split outside the function over its runs of blocks, so once and not per run."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40_000)), "a"), (2, "x y z", "b")],
                                 "doc_id long, text string, source string")
    mixed = mixing.take_words(docs)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "split(" in line]
    assert lines and all("Generate inline" in line and "lambda" not in line.split("split(")[0].rsplit("_words", 1)[-1] for line in lines)
    start = time.time()
    words = mixed.where("doc_id = 1").select(F.explode(F.split("text", " "))).count()
    assert words > 10_000 and time.time() - start < 30
