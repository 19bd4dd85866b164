"""URL filter, Merkle manifest and lexical search against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import lexical, merkle, urls
from quillspark.llm.queries import URL_RULES, op11_urls

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
SMALL = str.maketrans(urls.UPPER, urls.LOWER)


# --- URLs --------------------------------------------------------------------------------

ODD_URLS = [None, "", "no-mark/en/", "http://", "://x", "HTTP://Example.COM/en/a?q=/fr/#t", "http://example.com", "http://www.example.com/en/x",
            "http://a.www.example.com/en/", "http://notexample.com/en/1", "ftp://É.net/es/x", "http://net/fr/", "http://x.net?/es/",
            "http://x.org#://net/es/", "a://b://net/es/", "http://x.net/es\n/y", "http://www.example.com/EN/", "http://u@x.com:80/en/",
            "https://x.net/es/" + "a" * 300_000, "http://x.net/es/", "http://x.net/es/"]


def plain_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(SMALL)
    best = None
    for r in URL_RULES:
        fits = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        if fits and (best is None or len(r.host + r.path) > len(best.host + best.path)):
            best = r
    return host, path, best


def plain_score(host, path, model):
    marks, total, n = {"h": f"^{host}$", "p": f"^{path}$"}, 0.0, 0
    for part, text in marks.items():
        for size in model.sizes:
            for i in range(len(text) - size + 1):
                h = xxhash.xxh64_intdigest((part + text[i:i + size]).encode(), 42)
                total += model.weights[(h - (1 << 64) if h >> 63 else h) % len(model.weights)]
                n += 1
    return 1 / (1 + math.exp(-(total / math.sqrt(max(n, 1)) + model.bias)))


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return urls.fit(urls.sample(urls.labelled_by_rules(pages, URL_RULES)), rounds=8)


def test_urls_against_plain_python(spark, model):
    rows = [(i if i % 7 else None, u, "x", 1.0) for i, u in enumerate(ODD_URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    got = urls.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score").collect()
    want = []
    for number, url, *_ in rows:
        host, path, rule = plain_url(url)
        score = plain_score(host, path, model)
        want.append((number, host, path, rule and rule.host + rule.path,
                     rule.verdict if rule else "block" if score > 0.5 else "allow", score))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9)
    assert urls.judge(pages.where("page_id > 1000"), URL_RULES, model).count() == 0


def test_url_model_follows_its_gradient(spark):
    """One round from zero weights is the plain gradient step; the fitted model separates held-out URLs."""
    rows = [(f"spam{i}.org", f"/win/{i}", "block") for i in range(40)] + [(f"news{i}.org", f"/read/{i}", "allow") for i in range(60)]
    table = spark.createDataFrame(rows + [(None, None, "unknown")], "host string, path string, verdict string")
    one = urls.fit(table, rounds=1)
    slope = np.zeros(urls.BUCKETS)
    for host, path, verdict in rows:
        grams = [part + text[i:i + n] for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in urls.SIZES
                 for i in range(len(text) - n + 1)]
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            slope[(h - (1 << 64) if h >> 63 else h) % urls.BUCKETS] += (0.5 - (verdict == "block")) / math.sqrt(len(grams)) / len(rows)
    assert np.allclose(one.weights, -urls.RATE * slope, atol=1e-9) and one.bias == pytest.approx(-urls.RATE * (0.5 - 0.4))
    full = urls.fit(table)
    new = [(f"http://spam{i}.org/win/{i}", 1) for i in range(50, 70)] + [(f"http://news{i}.org/read/{i}", 0) for i in range(70, 90)]
    judged = urls.judge(spark.createDataFrame(new, "url string, page_id long"), [], full).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] == 1) and r["rule"] is None for r in judged)


def test_url_model_without_labels(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    model = urls.fit(none)
    assert not any(model.weights) and model.bias == 0
    one = spark.createDataFrame([("a.b", "/c", "block")] * 3, none.schema)
    page = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.judge(page, [], urls.fit(one)).first()["verdict"] == "block"
    assert urls.judge(page, [], model).first()["verdict"] == "allow"


def test_url_sample_is_bounded_and_skew_free(spark):
    rows = spark.range(20_000).selectExpr("concat('h', id % 5000) AS host", "'/' AS path",
                                          "CASE WHEN id % 5000 % 3 = 0 THEN 'block' ELSE 'allow' END AS verdict")
    hot = rows.unionAll(spark.range(10_000).selectExpr("'h0' AS host", "'/' AS path", "'block' AS verdict"))
    kept = urls.sample(hot, 100)
    counts = {r["verdict"]: r["count"] for r in kept.groupBy("verdict").count().collect()}
    assert counts == {"block": 100, "allow": 100} and kept.distinct().count() == 200
    assert sorted(kept.collect()) == sorted(urls.sample(hot.repartition(7), 100).collect())


def test_url_query_runs_without_python_workers(spark):
    plan = op11_urls(spark, SF)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|ExternalRDD", plan)


# --- Merkle ------------------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    steps, level = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for j in range(0, len(level), 8):
            run = level[j:j + 8]
            names = [n for n, _ in run]
            for k, (_, members) in enumerate(run):
                for m in members:
                    steps[m].append(("".join(names[:k]), "".join(names[k + 1:])))
            above.append((h("".join(names)), [m for _, members in run for m in members]))
        level = above
    return level[0][0], steps


def plain_manifest(rows, change):
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: plain_tree([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in langs}
    root, upper = plain_tree([built[g][0] for g in langs])
    out = []
    for g, above in zip(langs, upper):
        for x, steps in zip(sorted(trees[g], key=lambda x: x[:3]), built[g][1]):
            node = leaf(change(x[3]))
            for left, right in steps + above:
                node = h(left + node + right)
            out.append((x[3][0], x[2], built[g][0], root, h("".join(a + b for a, b in steps + above)), node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_against_plain_trees(spark, levels):
    """Blocks of 8, 64 and 4,096 leaves; nulls, ties, repeated rows, a tree of one leaf, 9 trees."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS)
    odd = [(1, None, None, None, None), (None, "a", "xx", 3, "Abc"), (5, "a", "en", 0, ""), (5, "a", "en", 0, ""), (5, "b", "en", 1, "Ü"),
           (9, "ß", "日本", 2, "É A " * 50_000)] + [(i, "s", f"l{i}", 1, "T") for i in range(40, 43)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema)).withColumn("node", F.lit("clash")).withColumn("at", F.lit(3)).repartition(5)

    def change(row):
        hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        return (*row[:4], row[4].translate(SMALL)) if hit else row

    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(docs, tampered={"text": F.translate("text", urls.UPPER, urls.LOWER)}, where=third, levels=levels)
    want = plain_manifest([tuple(r)[:5] for r in docs.collect()], change)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert not got.where("verified").isEmpty() and not got.where("NOT verified").isEmpty()


def test_manifest_without_tampering_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS)
    got = merkle.manifest(docs.limit(9), levels=1)
    assert got.where("verified").count() == 9
    none = merkle.manifest(docs.where("doc_id < 0"))
    assert none.count() == 0 and none.columns == got.columns
    one = merkle.manifest(docs.limit(1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h("")


def test_frontier_appends_like_plain_trees():
    for size in (1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 700):
        nodes = [h(str(i)) for i in range(size)]
        tree = merkle.Frontier(size, None)
        for i, node in enumerate(nodes):
            tree.append(node, i)
        assert (tree.close(), tree.paths) == plain_tree(nodes)


# --- lexical search ----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_rank(docs, items, k):
    bags = [TERM.findall((t or "").translate(SMALL)) for _, t in docs]
    n_docs, n_terms = sum(bool(b) for b in bags), sum(map(len, bags))
    df = {}
    for bag in bags:
        for term in set(bag):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        found = []
        for (doc, _), bag in zip(docs, bags):
            m = 75 + 25 * len(bag) * n_docs // max(n_terms, 1)
            score = 0
            for term in TERM.findall((text or "").translate(SMALL)):
                tf = bag.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["né", "漢字", "ÀB", "x-y", "U.S."]
    return [" ".join(vocabulary[min(int(rng.zipf(1.3)) - 1, 304)] for _ in range(rng.integers(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_rank_against_brute_force(spark, block_bytes):
    """Nulls, ties, repeated documents and items, one long text, clashing names, items in several blocks."""
    docs = [(i, t) for i, t in enumerate(random_texts(700, 1))] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w1 w2"), (800, None), (801, ""), (802, "W7 " * 50_000)]
    items = [(i, t) for i, t in enumerate(random_texts(23, 2))] + [(5, "w1 w2 W2"), (5, "w1 w2 W2"), (None, "w3"), (60, None), (61, " .,"), (62, "zzz")]
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, score string, item int").repartition(5)
    asked = spark.createDataFrame([(*i, 0, "r") for i in items], "item_id long, text string, rank int, share string")
    got = [tuple(r) for r in lexical.rank(frame, asked, k=7, block_bytes=block_bytes).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_rank(docs, items, 7)))


def test_rank_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0


def test_dual_tree_prunes_and_stays_exact():
    """Two families of texts: pairs across them are left out as whole nodes, the lists stay exact."""
    rng = np.random.default_rng(5)
    rows, n_terms, weights = 2000, 400, np.arange(1, 401, dtype=np.int64)
    family = rng.integers(0, 2, rows)
    row = np.repeat(np.arange(rows), 12)
    term = rng.integers(0, 200, rows * 12) + 200 * family[row]
    value = rng.integers(1, 1000, rows * 12)
    row, term, value = lexical._maxima(row, term, value)
    bags = [{int(t): 1 for t in rng.integers(0, 200, 8) + 200 * (i % 2)} for i in range(30)]
    tree, order = lexical._item_tree(bags, weights)
    items = lexical.Items(tree, n_terms, 5)
    docs, seat = lexical.doc_tree(row, term, value, rows, weights)
    lexical.search(items, docs, seat, np.zeros(rows, bool))
    dense = np.zeros((rows, n_terms), np.int64)
    dense[row, term] = value
    for at, number in enumerate(order):
        w = np.zeros(n_terms, np.int64)
        w[list(bags[number])] = weights[list(bags[number])]
        score = dense @ w
        best = sorted(((-s, i) for i, s in enumerate(score) if s))[:5]
        mine = items.item == at
        assert [(-s, d) for s, d in zip(items.score[mine], items.doc[mine])] == best
    assert items.scored < 0.6 * rows * len(bags)
