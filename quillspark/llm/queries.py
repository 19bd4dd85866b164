"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..sources.tables import table
from . import (bpe, exact, fingerprint, jaccard, langid, lexical, masked_lm, merkle, mixing, quality, substring, urls,
               warc)
from .common import documents, fold


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id") != 1)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.decode(bpe.encode(documents(spark, sf_dir, "doc_id", "text"), file), file)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                         F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir, "doc_id", "text"), hash_all=True)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = fingerprint.with_edited(documents(spark, sf_dir, "doc_id", "text"))
    own = F.col("fingerprint")
    return marks.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", fingerprint.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    network = langid.fit(docs.where(fold("doc_id") != 1))
    return langid.predict(docs, network).select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html", spread="page_id")
    kind = pages.schema["page_id"].dataType
    return warc.capture_history(pages).select(
        F.when(F.col("page") != "null", F.col("page")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir, "doc_id", "text"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return masked_lm.score(docs, masked_lm.fit(docs))


# The rules that the URL query applies.
URL_RULES = (urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"),
             urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"),
             urls.Rule("block", "net", "/fr/"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from URLs that a rule decides and judges those that none does."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    model = urls.fit(urls.sample(urls.labelled_by_rules(pages, URL_RULES)))
    return urls.judge(pages, URL_RULES, model)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *merkle.FIELDS)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, tampered={"text": F.translate("text", urls.UPPER, urls.LOWER)}, where=third)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_SEATS = """
{t}_a AS (SELECT *, sum({votes}) OVER ({part}) AS tot, count(*) OVER ({part}) AS cnt FROM {src}),
{t}_b AS (SELECT *, least(CASE WHEN tot > 0 THEN floor({votes} * {seats} / tot + 0.5) ELSE 0 END, {cap})::BIGINT AS s0 FROM {t}_a),
{t}_c AS (SELECT *, ({seats} - sum(s0) OVER ({part}))::BIGINT AS d FROM {t}_b),
{t}_d AS (SELECT *, unnest(range(1, (CASE WHEN tot > 0 THEN ceil((abs(d) + cnt) * {votes} / tot) + 1 ELSE 1 END)::BIGINT + 1)) AS j
    FROM {t}_c WHERE d <> 0),
{t}_e AS (SELECT *, CASE WHEN d > 0 THEN s0 + j ELSE s0 - j + 1 END AS k FROM {t}_d),
{t}_f AS (SELECT *, {votes} / (2 * k - 1) AS q FROM {t}_e WHERE k >= 1 AND k <= {cap}),
{t}_g AS (SELECT *, row_number() OVER ({part} ORDER BY CASE WHEN d > 0 THEN -q ELSE q END,
    CASE WHEN d > 0 THEN {tie} ELSE -{tie} END, j) AS r FROM {t}_f),
{t}_h AS (SELECT key, {tie}, count(*) AS won FROM {t}_g WHERE r <= abs(d) GROUP BY ALL),
{t} AS (SELECT c.* EXCLUDE (tot, cnt, s0, d), (s0 + CASE WHEN d > 0 THEN 1 ELSE -1 END * coalesce(won, 0))::BIGINT AS {out}
    FROM {t}_c c LEFT JOIN {t}_h h USING (key, {tie}))"""

_MIX_SQL = r"""WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS o, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key FROM documents),
d AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT % 256 AS shard FROM docs),
cell AS (SELECT key, source, shard, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
src AS (SELECT key, source, sum(words)::BIGINT AS source_size FROM cell GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
level AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM weighed),
aimed AS (SELECT key, source, source_size, rank, least(cap, max(l) OVER () * w) AS target FROM level),
wished AS (SELECT *, floor(sum(target) OVER () / 16 + 0.5)::BIGINT AS seats, (2 * ceil(source_size / 16))::BIGINT AS most FROM aimed),
""" + _SEATS.format(t="seated", src="wished", votes="target", seats="seats", cap="most", tie="rank", out="quota", part="").lstrip("\n") + r""",
based AS (SELECT *, (sum(words) OVER (PARTITION BY key ORDER BY shard) - words)::BIGINT AS base FROM cell),
cut AS (SELECT b.key, shard, base, ceil(base / 16)::BIGINT AS first, (ceil((base + words) / 16) - ceil(base / 16))::BIGINT AS blocks,
    s.source_size, s.target, s.quota FROM based b JOIN seated s ON b.key = s.key),
capped AS (SELECT *, 2 * blocks AS most FROM cut),
""" + _SEATS.format(t="given", src="capped", votes="blocks", seats="quota", cap="most", tie="shard", out="own", part="PARTITION BY key").lstrip("\n") + r""",
turned AS (SELECT *, ('0x' || substr(md5('mix|' || key || '|' || shard), 1, 8))::BIGINT AS turn,
    own // greatest(blocks, 1) AS passes, own % greatest(blocks, 1) AS rest FROM given),
ended AS (SELECT *, CASE WHEN blocks > 0 THEN passes + ((((blocks - 1) * 1000000007 + turn) % greatest(blocks, 1)) < rest)::INT END AS lst FROM turned),
plan AS (SELECT *, coalesce(last_value(lst IGNORE NULLS) OVER (PARTITION BY key ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS enter FROM ended),
placed AS (SELECT d.doc_id, size, source_size, target, first, blocks, passes, rest, turn, enter,
    (base + sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS to_w
    FROM d JOIN plan p ON d.key = p.key AND d.shard = p.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range((to_w - size) // 16, (to_w - 1) // 16 + 1),
    lambda k: (least((k + 1) * 16, to_w) - greatest(k * 16, to_w - size)) * CASE WHEN k < first THEN enter
        ELSE passes + CASE WHEN ((k - first) * 1000000007 + turn) % greatest(blocks, 1) < rest THEN 1 ELSE 0 END END)) END::BIGINT AS taken FROM placed"""

_EXACT_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN head <> page_id THEN head END AS refers_to FROM q"""

_SUBSTRING_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, p + o AS i FROM g JOIN f USING (g) CROSS JOIN range(13) AS t(o) WHERE f < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
k AS (SELECT t.doc_id, count(*) AS n, count(c.i) AS r, string_agg(x, ' ' ORDER BY t.i) FILTER (c.i IS NULL) AS kept
    FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

_RAISED = """{t} AS (SELECT 0 AS lvl, k, pos, h, count(*) OVER (PARTITION BY k) AS cnt FROM {src}
    UNION ALL SELECT lvl + 1, k, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(cnt) + 7) // 8 FROM {t}
    WHERE cnt > 1 GROUP BY lvl, k, pos // 8),
{t}_s AS (SELECT lvl, k, pos, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {t} WHERE cnt > 1 WINDOW b AS (PARTITION BY lvl, k, pos // 8 ORDER BY pos))"""

_CODED = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_SMALL = f"translate(text, '{urls.UPPER}', '{urls.LOWER}')"
_CRC = ("xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
_LEAF = "sha256(" + " || ".join(_CODED.format(c=c) for c in merkle.FIELDS) + ")"
_BAD = "sha256(" + " || ".join(_CODED.format(c=_SMALL if c == "text" else c) for c in merkle.FIELDS) + ")"

_MERKLE_SQL = f"""WITH RECURSIVE leaf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS k,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {_LEAF} AS h,
    CASE WHEN {_CRC} % 3 = 0 THEN {_BAD} ELSE {_LEAF} END AS shown FROM documents),
{_RAISED.format(t="t", src="leaf")},
sub AS (SELECT k AS tree, '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, h FROM t WHERE cnt = 1),
{_RAISED.format(t="u", src="sub")},
steps AS (SELECT doc_id, lvl, l, r FROM leaf JOIN t_s ON leaf.k = t_s.k AND t_s.pos = leaf.pos // (8 ** lvl)::BIGINT
    UNION ALL SELECT doc_id, 1000 + lvl, l, r FROM leaf JOIN sub ON leaf.k = sub.tree JOIN u_s ON u_s.pos = sub.pos // (8 ** lvl)::BIGINT),
paths AS (SELECT doc_id, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY doc_id),
done AS (SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, (SELECT h FROM u WHERE cnt = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([shown] || coalesce(path, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
    FROM leaf JOIN sub ON leaf.k = sub.tree LEFT JOIN paths ON leaf.doc_id = paths.doc_id)
SELECT *, folded_root = root AS verified FROM done"""

_TERMS = (f"unnest(regexp_extract_all({_SMALL}, " + r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term")
_LEXICAL_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
i AS (SELECT item_id, {_TERMS} FROM benchmark),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""

QUERIES = {
    "op1_quality": (op1_quality, None), "op2_mixing": (op2_mixing, _MIX_SQL), "op3_bpe": (op3_bpe, None),
    "op4_exact_dedup": (op4_exact_dedup, _EXACT_SQL), "op5_fingerprint": (op5_fingerprint, None),
    "op6_language": (op6_language, None), "op7_warc": (op7_warc, _WARC_SQL), "op8_jaccard": (op8_jaccard, None),
    "op9_substring": (op9_substring, _SUBSTRING_SQL), "op10_masked_lm": (op10_masked_lm, None),
    "op11_urls": (op11_urls, None), "op12_merkle": (op12_merkle, _MERKLE_SQL), "op13_lexical": (op13_lexical, _LEXICAL_SQL),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}
