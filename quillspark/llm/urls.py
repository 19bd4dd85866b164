"""URL filter: rules by host and path, and a logistic regression for the URLs that no rule decides.

DataFrame functions only. The features are hashed character n-grams of host and path; the model
is a list of weights of fixed length, trained by full gradients on a small labelled table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from .common import stored

BUCKETS = 4096
SIZES = (3, 4)
PER_LABEL = 1000  # labelled URLs of each verdict that ``sample`` keeps at most
ROUNDS, RATE, MOMENTUM, DECAY = 30, 4.0, 0.9, 1e-4
_UNIT = 1 << 40  # gradients are summed as whole numbers of 2^-40, so their order does not matter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Model:
    """Weights of the hash buckets and the bias; a positive sum means block."""
    weights: tuple[float, ...]
    bias: float
    sizes: tuple[int, ...] = SIZES


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; longer hosts win ties."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.path))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]

    def chosen(values: list[str]) -> Column:
        return F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values)], F.lit(None).cast("string"))
    return chosen([r.host + r.path for r in ordered]), chosen([r.verdict for r in ordered])


def _grams(part: str, chars: Column, sizes: Sequence[int], buckets: int) -> Column:
    """Hash buckets of the n-grams of a marked array of characters; the part's letter is hashed too."""
    def of(size: int) -> Column:
        def gram(i: Column) -> Column:
            text = F.concat(F.lit(part), *[F.get(chars, i + k) for k in range(size)])
            return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")
        return F.when(F.size(chars) >= size, F.transform(F.sequence(F.lit(0), F.size(chars) - size), gram)).otherwise(
            F.array().cast("array<int>"))
    return F.concat(*[of(size) for size in sizes])


def _with_grams(df: DataFrame, host: str, path: str, sizes: Sequence[int], buckets: int) -> DataFrame:
    """``df`` with ``_grams``. Characters and grams are bound, so no text is split twice."""
    chars = draws.bind(df, _hc=F.split(F.concat(F.lit("^"), F.col(host), F.lit("$")), ""),
                       _pc=F.split(F.concat(F.lit("^"), F.col(path), F.lit("$")), ""))
    both = F.concat(_grams("h", F.col("_hc"), sizes, buckets), _grams("p", F.col("_pc"), sizes, buckets))
    return draws.bind(chars, _grams=both).drop("_hc", "_pc")


def _chance(grams: Column, weights: Sequence[float], bias: float) -> Column:
    """Probability of block. The weights are one constant of the plan."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + bias)))


def sample(labelled: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """At most ``per_label`` distinct rows of each verdict from a table with host, path, verdict.

    A row's hash deals it to one of ``per_label`` classes, and the smallest hash of each class stays:
    tasks hand on one number a class, however often a URL is repeated.
    """
    keyed = labelled.select("host", "path", "verdict", F.xxhash64("host", "path").alias("_h"))
    least = keyed.groupBy("verdict", F.pmod("_h", F.lit(per_label)).alias("_c")).agg(F.min("_h").alias("_h"))
    return keyed.join(least.select("verdict", "_h"), ["verdict", "_h"], "left_semi").select(
        "host", "path", "verdict").distinct()


def fit(labelled: DataFrame, buckets: int = BUCKETS, sizes: Sequence[int] = SIZES, rounds: int = ROUNDS) -> Model:
    """Train on a small table with host, path and verdict (``allow`` or ``block``; others are left out).

    Each round one task computes the errors of all rows under the weights so far and sums the
    gradient by bucket: at most ``buckets`` numbers come back. The table must be small, as ``sample`` makes
    it. Null parts count as empty. Without rows all weights stay 0; with one verdict only, that verdict wins.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("verdict").isin("allow", "block")).select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        (F.col("verdict") == "block").cast("double").alias("y"))
    rows = stored(_with_grams(rows, "host", "path", sizes, buckets).select("y", "_grams").coalesce(1), "url-train")
    n = rows.count()
    # The bias is bucket ``buckets``; its feature is 1 in every row, as the others' are 1 / sqrt(grams).
    weights, speed = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for _ in range(rounds if n else 0):
        error = _chance(F.col("_grams"), weights[:buckets], weights[buckets]) - F.col("y")
        marked = draws.bind(rows.coalesce(1), _e=error)
        share = F.col("_e") / F.sqrt(F.size("_grams"))
        each = marked.select(F.explode(F.concat(
            F.transform("_grams", lambda g: F.struct(g.alias("b"), share.alias("d"))),
            F.array(F.struct(F.lit(buckets).alias("b"), F.col("_e").alias("d"))))).alias("g"))
        slope = each.groupBy("g.b").agg(F.sum(F.round(F.col("g.d") * _UNIT).cast("long")).alias("s")).collect()
        step = {row["b"]: row["s"] / _UNIT / n for row in slope}
        for b in range(buckets + 1):
            pull = DECAY * weights[b] if b < buckets else 0.0
            speed[b] = MOMENTUM * speed[b] - RATE * (step.get(b, 0.0) + pull)
            weights[b] += speed[b]
    assert all(map(math.isfinite, weights))
    return Model(tuple(weights[:buckets]), weights[buckets], tuple(sizes))


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, url_col: str = "url",
          id_col: str = "page_id") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    ``score`` is the model's probability of block, for every URL. A rule fits its host and all subdomains
    where the path starts with the rule's; the longest one decides. Without a rule the model
    does: block above 0.5. A null URL or one without ``://`` has empty parts, fits no rule and
    is judged by them. Repeated rows are judged alike, null ids stay, further columns may have
    any name and are not read. Very long URLs are taken whole, in time that grows with their length.
    """
    rows = draws.bind(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")),
                      _host=host_of(F.col("_url")), _path=path_of(F.col("_url")))
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    rows = _with_grams(rows, "_host", "_path", model.sizes, len(model.weights))
    scored = draws.bind(rows, _p=_chance(F.col("_grams"), model.weights, model.bias))
    learned = F.when(F.col("_p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                         rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("_p").alias("score"))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """host, path and verdict of the URLs that a rule decides."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = draws.bind(pages.select(url_col), host=host, path=path)
    return parts.select("host", "path", ruled(F.col("host"), F.col("path"), rules)[1].alias("verdict")).where(
        "verdict IS NOT NULL")
