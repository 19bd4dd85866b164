"""Heuristics for "the model answered instead of cleaning"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import bind, let
from .text import strip, word_count, words
from .vocab import ANSWER_PHRASES, QUESTION_TELLS

_EDGE = r"""[.,!?;:'"]+"""


def word_set(t: Column) -> Column:
    """Distinct lower-case tokens without edge punctuation; a pure-punctuation token
    contributes the empty string."""
    return F.array_distinct(F.transform(
        words(F.lower(t)), lambda w: F.regexp_replace(w, rf"^{_EDGE}|{_EDGE}\z", "")))


def overlap(in_words: Column, out_words: Column) -> Column:
    shared = F.size(F.array_intersect(in_words, out_words))
    return shared / F.greatest(F.lit(1), F.size(in_words)).cast("double")


def first_hit(text_lower: Column, needles: list[str]) -> Column:
    """First needle, in list order, contained in the text; NULL if none is."""
    out = F.lit(None).cast("string")
    for needle in reversed(needles):
        out = F.when(F.contains(text_lower, F.lit(needle)), F.lit(needle)).otherwise(out)
    return out


def percent(x: Column) -> Column:
    """Whole-percent text, ties to even as in ``{:.0%}``."""
    return F.concat(F.bround(F.lit(100) * x, 0).cast("int").cast("string"), F.lit("%"))


def with_verdict(df: DataFrame, category: str = "category", text: str = "text",
                 output: str = "output") -> DataFrame:
    """Append ``flagged`` and ``reason``; the first matching rule wins.

    The rule inputs are bound once per row; the rules only read them.
    """
    cat, t, out = F.col(category), F.col(text), F.col(output)
    base = bind(
        df,
        _low=strip(F.lower(out)),
        _in_low=F.lower(t),
        _ov=let(word_set(t), lambda ws: overlap(ws, word_set(out))),
        _n_in=word_count(t),
        _n_out=word_count(out),
    )
    base = bind(
        base,
        _phrase=first_hit(F.col("_low"), ANSWER_PHRASES),
        _tell=F.when(cat == "QUESTION", first_hit(F.col("_low"), QUESTION_TELLS)),
    )
    ov, n_in, n_out = F.col("_ov"), F.col("_n_in"), F.col("_n_out")
    counts = F.concat(F.lit("output "), n_out, F.lit(" words vs input "), n_in)
    low = F.concat(F.lit("low word overlap with input ("), percent(ov), F.lit(") — "))
    reason = (
        F.when((F.col("_low") == "") | (t == ""), F.lit(""))
        .when(F.col("_phrase").isNotNull(), F.concat(
            F.lit('contains assistant-style phrase "'), F.col("_phrase"), F.lit('"')))
        .when(F.col("_tell").isNotNull(), F.concat(
            F.lit('contains factual-answer fragment "'), F.trim(F.col("_tell")), F.lit('"')))
        .when((cat == "QUESTION") & F.contains(F.col("_in_low"), F.lit("neural network"))
              & (n_out > n_in * 2),
              F.concat(counts, F.lit(" — likely explained instead of cleaned")))
        .when((cat == "QUESTION") & (ov < 0.5), F.concat(low, F.lit("drifted from question")))
        .when((cat == "PROVOCATIVE") & (ov < 0.6), F.concat(low, F.lit("likely deflected")))
        .when((n_in >= 3) & (n_out > F.greatest(F.lit(25), n_in * 3)),
              F.concat(counts, F.lit(" — too elaborative")))
        .otherwise(F.lit(""))
    )
    return (bind(base, reason=reason)
            .withColumn("flagged", F.col("reason") != "")
            .drop("_low", "_in_low", "_ov", "_n_in", "_n_out", "_phrase", "_tell"))
