"""Scalar text columns: cleaning, counting, gates, model-output trimming.

Character classes are spelled out instead of using ``\\b``/``\\s``: what those match in
Java depends on the JDK version, the classes below do not.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CARDINALS, CLEAN_FILLERS, SPELLING_TARGETS, TERMINAL_PUNCTUATION

# Letters and digits of any script; the ASCII letters come first because Java tests the
# parts of a class in order and they decide almost every character.
WORD = r"[a-zA-Z\p{L}\p{N}_]"
# White space is written as "none of the other ranges", the frequent ones first, for the
# same reason; STRIP holds the same characters as a literal set.
NON_SPACE = (r"[!-\x84\xa1-\u167f\u3001-\x{10ffff}\x00-\x08\x0e-\x1b\x86-\x9f\u1681-\u1fff"
             r"\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff]")
SPACE = "[^" + NON_SPACE[1:]
STRIP = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ODD_SPACE = STRIP.replace(" ", "")
EDGE_L = rf"(?<!{WORD})"
EDGE_R = rf"(?!{WORD})"


def any_word(words: list[str]) -> str:
    """Pattern of one whole-word alternative, tried in list order."""
    return EDGE_L + "(?:" + "|".join(re.escape(w) for w in words) + ")" + EDGE_R


def strip(t: Column) -> Column:
    """Both-side strip of every Unicode white-space character."""
    return F.btrim(t, F.lit(STRIP))


def plain_spaces(t: Column) -> Column:
    """Every white-space character as a blank.

    Almost all texts have none but blanks: an ASCII text is searched for the few others byte by byte,
    which is far cheaper than a pattern or a table that looks at each character.
    """
    odd = reduce(Column.__or__, [F.contains(t, F.lit(c)) for c in ODD_SPACE if c < "\x80"])
    return F.when((F.octet_length(t) == F.length(t)) & ~odd, t).otherwise(
        F.translate(t, ODD_SPACE, " " * len(ODD_SPACE)))


def words(t: Column) -> Column:
    """White-space tokens; blank text gives an empty array.

    Spark compiles the pattern of a split anew for every row, a plain character needs none. No
    lambda, so it stays in codegen.
    """
    return F.array_remove(F.split(plain_spaces(t), " "), "")


def word_count(t: Column) -> Column:
    """Number of white-space tokens, 0 for blank."""
    return F.size(words(t))


def not_blank(t: Column) -> Column:
    return strip(t) != ""


# --- cleaner -----------------------------------------------------------------------

def strip_fillers(t: Column) -> Column:
    """Whole filler words out. Two cheap tests in front pass over most places of a text: an ASCII letter
    before, and a first letter that no filler has."""
    firsts = "".join(sorted({w[0] for w in CLEAN_FILLERS}))
    return F.regexp_replace(t, f"(?iu)(?<![a-z])(?=[{firsts}])" + any_word(CLEAN_FILLERS), "")


def collapse_spaces(t: Column) -> Column:
    return F.array_join(words(t), " ")


def capitalise_first(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def terminal_period(t: Column) -> Column:
    """Append a period unless the text is empty or already ends in punctuation."""
    closed = F.right(t, F.lit(1)).isin("", *TERMINAL_PUNCTUATION)
    return F.concat(t, F.when(closed, F.lit("")).otherwise(F.lit(".")))


def clean(t: Column) -> Column:
    """The rule-based cleaner: fillers, white space, first capital, final period.

    Every step reads its input unconditionally, so codegen shares the expensive regex part;
    text made only of fillers ends up empty, without a period.
    """
    return terminal_period(capitalise_first(collapse_spaces(strip_fillers(t))))


# --- sentences and gates -----------------------------------------------------------

SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"


def sentences(t: Column) -> Column:
    """Array of stripped sentences; blank text gives an empty array."""
    return F.array_remove(sentence_parts(t), "")


def sentence_parts(t: Column) -> Column:
    """Array of stripped sentences; blank text gives one empty sentence.

    A break takes all the white space between two sentences, so parts of stripped text need no strip.
    """
    return F.split(strip(F.replace(t, F.lit("\n"), F.lit(" "))), SENTENCE_BREAK)


def letter_count(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^a-zA-Z\p{L}]+", ""))


def good_sentence(s: Column, min_words: int = 8, max_words: int = 120) -> Column:
    """Quality gate; cheap terms are written first so they short-circuit the regex ones.

    The word range is one comparison, because BETWEEN would count the words twice.
    """
    middle, reach = min_words + max_words, max_words - min_words
    return (
        ~F.contains(s, F.lit("@"))
        & ~F.contains(F.lower(s), F.lit("http"))
        & ~F.contains(F.lower(s), F.lit("www."))
        & ~s.rlike(rf"^{SPACE}*=")
        & (F.abs(2 * word_count(s) - middle) <= reach)
        & (letter_count(s) >= F.lit(0.55) * F.length(s))
    )


def has_signal(dirty: Column, clean_: Column) -> Column:
    """False where the dirty text equals the clean one after stripping."""
    return strip(dirty) != strip(clean_)


def cardinal_only(t: Column) -> Column:
    """At least three ASCII words, all of them one..ten."""
    low = F.lower(t)
    word = "(?:" + "|".join(CARDINALS) + ")"
    return low.rlike(rf"^[^a-z]*{word}(?:[^a-z]+{word}){{2,}}[^a-z]*\z")


def typo_survived(dirty: Column, typo: Column) -> Column:
    return F.contains(F.lower(dirty), F.lower(typo))


def has_any_typo(t: Column) -> Column:
    """Raw substring test, deliberately not bounded to words."""
    typos = sorted({w.lower() for _, _, w in SPELLING_TARGETS})
    return F.lower(t).rlike("|".join(re.escape(w) for w in typos))


# --- display and model output ------------------------------------------------------

def preview(t: Column, n: int = 120) -> Column:
    return F.substring(t, 1, n)


def first_line(t: Column) -> Column:
    return strip(F.substring_index(t, "\n", 1))


def cut_at_stop(t: Column) -> Column:
    """Cut at the first line break or at the first ``Input:``."""
    return F.substring_index(F.substring_index(t, "\n", 1), "Input:", 1)


def prompt(t: Column) -> Column:
    return F.concat(F.lit("Input: "), t, F.lit("\nOutput: "))


def shown(t: Column, placeholder: str) -> Column:
    return F.when(t == "", F.lit(placeholder)).otherwise(t)


def pause_hint(ms: Column) -> Column:
    """Label of a silence setting in milliseconds."""
    return (
        F.when(ms < 300, "⚠ May cut off fast speakers")
        .when(ms <= 500, "✓ Recommended for most users")
        .when(ms <= 800, "Tolerates longer mid-sentence pauses")
        .otherwise("Long pause before transcription triggers")
    )
