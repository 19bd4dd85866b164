"""Text corruption as columns: every operator is ``(text, seed, id) -> text``.

Words are white-space tokens. Decisions come from :mod:`draws`, keyed by operator tag and
position, so two operators on one row never share a draw.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draws as d
from .text import EDGE_L, EDGE_R, WORD, any_word, cardinal_only, words
from .vocab import (DIGIT_WORDS, FILLERS_NARROW, FILLERS_WIDE, HOMOPHONES, MISSPELLINGS,
                    ORDINAL_WORDS)

Op = Callable[[Column, int, Column], Column]


def insert_fillers(t: Column, seed: int, row_id: Column, *, p: float = 0.15,
                   prefix_p: float = 0.30, min_words: int = 3,
                   fillers: list[str] = FILLERS_WIDE) -> Column:
    """After interior words with probability ``p``, plus a prefix with ``prefix_p``."""

    def noisy(ws: Column, blocks: Column) -> Column:
        last = F.size(ws) - 1

        def step(w: Column, i: Column) -> Column:
            hit = d.gate_at(blocks, i, p) & (i > 0) & (i < last)
            dig = d.digest(seed, row_id, "fillword", i)
            return F.when(hit, F.concat(w, F.lit(" "), d.choice(fillers, dig))).otherwise(w)

        prefix = d.let(d.digest(seed, row_id, "prefix"), lambda head: F.when(
            d.gate(head, prefix_p), F.concat(d.choice(fillers, head), F.lit(" "))).otherwise(F.lit("")))
        body = F.concat(prefix, F.array_join(F.transform(ws, step), " "))
        return F.when(F.size(ws) < min_words, t).otherwise(body)

    return d.let(words(t), lambda ws: d.let(
        d.gate_blocks(seed, row_id, "fill", F.size(ws)), lambda blocks: noisy(ws, blocks)))


def insert_fillers_narrow(t: Column, seed: int, row_id: Column) -> Column:
    """The variant of the guarded mix: denser, shorter list, from two words on."""
    return insert_fillers(t, seed, row_id, p=0.18, min_words=2, fillers=FILLERS_NARROW)


def remove_punctuation(t: Column, seed: int = 0, row_id: Column | None = None) -> Column:
    return reduce(lambda acc, c: F.replace(acc, F.lit(c), F.lit("")), ".,?!;:", t)


def lowercase(t: Column, seed: int = 0, row_id: Column | None = None) -> Column:
    return F.lower(t)


def replace_first(t: Column, word: str, repl: str) -> Column:
    """Replace the first whole-word occurrence, case-sensitive. The edge is looked at only where the letters match."""
    return F.regexp_replace(t, rf"(?s)\A(.*?)(?={re.escape(word)}){EDGE_L}{re.escape(word)}{EDGE_R}",
                            "$1" + re.sub(r"([\\$])", r"\\\1", repl))


def force_typo(t: Column, correct: Column, typo: Column) -> Column:
    """Replace one whole-word occurrence of a per-row target word."""
    pattern = F.concat(F.lit(rf"(?s)\A(.*?){EDGE_L}\Q"), correct, F.lit(rf"\E{EDGE_R}"))
    return F.regexp_replace(t, pattern, F.concat(F.lit("$1"), typo))


def spelling_errors(t: Column, seed: int, row_id: Column, p: float = 0.40) -> Column:
    """Ordered misspellings, each applied to its first occurrence with probability ``p``.

    Only rules whose word occurs in the text enter the fold (no rule creates the word of
    another). The fold binds the running text once; each branch carries a literal pattern,
    so Spark compiles every pattern once per task.
    """
    present = F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(word)), F.lit(n))
        for n, (word, _) in enumerate(MISSPELLINGS)]))

    def step(acc: Column, i: Column) -> Column:
        branch = None
        for n, (word, typo) in enumerate(MISSPELLINGS):
            dig = d.digest(seed, row_id, "spell", n // 4)
            value = F.when(d.gate(dig, p, n % 4), replace_first(acc, word, typo)).otherwise(acc)
            branch = F.when(i == n, value) if branch is None else branch.when(i == n, value)
        return branch.otherwise(acc)

    return F.aggregate(present, t, step)


def homophone_swaps(t: Column, seed: int, row_id: Column, p: float = 0.55) -> Column:
    """Swap whole words with another member of their homophone group."""
    keys = [w for group in HOMOPHONES for w in group]
    options = {w: [x for x in group if x != w] for group in HOMOPHONES for w in group}
    lookup = F.create_map(*[c for k, v in options.items()
                            for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    firsts = "".join(sorted({w[0] for w in keys}))
    keyword = f"(?=[{firsts}])" + any_word(keys)
    # Cheap tests in front pass over most places of a text, and only a lower-cased piece that is a key is swapped.
    likely = F.lower(t).rlike("(?<![a-z])" + keyword)
    pieces = F.regexp_extract_all(t, F.lit(rf"(?ius){keyword}|{WORD}+|[^{WORD[1:-1]}]+"),
                                  F.lit(0))

    def step(piece: Column, i: Column) -> Column:
        dig = d.digest(seed, row_id, "homo", i)
        other = d.choice(F.element_at(lookup, F.lower(piece)), dig)
        first = F.substring(piece, 1, 1)
        cap = (first != F.lower(first)) & (piece != F.upper(piece))
        swapped = F.when(cap, F.concat(F.upper(F.substring(other, 1, 1)),
                                       F.substr(other, F.lit(2)))).otherwise(other)
        return F.when(F.lower(piece).isin(keys) & d.gate(dig, p), swapped).otherwise(piece)

    return F.when(likely, F.array_join(F.transform(pieces, step), "")).otherwise(t)


def number_words(t: Column, seed: int = 0, row_id: Column | None = None) -> Column:
    """Ordinals (any case) and one- to four-digit tokens into words; unknown ones stay.

    Both rules match whole word runs only, so one tokenised pass covers the two maps.
    """
    spoken = {**ORDINAL_WORDS, **DIGIT_WORDS}
    lookup = F.create_map(*[F.lit(x) for kv in spoken.items() for x in kv])
    pieces = F.regexp_extract_all(t, F.lit(rf"(?s){WORD}+|[^{WORD[1:-1]}]+"), F.lit(0))
    said = F.transform(pieces, lambda w: F.when(
        w.rlike("^[0-9]"), F.coalesce(F.element_at(lookup, F.lower(w)), w)).otherwise(w))
    return F.when(t.rlike("[0-9]"), F.array_join(said, "")).otherwise(t)


def duplicate_words(t: Column, seed: int, row_id: Column, p: float = 0.05) -> Column:
    def noisy(ws: Column, blocks: Column) -> Column:
        twice = F.transform(ws, lambda w, i: F.when(
            d.gate_at(blocks, i, p), F.concat(w, F.lit(" "), w)).otherwise(w))
        return F.when(F.size(ws) < 4, t).otherwise(F.array_join(twice, " "))

    return d.let(words(t), lambda ws: d.let(
        d.gate_blocks(seed, row_id, "dup", F.size(ws)), lambda blocks: noisy(ws, blocks)))


def drop_words(t: Column, seed: int, row_id: Column) -> Column:
    """Drop one interior word (70 %) or two; the two draws may coincide."""
    def picks(ws: Column, dig: Column) -> Column:
        interior = F.size(ws) - 2
        one = d.index(dig, interior, 1) + 1
        two = F.when(d.gate(dig, 0.70), one).otherwise(d.index(dig, interior, 2) + 1)
        return F.struct(one.alias("one"), two.alias("two"))

    def noisy(ws: Column) -> Column:
        kept = d.let(d.let(d.digest(seed, row_id, "drop"), lambda dig: picks(ws, dig)), lambda n: F.filter(
            ws, lambda w, i: (i != n["one"]) & (i != n["two"])))
        return F.when(F.size(ws) < 6, t).otherwise(F.array_join(kept, " "))

    return d.let(words(t), noisy)


# --- mixes -------------------------------------------------------------------------

# Operator gates of the three mixes, in order.
FULL_MIX: list[tuple[float, str, Op]] = [
    (0.65, "fillers", insert_fillers),
    (0.55, "lower", lowercase),
    (0.55, "punct", remove_punctuation),
    (0.40, "spell", spelling_errors),
    (0.30, "homophone", homophone_swaps),
    (0.25, "number", number_words),
    (0.15, "duplicate", duplicate_words),
    (0.20, "drop", drop_words),
]
LIGHT_MIX: list[tuple[float, str, Op]] = [
    (0.55, "fillers", insert_fillers),
    (0.55, "lower", lowercase),
    (0.55, "punct", remove_punctuation),
    (0.30, "spell", spelling_errors),
    (0.10, "duplicate", duplicate_words),
]
GUARDED_MIX: list[tuple[float, str, Op]] = [
    (0.55, "lower", lowercase),
    (0.55, "punct", remove_punctuation),
    (0.45, "fillers", insert_fillers_narrow),
]


def _gated(mix: list[tuple[float, str, Op]], seed: int, row_id: Column, tag: str) -> Column:
    """Array of operator numbers whose gate fired, in list order; a digest is made once for its four gates."""
    digests = F.array(*[d.digest(seed, row_id, tag, n) for n in range(-(-len(mix) // 4))])

    def fired(digs: Column) -> Column:
        flags = [F.when(d.gate(F.get(digs, F.lit(n // 4)), p, n % 4), n).otherwise(-1)
                 for n, (p, _, _) in enumerate(mix)]
        return F.array_remove(F.array(*flags), -1)

    return d.let(digests, fired)


def unchosen(chosen: Column, size: int) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in range(size)]), chosen)


def spelling_first(ops: Column, mix: list[tuple[float, str, Op]]) -> Column:
    """Stable priority sort: the spelling operator first, the rest in their order."""
    spell = next(n for n, (_, name, _) in enumerate(mix) if name == "spell")
    return d.let(ops, lambda chosen: F.when(
        F.array_contains(chosen, spell), F.concat(F.array(F.lit(spell)), F.array_remove(chosen, spell))).otherwise(chosen))


def full_mix_ops(seed: int, row_id: Column) -> Column:
    """Two to four operator numbers: gated, topped up at random, cut, spelling first."""

    def topped(chosen: Column) -> Column:
        spare = F.sort_array(F.transform(unchosen(chosen, len(FULL_MIX)), lambda o: F.struct(
            F.substring(d.digest(seed, row_id, "topup", o), 1, 8).alias("key"),
            o.alias("op"))))
        extra = F.transform(F.slice(spare, F.lit(1), F.lit(2) - F.size(chosen)),
                            lambda s: s["op"])
        return F.when(F.size(chosen) >= 2, chosen).otherwise(F.concat(chosen, extra))

    ops = d.let(_gated(FULL_MIX, seed, row_id, "full"), topped)
    return spelling_first(F.slice(ops, 1, 4), FULL_MIX)


def light_mix_ops(seed: int, row_id: Column) -> Column:
    def filled(chosen: Column) -> Column:
        return F.when(F.size(chosen) == 0, F.array(F.lit(0))).otherwise(chosen)

    return spelling_first(d.let(_gated(LIGHT_MIX, seed, row_id, "light"), filled), LIGHT_MIX)


def guarded_mix_ops(seed: int, row_id: Column) -> Column:
    def filled(chosen: Column) -> Column:
        return F.when(F.size(chosen) == 0, F.array(F.lit(2))).otherwise(chosen)

    return d.let(_gated(GUARDED_MIX, seed, row_id, "guard"), filled)


def apply_ops(t: Column, ops: Column, mix: list[tuple[float, str, Op]], seed: int,
              row_id: Column) -> Column:
    """Fold the chosen operators over the text in the given order."""

    def step(acc: Column, o: Column) -> Column:
        branch = None
        for n, (_, _, op) in enumerate(mix):
            value = op(acc, seed, row_id)
            branch = F.when(o == n, value) if branch is None else branch.when(o == n, value)
        return branch.otherwise(acc)

    return F.aggregate(ops, t, step)


def corrupt_full(t: Column, seed: int, row_id: Column) -> Column:
    return apply_ops(t, full_mix_ops(seed, row_id), FULL_MIX, seed, row_id)


def corrupt_light(t: Column, seed: int, row_id: Column) -> Column:
    """Never drops a word."""
    return apply_ops(t, light_mix_ops(seed, row_id), LIGHT_MIX, seed, row_id)


def corrupt_guarded(t: Column, seed: int, row_id: Column) -> Column:
    """Light three-operator mix. The cardinal guard never removes one of its operators;
    it is reported by :func:`guard_fires` instead."""
    return apply_ops(t, guarded_mix_ops(seed, row_id), GUARDED_MIX, seed, row_id)


def guard_fires(t: Column) -> Column:
    return cardinal_only(t)
