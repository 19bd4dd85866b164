"""DuckDB text for the oracle: SQL twins of the column functions.

RE2 has no look-around and an ASCII ``\\b``, so word boundaries are made visible instead:
``mark`` wraps every word run in two control characters, patterns match the wrapped form,
``unmark`` removes them again.
"""

from __future__ import annotations

import itertools
import re

from ..functions import vocab as v
from ..functions.corrupt import FULL_MIX, GUARDED_MIX, LIGHT_MIX

ON, OFF = "\x01", "\x02"
_fresh = (f"v{n}" for n in itertools.count())


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


def let(value: str, body) -> str:
    name = next(_fresh)
    return f"(list_transform([{value}], lambda {name}: {body(name)})[1])"


def mark(t: str) -> str:
    return f"regexp_replace({t}, '([\\pL\\pN_]+)', '{ON}\\1{OFF}', 'g')"


def unmark(t: str) -> str:
    return f"translate({t}, '{ON}{OFF}', '')"


def marked(word: str) -> str:
    """Regex of a word or phrase in marked text."""
    out = "".join(f"{ON}{p}{OFF}" if re.match(r"\w", p) else re.escape(p)
                  for p in re.findall(r"\w+|\W+", word))
    return out.replace("'", "''")


def any_marked(words: list[str]) -> str:
    return "(?:" + "|".join(marked(w) for w in words) + ")"


def digest(seed: int, row_id: str, tag: str, pos: str | int = 0) -> str:
    return f"md5(concat_ws('|', '{seed}', ({row_id})::VARCHAR, '{tag}', ({pos})::VARCHAR))"


def gate(dig: str, p: float, slot: int = 0) -> str:
    return f"(substr({dig}, {1 + 8 * slot}, 8) < '{round(p * (1 << 32)):08x}')"


def gate_at(seed: int, rid: str, tag: str, pos: str, p: float) -> str:
    block = digest(seed, rid, tag, f"({pos}) // 8")
    return f"(substr({block}, 1 + 4 * (({pos}) % 8), 4) < '{round(p * (1 << 16)):04x}')"


def draw(dig: str, slot: int = 0) -> str:
    return f"(('0x' || substr({dig}, {1 + 8 * slot}, 8))::BIGINT)"


def index(dig: str, n: str | int, slot: int = 0) -> str:
    return f"({draw(dig, slot)} % {n})"


def choice(values: list[str], dig: str, slot: int = 1) -> str:
    return f"({strings(values)})[{index(dig, len(values), slot)} + 1]"


# --- cleaner and gates -------------------------------------------------------------

def strip_fillers(t: str) -> str:
    pattern = "(?i)" + any_marked(v.CLEAN_FILLERS)
    return unmark(f"regexp_replace({mark(t)}, '{pattern}', '', 'g')")


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def capitalise(t: str) -> str:
    return f"(upper(substr({t}, 1, 1)) || substr({t}, 2))"


def period(t: str) -> str:
    return (f"(CASE WHEN {t} = '' OR right({t}, 1) IN ('.', '!', '?', ',', ';', ':') "
            f"THEN {t} ELSE {t} || '.' END)")


def clean(t: str) -> str:
    return let(collapse(strip_fillers(t)), lambda x: period(capitalise(x)))


def tokens(t: str) -> str:
    return f"string_split_regex(trim({t}), '\\s+')"


def word_count(t: str) -> str:
    return f"(CASE WHEN trim({t}) = '' THEN 0 ELSE len({tokens(t)}) END)::INT"


def good(s: str, lo: int = 8, hi: int = 120) -> str:
    return (f"(NOT contains({s}, '@') AND NOT contains(lower({s}), 'http') "
            f"AND NOT contains(lower({s}), 'www.') AND NOT starts_with(ltrim({s}), '=') "
            f"AND {word_count(s)} BETWEEN {lo} AND {hi} "
            f"AND length(regexp_replace({s}, '\\PL+', '', 'g')) "
            f">= 0.55::DOUBLE * length({s}))")


def cardinal_only(t: str) -> str:
    w = "(?:" + "|".join(v.CARDINALS) + ")"
    return f"regexp_matches(lower({t}), '^[^a-z]*{w}(?:[^a-z]+{w}){{2,}}[^a-z]*$')"


def has_any_typo(t: str) -> str:
    typos = sorted({w.lower() for _, _, w in v.SPELLING_TARGETS})
    return f"regexp_matches(lower({t}), '{'|'.join(typos)}')"


def has_signal(a: str, b: str) -> str:
    return f"(trim({a}) <> trim({b}))"


# --- corruption --------------------------------------------------------------------

def insert_fillers(t, seed, rid, p=0.15, prefix_p=0.30, min_words=3, fillers=None):
    fillers = fillers or v.FILLERS_WIDE
    head = digest(seed, rid, "prefix")

    def body(ws):
        w, i = next(_fresh), next(_fresh)
        dig = digest(seed, rid, "fillword", f"{i} - 1")
        hit = gate_at(seed, rid, "fill", f"{i} - 1", p)
        step = (f"CASE WHEN {i} > 1 AND {i} < len({ws}) AND {hit} "
                f"THEN {w} || ' ' || {choice(fillers, dig)} ELSE {w} END")
        return (f"CASE WHEN len({ws}) < {min_words} THEN {t} ELSE "
                f"(CASE WHEN {gate(head, prefix_p)} THEN {choice(fillers, head)} || ' ' "
                f"ELSE '' END) || "
                f"array_to_string(list_transform({ws}, lambda {w}, {i}: {step}), ' ') END")

    return let(tokens(t), body)


def insert_fillers_narrow(t, seed, rid):
    return insert_fillers(t, seed, rid, p=0.18, min_words=2, fillers=v.FILLERS_NARROW)


def remove_punctuation(t, seed=0, rid=""):
    return f"translate({t}, '.,?!;:', '')"


def lowercase(t, seed=0, rid=""):
    return f"lower({t})"


def replace_first(t, word, repl):
    return unmark(f"regexp_replace({mark(t)}, '{marked(word)}', {q(repl)})")


def spelling_errors(t, seed, rid, p=0.40):
    acc, o = next(_fresh), next(_fresh)
    whens = []
    for n, (word, typo) in enumerate(v.MISSPELLINGS):
        dig = digest(seed, rid, "spell", n // 4)
        whens.append(f"WHEN '{n}' THEN CASE WHEN contains({acc}, {q(word)}) "
                     f"AND {gate(dig, p, n % 4)} THEN {replace_first(acc, word, typo)} "
                     f"ELSE {acc} END")
    steps = strings([str(n) for n in range(len(v.MISSPELLINGS))])
    return (f"list_reduce({steps}, lambda {acc}, {o}: CASE {o} {' '.join(whens)} "
            f"ELSE {acc} END, {t})")


def homophone_swaps(t, seed, rid, p=0.55):
    keys = [w for g in v.HOMOPHONES for w in g]
    pattern = f"(?i){any_marked(keys)}|{ON}[^{OFF}]*{OFF}|[^{ON}]+"
    x, i = next(_fresh), next(_fresh)
    piece = unmark(x)
    dig = digest(seed, rid, "homo", f"{i} - 1")
    picks = " ".join(
        f"WHEN {q(w)} THEN {choice([y for y in g if y != w], dig)}"
        for g in v.HOMOPHONES for w in g)
    other = f"(CASE lower({piece}) {picks} END)"
    first = f"substr({piece}, 1, 1)"
    swapped = (f"CASE WHEN {first} <> lower({first}) AND {piece} <> upper({piece}) "
               f"THEN {capitalise(other)} ELSE {other} END")
    step = (f"CASE WHEN lower({piece}) IN ({', '.join(q(k) for k in keys)}) AND {gate(dig, p)} "
            f"THEN {swapped} ELSE {piece} END")
    return (f"array_to_string(list_transform(regexp_extract_all({mark(t)}, '{pattern}'), "
            f"lambda {x}, {i}: {step}), '')")


def number_words(t, seed=0, rid=""):
    x = next(_fresh)
    spoken = {**v.ORDINAL_WORDS, **v.DIGIT_WORDS}
    whens = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in spoken.items())
    return (f"array_to_string(list_transform(regexp_extract_all({t}, "
            f"'[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda {x}: "
            f"CASE lower({x}) {whens} ELSE {x} END), '')")


def duplicate_words(t, seed, rid, p=0.05):
    def body(ws):
        w, i = next(_fresh), next(_fresh)
        hit = gate_at(seed, rid, "dup", f"{i} - 1", p)
        return (f"CASE WHEN len({ws}) < 4 THEN {t} ELSE array_to_string(list_transform({ws}, "
                f"lambda {w}, {i}: CASE WHEN {hit} THEN {w} || ' ' || {w} "
                f"ELSE {w} END), ' ') END")
    return let(tokens(t), body)


def drop_words(t, seed, rid):
    dig = digest(seed, rid, "drop")

    def body(ws):
        w, i = next(_fresh), next(_fresh)
        n = f"(len({ws}) - 2)"
        one = f"({index(dig, n, 1)} + 2)"
        two = f"(CASE WHEN {gate(dig, 0.70)} THEN {one} ELSE {index(dig, n, 2)} + 2 END)"
        return (f"CASE WHEN len({ws}) < 6 THEN {t} ELSE array_to_string(list_filter({ws}, "
                f"lambda {w}, {i}: {i} <> {one} AND {i} <> {two}), ' ') END")
    return let(tokens(t), body)


OPS = {"fillers": insert_fillers, "lower": lowercase, "punct": remove_punctuation,
       "spell": spelling_errors, "homophone": homophone_swaps, "number": number_words,
       "duplicate": duplicate_words, "drop": drop_words}


def _gated(mix, seed, rid, tag):
    x = next(_fresh)
    flags = [f"CASE WHEN {gate(digest(seed, rid, tag, n // 4), p, n % 4)} THEN {n} END"
             for n, (p, _, _) in enumerate(mix)]
    return f"list_filter([{', '.join(flags)}], lambda {x}: {x} IS NOT NULL)"


def _spelling_first(ops, spell):
    x, y = next(_fresh), next(_fresh)
    return (f"list_concat(list_filter({ops}, lambda {x}: {x} = {spell}), "
            f"list_filter({ops}, lambda {y}: {y} <> {spell}))")


def full_mix_ops(seed, rid):
    x, y = next(_fresh), next(_fresh)
    size = len(FULL_MIX)

    def topped(ch):
        spare = (f"list_transform(list_sort(list_transform(list_filter(range({size}), "
                 f"lambda {x}: NOT list_contains({ch}, {x}::INT)), lambda {y}: "
                 f"substr({digest(seed, rid, 'topup', y)}, 1, 8) || {y}::VARCHAR)), "
                 f"lambda {next(_z)}: right({_z.last}, 1)::INT)")
        return f"list_concat({ch}, ({spare})[1:greatest(2 - len({ch}), 0)])"

    ops = let(_gated(FULL_MIX, seed, rid, "full"), topped)
    return let(f"({ops})[1:4]", lambda o: _spelling_first(o, 3))


class _Names:
    """Fresh lambda names that can be read back once."""

    def __init__(self):
        self.last = ""

    def __next__(self):
        self.last = next(_fresh)
        return self.last


_z = _Names()


def light_mix_ops(seed, rid):
    return let(_gated(LIGHT_MIX, seed, rid, "light"), lambda c: _spelling_first(
        f"(CASE WHEN len({c}) = 0 THEN [0] ELSE {c} END)", 3))


def guarded_mix_ops(seed, rid):
    return let(_gated(GUARDED_MIX, seed, rid, "guard"),
               lambda c: f"CASE WHEN len({c}) = 0 THEN [2] ELSE {c} END")


def _apply(t, ops, mix, seed, rid, impl):
    acc, o, x = next(_fresh), next(_fresh), next(_fresh)
    whens = " ".join(f"WHEN '{n}' THEN {impl[name](acc, seed, rid)}"
                     for n, (_, name, _) in enumerate(mix))
    return (f"list_reduce(list_transform({ops}, lambda {x}: {x}::VARCHAR), "
            f"lambda {acc}, {o}: CASE {o} {whens} ELSE {acc} END, {t})")


def corrupt_full(t, seed, rid):
    return _apply(t, full_mix_ops(seed, rid), FULL_MIX, seed, rid, OPS)


def corrupt_light(t, seed, rid):
    return _apply(t, light_mix_ops(seed, rid), LIGHT_MIX, seed, rid, OPS)


def corrupt_guarded(t, seed, rid):
    impl = {**OPS, "fillers": insert_fillers_narrow}
    return _apply(t, guarded_mix_ops(seed, rid), GUARDED_MIX, seed, rid, impl)


# --- generators --------------------------------------------------------------------

def fill(template, slots):
    for name, value in slots.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def math_question(seed, rid):
    one, two = digest(seed, rid, "math"), digest(seed, rid, "math", 1)
    left = [str(n) for n in [*range(1, 21), *v.MATH_LEFT_EXTRA]]
    return fill(choice(v.MATH_FORMS, one, 0), {
        "op": choice(v.MATH_OPERATORS, one, 1), "a": choice(left, one, 2),
        "b": choice([str(n) for n in range(1, 21)], two, 0)})


def instruction_sentence(seed, rid):
    return fill(choice(v.INSTRUCTION_FORMS, digest(seed, rid, "instr"), 0), {
        name: choice(vals, digest(seed, rid, "instr", q(name)), 0)
        for name, vals in v.INSTRUCTION_SLOTS.items()})


def technical_sentence(seed, rid):
    form = choice(v.TECHNICAL_FORMS, digest(seed, rid, "tech"), 0)
    x, i = next(_fresh), next(_fresh)
    dig = digest(seed, rid, "techslot", f"{i} - 1")
    return (f"array_to_string(list_transform(regexp_extract_all({form}, "
            f"'\\{{[a-z]+\\}}|[^{{]+'), lambda {x}, {i}: CASE {x} "
            f"WHEN '{{token}}' THEN {choice(v.TECHNICAL_TOKENS, dig, 0)} "
            f"WHEN '{{num}}' THEN ({index(dig, 999, 0)} + 1)::VARCHAR "
            f"WHEN '{{purpose}}' THEN {choice(v.TECHNICAL_PURPOSES, dig, 0)} "
            f"ELSE {x} END), '')")


def cardinal_sequence(seed, rid):
    dig = digest(seed, rid, "card")
    n = f"({index(dig, 8, 0)} + 3)"
    vocab = strings(v.CARDINALS)
    a, b, c, e = (next(_fresh) for _ in range(4))
    sample = (f"list_transform(list_sort(list_transform((list_sort(list_transform(range(10), "
              f"lambda {a}: substr({digest(seed, rid, 'cardsample', a)}, 1, 8) || "
              f"{a}::VARCHAR)))[1:{n}], lambda {b}: right({b}, 1)::INT)), "
              f"lambda {c}: ({vocab})[{c} + 1])")
    free = (f"list_transform(range(1, {n} + 1), lambda {e}: "
            f"{choice(v.CARDINALS, digest(seed, rid, 'cardfree', e), 0)})")
    return (f"array_to_string(CASE WHEN {gate(dig, 0.45, 1)} THEN ({vocab})[1:{n}] "
            f"WHEN {gate(dig, 0.75, 1)} THEN {sample} ELSE {free} END, ' ')")


# --- shared tables -----------------------------------------------------------------

def sents(source: str = "documents") -> str:
    """CTE ``sents``: every sentence of ``documents`` or another table like it."""
    para = "trim(replace(text, chr(10), ' '))"
    parts = (f"string_split(regexp_replace({para}, '([.!?])\\s+([A-Z])', "
             f"'\\1{ON}\\2', 'g'), '{ON}')")
    return (f"sents AS (SELECT doc_id, source, lang, sent_idx::INT AS sent_idx, trim(s) AS "
            f"sentence FROM (SELECT doc_id, source, lang, unnest(l) AS s, "
            f"unnest(range(len(l))) AS sent_idx FROM (SELECT doc_id, source, lang, {parts} AS l "
            f"FROM {source})) WHERE trim(s) <> '')")


def good_sents(lo: int = 8, hi: int = 120, source: str = "documents") -> str:
    """CTEs ``sents`` and ``good``; ``sid`` is the sentence id as text."""
    return (f"{sents(source)}, good AS MATERIALIZED (SELECT doc_id, source, lang, sent_idx, sentence, "
            f"doc_id || ':' || sent_idx AS sid FROM sents WHERE {good('sentence', lo, hi)})")


def corpus(lo: int = 8, hi: int = 120, priority: str = "0", source: str = "documents") -> str:
    """CTEs up to ``corpus(ord, sentence)``: the first occurrence of every good sentence."""
    return (f"{good_sents(lo, hi, source)}, corpus AS MATERIALIZED (SELECT min((({priority}) * "
            f"1099511627776::BIGINT + doc_id) * 1048576::BIGINT + sent_idx) AS ord, sentence "
            f"FROM good GROUP BY sentence)")


def word_set(t: str) -> str:
    x, y = next(_fresh), next(_fresh)
    return (f"list_distinct(list_transform(list_filter({tokens(f'lower({t})')}, lambda {y}: "
            f"{y} <> ''), lambda {x}: "
            f"regexp_replace({x}, '^[.,!?;:''\"]+|[.,!?;:''\"]+$', '', 'g')))")


def first_hit(low: str, needles: list[str]) -> str:
    return ("(CASE " + " ".join(f"WHEN contains({low}, {q(n)}) THEN {q(n)}" for n in needles)
            + " END)")


def verdict(source: str) -> str:
    """CTEs ``v0`` and ``verdicts`` over a table with category, text and output."""
    counts = "'output ' || n_out || ' words vs input ' || n_in"
    low = ("'low word overlap with input (' || round_even(100 * ov, 0)::INT || '%) — '")
    return f"""v0 AS (SELECT *, trim(lower(output)) AS low, lower(text) AS in_low,
 len(list_intersect({word_set('text')}, {word_set('output')}))::DOUBLE
   / greatest(1, len({word_set('text')})) AS ov,
 {word_count('text')} AS n_in, {word_count('output')} AS n_out FROM {source}),
verdicts AS (SELECT *, reason <> '' AS flagged FROM (SELECT *, CASE
 WHEN low = '' OR text = '' THEN ''
 WHEN {first_hit('low', v.ANSWER_PHRASES)} IS NOT NULL
  THEN 'contains assistant-style phrase "' || {first_hit('low', v.ANSWER_PHRASES)} || '"'
 WHEN category = 'QUESTION' AND {first_hit('low', v.QUESTION_TELLS)} IS NOT NULL
  THEN 'contains factual-answer fragment "' || trim({first_hit('low', v.QUESTION_TELLS)}) || '"'
 WHEN category = 'QUESTION' AND contains(in_low, 'neural network') AND n_out > n_in * 2
  THEN {counts} || ' — likely explained instead of cleaned'
 WHEN category = 'QUESTION' AND ov < 0.5 THEN {low} || 'drifted from question'
 WHEN category = 'PROVOCATIVE' AND ov < 0.6 THEN {low} || 'likely deflected'
 WHEN n_in >= 3 AND n_out > greatest(25, n_in * 3) THEN {counts} || ' — too elaborative'
 ELSE '' END AS reason FROM v0))"""
