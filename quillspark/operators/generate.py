"""Table-driven sentence generators and (dirty, clean) pair builders.

Every builder is driven by a column of ids: n ids give n rows, whatever the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import corrupt as c
from ..functions import draws as d
from ..functions import text as t
from ..functions import vocab as v
from .mining import GROUPS, spelling_sources
from .quota import first_k, materialise, shuffled, smallest_k, with_index


def _fill(template: Column, slots: dict[str, Column]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit("{" + kv[0] + "}"), kv[1]),
                  slots.items(), template)


def math_question(seed: int, row_id: Column) -> Column:
    one, two = d.digest(seed, row_id, "math"), d.digest(seed, row_id, "math", 1)
    left = [str(n) for n in [*range(1, 21), *v.MATH_LEFT_EXTRA]]
    right = [str(n) for n in range(1, 21)]
    return _fill(d.choice(v.MATH_FORMS, one, 0), {
        "op": d.choice(v.MATH_OPERATORS, one, 1),
        "a": d.choice(left, one, 2),
        "b": d.choice(right, two, 0),
    })


def instruction_sentence(seed: int, row_id: Column) -> Column:
    slots = {name: d.choice(values, d.digest(seed, row_id, "instr", name), 0)
             for name, values in v.INSTRUCTION_SLOTS.items()}
    return _fill(d.choice(v.INSTRUCTION_FORMS, d.digest(seed, row_id, "instr"), 0), slots)


def technical_sentence(seed: int, row_id: Column) -> Column:
    """Repeated slots are drawn separately, keyed by their position in the form."""
    form = d.choice(v.TECHNICAL_FORMS, d.digest(seed, row_id, "tech"), 0)
    parts = F.regexp_extract_all(form, F.lit(r"\{[a-z]+\}|[^{]+"), F.lit(0))

    def fill(part: Column, i: Column) -> Column:
        dig = d.digest(seed, row_id, "techslot", i)
        return (F.when(part == "{token}", d.choice(v.TECHNICAL_TOKENS, dig, 0))
                .when(part == "{num}", (d.index(dig, 999, 0) + 1).cast("string"))
                .when(part == "{purpose}", d.choice(v.TECHNICAL_PURPOSES, dig, 0))
                .otherwise(part))

    return F.array_join(F.transform(parts, fill), "")


def cardinal_sequence(seed: int, row_id: Column) -> Column:
    """3-10 words: 45 % counted from one, 30 % sorted sample, 25 % free with repeats."""
    dig = d.digest(seed, row_id, "card")
    vocab = F.array(*[F.lit(w) for w in v.CARDINALS])
    n = d.index(dig, 8, 0) + 3
    positions = F.sequence(F.lit(0), F.lit(len(v.CARDINALS) - 1))
    keyed = F.sort_array(F.transform(positions, lambda i: F.struct(
        F.substring(d.digest(seed, row_id, "cardsample", i), 1, 8).alias("key"),
        i.alias("i"))))
    sample = F.transform(F.sort_array(F.transform(F.slice(keyed, F.lit(1), n),
                                                  lambda s: s["i"])),
                         lambda i: F.get(vocab, i))
    free = F.transform(F.sequence(F.lit(1), n), lambda i: d.choice(
        v.CARDINALS, d.digest(seed, row_id, "cardfree", i), 0))
    words = (F.when(d.gate(dig, 0.45, 1), F.slice(vocab, F.lit(1), n))
             .when(d.gate(dig, 0.75, 1), sample).otherwise(free))
    return F.array_join(words, " ")


def pass_through_pairs(ids: DataFrame, seed: int, row_id: str = "id") -> DataFrame:
    """One math, one instruction and one technical pair per id, lightly corrupted."""
    i = F.col(row_id)
    made = ids.select(i, F.inline(F.array(
        F.struct(F.lit("math").alias("category"), math_question(seed, i).alias("output")),
        F.struct(F.lit("instruction").alias("category"),
                 instruction_sentence(seed, i).alias("output")),
        F.struct(F.lit("technical").alias("category"),
                 technical_sentence(seed, i).alias("output")))))
    pair_id = F.concat_ws(":", "category", row_id)
    return made.select(
        pair_id.alias("pair_id"), "category",
        c.corrupt_light(F.col("output"), seed, pair_id).alias("input"), "output")


def cardinal_pairs(ids: DataFrame, target: int, seed: int, row_id: str = "id",
                   attempts: int = 3) -> DataFrame:
    """First ``target`` usable pairs of up to ``attempts`` draws per id, by attempt.

    Round r of an id comes after all ids of round r-1, and runs only if the rounds before left the
    quota open. Ids may be any numbers, NULL (first) too: an attempt is named by round and id in one
    number while the id is below 2^40, by both of them otherwise, so no two share a name.
    Equal ids make equal pairs.
    """
    i, out, missing = F.col(row_id), [], target
    for r in range(attempts):
        own = F.concat_ws(":", F.lit(r), F.coalesce(i.cast("string"), F.lit("NULL")))
        name = F.when(i.between(0, (1 << 40) - 1), (i + F.lit(r << 40)).cast("string")).otherwise(own)
        tries = d.bind(ids.select(row_id), attempt=name)
        a = F.col("attempt")
        seq = d.bind(tries, clean=cardinal_sequence(seed, a))
        cap = t.capitalise_first(F.col("clean"))
        seeded = F.when(d.gate(d.digest(seed, a, "cardcap"), 0.25), cap).otherwise(F.col("clean"))
        pairs = d.bind(seq, input=c.corrupt_guarded(seeded, seed, a), output=F.concat(cap, F.lit("."))).drop("clean")
        usable = materialise(pairs.where(t.has_signal(F.col("input"), F.col("output"))), "cardinal-tries")
        got = usable.count()
        if got > missing:
            usable = with_index(usable, row_id, "_idx").where(F.col("_idx") < missing)
        out.append(usable.select(F.concat_ws(":", F.lit("cardinal"), "attempt").alias("pair_id"),
                                 F.lit("cardinal").alias("category"), "input", "output"))
        missing -= min(got, missing)
        if missing == 0:
            break
    return reduce(DataFrame.unionByName, out)


def real_text_pairs(sentences: DataFrame, need: int, seed: int, row_id: str = "ord",
                    max_rounds: int = 6) -> DataFrame:
    """``need`` pairs from real sentences, reusing sentences round by round if too few.

    A round is one pass over the corpus with fresh draws; the next round runs only if the
    pairs so far do not fill the quota. The pairs of a round with the smallest draws count, and a
    draw is cheap: the sentences are corrupted by rising bands of the draw, the first a little
    wider than the need, and a further band only if too few of it were usable. The result is that
    of corrupting all. Only counts reach the driver.
    """
    out, missing, total = [], need, sentences.count()
    for r in range(max_rounds):
        pid = F.concat_ws(":", F.lit("real"), F.lit(str(r)), row_id)
        keyed = d.bind(sentences, pair_id=pid).withColumn("_draw", d.shuffle_key(seed, F.col("pair_id"), "round"))
        bands, got, upto = [], 0, 0
        while not bands or (got < missing and upto < d.DRAW_SPAN):
            start, rate = upto, max(got, 1) / (total * upto / d.DRAW_SPAN) if upto else 1.0
            upto = band_end(start, missing - got, rate, total)
            band = keyed.where((F.col("_draw") >= start) & (F.col("_draw") < upto))
            made = d.bind(band, input=c.corrupt_full(F.col("sentence"), seed, F.col("pair_id"))).select(
                "pair_id", F.lit("real").alias("category"), "input", F.col("sentence").alias("output"), "_draw",
            ).where(t.has_signal(F.col("input"), F.col("output")))
            bands.append(materialise(made, "real-round"))
            got += bands[-1].count()
        made = reduce(DataFrame.unionByName, bands)
        if got > missing:
            made = smallest_k(made, missing, "_draw", tie=["pair_id"])
        out.append(made.drop("_draw"))
        missing -= min(got, missing)
        if missing == 0 or got == 0:
            break
    return reduce(DataFrame.unionByName, out)


def band_end(start: int, missing: int, rate: float, total: int) -> int:
    """End of the band of draws from ``start`` in which ``missing`` usable rows are expected, with a margin.

    The margin is a twentieth and four standard deviations of the count.
    """
    want = 1.05 * missing / rate
    want += 4 * want ** 0.5
    if want >= total * (1 - start / d.DRAW_SPAN):
        return d.DRAW_SPAN
    return start + -int(-want / total * d.DRAW_SPAN // 1)


def spelling_pairs(sentences: DataFrame, target: int, seed: int) -> DataFrame:
    """Pairs whose input carries a targeted misspelling, ``target // 11`` per group."""
    quota = target // len(GROUPS)
    src = spelling_sources(sentences, quota + 50)
    pid = F.concat_ws(":", F.lit("spelling"), "grp", "ord")
    picked = d.bind(src.withColumn("pair_id", pid), pick=d.choice(
        F.col("usable"), d.digest(seed, F.col("pair_id"), "variant"), 0))
    dirty = c.force_typo(F.col("sentence"), F.col("pick.correct"), F.col("pick.typo"))
    made = d.bind(picked, input=c.corrupt_guarded(dirty, seed, F.col("pair_id"))).select(
        "pair_id", "grp", F.col("pick.typo").alias("typo"), "input",
        F.col("sentence").alias("output"),
        d.shuffle_key(seed, F.col("pair_id"), "group").alias("_draw"),
    ).where(t.has_signal(F.col("input"), F.col("output"))
            & t.typo_survived(F.col("input"), F.col("typo")))
    if quota <= 1000:
        kept = first_k(made, quota, [F.col("_draw"), F.col("pair_id")], ["grp"])
    else:
        kept = smallest_k(materialise(made, "spelling"), quota, "_draw", ["grp"], ["pair_id"])
    return kept.select("pair_id", F.lit("spelling").alias("category"), "input", "output")


def mix_pairs(parts: list[DataFrame], seed: int) -> DataFrame:
    """Bag union of pair categories in a persisted random order."""
    both = reduce(DataFrame.unionByName, parts)
    return shuffled(both, seed, F.col("pair_id"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Count and average lengths; one partial + final hash aggregate."""
    return pairs.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(F.length("input")).alias("avg_in"),
        F.avg(F.length("output")).alias("avg_out"),
    ).withColumn("overhead", F.col("avg_in") - F.col("avg_out"))


def verify_pairs(pairs: DataFrame) -> DataFrame:
    """Self-check counts: typo present, guard fires, mixed rows."""
    cat, inp = F.col("category"), F.col("input")
    return pairs.agg(
        F.count_if(cat == "spelling").alias("n_spelling"),
        F.count_if((cat == "spelling") & t.has_any_typo(inp)).alias("n_with_typo"),
        F.count_if(cat == "cardinal").alias("n_cardinal"),
        F.count_if((cat == "cardinal") & t.cardinal_only(inp)).alias("n_guarded"),
        F.count_if(~cat.isin("spelling", "cardinal")).alias("n_mixed"))
