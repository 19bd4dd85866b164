"""Exact Jaccard links between documents by partitioned shingle universes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quota import with_index
from .common import (bitmap, grams, mix64, pieces, planes, small_batches, smallest_linked, stored, unplane,
                     word_hashes, words)

BITS = 1 << 23        # bits of the map of documents whose shingles are read again
PART_BYTES = 4 << 20  # text per part of the key space
PIECE_BYTES = 1 << 20  # text whose words a task holds at once
HELD_KEYS = 400_000   # keys a task gathers before it sends them
BLOCK_ROWS = 512      # sets, and
BLOCK_TOKENS = 150_000  # shingles of one of the two blocks that a comparison holds
CHAIN, WIDTH = 7, 9  # segments after a key's own that its sketch covers, and bits for each
CHECK = 0.002         # cost of comparing two sketches, in keys


@dataclass(frozen=True)
class Scheme:
    """Sets link if den * intersection >= num * union.

    Sizes are cut in bands so that linked sets lie in one band or in neighbours. Of sets r and s
    at most (r + s) (den - num) / (den + num) shingles differ. A band's universe is cut into
    segments by hash; segment i is allotted 1 (it must be equal) or 2 (it may differ by one
    shingle), and if the allotments add up to more than the number that may differ, linked
    sets agree in some segment.

    More holds when the segments are laid on a ring: start behind the place where differences
    less allotments, added up, were highest for the last time. From there, every run of segments
    differs in less than its allotments add up to. So a key carries a sketch of the next
    segments, one bit of parity per hash class of shingles, and two sets that share a key are
    candidates only if the sketches differ by less than that. Sketches never differ by more
    than the sets do, so no linked pair is lost.
    """

    num: int
    den: int
    crowd: int = 1_000_000  # sets a band is expected to hold, for the cost of chance matches

    @cached_property
    def starts(self) -> list[int]:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * self.den // self.num + 1)
        return out

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def allot(self, band: int) -> tuple[int, int]:
        return _allot(self, band)


@lru_cache(maxsize=4096)
def _allot(s: Scheme, band: int) -> tuple[int, int]:
    """(segments allotted 2, segments allotted 1) of least cost for the band.

    A set costs one key per segment, one per shingle of the segments allotted 2 (its
    one-deletion neighbours), and a comparison of sketches per set that agrees by chance, which
    happens where a segment is empty on both sides or nearly so.
    """
    size, largest = s.starts[band], s.starts[band + 1] - 1
    differ = 2 * largest * (s.den - s.num) // (s.den + s.num)
    best = None
    for twos in {0, (differ + 1) // 4, (differ + 1) // 2, (differ + 2) // 2}:
        ones = max(0, differ + 1 - 2 * twos)
        m = twos + ones
        if m == 0:
            continue
        fill = size / m
        chance = s.crowd * np.exp(-2 * fill) * (ones + twos * (1 + fill) ** 2)
        cost = m + largest * twos / m + CHECK * chance
        if best is None or cost < best[0]:
            best = (cost, twos, ones)
    return best[1], best[2]


def keys_of(tokens: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set of distinct shingles is indexed, in its own band and the next, and
    the sketch of the segments after each key's. A sketch's top bit tells that allotments of 2
    are among those segments."""
    keys, chains, own = [], [], scheme.band(len(tokens))
    place, value = mix64(tokens + np.uint64(1)), mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bit = np.uint64(1) << (value >> np.uint64(32)) % np.uint64(WIDTH)
    for band in (own, own + 1):
        twos, ones = scheme.allot(band)
        m = twos + ones
        seg = (place % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        total, parity = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        first = np.searchsorted(seg[order], np.arange(m))
        full = np.flatnonzero(np.r_[first[1:], len(seg)] > first)
        total[full] = np.add.reduceat(value[order], first[full])
        parity[full] = np.bitwise_xor.reduceat(bit[order], first[full])
        chain = np.zeros(m, np.uint64)
        loose = np.arange(m) < twos
        for step in range(1, min(CHAIN, m - 1) + 1):
            chain |= np.roll(parity, -step) << np.uint64(WIDTH * (step - 1))
            loose |= np.roll(np.arange(m) < twos, -step)
        chain |= loose.astype(np.uint64) << np.uint64(63)
        base = mix64(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        keys.append(mix64(total + base))
        chains.append(chain)
        if twos:  # the first segments are those allotted 2: their sums less one shingle each
            near = seg < twos
            keys.append(mix64(total[seg[near]] - value[near] + base[seg[near]]))
            chains.append(chain[seg[near]])
    return np.concatenate(keys), np.concatenate(chains)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of two sets under one key allow them to be linked."""
    differ, loose = x ^ y, (x >> np.uint64(63)).astype(np.int64)
    good = np.ones(len(x), bool)
    for step in range(CHAIN, 0, -1):  # with n segments after the key's: n, or 2n + 1 where loose
        part = np.bitwise_count(differ & np.uint64((1 << WIDTH * step) - 1))
        good &= part <= step + loose * (step + 1)
    return good


def meet(key: np.ndarray, chain: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Rows (a, b), a > b: links that connect the ids ``k`` of each key whose sketches are alike.

    Ids with the same sketch hang on their smallest. The distinct sketches of a key are then
    compared with each other; a pair that is connected already adds no row.
    """
    order = np.lexsort((k, chain, key))
    key, chain, k = key[order], chain[order], k[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (chain[1:] != chain[:-1])]
    root = k[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    out = [np.unique(np.stack([k, root], axis=1)[k != root], axis=0)]
    key, chain, k = key[new], chain[new], k[new]
    label, at, step = np.arange(len(key)), np.arange(len(key)), 0
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        x, y = label[at], label[at + step]
        while ((label[x] != x) | (label[y] != y)).any():
            x, y = label[x], label[y]
        label[at], label[at + step] = x, y
        apart = np.flatnonzero(x != y)
        good = apart[alike(chain[at[apart]], chain[at[apart] + step])]
        a, b = k[at[good]], k[at[good] + step]
        out.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b])
        label[np.maximum(x, y)[good]] = np.minimum(x, y)[good]
    return np.unique(np.concatenate(out), axis=0)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A-Z are lower-cased; a text with fewer words
    has its whole sequence as one shingle, one without words none."""
    starts, codes, distinct = words(texts)
    hashed = word_hashes([w.lower() for w in distinct])[codes]  # bytes.lower changes A-Z only
    every = grams(hashed, size)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        else:
            yield grams(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _class(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), len(tokens))).astype(np.int64))


def _hung(rows: DataFrame, scheme: Scheme, size: int) -> DataFrame:
    """(a, b): documents that share a key and have sketches alike, as links that connect them.

    Of equal sets a task indexes one. Keys travel in blocks of bytes, one per batch and part of
    the key space; a part stands for about PART_BYTES of text, so a task holds a bounded number.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def pack(keys: list, chains: list, owner: list) -> pa.RecordBatch:
        key, chain, k = np.concatenate(keys), np.concatenate(chains), np.concatenate(owner)
        part = (key % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[by], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edge))
        low, blobs = [], []
        for p in full:
            i = by[edge[p]:edge[p + 1]]
            low.append(int(k[i].min()))
            wide = max(1, (int(k[i].max()) - low[-1]).bit_length() + 7 >> 3)
            # 48 bits of the key besides the part; candidates are compared exactly later.
            blobs.append(bytes([wide]) + planes(key[i] // np.uint64(parts), 6) + planes(chain[i], 8)
                         + planes((k[i] - low[-1]).astype(np.int64), wide))
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int64()), pa.array(np.diff(edge)[full], pa.int64()), pa.array(low, pa.int64()), pa.array(blobs, pa.binary())],
            ["part", "n", "low", "blob"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n = ([], [], []), 0
        for batch in pieces(batches, max_bytes=PIECE_BYTES):
            for i, tokens in zip(batch.column("id").to_numpy(), shingle_sets(batch.column("text"), size)):
                cls = _class(tokens) if len(tokens) else None
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    key, chain = keys_of(tokens, scheme)
                    for into, made in zip(held, (key, chain, np.full(len(key), i, np.int64))):
                        into.append(made)
                    n += len(key)
                if n >= HELD_KEYS:
                    yield pack(*held)
                    held, n = ([], [], []), 0
            if len(seen) > 200_000:
                seen.clear()
        if n:
            yield pack(*held)

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                blobs.setdefault(r["part"], []).append((r["n"], r["low"], r["blob"]))
        while blobs:
            key, chain, k = [], [], []
            for n, low, raw in blobs.popitem()[1]:
                key.append(unplane(raw[1:6 * n + 1], n, 6, np.uint64))
                chain.append(unplane(raw[6 * n + 1:14 * n + 1], n, 8, np.uint64))
                k.append(low + unplane(raw[14 * n + 1:], n, raw[0], np.int64))
            pairs = meet(np.concatenate(key), np.concatenate(chain), np.concatenate(k))
            for a in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[a:a + 50_000, 0]), pa.array(pairs[a:a + 50_000, 1])], ["a", "b"])

    named = rows.where("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    return (named.mapInArrow(spread, "part long, n long, low long, blob binary").repartition(parts, "part")
            .mapInArrow(hang, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       num: int = 90, den: int = 100, size: int = 3) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    1. Shingle sets; equal sets are one class from here on, so copies cost nothing more.
    2. Each class's keys (see ``Scheme``), shuffled by key; documents that meet under one key with
       sketches alike are connected. This gives groups of candidates, not pairs.
    3. Shingles of the candidates only are read again, and every pair inside a group is compared
       exactly; a large group is cut in blocks and each pair of blocks is a piece of work of its
       own. What comes out is one row per set at most, not one per pair.
    4. Verified links are followed to the smallest id.

    Documents without words have n_shingles 0 and are their own component; null text counts as
    empty. Null ids link with nothing and have a null component; rows that repeat an id share its
    component if their texts are equal. Shingles and sets are compared by 64-bit hashes.
    """
    scheme, spark = Scheme(num, den), docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max_bytes=PIECE_BYTES):
            found = [(len(t), _class(t) if len(t) else None) for t in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())],
                ["id", "n", "cls"])

    sets = stored(rows.mapInArrow(describe, f"id {kind}, n long, cls long"), "jaccard-sets")
    heads = stored(sets.where("cls is not null and id is not null").groupBy("cls")
                   .agg(F.min("id").alias("head"), F.max("n").alias("n")), "jaccard-heads")
    groups = smallest_linked(_hung(rows, scheme, size), "jaccard-candidates")
    grouped = groups.join(sets.where("cls is not null").select("id", "cls"), "id").select(F.col("root").alias("grp"), "cls").distinct()
    members = stored(grouped.join(heads, "cls"), "jaccard-members")
    shape = members.groupBy("grp").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_ROWS)).alias("blocks"))
    placed = members.join(stored(shape, "jaccard-shape"), "grp").select(
        "grp", "cls", "head", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("blk"))
    marked = bitmap(members, "head", BITS)
    sent = spark.sparkContext.broadcast(np.packbits(marked, bitorder="little"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for whole in batches:
            at = whole.column("bit").to_numpy()
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            some = whole.filter(pa.array(keep.astype(bool)))
            for batch in pieces([some], max_bytes=PIECE_BYTES):
                found = list(shingle_sets(batch.column("text"), size))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                cls = [_class(t) if len(t) else None for t in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    ["head", "cls", "tokens"])

    reread = (rows.where("id is not null").withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(BITS)))
              .mapInArrow(again, f"head {kind}, cls long, tokens array<long>"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("blk")),
                    lambda j: F.struct(F.least(j, F.col("blk")).alias("x"), F.greatest(j, F.col("blk")).alias("y"))))
    work = (reread.join(placed, ["head", "cls"]).withColumn("p", F.explode(pairs))
            .select("grp", "p.x", "p.y", "head", "tokens"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads_, tokens = None, [], []
        out: list[tuple] = []
        head_type = pa.int64()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], head_type), pa.array([b for _, b in out], head_type)], ["a", "b"])
            out.clear()
            return made

        for batch in batches:
            head_type = batch.schema.field("head").type
            lists = batch.column("tokens")
            flat, offs = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "x", "y")))):
                if k != key:
                    out += _linked(heads_, tokens, num, den)
                    key, heads_, tokens = k, [], []
                heads_.append(batch.column("head")[i].as_py())
                tokens.append(flat[offs[i]:offs[i + 1]].copy())
            if len(out) > 1000:
                yield flush()
        out += _linked(heads_, tokens, num, den)
        yield flush()

    linked = (work.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
              .mapInArrow(compare, f"a {kind}, b {kind}"))
    roots = smallest_linked(linked, "jaccard-links")
    named = stored(heads.join(roots, heads["head"] == roots["id"], "left").select(
        "cls", F.coalesce("root", "head").alias("component_id")), "jaccard-roots")
    some = sets.where("cls is not null").select("id", "n", "cls").join(named, "cls", "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    none = sets.where("cls is null").select("id", "n", F.col("id").alias("component_id"))
    return some.unionAll(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _linked(heads: list, tokens: list[np.ndarray], num: int, den: int) -> list[tuple]:
    """(head, smallest head of those it is linked to through others here), exact for every pair."""
    g = len(heads)
    if g < 2:
        return []
    n = np.array([len(t) for t in tokens], np.int64)
    value, count = np.unique(np.concatenate(tokens), return_counts=True)
    shared = value[(count > 1) & (count < g)]
    common = np.full((g, g), int((count == g).sum()), np.float64)
    where = [np.searchsorted(shared, t[np.isin(t, shared, assume_unique=True)]) for t in tokens]
    for a in range(0, len(shared), 4096):  # a dense piece of the incidence matrix at a time
        block = np.zeros((g, min(4096, len(shared) - a)), np.float32)
        for i, w in enumerate(where):
            block[i, w[np.searchsorted(w, a):np.searchsorted(w, a + 4096)] - a] = 1
        common += block @ block.T
    near = den * common >= num * (n[:, None] + n[None, :] - common)
    left, out = np.ones(g, bool), []
    for i in sorted(range(g), key=lambda i: heads[i]):
        if left[i]:
            group, edge = np.zeros(g, bool), np.zeros(g, bool)
            edge[i] = True
            while edge.any():
                group |= edge
                edge = near[edge].any(0) & ~group
            left &= ~group
            out += [(heads[j], heads[i]) for j in np.flatnonzero(group) if heads[j] != heads[i]]
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80,
                         den: int = 100, size: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows with a null id stay, and so do texts without words. Where ids repeat, every row with another
    text is a document of its own, numbered by (id, hash of its text); rows that repeat both are one document.
    """
    named = docs.where(F.col(id_col).isNotNull())
    if named.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        found = stored(jaccard_components(docs, id_col, text_col, num, den, size), "jaccard-found")
        gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id")) & F.col(id_col).isNotNull()).select(id_col)
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                               F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("key"), text.alias("text")),
                  "jaccard-rows").dropDuplicates(["key"])
    numbered = with_index(rows, "key", "no")
    found = stored(jaccard_components(numbered, "no", "text", num, den, size), "jaccard-found")
    stay = found.where("no = component_id").select("no")
    return numbered.join(stay, "no", "left_semi").select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
