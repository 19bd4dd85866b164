"""Repeated passages: suffix automata over the first holders of repeated word windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, grams, pieces, planes, small_batches, stored, unplane, word_hashes, words

BITS = 1 << 23
NONE = -(1 << 63)       # stands for a null id: smaller than any
PART_BYTES = 4 << 20    # text per part of the window table
HOT_LIMIT = 10_000      # first holders that are split over several tasks, at most


def _unpacked(block: tuple[int, int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and positions of a block's windows."""
    n, first, raw = block
    wide, raw = raw[0], raw[1:]
    return (unplane(raw[:6 * n], n, 6, np.uint64), first + unplane(raw[6 * n:(6 + wide) * n], n, wide, np.int64),
            unplane(raw[(6 + wide) * n:], n, 4, np.int32))


class Automaton:
    """Suffix automaton over word codes, several spans one after another (states are shared)."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.codes: dict[str, int] = {}

    def add(self, span: list[str]) -> None:
        nxt, link, size, codes = self.next, self.link, self.size, self.codes
        last = 0
        for word in span:
            c = codes.setdefault(word, len(codes))
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            p = last
            if q is None:
                cur = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    link[cur] = self._split(p, c)
                last = cur
            else:
                last = self._split(p, c)

    def _split(self, p: int, c: int) -> int:
        """The state reached from p by c, made to hold p's length plus one and no longer text."""
        nxt, link, size = self.next, self.link, self.size
        q = nxt[p][c]
        if size[q] == size[p] + 1:
            return q
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def matches(self, text: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal stretches [from, to) of ``text`` covered by words runs of ``least`` or more that
        occur in the automaton: the matching statistic at each word is the longest such run
        that ends there."""
        nxt, link, size, codes = self.next, self.link, self.size, self.codes
        state = long = 0
        out: list[tuple[int, int]] = []
        for at, word in enumerate(text):
            c = codes.get(word, -1)
            while state and c not in nxt[state]:
                state = link[state]
                long = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                long += 1
            else:
                long = 0
            if long >= least:
                start = at + 1 - long
                if out and start <= out[-1][1]:
                    out[-1] = (min(out[-1][0], start), at + 1)
                else:
                    out.append((start, at + 1))
        return out


def _runs(at: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """[from, to) stretches of words under windows that begin at the sorted positions ``at``."""
    if len(at):
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        for run in np.split(at, cut):
            yield int(run[0]), int(run[-1]) + width


def repeated_windows(rows: DataFrame, width: int) -> DataFrame:
    """(role, k, pos, first): windows met in several documents, by a 64-bit hash of their words.

    Role 1: document k holds the window at word ``pos`` and document ``first`` < k is the smallest
    that holds it. Role 0: ``k`` is that smallest document, its window at ``pos`` is the one to
    compare with. A task first settles what repeats inside its own batch and hands on a window
    for the smallest of its documents only, so one that very many documents share makes few entries.
    Entries travel in blocks of bytes, one per batch and part; a part holds about PART_BYTES of text.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            starts, codes, distinct = words(batch.column("text"))
            every = grams(word_hashes(distinct)[codes], width)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            pos = np.arange(len(codes)) - starts[doc]
            inside = np.flatnonzero(pos[:len(every)] + width <= np.diff(starts)[doc[:len(every)]])
            h, pos = every[inside], pos[inside]
            k = batch.column("k").to_numpy()[doc[inside]]
            order = np.lexsort((pos, k, h))
            new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            later = k[order] != k[head]
            yield _windows(np.ones(later.sum()), k[order][later], pos[order][later], k[head][later])
            refs = np.unique(head[later])
            yield _windows(np.zeros(len(refs)), k[refs], pos[refs], k[refs])
            sole = np.sort(order[~later])
            part = (h[sole] % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[by], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edge)):
                i = sole[by[edge[p]:edge[p + 1]]]
                first = int(k[i].min())
                wide = max(1, (int(k[i].max()) - first).bit_length() + 7 >> 3)
                # 48 bits of the hash besides the part; every match is compared word by word later.
                blob = (bytes([wide]) + planes(h[i] // np.uint64(parts), 6)
                        + planes((k[i] - first).astype(np.int64), wide) + planes(pos[i].astype(np.int32), 4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([2], pa.int32()), pa.array([first]), pa.array([len(i)], pa.int32()), pa.array([int(p)]), pa.array([blob])],
                    ["role", "k", "pos", "first", "blob"])

    def _windows(role, k, pos, first) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(role.astype(np.int32)), pa.array(k.astype(np.int64)), pa.array(pos.astype(np.int32)),
             pa.array(first.astype(np.int64)), pa.nulls(len(k), pa.binary())], ["role", "k", "pos", "first", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            role = batch.column("role").to_numpy()
            plain = batch.filter(pa.array(role < 2))
            if plain.num_rows:
                yield plain.select(["role", "k", "pos", "first"])
            for r in batch.filter(pa.array(role == 2)).to_pylist():
                blobs.setdefault(r["first"], []).append((r["pos"], r["k"], r["blob"]))
        while blobs:  # parts are unpacked one after another
            h, k, pos = (np.concatenate(x) for x in zip(*map(_unpacked, blobs.popitem()[1])))
            order = np.lexsort((pos, k, h))
            h, k, pos = h[order], k[order], pos[order]
            head = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0))
            later = np.flatnonzero(k != k[head])
            refs = np.unique(head[later])
            for role, at in ((1, later), (0, refs)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), role, np.int32)), pa.array(k[at]), pa.array(pos[at]), pa.array(k[head[at]])],
                    ["role", "k", "pos", "first"])

    found = rows.select("k", "text").mapInArrow(spread, "role int, k long, pos int, first long, blob binary")
    # Settled windows are dealt evenly, blocks by their part.
    deal = F.when(F.col("role") == 2, F.col("first")).otherwise(F.pmod(F.xxhash64("k", "pos"), F.lit(parts)))
    return found.withColumn("deal", deal).repartition(parts, "deal").mapInArrow(
        gather, "role int, k long, pos int, first long")


def repeated_by_words(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(k, h, a, b): the windows of ``asked`` (k, h, a, words) whose words also start in a smaller document.

    The texts are read once more. A bitmap of the hashes of the asked windows names the windows that may be
    among them; these travel with their words and the smallest document of their batch, and the
    words decide. So the result is exact whatever the hashes do.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            _, codes, distinct = words(batch.column("words"))
            g = grams(word_hashes(distinct)[codes], width)[::width]
            yield pa.RecordBatch.from_arrays([pa.array((g % np.uint64(BITS)).astype(np.int64))], ["bit"])

    distinct_words = asked.select("words").distinct()
    wanted = bitmap(distinct_words.mapInArrow(hashed, "bit long"), "bit", BITS, placed=True)
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            starts, codes, distinct = words(batch.column("text"))
            every = grams(word_hashes(distinct)[codes], width)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))[:len(every)]
            bit = (every % np.uint64(BITS)).astype(np.int64)
            hit = ((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
            hit &= np.arange(len(every)) + width <= starts[doc + 1]
            k = batch.column("k").to_numpy()
            first: dict[str, int] = {}
            for at in np.flatnonzero(hit).tolist():
                window = b" ".join(distinct[c] for c in codes[at:at + width].tolist()).decode()
                first[window] = min(first.get(window, k[doc[at]]), k[doc[at]])
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.int64())],
                                             ["words", "first"])

    held = rows.select("k", "text").mapInArrow(holders, "words string, first long")
    first = held.groupBy("words").agg(F.min("first").alias("first"))
    return asked.join(first, "words").where("k > first").select("k", "h", "a", (F.col("a") + width).alias("b"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the kept words, joined by one space).

    A word goes if a window of ``width`` consecutive words covers it whose words also stand in
    a document with a smaller id; windows are judged on the input. Words are runs without ASCII
    white space, unchanged.

    1. ``repeated_windows`` names, by hash, the windows that repeat and the smallest document of
       each: the reference.
    2. The reference spans of each such document make one suffix automaton, a shard. The spans of
       other documents that may match are sent to it and streamed through it for matching
       statistics; stretches of ``width`` words or more are confirmed word by word. A
       reference that very many documents match is built in several tasks, each with
       a share of them.
    3. A window that the automaton refuses shares only its hash with the reference; another document
       may still hold its words. These windows (none, as long as no two hashes clash) are looked up
       by their words in a second pass, see ``repeated_by_words``.
    4. Confirmed stretches go back to their documents.

    Texts without a repeated window are neither shuffled nor compared. Null text has no words; a
    null id counts as smaller than any, and rows that repeat an id do not count as smaller than
    each other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NONE))
    rows = docs.select(key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(repeated_windows(rows, width), "repeat-windows")
    hot = max(50_000, found.count() // HOT_LIMIT)
    split = {r["first"]: int(-(-r["n"] // hot)) for r in found.where("role = 1").groupBy("first")
             .agg(F.count("*").alias("n")).where(F.col("n") > hot).collect()}  # at most HOT_LIMIT rows
    bits = spark.sparkContext.broadcast(np.packbits(bitmap(found, "k", BITS), bitorder="little"))
    rows = rows.withColumn("bit", F.pmod(F.xxhash64("k"), F.lit(BITS))).withColumn("h", F.xxhash64("text"))

    def marked(yes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("bit").to_numpy()
                hit = ((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                yield batch.filter(pa.array(hit == yes)).select(["k", "h", "text"])
        return run

    some = rows.mapInArrow(marked(True), "k long, h long, text string")
    other = rows.mapInArrow(marked(False), "k long, h long, text string")
    texts = some.select("k", F.lit(-1).alias("role"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("first"), "h", "text")
    flags = found.select("k", "role", "pos", "first", F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("text"))
    together = texts.unionAll(flags).repartition("k").sortWithinPartitions("k", "role", "first", "pos")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for k, held, marks in _documents(batches):
            for h, text in held:
                tokens = text.split()
                for role, first, at in marks:
                    at = at[at + width <= len(tokens)]
                    for a, b in _runs(np.unique(at), width):
                        n = split.get(first, 1)
                        for salt in range(n) if role == 0 else (_share(k, a, n),):
                            out.append((first, salt, role, k, h, a, b" ".join(tokens[a:b]).decode()))
                            size += b - a
                        if size > 300_000:
                            yield _table(out, SPANS)
                            out, size = [], 0
        yield _table(out, SPANS)

    shards = (together.mapInArrow(spans, SPANS_DDL).repartition("first", "salt")
              .sortWithinPartitions("first", "salt", "role", "k", "h", "a"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, Automaton()
        for batch in batches:
            out = []
            for first, salt, role, k, h, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != (first, salt):
                    shard, automaton = (first, salt), Automaton()
                if role == 0:
                    automaton.add(text.split(" "))
                else:
                    tokens = text.split(" ")
                    refused = np.ones(len(tokens) - width + 1, bool)
                    for x, y in automaton.matches(tokens, width):
                        out.append((k, h, a + x, a + y, None))
                        refused[x:y - width + 1] = False
                    out += [(k, h, a + x, None, " ".join(tokens[x:x + width])) for x in np.flatnonzero(refused).tolist()]
            yield _table(out, JUDGED)

    judged = stored(shards.mapInArrow(confirm, "k long, h long, a int, b int, words string"), "repeat-judged")
    confirmed, refused = judged.where("words IS NULL").drop("words"), judged.where("words IS NOT NULL")
    if not refused.isEmpty():
        confirmed = confirmed.unionAll(repeated_by_words(rows, refused, width))
    marks = confirmed.select("k", "h", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("string").alias("text"))
    back = (some.select("k", "h", F.lit(0).alias("role"), F.lit(0).alias("a"), F.lit(0).alias("b"), "text").unionAll(marks)
            .repartition("k", "h").sortWithinPartitions("k", "h", "role", "a"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, stretches = None, [], []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            for text in held:
                tokens = text.split()
                keep = np.ones(len(tokens), bool)
                for a, b in stretches:
                    keep[a:b] = False
                kept = b" ".join([w for w, y in zip(tokens, keep.tolist()) if y]).decode()
                out.append((doc[0], len(tokens), len(tokens) - int(keep.sum()), kept))

        for batch in batches:
            for k, h, role, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != (k, h):
                    close()
                    doc, held, stretches = (k, h), [], []
                if role == 0:
                    held.append(text.encode())
                    size += len(text)
                else:
                    stretches.append((a, b))
                if size > 2 << 20:
                    yield _table(out, KEPT)
                    out, size = [], 0
        close()
        yield _table(out, KEPT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens = [t.encode().split() for t in batch.column("text").to_pylist()]
            yield _table([(k, len(w), 0, b" ".join(w).decode()) for k, w in zip(batch.column("k").to_pylist(), tokens)], KEPT)

    ddl = "k long, n_words long, n_removed long, kept string"
    result = back.mapInArrow(remove, ddl).unionAll(other.mapInArrow(whole, ddl))
    kind = docs.schema[id_col].dataType
    return result.select(F.when(F.col("k") != NONE, F.col("k")).cast(kind).alias(id_col), "n_words", "n_removed", "kept")


SPANS = pa.schema([("first", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("k", pa.int64()),
                   ("h", pa.int64()), ("a", pa.int32()), ("text", pa.string())])
SPANS_DDL = "first long, salt int, role int, k long, h long, a int, text string"
JUDGED = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("words", pa.string())])
KEPT = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _share(k: int, at: int, n: int) -> int:
    return (k * 1_000_003 + at) % n


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(k, [(h, text)], [(role, first, positions)]) of each document, from rows sorted by document."""
    k, held, marks = None, [], []
    for batch in batches:
        ks = batch.column("k").to_numpy()
        role, first = batch.column("role").to_numpy(), batch.column("first").to_numpy()
        pos = batch.column("pos").to_numpy()
        if not len(ks):
            continue
        same = (ks[1:] == ks[:-1]) & (role[1:] == role[:-1]) & (first[1:] == first[:-1]) & (role[1:] >= 0)
        edges = np.r_[0, np.flatnonzero(~same) + 1, len(ks)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if ks[a] != k:
                if k is not None:
                    yield k, held, _joined(marks)
                k, held, marks = int(ks[a]), [], []
            if role[a] < 0:
                held.append((batch.column("h")[a].as_py(), batch.column("text")[a].as_py().encode()))
            else:
                marks.append((int(role[a]), int(first[a]), pos[a:b]))
    if k is not None:
        yield k, held, _joined(marks)


def _joined(marks: list[tuple]) -> list[tuple]:
    """Marks of one role and reference that two batches have cut are put together again."""
    out: list[tuple] = []
    for role, first, at in marks:
        if out and out[-1][:2] == (role, first):
            out[-1] = (role, first, np.concatenate([out[-1][2], at]))
        else:
            out.append((role, first, at))
    return out
