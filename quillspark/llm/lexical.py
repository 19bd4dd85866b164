"""Ranked lexical search of all documents for a set of items, exact, by dual-tree search.

Items and documents are kept as sparse vectors over the items' terms: an item's coordinate is its
terms' weight, a document's the saturated frequency. Both sides form hierarchies whose nodes hold the
largest coordinates below them, so the product of two nodes bounds every score between them. A node
pair whose bound stays below the weakest kth score of the node's items is left with all that is below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_bytes, pieces, stored

TOP = 20
FAN = 4             # children of a node
BATCH = 4096        # documents of one hierarchy
EXPAND = 4 << 20    # products formed at a time
BLOCK_BYTES = 1 << 20  # text of the items that are searched for in one pass

# ASCII letters and digits and every byte of a longer character belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order; only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies; ``size`` is the number of terms of each entry's document."""
    m = 75 + 25 * size * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several runs, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of (node, term) with their largest value, ordered by node and term."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])))[:len(node)])
    top = np.maximum.reduceat(value, first) if len(first) else value
    return node[first], term[first], top


class Hierarchy:
    """Levels of (node, term, value); level 0 are the rows themselves, the last has at most ``FAN`` nodes."""

    def __init__(self, rows: int, node: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.sizes, self.levels = [rows], [_maxima(node, term, value)]
        while self.sizes[-1] > FAN:
            node, term, value = self.levels[-1]
            self.levels.append(_maxima(node // FAN, term, value))
            self.sizes.append(-(-self.sizes[-1] // FAN))


class Items:
    """The items' hierarchy, stored by term, and the best documents found for each item so far."""

    def __init__(self, tree: Hierarchy, n_terms: int, k: int):
        self.sizes, self.k, self.postings = tree.sizes, k, []
        for node, term, value in tree.levels:
            order = np.argsort(term, kind="stable")
            self.postings.append((np.searchsorted(term[order], np.arange(n_terms + 1)), node[order], value[order]))
        n = tree.sizes[0]
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, bool)
        self.kth = np.ones(n, np.int64)  # a score of 0 is never returned
        self.scored = 0

    def weakest(self, level: int) -> np.ndarray:
        """Smallest kth score of the items below each node of a level."""
        low = self.kth
        for _ in range(level):
            low = np.minimum.reduceat(low, np.arange(0, len(low), FAN))
        return low

    def bounds(self, level: int, rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray,
               mask: np.ndarray) -> np.ndarray:
        """Products of document entries with all item nodes of a level, where ``mask`` allows them."""
        ptr, nodes, weights = self.postings[level]
        width = self.sizes[level]
        out = np.zeros(rows * width, np.int64)
        count = ptr[term + 1] - ptr[term]
        ends = np.cumsum(count)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND, side="right")))
            pick = spans(ptr[term[at:to]], count[at:to])
            cell = np.repeat(row[at:to], count[at:to]) * width + nodes[pick]
            product = np.repeat(value[at:to], count[at:to]) * weights[pick]
            use = mask.reshape(-1)[cell]
            np.add.at(out, cell[use], product[use])
            at = to
        return out.reshape(rows, width)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Keep each item's k best: by score, then by id, rows without id last."""
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, score))
        doc, null = np.concatenate((self.doc, doc)), np.concatenate((self.null, null))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.sizes[0]))
        keep = np.arange(len(item)) - first[item] < self.k
        order, self.item = order[keep], item[keep]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        full = np.searchsorted(self.item, np.arange(self.sizes[0] + 1))
        has = np.diff(full) == self.k
        self.kth[has] = np.maximum(self.score[full[1:][has] - 1], 1)


def search(items: Items, docs: Hierarchy, ids: np.ndarray, null: np.ndarray) -> None:
    """Take one hierarchy of documents into the items' best lists.

    Top nodes of documents are visited from the highest bound down. Below each, both sides
    descend together, and the thresholds in force are those that the nodes before have left.
    """
    depth = len(docs.levels)
    starts = [np.searchsorted(node, np.arange(size + 1)) for (node, _, _), size in zip(docs.levels, docs.sizes)]

    def product(level: int, nodes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the nodes at a level, and which item nodes may still gain from them."""
        beside = min(level, len(items.sizes) - 1)
        begin = starts[level][nodes]
        length = starts[level][nodes + 1] - begin
        pick = spans(begin, length)
        _, term, value = docs.levels[level]
        bound = items.bounds(beside, len(nodes), np.repeat(np.arange(len(nodes)), length), term[pick], value[pick], mask)
        return bound, mask & (bound >= items.weakest(beside))

    top = depth - 1
    width = items.sizes[min(top, len(items.sizes) - 1)]
    bound, _ = product(top, np.arange(docs.sizes[top]), np.ones((docs.sizes[top], width), bool))
    for head in np.argsort(-bound.max(axis=1, initial=0), kind="stable"):
        nodes = np.array([head])
        alive = (bound[nodes] >= items.weakest(min(top, len(items.sizes) - 1)))
        scores = bound[nodes]
        for level in range(top - 1, -1, -1):
            some = alive.any(axis=1)
            nodes, alive = nodes[some], alive[some]
            if not len(nodes):
                break
            below = nodes[:, None] * FAN + np.arange(FAN)
            real = below < docs.sizes[level]
            parent = np.repeat(np.arange(len(nodes)), FAN)[real.reshape(-1)]
            nodes = below[real]
            beside, over = min(level, len(items.sizes) - 1), min(level + 1, len(items.sizes) - 1)
            mask = alive[parent]
            if beside != over:
                mask = mask[:, np.arange(items.sizes[beside]) // FAN]
            scores, alive = product(level, nodes, mask)
            if level == 0:
                items.scored += int(mask.sum())
        if top == 0:
            items.scored += alive.size
        row, item = np.nonzero(alive) if len(nodes) else (np.zeros(0, int), np.zeros(0, int))
        if len(row):
            items.add(item, scores[row, item], ids[nodes[row]], null[nodes[row]])


def _vectors(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as their term count and the item terms they hold, with frequencies."""
        known = vocabulary.get
        for batch in pieces(batches, "_text"):
            size, ptr, ids, freqs = [], [0], [], []
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                found = terms(text)
                counts: dict[int, int] = {}
                for number in map(known, found):
                    if number is not None:
                        counts[number] = counts.get(number, 0) + 1
                size.append(len(found))
                ids.extend(counts)
                freqs.extend(counts.values())
                ptr.append(len(ids))
            offsets = pa.array(ptr, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(freqs, pa.int32()))],
                names=["id", "size", "term", "tf"])
    return run


def _axis(row: np.ndarray, term: np.ndarray, rows: int, n_terms: int, rounds: int = 30) -> np.ndarray:
    """A coordinate that lies close for rows that share terms, by repeated averaging over rows and
    terms: texts of one language or topic come to lie together."""
    of_row, of_term = np.bincount(row, minlength=rows), np.bincount(term, minlength=n_terms)
    x = np.random.default_rng(0).standard_normal(rows)
    for _ in range(rounds if len(row) else 0):
        mean = np.bincount(term, x[row], minlength=n_terms) / np.maximum(of_term, 1)
        x = np.bincount(row, mean[term], minlength=rows) / np.maximum(of_row, 1)
        x -= x @ of_row / len(row)
        x /= max(math.sqrt(x * x @ of_row / len(row)), 1e-12)
    return x


def _item_tree(bags: list[dict[int, int]], weights: np.ndarray) -> tuple[Hierarchy, np.ndarray]:
    """The items' hierarchy, items that share terms beside each other, and the item at each row."""
    row = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    term = np.array([t for bag in bags for t in bag], np.int64)
    value = np.array([q for bag in bags for q in bag.values()], np.int64) * weights[term]
    order = np.argsort(_axis(row, term, len(bags), len(weights)), kind="stable")
    place = np.empty(len(bags), np.int64)
    place[order] = np.arange(len(bags))
    some = value > 0
    return Hierarchy(len(bags), place[row[some]], term[some], value[some]), order


def doc_tree(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int,
             weights: np.ndarray) -> tuple[Hierarchy, np.ndarray]:
    """A hierarchy of documents, and the document at each of its rows: those that share the term
    they would gain most by lie beside each other."""
    order = np.lexsort((-value * weights[term], row))
    first = np.searchsorted(row[order], np.arange(rows))
    lead = np.full(rows, -1, np.int64)
    has = np.bincount(row, minlength=rows) > 0
    lead[has] = term[order][first[has]]
    seat = np.argsort(lead, kind="stable")
    place = np.empty(rows, np.int64)
    place[seat] = np.arange(rows)
    return Hierarchy(rows, place[row], term, value), seat


def _searcher(tree: Hierarchy, numbers: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of this task for each item."""
        items = Items(tree, len(weights), k)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids = batch.column("id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                number = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                lists = batch.column("term")
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = batch.column("size").to_numpy(zero_copy_only=False)
                value = impacts(tf, np.repeat(size, length), n_docs, n_terms)
                docs, seat = doc_tree(np.repeat(np.arange(batch.num_rows), length), term, value,
                                      batch.num_rows, weights)
                search(items, docs, number[seat], null[seat])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[items.item]), pa.array(items.score), pa.array(items.doc, mask=items.null)],
            names=["item", "score", "doc_id"])
    return run


def _blocks(items: DataFrame, max_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as (number, terms), in lists of at most ``max_bytes`` of text, one item at least."""
    block, used = [], 0
    for row in items.select("item", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(row["text"] or b"")
        if block and used + len(text) > max_bytes:
            yield block
            block, used = [], 0
        block.append((row["item"], terms(text)))
        used += len(text)
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; equal scores by ascending id.

    Items are taken in blocks of bounded text, and each block is searched for in all documents: one
    pass writes the documents' sparse vectors over the block's terms, which also give the counts
    that weights need, a second one searches them. What is broadcast is a block's items; what a task returns
    is k rows for each of them.

    Null texts have no terms: such documents are never found, such items find nothing. Rows that repeat
    an item are items of their own, rows that repeat a document are documents of their own. Ids are
    integers; a null id comes after all others of its score. Empty tables give no rows, further columns may
    have any name.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("_item"),
                                F.col(item_text).alias("text")), "lexical-items")
    kind = docs.schema[id_col].dataType.simpleString()
    found = []
    with batch_bytes(spark):
        for block in _blocks(asked, block_bytes):
            vocabulary: dict[bytes, int] = {}
            bags: list[dict[int, int]] = []
            for _, words in block:
                bag: dict[int, int] = {}
                for word in words:
                    number = vocabulary.setdefault(word, len(vocabulary))
                    bag[number] = bag.get(number, 0) + 1
                bags.append(bag)
            vectors = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
                _vectors(vocabulary), f"id {kind}, size bigint, term array<int>, tf array<int>")
            vectors = stored(vectors.where("size > 0"), "lexical-vectors")
            n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            df = np.zeros(len(vocabulary) + 1, np.int64)
            for row in vectors.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
                df[row["t"]] = row["count"]
            weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
            tree, order = _item_tree(bags, weights)
            numbers = np.array([number for number, _ in block], np.int64)[order]
            best = vectors.where(F.size("term") > 0).mapInArrow(
                _searcher(tree, numbers, weights, n_docs, n_terms, k), "item bigint, score bigint, doc_id bigint")
            found.append(stored(best.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64))), "lexical-best"))
    if not found:
        found.append(asked.limit(0).selectExpr("item", "item AS score", "item AS doc_id", "0 AS share"))
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Two steps: an item's rows of all tasks never meet unless they are among its share's best.
    for keys in (["item", "share"], ["item"]):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(
            F.col("rank") <= k)
    return every.join(asked.select("item", "_item"), "item").select(
        F.col("_item").alias(item_col), "rank", F.col("doc_id").cast(kind).alias(id_col), "score")
