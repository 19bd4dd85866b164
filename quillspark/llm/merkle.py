"""Merkle manifest of a dataset: trees of arity 8 with a membership proof for every row.

A block of 4,096 consecutive nodes is appended node by node to a frontier of open subtrees. Every
node that enters carries a witness; whenever a subtree closes, the witnesses below it are extended by
the siblings that it now has. The roots of the blocks are appended to the next frontier in the same
way, until one node of a tree is left. Blocks of one tree are independent tasks, and what travels
between the levels is one root upwards and one path downwards for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_bytes, stored

ARITY = 8
LEVELS = 4  # tree levels inside a block, so a block has 4,096 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A path: the siblings to the left and to the right of the running node, level by level.
PATH = "array<struct<l: string, r: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


class Frontier:
    """Aligned append: the open subtree of each level, and the witnesses of what is below it.

    ``append`` takes the next node with its member numbers; ``close`` raises what is open. A
    witness is a list of (left siblings, right siblings) from the node upwards.
    """

    def __init__(self, size: int, levels: int | None):
        self.open: list[list[tuple[str, list[int]]]] = [[]]
        self.paths: list[list[tuple[str, str]]] = [[] for _ in range(size)]
        self.levels = levels

    def append(self, node: str, member: int) -> None:
        self._put(0, node, [member])

    def _put(self, level: int, node: str, members: list[int]) -> None:
        if len(self.open) == level:
            self.open.append([])
        self.open[level].append((node, members))
        # The topmost level stays open until ``close`` knows whether a sibling follows.
        if len(self.open[level]) == ARITY and level != self.levels:
            self._shut(level)

    def _shut(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, members) in enumerate(run):
            step = "".join(nodes[:i]), "".join(nodes[i + 1:])
            for member in members:
                self.paths[member].append(step)
        self._put(level + 1, digest("".join(nodes)), [m for _, members in run for m in members])

    def close(self) -> str:
        """Raise the last, shorter runs: to the fixed level, or until one node is left."""
        level = 0
        while level != self.levels and (
                self.levels is not None or len(self.open[level]) > 1 or any(self.open[level + 1:])):
            if self.open[level]:
                self._shut(level)
            level += 1
        return self.open[level][0][0]


def _build(nodes: list[str], levels: int | None) -> tuple[str, list[list[tuple[str, str]]]]:
    tree = Frontier(len(nodes), levels)
    for member, node in enumerate(nodes):
        tree.append(node, member)
    return tree.close(), tree.paths


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a node and its siblings."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``df`` with its position inside each key (``at``) and the key's row count (``n``).

    Rows are dealt over sorted ranges of (key, order), so a key with a third of all rows lies in
    many tasks; the counts by (range, key) are prefix-summed. ``order`` must end in a column
    that splits equal rows, and ``df`` must be a stored table, because ranges are sampled.
    """
    spark = df.sparkSession
    parts = max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    ranged = stored(ranged, f"{label}-ranged")
    counts = ranged.groupBy(key, "_pid").agg(F.min("_row").alias("_first"), F.count("*").alias("_c"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_pid", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_off"),
                           F.sum("_c").over(whole).alias("n"))
    return ranged.join(starts, [key, "_pid"]).withColumn("at", F.col("_row") + F.col("_off")).drop(
        "_pid", "_row", "_off")


def _heights(n: int, levels: int) -> int | None:
    """Levels that a block is raised: all of a larger tree's blocks alike, a tree's only block to its root."""
    return None if n <= ARITY ** levels else levels


def _packer(levels: int):
    def pack(pdf):
        """A block's nodes as one row: its digests, what they carry, and its root."""
        pdf = pdf.sort_values("at", kind="stable")
        root, _ = _build(pdf["node"].tolist(), _heights(pdf["n"].iloc[0], levels))
        row = pdf.iloc[:1][["tree", "block", "n"]].assign(
            nodes=b"".join(bytes.fromhex(x) for x in pdf["node"]), root=root)
        for name in pdf.columns.difference(["tree", "block", "at", "n", "node"]):
            row[name] = [pdf[name].tolist()]
        return row
    return pack


def blocks(nodes: DataFrame, levels: int, label: str) -> DataFrame:
    """One row per block of positions of a tree: its digests in order, its root, and lists of the
    string columns that the nodes carry."""
    carried = [c for c in nodes.columns if c not in ("tree", "at", "n", "node")]
    placed = nodes.withColumn("block", F.expr(f"at div {ARITY ** levels}"))
    schema = "tree string, block bigint, n bigint, nodes binary, root string"
    return stored(placed.groupBy("tree", "block").applyInPandas(
        _packer(levels), schema + "".join(f", {c} array<string>" for c in carried)), f"{label}-blocks")


def _unpacked(row: dict, levels: int):
    """(digests, their steps inside the block, the steps above it) of a packed block."""
    raw = row["nodes"]
    nodes = [raw[i:i + 32].hex() for i in range(0, len(raw), 32)]
    return nodes, _build(nodes, _heights(row["n"], levels))[1], [(s["l"], s["r"]) for s in row["above"]]


_OPENED = f"tree string, at bigint, node string, sub string, carried string, path {PATH}"


def _opener(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of blocks with their whole paths: the block's own steps, then those above it."""
        for batch in batches:
            for row in batch.to_pylist():
                nodes, own, above = _unpacked(row, levels)
                size = len(nodes)
                steps = [[{"l": left, "r": right} for left, right in (*path, *above)] for path in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * size), pa.array(np.arange(size) + row["block"] * ARITY ** levels),
                     pa.array(nodes), pa.array([row["sub"]] * size),
                     pa.array(row.get("of") or [None] * size, pa.string()),
                     pa.array(steps, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))],
                    names=["tree", "at", "node", "sub", "carried", "path"])
    return run


def forest(nodes: DataFrame, levels: int, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """(root of each tree, its rounds of blocks from the bottom up) of nodes with tree, at, n, node.

    Each round appends the roots of the last one's blocks as nodes, a 4,096th of them.
    """
    size, rounds = ARITY ** levels, []
    while True:
        made = blocks(nodes, levels, f"{label}-{len(rounds)}")
        rounds.append(made)
        over = made.where(F.col("n") > size)
        if over.isEmpty():
            break
        nodes = over.select("tree", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
                            F.col("root").alias("node"))
    ends = [made.where(F.col("n") <= size).select("tree", F.col("root").alias("sub")) for made in rounds]
    return stored(reduce(DataFrame.unionAll, ends), f"{label}-roots"), rounds


def paths(rounds: list[DataFrame], tops: DataFrame, levels: int, label: str) -> DataFrame:
    """Blocks of the first round with ``above``, the path from their root on, and ``sub``.

    ``tops`` holds each tree's root (``sub``) and the path from it on (``path``). Going down, a block
    takes the path of the node that it is in the block above; the topmost takes its tree's.
    """
    size, above = ARITY ** levels, None
    for depth in range(len(rounds) - 1, -1, -1):
        joined = rounds[depth].where(F.col("n") <= size).join(
            tops.select("tree", "sub", F.col("path").alias("above")), "tree")
        if above is not None:
            joined = joined.unionByName(rounds[depth].where(F.col("n") > size).join(
                above.select("tree", F.col("at").alias("block"), "sub", F.col("path").alias("above")),
                ["tree", "block"]))
        if depth:
            above = stored(joined.mapInArrow(_opener(levels), _OPENED), f"{label}-path-{depth}")
    return joined


def _proofs(root: str, levels: int):
    """Rows of a block's leaves with their proofs, folded roots and verdicts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, lower, above = _unpacked(row, levels)
                tail = "".join(left + right for left, right in above)
                proof = [digest("".join(left + right for left, right in path) + tail) for path in lower]
                folded = [fold(fold(bad or node, path), above)
                          for node, bad, path in zip(nodes, row["bad"], lower)]
                size = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["id"], pa.string()), pa.array(nodes), pa.array([row["sub"]] * size),
                     pa.array([root] * size), pa.array(proof), pa.array(folded),
                     pa.array([f == root for f in folded])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


_PROOF = ("leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None,
             where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per input row: its id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are hashes of the encoded ``fields``; each value of ``group_col`` is a tree of its leaves by
    ascending id, and the trees' roots, by group (null first, then by UTF-8 bytes), are the leaves of
    the tree over them. ``tampered`` replaces fields in rows matching ``where``: their proofs are folded
    from the changed leaf, so ``verified`` tells whether the change is noticed. Without it every row
    is folded from its own leaf.

    Null values are encoded as such; a null id comes first in its tree, a null group is a tree of
    its own, before all others. Equal ids are ordered by their leaf, and rows equal in all fields are
    leaves beside each other, each with a proof. Columns that are not read may have any name.
    An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    tampered = tampered or {}
    leaf = leaf_hash(*[F.col(f) for f in fields])
    bad = leaf_hash(*[tampered.get(f, F.col(f)) for f in fields])
    hit = F.lit(False) if where is None or not tampered else F.coalesce(where, F.lit(False))
    # A null group sorts before every other: 'n' before 's...'.
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    leaves = stored(docs.select(F.col(id_col).alias("_id"), tree.alias("tree"), leaf.alias("node"),
                                F.when(hit, bad).alias("bad"), F.monotonically_increasing_id().alias("_tie")),
                    "merkle-leaves")
    if leaves.isEmpty():
        return docs.limit(0).selectExpr(f"`{id_col}`", *[
            f"CAST(NULL AS {part.split()[1]}) AS {part.split()[0]}" for part in _PROOF.split(", ")])
    placed = numbered(leaves, "tree", ["_id", "node", "_tie"], "merkle").select(
        "tree", "at", "n", "node", F.col("_id").cast("string").alias("id"), "bad")
    with batch_bytes(spark):
        subs, rounds = forest(placed, levels, "merkle")
        tops = stored(subs.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("sub").alias("node")),
                      "merkle-subs")
        upper_nodes = numbered(tops, "tree", ["of"], "merkle-top").select("tree", "at", "n", "node", "of")
        whole, upper = forest(upper_nodes, levels, "merkle-top")
        root = whole.first()["sub"]
        ends = whole.select("tree", "sub", F.expr(f"CAST(array() AS {PATH})").alias("path"))
        by_tree = stored(
            paths(upper, ends, levels, "merkle-top").mapInArrow(_opener(levels), _OPENED)
            .select(F.col("carried").alias("tree"), F.col("node").alias("sub"), "path"), "merkle-tree-paths")
        proven = stored(paths(rounds, by_tree, levels, "merkle").mapInArrow(_proofs(root, levels), f"id string, {_PROOF}"),
                        "merkle-proofs")
    return proven.select(F.col("id").cast(kind).alias(id_col), *[part.split()[0] for part in _PROOF.split(", ")])
