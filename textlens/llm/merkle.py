"""Merkle manifest of a dataset, with persistent versions of tampered rows.

A row's digest is a leaf; the leaves of a partition (a *tree*) stand in order,
and every ``fanout`` consecutive nodes become the digest above them until one
is left.  The roots of the trees are the leaves of one more tree.

A tree is cut into aligned blocks of ``fanout ** block_levels`` leaves, and a
block is one small group wherever its rows are: a partition that holds a third
of the table is many blocks.  The blocks' tops are the leaves of the next
distributed round, so some thousand million rows take three rounds.

Within a block the tree is persistent: a tampered leaf creates a version that
copies the leaf's ancestors only and shares every other node with the
original.  Above the block, the version goes on by copying the ancestors of
the block's top, and so on to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, stored

#: Consecutive nodes that become one.
FANOUT = 2
#: Levels of a block: 1,024 leaves of a binary tree.
BLOCK_LEVELS = 10
#: Rows of a sorted range at most, on average.
RANGE_ROWS = 2_000_000

_PROOF = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_above(n: int, fanout: int = FANOUT) -> int:
    """Levels from ``n`` nodes up to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class PathCopyTree:
    """Persistent tree over the nodes of one block.

    ``levels[0]`` are the given nodes.  Version 0 is the original; a further
    version holds the copied path of one changed leaf and shares the rest.
    """

    def __init__(self, nodes: list[str], levels: int, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels = [list(nodes)]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
        self.paths: list[tuple[int, list[str]]] = []

    def change(self, at: int, leaf: str) -> int:
        """A new version in which leaf ``at`` is ``leaf``; its number."""
        path, i = [leaf], at
        for level in self.levels[:-1]:
            first = i - i % self.fanout
            run = level[first : first + self.fanout]
            run[i - first] = path[-1]
            path.append(digest("".join(run)))
            i //= self.fanout
        self.paths.append((at, path))
        return len(self.paths)

    def node(self, version: int, level: int, i: int) -> str:
        if version:
            at, path = self.paths[version - 1]
            if at // self.fanout**level == i:
                return path[level]
        return self.levels[level][i]

    def top(self, version: int = 0) -> str:
        return self.node(version, len(self.levels) - 1, 0)

    def siblings(self) -> tuple[list[list[str]], list[list[str]]]:
        """What stands left and right of each node in its run, level by level."""
        f, left, right = self.fanout, [], []
        for level in self.levels[:-1]:
            left.append(["".join(level[i - i % f : i]) for i in range(len(level))])
            right.append(["".join(level[i + 1 : i - i % f + f]) for i in range(len(level))])
        return left, right


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its bytes' number,
    ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows(tree, ...)`` with ``n`` (rows of the tree) and ``pos`` (place
    among them by ``order``, from 0).

    Rows are range-sorted and stored with their range; a range's offset within
    a tree comes from a table of one row per (tree, range), so no tree is one
    group.  ``row`` breaks ties: equal rows spread over ranges too.
    """
    spark = rows.sparkSession
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), name)
    parts = max(default_partitions(spark), rows.count() // RANGE_ROWS + 1)
    by = [F.col("tree"), *order, F.col("row")]
    ranged = (rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
              .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    ranged = stored(ranged, name + "-sorted")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "part", F.sum("held").over(tree).alias("n"),
                           (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift", "row")


def _tops(levels: int, fanout: int) -> Callable[[pa.Table], pa.Table]:
    """The top of each block."""
    def run(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("pos").to_numpy())
        nodes = block.column("node").take(order).to_pylist()
        n = block.column("n")[0].as_py()
        tree = PathCopyTree(nodes, min(levels, levels_above(n, fanout)), fanout)
        return pa.table({"tree": block.column("tree")[:1], "n": pa.array([-(-n // fanout**levels)], pa.int64()),
                         "pos": block.column("block")[:1], "node": pa.array([tree.top()])})
    return run


def _proofs(levels: int, fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The proofs of a block's nodes and the tops of its versions, continued
    along the proof of the block's own top."""
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.take(np.argsort(block.column("pos").to_numpy()))
        nodes = block.column("node").to_pylist()
        tree = PathCopyTree(nodes, min(levels, levels_above(block.column("n")[0].as_py(), fanout)), fanout)
        on = [(step["left"], step["right"]) for step in above.column("proof")[0].as_py()]
        versions: list[str | None] = []
        for at, leaf in enumerate(block.column("changed").to_pylist()):
            top = None
            if leaf is not None:
                top = tree.top(tree.change(at, leaf))
                for left, right in on:
                    top = digest(left + top + right)
            versions.append(top)
        left, right = tree.siblings()
        lefts, rights = [], []
        for at in range(len(nodes)):
            for up in range(len(left)):
                lefts.append(left[up][at // fanout**up])
                rights.append(right[up][at // fanout**up])
            lefts.extend(s[0] for s in on)
            rights.extend(s[1] for s in on)
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
        offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * (len(left) + len(on)))
        n = len(nodes)
        return pa.table({"tree": block.column("tree"), "pos": block.column("pos"), "doc_id": block.column("doc_id"),
                         "node": block.column("node"), "proof": pa.ListArray.from_arrays(offsets, steps),
                         "version_root": pa.array(versions, pa.string()),
                         "subroot": pa.array(above.column("subroot").to_pylist() * n, pa.string()),
                         "root": pa.array(above.column("root").to_pylist() * n, pa.string())})
    return run


_PROVED = f"tree string, pos long, doc_id long, node string, proof {_PROOF}, version_root string, subroot string, root string"


def proved(nodes: DataFrame, at_top: Callable[[DataFrame], DataFrame], fanout: int, block_levels: int) -> DataFrame:
    """``nodes(tree, n, pos, doc_id, node, changed)`` with proofs.

    ``at_top`` continues the rows ``(tree, node)`` of the trees' roots: it
    gives ``tree, proof, subroot, root``.
    """
    if nodes.where("n > 1").limit(1).count() == 0:
        lone = nodes.join(at_top(nodes.select("tree", "node")), "tree")
        version = folded(F.col("changed"), F.col("proof"))
        return lone.select("tree", "pos", "doc_id", "node", "proof", version.alias("version_root"), "subroot", "root")
    keyed = nodes.withColumn("block", F.expr(f"pos div {fanout**block_levels}"))
    tops = keyed.select("tree", "n", "pos", "block", "node").groupBy("tree", "block").applyInArrow(
        _tops(block_levels, fanout), "tree string, n long, pos long, node string")
    tops = stored(tops, "merkle-tops").withColumn("doc_id", F.lit(None).cast("long")).withColumn("changed", F.lit(None).cast("string"))
    above = proved(tops, at_top, fanout, block_levels)
    above = stored(above.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root"), "merkle-above")
    return keyed.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(
        _proofs(block_levels, fanout), _PROVED)


def manifest(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest of ``leaves(tree, doc_id, leaf, changed)``.

    ``tree`` names the row's tree (not null; trees are ordered by it), leaves
    of a tree ascend by ``doc_id`` (a null id first, equal ids by their leaf);
    ``changed`` is the leaf of the tampered row, null where there is none.
    Returns ``doc_id, leaf``, ``proof`` (for each level up to the root, what
    stands left and right of the node in its run), ``version_root`` (root of
    the version that a changed leaf creates), ``subroot`` and ``root``.  A
    single leaf is its tree's root, a single tree's root is the root, and their
    proofs are empty.  Repeated rows are leaves of their own; an empty table
    gives no rows.
    """
    leaves = leaves.select("tree", "doc_id", F.col("leaf").alias("node"), "changed")
    nodes = stored(numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("node")], "merkle-leaves"), "merkle-numbered")

    def roots(tops: DataFrame) -> DataFrame:
        rows = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
        rows = stored(numbered(rows, [F.col("name")], "merkle-roots"), "merkle-roots-numbered")
        ids = rows.withColumn("doc_id", F.lit(None).cast("long")).withColumn("changed", F.lit(None).cast("string"))
        up = proved(ids, lambda top: top.select("tree", F.array().cast(_PROOF).alias("proof"), F.col("node").alias("subroot"),
                                                F.col("node").alias("root")), fanout, block_levels)
        up = up.select("pos", "proof", "root")
        return stored(rows.join(up, "pos").select(F.col("name").alias("tree"), "proof", F.col("node").alias("subroot"), "root"),
                      "merkle-roots-proved")

    rows = proved(nodes, roots, fanout, block_levels)
    return rows.select("doc_id", F.col("node").alias("leaf"), "proof", "version_root", "subroot", "root")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs(doc_id, source, lang, n_chars, text)``, a tree per
    language (null first, then by bytes).  Where 7 divides the crc32 of the
    decimal id, the tampered row has one character more (null stays null); a
    row without an id is not tampered.  Other columns are ignored."""
    def leaf(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    count = F.col("n_chars").cast("decimal(38,0)")  # one more than the largest long, too
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), "doc_id",
                       leaf(count).alias("leaf"), F.when(tampered, leaf(count + 1)).alias("changed"))


def verify_documents(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``manifest`` of ``document_leaves`` with ``folded_root`` (a tampered
    row's version root, else the root that its leaf and proof give) and
    ``verified`` (whether that is the root)."""
    rows = manifest(document_leaves(docs), fanout, block_levels)
    rows = rows.withColumn("folded_root", F.coalesce("version_root", folded(F.col("leaf"), F.col("proof"))))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
