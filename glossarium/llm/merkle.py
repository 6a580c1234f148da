"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, and for every row a proof.

Leaves are numbered in their group (ranks.py) and dealt out in aligned blocks of FAN ** HEIGHT.  A block is walked recursively in
postorder: a subtree returns its digest, and while the recursion unwinds, the siblings of each node are appended to the proofs of
the leaves it contains.  The digests of the blocks are the leaves of the next, much smaller traversal, until every group has one;
these are the leaves of the last tree.  On the way back down each block is walked once more, and its leaves' proofs are continued
by the proof of the block.  A task holds one block and the proof of its root; a group of any size lies in many blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, settled
from .ranks import ranked

#: Children of a node, and levels of a block.
FAN, HEIGHT = 16, 2
BLOCK = FAN**HEIGHT
PROOF = "array<struct<left: string, right: string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest_of(texts: Iterable[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def leaf(columns: Sequence[str | Column]) -> Column:
    """Digest of a row: of each column `-` if it is null, else the number of bytes of its text, `:` and the text."""
    texts = [(named(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(leaf_col: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf_col, lambda have, s: F.sha2(F.concat(s["left"], have, s["right"]), 256))


def height_of(size: int) -> int:
    """Levels of a block in a tree of `size` nodes: all of them in a tree of several blocks, else until one node is left."""
    height = 0
    while size > 1 and height < HEIGHT:
        size, height = -(-size // FAN), height + 1
    return height


def walk(leaves: Sequence[str], height: int, proofs: Sequence[list] | None = None) -> str:
    """The digest of the subtree of this height over all leaves; `proofs` get the siblings, from the lowest level up."""

    def climb(at: int, height: int) -> str:
        if not height:
            return leaves[at]
        step = FAN ** (height - 1)
        starts = range(at, min(at + FAN * step, len(leaves)), step)
        own = [climb(s, height - 1) for s in starts]
        if proofs is not None:
            for k, s in enumerate(starts):
                siblings = {"left": "".join(own[:k]), "right": "".join(own[k + 1 :])}
                for i in range(s, min(s + step, len(leaves))):
                    proofs[i].append(siblings)
        return digest_of(own)

    return climb(0, height)


def _root(block: pa.Table) -> pa.Table:
    block = block.sort_by("rank")
    size = block.column("size")[0].as_py()
    digest = walk(block.column("digest").to_pylist(), height_of(size))
    row = {"tree": block.column("tree")[0].as_py(), "rank": block.column("block")[0].as_py(), "size": -(-size // BLOCK), "digest": digest}
    return pa.table({k: [v] for k, v in row.items()}, pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))


def _unwind(block: pa.Table, above: pa.Table) -> pa.Table:
    block = block.sort_by("rank")
    proofs: list[list] = [[] for _ in range(block.num_rows)]
    walk(block.column("digest").to_pylist(), height_of(block.column("size")[0].as_py()), proofs)
    rest = above.column("proof")[0].as_py()
    block = block.append_column("proof", pa.array([p + rest for p in proofs], _PROOF))
    for c in ("subroot", "root"):
        block = block.append_column(c, pa.array([above.column(c)[0].as_py()] * block.num_rows, pa.string()))
    return block.drop_columns(["block"])


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("rank") / BLOCK))


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """nodes (tree, rank, size, digest), the roots of their blocks, the roots of those, until every tree has one."""
    out = [nodes]
    while len(out) == 1 or not out[-1].filter("size > 1").isEmpty():
        below = (out[-1] if len(out) == 1 else out[-1].filter("size > 1")).select("tree", "rank", "size", "digest")
        out.append(settled(_blocks(below).groupBy("tree", "block").applyInArrow(_root, "tree string, rank long, size long, digest string"), f"{name}{len(out)}"))
    return out


def _down(levels: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """The lowest level with proof, subroot and root; top: (tree, proof, subroot, root) of every tree's root."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k] if k == 0 else levels[k].filter("size > 1")
        if above is not None:
            like = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
            each = _blocks(nodes).groupBy("tree", "block").cogroup(above.withColumnRenamed("rank", "block").groupBy("tree", "block"))
            nodes = each.applyInArrow(_unwind, f"{like}, proof {PROOF}, subroot string, root string")
        if k == 0:
            return nodes
        ended = levels[k].filter("size = 1").select("tree", "rank").join(top, "tree").select("tree", "rank", "proof", "subroot", "root")
        above = ended if above is None else ended.unionByName(nodes.select(ended.columns))
        above = settled(above, f"{name}{k}")
    raise ValueError("no level")


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", digest: str = "leaf") -> DataFrame:
    """The rows of leaves with subroot (their group's root), root (of all) and proof.

    In each group (null is one, the first) the leaves ascend by `order` (nulls first, ties by digest); every FAN consecutive nodes
    become their digest until one is left.  The groups' roots, in the order of the groups' bytes, do likewise.  proof: for each
    level, from the leaf up, the digests of the run's other nodes to the left and to the right, one behind the other; fold() leads
    from a leaf and its proof to the root.  `digest` must be a text of every row (leaf() makes one).  Other columns pass through;
    those called tree, rank, size, digest, block, proof, subroot or root must be renamed first.  Repeated rows are leaves of their
    own.  An empty table has no rows and no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit(""))
    at = leaves.select("*", tree.alias("tree"), named(digest).alias("digest"))
    rows = ranked(at, ["tree"], [order, "digest"], "leaves")
    levels = _levels(rows, "level")
    subroots = reduce(DataFrame.unionByName, (x.filter("size = 1").select(F.col("tree").alias("of"), "digest") for x in levels[1:]))
    forest = _levels(ranked(subroots.withColumn("tree", F.lit("")), ["tree"], ["of"], "subroots"), "top")
    root = reduce(DataFrame.unionByName, (x.filter("size = 1").select("tree", F.col("digest").alias("root")) for x in forest[1:]))
    top = root.select("tree", F.array().cast(PROOF).alias("proof"), F.col("root").alias("subroot"), "root")  # one row
    tops = settled(_down(forest, top, "under").select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "tops")
    return _down(levels, tops, "proofs").select(*(named(c) for c in leaves.columns), "subroot", "root", "proof")
