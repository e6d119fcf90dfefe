"""Merkle manifest of a dataset with incremental witnesses.

Rows are hashed in columns; only their digests travel.  The leaves of a tree are numbered over all partitions and dealt in
aligned blocks of ``fan_out ** LEVELS`` leaves.  A task appends the leaves of a block one by one: a leaf takes a partial witness into
the open subtrees above it, and whenever a run of siblings is complete, the witnesses of all leaves below them are extended.
The roots of the blocks are appended in the same way to the tree above, block by block, and the roots of the trees to
the tree of trees; what a block's root gets as its witness extends the witnesses of the block.  So no task holds more than a block, and no
key but (tree, block) is shuffled on.

Defined results: a null is hashed as ``-``, an empty text as ``0:``; rows of a null tree are a tree of their own, the first;
rows that share an order value ascend by their digest, nulls first; equal rows are leaves each; a text of any length is hashed whole;
further columns, also of the same names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed, ranked

FAN_OUT, LEVELS = 8, 4
WITNESS = "lefts array<string>, rights array<string>"


def encoded(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Growing:
    """A tree that digests are appended to, which keeps the witness of each: what stands left and right of it, level by level."""

    def __init__(self, fan_out: int):
        self.fan_out, self.witness, self.open = fan_out, [], [[]]

    def append(self, digest: str) -> None:
        self.witness.append([])
        self.grow(0, digest, range(len(self.witness) - 1, len(self.witness)))

    def grow(self, level: int, digest: str, below: range) -> None:
        """One more node among the open siblings of a level; the last of a run completes it."""
        self.open[level].append((digest, below))
        if len(self.open[level]) == self.fan_out:
            self.complete(level)

    def complete(self, level: int) -> None:
        """Extends the witnesses below each sibling of the open run, and takes its digest one level up."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for i, (_, below) in enumerate(run):
            step = "".join(digests[:i]), "".join(digests[i + 1 :])
            for member in below:
                self.witness[member].append(step)
        if level + 1 == len(self.open):
            self.open.append([])
        self.grow(level + 1, joined(digests), range(run[0][1].start, run[-1][1].stop))

    def close(self, levels: int | None) -> str:
        """The root: all runs completed up to ``levels``, or (None) until one node is left."""
        level = 0
        while level < levels if levels is not None else any(self.open[level + 1 :]) or len(self.open[level]) > 1:
            if self.open[level]:
                self.complete(level)
            level += 1
        return self.open[level][0][0]


def grown(digests: list[str], first: bool, fan_out: int, levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, witnesses) of a block.  The first block of a tree may be all of it, and then ends where one node is left."""
    tree = Growing(fan_out)
    for d in digests:
        tree.append(d)
    return tree.close(None if first and len(digests) < fan_out**levels else levels), tree.witness


def ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def witnesses(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], finish: Callable[[pa.Table, list[str], list[str], str, str], pa.Table], schema: str, fan_out: int, levels: int) -> DataFrame:
    """``finish`` over the blocks of ``nodes`` (tree, idx, digest, ...), each with the witnesses of its nodes up to the root of all.

    ``above`` gives (tree, idx, lefts, rights, subroot, root) for the roots of trees that are one block.
    """
    size = fan_out**levels
    nodes = nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long"))

    def root_of(key: tuple, table: pa.Table) -> pa.Table:
        root, _ = grown(ordered(table).column("digest").to_pylist(), key[1].as_py() == 0, fan_out, levels)
        return pa.table({"tree": pa.array([key[0].as_py()]), "idx": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array([root])})

    roots = checkpointed(nodes.select("tree", "block", "idx", "digest").groupBy("tree", "block").applyInArrow(root_of, "tree string, idx bigint, digest string"))
    if roots.where("idx > 0").isEmpty():
        upper = above(roots)
    else:
        upper = witnesses(roots, above, extended, f"tree string, idx bigint, {WITNESS}, subroot string, root string", fan_out, levels)

    def extend(key: tuple, table: pa.Table, over: pa.Table) -> pa.Table:
        rows, up = ordered(table), over.to_pylist()[0]
        _, own = grown(rows.column("digest").to_pylist(), key[1].as_py() == 0, fan_out, levels)
        return finish(rows, own, list(zip(up["lefts"], up["rights"], strict=True)), up["subroot"], up["root"])

    return nodes.groupBy("tree", "block").cogroup(upper.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInArrow(extend, schema)


def extended(rows: pa.Table, own: list, up: list, subroot: str, root: str) -> pa.Table:
    """The nodes with their witnesses, extended by that of their block."""
    n = rows.num_rows
    return pa.table({
        "tree": rows.column("tree"), "idx": rows.column("idx"),
        "lefts": pa.array([[a for a, _ in [*w, *up]] for w in own], pa.list_(pa.string())), "rights": pa.array([[b for _, b in [*w, *up]] for w in own], pa.list_(pa.string())),
        "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
    })


def named(rows: pa.Table, own: list, up: list, subroot: str, root: str) -> pa.Table:
    """The same for the tree of trees, whose nodes are the roots of named trees."""
    out = extended(rows, own, up, subroot, root)
    n = rows.num_rows
    return pa.table({"tree": rows.column("name"), "idx": pa.array([0] * n, pa.int64()), "lefts": out.column("lefts"), "rights": out.column("rights"), "subroot": rows.column("digest"), "root": out.column("root")})


def folded(digest: str, witness: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in witness:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def proven(rows: pa.Table, own: list, up: list, subroot: str, root: str) -> pa.Table:
    """Leaves with the digest of their witness and the root that their claimed digest gives."""
    rest = "".join(a + b for a, b in up)
    proof = [sha256(("".join(a + b for a, b in w) + rest).encode()).hexdigest() for w in own]
    found = [folded(d, [*w, *up]) for d, w in zip(rows.column("claimed").to_pylist(), own, strict=True)]
    n = rows.num_rows
    return pa.table({
        "row": rows.column("row"), "leaf": rows.column("digest"), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
        "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(found, pa.string()), "verified": pa.array([f == root for f in found], pa.bool_()),
    })


def manifest(df: DataFrame, columns: list[str], tree: str, order: str, claimed: dict[str, Column] | None = None, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """(``order``, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    A leaf is the digest of ``columns``; the leaves of a ``tree`` ascend by ``order``, an integer; the trees ascend by name.  The witness of a leaf is folded
    with the digest of the row as it is claimed to be, with ``claimed`` in place of its columns of these names.
    """
    claims = {c: F.col(c) for c in columns} | (claimed or {})
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # ascends as the values do, nulls first
    digests = df.select(name.alias("tree"), F.col(order).cast("long").alias("row"), leaf([F.col(c) for c in columns]).alias("digest"), leaf([claims[c] for c in columns]).alias("claimed"))
    leaves = ranked(checkpointed(digests), "tree", ["row", "digest"])
    ground = lambda roots: roots.select("tree", "idx", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    of_trees = f"tree string, idx bigint, {WITNESS}, subroot string, root string"

    def trees(roots: DataFrame) -> DataFrame:
        each = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
        return witnesses(each, ground, named, of_trees, fan_out, levels)

    out = witnesses(leaves, trees, proven, "row bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", fan_out, levels)
    return out.withColumnRenamed("row", order)
