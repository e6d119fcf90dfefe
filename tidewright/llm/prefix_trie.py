"""Prefix trie of conversations, by recursion at half depth.

A conversation is the sequence of its turns.  Sequences are cut at half depth, again and again, down to blocks of ``HEIGHT``
turns.  Going up, each half gets a digest; going down, the cut prefix of each lower half is named by the name of the prefix
above and the digest of the upper half beside it, so upper tries and lower forests of one size are built at once and the rounds are
as many as the logarithm of the depth.  Within a block names follow from turn to turn.  Equal prefixes get equal names and are one node.
Totals go the same way: each node's own share is put on the path of its smallest member, a half sums its shares,
and what lies in a lower half is grafted onto the upper one; a node's total is the sum over its members of what lies from it on.

Texts do not travel, only their digests and lengths.  No key but (conversation, block) holds rows together, so a conversation may be of
any length; nodes with many members or children are aggregated before they are shuffled; ids that end at one node are
joined in chunks, and the chunks of a node are hashed one after the other as they are read.

Defined results: rows of a null conversation are left out; a null role or text is empty; of equal turns the order is that of the digest of
role and text, and repeated rows are turns each; a conversation without turns is a member of the root alone; further columns, also of the same names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed, ranked

HEIGHT = 8  # turns of a block
CHUNK = 4096  # ids of a chunk
ROOT = bytes(32)


def sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, pos, name, size): the turns of each conversation, from 1, with a digest of role and text and the text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = sha(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    return checkpointed(ranked(checkpointed(rows), "conv_id", ["turn", "name"]).select("conv_id", (F.col("idx") + 1).alias("pos"), "name", "size"))


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int, chunk: int = CHUNK) -> DataFrame:
    """The same, where conversation ``conv_id`` begins with the first ``heads`` turns of conversation ``base`` in place of its own.

    ``heads`` (at most ``most``) and ``base`` are functions of ``conv_id``.  Each conversation also gets a row at 0, of no text, the root.
    """
    sized = checkpointed(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = sized.withColumn("base", base).withColumn("h", heads)
    convs = convs.join(sized.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left_outer")
    convs = checkpointed(convs.select("conv_id", "base", "h", "n", F.least("h", F.coalesce("there", F.lit(0))).alias("k")))
    first = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "name", "size")
    taken = first.join(convs.where("k > 0").select("base", "conv_id", "k"), "base").where("pos <= k").select("conv_id", "pos", "name", "size")
    # A long conversation meets its own row in parts, so that no task gets all of it.
    part = F.floor(F.col("pos") / chunk)
    own = convs.where("n > h").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / chunk))))
    rest = turns.withColumn("part", part).join(own.select("conv_id", "part", "h", "k"), ["conv_id", "part"]).where("pos > h")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("size"))
    return root.union(taken).union(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "name", "size"))


def recursion(blocks: DataFrame, up: Callable[[Column, Column], Column], start: Column, upper: Callable[[Column, Column, Column], Column], lower: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(conv_id, block, given): what recursion at half depth gives each of the ``blocks`` (conv_id, block, value).

    Two halves have the value ``up(value of the upper, of the lower)``.  A whole is given ``start``; what it is given goes on to its
    halves as ``upper(given, value of the upper, of the lower)`` and ``lower(...)``.  A lower half that is not there is null.
    """
    levels = [blocks.select("conv_id", F.col("block").alias("at"), "value")]
    for _ in range(int(blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]).bit_length()):
        half = F.col("at") % 2 == 0
        pairs = levels[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(half, F.col("value"))).alias("u"), F.max(F.when(~half, F.col("value"))).alias("l"))
        levels.append(checkpointed(pairs.withColumn("value", F.when(F.col("l").isNull(), F.col("u")).otherwise(up(F.col("u"), F.col("l"))))))
    given = levels[-1].select("conv_id", "at", start.alias("given"))
    for pairs in reversed(levels[1:]):
        g, u, v = F.col("given"), F.col("u"), F.col("l")
        both = pairs.select("conv_id", "at", "u", "l").join(given, ["conv_id", "at"])
        upper_half = F.struct((F.col("at") * 2).alias("at"), upper(g, u, v).alias("given"))
        lower_half = F.when(v.isNotNull(), F.struct((F.col("at") * 2 + 1).alias("at"), lower(g, u, v).alias("given")))
        given = checkpointed(both.select("conv_id", F.inline(F.array_compact(F.array(upper_half, lower_half)))))
    return given.withColumnRenamed("at", "block")


def named(rows: DataFrame, height: int) -> DataFrame:
    """(conv_id, block, items, last): blocks of rows with the names of their nodes, and the last name of the block before."""
    block = F.floor(F.col("pos") / height).cast("long").alias("block")
    blocks = checkpointed(rows.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "size"))).alias("turns")))
    values = blocks.select("conv_id", "block", sha(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")).alias("value"))
    given = recursion(values, lambda u, v: sha(u, v), F.lit(ROOT), lambda g, u, v: g, lambda g, u, v: sha(g, u))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = []
            for name, turns in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out = []
                for t in turns:
                    name = sha256(name + t["name"]).digest()
                    out.append({"pos": t["pos"], "node": name, "size": t["size"]})
                items.append(out)
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("node", pa.binary()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, kind)], names=["conv_id", "block", "items"])

    made = blocks.join(given, ["conv_id", "block"]).select("conv_id", "block", "given", "turns")
    made = checkpointed(made.mapInArrow(follow, "conv_id bigint, block bigint, items array<struct<pos:bigint,node:binary,size:bigint>>"))
    before = made.select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("items", -1)["node"].alias("before"))
    return checkpointed(made.join(before, ["conv_id", "block"], "left_outer"))


def digests_of_ends(ends: DataFrame, chunk: int) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids that end at a node, ascending and joined by commas."""
    placed = ranked(checkpointed(ends), "node", ["conv_id"]).withColumn("chunk", F.floor(F.col("idx") / chunk))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = checkpointed(placed.groupBy("node", "chunk").agg(F.array_join(ids, ",").alias("ids")))
    more = chunks.where("chunk > 0").select("node").distinct()
    short = chunks.join(more, "node", "left_anti").select("node", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])
        for batch in batches:
            for of, ids in zip(batch.column(0), batch.column(1), strict=True):
                if of.as_py() != node:
                    if node is not None:
                        yield done()
                    node, state = of.as_py(), sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if node is not None:
            yield done()

    long = chunks.join(more, "node", "left_semi").repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return short.union(long.mapInArrow(hashed, "node binary, ends_sha256 string"))


def trie(rows: DataFrame, height: int = HEIGHT, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``rows`` (conv_id, pos, name, size) are the turns of each conversation from 1 and its row at 0; a node goes by its smallest member and its depth.
    """
    blocks = named(rows, height)
    item = F.posexplode("items").alias("i", "t")
    each = blocks.select("conv_id", item, "items", "before").select("conv_id", F.col("t.pos").alias("pos"), F.col("t.node").alias("node"), F.col("t.size").alias("size"), F.when(F.col("i") > 0, F.get("items", F.col("i") - 1)["node"]).otherwise(F.col("before")).alias("parent"))
    nodes = checkpointed(each.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("size").alias("size")))
    kids = checkpointed(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    nodes = checkpointed(nodes.join(kids, "node", "left_outer").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    # Own shares, on the paths of the smallest members: (pos, tokens saved, leaves) of each block.
    own = nodes.select("conv_id", F.floor(F.col("depth") / height).cast("long").alias("block"), F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    own = checkpointed(own.where("saved > 0 or leaves > 0").groupBy("conv_id", "block").agg(F.collect_list(F.struct("pos", "saved", "leaves")).alias("own")))
    over = lambda xs, c: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[c])
    add = lambda a, b: F.struct((a["saved"] + b["saved"]).alias("saved"), (a["leaves"] + b["leaves"]).alias("leaves"))
    none = F.struct(F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    # Blocks without a share have to be there too: those above them are given what lies below.
    whole = checkpointed(blocks.select("conv_id", "block", "items").join(own, ["conv_id", "block"], "left_outer").withColumn("own", F.coalesce("own", F.array().cast("array<struct<pos:bigint,saved:bigint,leaves:bigint>>"))))
    values = whole.select("conv_id", "block", F.struct(over(F.col("own"), "saved").alias("saved"), over(F.col("own"), "leaves").alias("leaves")).alias("value"))
    below = recursion(values, add, none, lambda g, u, v: F.when(v.isNull(), g).otherwise(add(g, v)), lambda g, u, v: g)
    shares = whole.join(below, ["conv_id", "block"]).where("size(own) > 0 or given.saved > 0 or given.leaves > 0").select(F.explode("items").alias("t"), "own", "given")
    from_here = F.filter("own", lambda x: x["pos"] >= F.col("t.pos"))
    shares = shares.select(F.col("t.node").alias("node"), (F.col("given.saved") + over(from_here, "saved")).alias("saved"), (F.col("given.leaves") + over(from_here, "leaves")).alias("leaves"))
    totals = shares.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    last = blocks.groupBy("conv_id").agg(F.max_by(F.element_at("items", -1)["node"], "block").alias("node"))
    ended = digests_of_ends(last, chunk)
    out = nodes.join(totals, "node", "left_outer").join(ended, "node", "left_outer")
    # A parent of more than a thousandth of all nodes is one of a thousand at most; these few are broadcast, the others joined.
    many = nodes.where(F.col("n_children") > F.lit(nodes.count() // 1000)).select(F.col("node").alias("parent"), F.col("conv_id").alias("famous"))
    few = nodes.where(F.col("n_children").between(1, F.lit(nodes.count() // 1000))).select(F.col("node").alias("parent"), F.col("conv_id").alias("other"))
    out = checkpointed(out.join(F.broadcast(many), "parent", "left_outer"))
    known, open_ = out.where("famous is not null or parent is null"), out.where("famous is null and parent is not null")
    out = known.withColumn("other", F.lit(None).cast("long")).unionByName(open_.join(few, "parent"))
    return out.select("conv_id", "depth", F.coalesce("famous", "other").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
