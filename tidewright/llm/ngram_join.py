"""Similarity join of texts on the Jaccard similarity of their word n-grams, by MinHash banding.

The number of rows in a band and of bands follow from the recall wanted at the threshold.  Texts with the same n-gram set
are one node.  Nodes are shuffled on their band hashes; each is tied to the least node of its bucket, and the components
of these ties hold every candidate pair.  Within a component all pairs of full n-gram sets are compared exactly: small
components in one task, large ones as pairs of blocks of bounded texts and characters, so no task holds more than two
blocks.  Links are
counted, not returned one by one: a row per document says which class it is in and how many documents it is linked to.

Defined results: a text of fewer than ``n`` words has one n-gram, all its words; a null or empty text has none, is linked
to nothing and is a class of its own; copies are linked to each other; rows that share an id are one document, of as many
texts as they have different n-gram sets: each row returns what holds for the document, its links are those of all its
texts to all other texts, and its texts are in one class; rows with a null id are left out; of equal ids or sets the smallest id leads; a text of any length is
compared whole; further columns, also of the same names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WordHashes, checkpointed, chunks, in_small_batches, mix, rolled
from tidewright.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.999
BLOCK = 512  # nodes of a large component that are compared with as many others in one task
BLOCK_CHARS = 1 << 22  # and the characters of their texts


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach ``recall`` at ``threshold`` with at most ``most`` hashes, or else as few as do."""
    bands = lambda rows: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
    fitting = [rows for rows in range(1, 33) if bands(rows) * rows <= most]
    rows = max(fitting, default=1)  # one row a band needs the fewest hashes
    return bands(rows), rows


def shingles(text: str, hashes: WordHashes, n: int) -> np.ndarray:
    """The distinct hashed n-grams of a text, sorted."""
    words = text.lower().split()
    return np.unique(rolled(hashes(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def features(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc, key, set, chars, bands): a digest of the n-gram set (null: none) and the band hashes of its MinHash signature."""
    import xxhash

    hashes = WordHashes()
    rng = np.random.default_rng(20240607)
    a, b = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, np.uint64)
    salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for ids, texts, keys in chunks(batches, third=True):
        sets, out = [], []
        for t in texts:
            s = shingles(t, hashes, n)
            if not len(s):
                sets.append(None)
                out.append(None)
                continue
            sets.append(xxhash.xxh3_128_digest(s.tobytes()))
            least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
            for i in range(0, len(s), 1024):
                np.minimum(least, ((s[i : i + 1024, None] * a + b) >> np.uint64(16)).min(axis=0), out=least)
            h = salt.copy()
            for column in least.reshape(bands, rows).T:
                h = mix(h ^ column)
            out.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.binary()), pa.array([len(t) for t in texts], pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["doc", "key", "set", "chars", "bands"])


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` reach the threshold with which of ``b`` (None: with each other), by exact intersections."""
    sets = a + (b or [])
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what only one set has is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m = len(a), len(a) if b is None else len(b)
    common = np.zeros((n, m), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, total, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), min(4096, total - lo)), np.float32)
        x[owner[i:j], column[i:j] - lo] = 1
        common += x[:n] @ (x[:n] if b is None else x[n:]).T
    union = size[:n, None] + (size[:n] if b is None else size[n:])[None, :] - common
    out = common >= threshold * union - 1e-6
    if b is None:
        np.fill_diagonal(out, False)
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The least index that each can be reached from."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent.any(axis=1), np.where(adjacent, label[None, :], len(label)).min(axis=1), label)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """For the nodes of one component, or of two of its blocks: their links and the least node each is connected to here."""
    names = table.column("node").to_pylist()
    order = sorted({name: i for i, name in enumerate(names)}.values(), key=names.__getitem__)
    ids, block, many = np.array([names[i] for i in order], object), table.column("block").to_numpy()[order], table.column("many").to_numpy()[order]
    texts, hashes = table.column("text").take(pa.array(order)), WordHashes()
    sets = [shingles(t.as_py() or "", hashes, n) for t in texts]
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    if p == q:
        near = linked(sets, None, threshold)
    else:
        near = np.zeros((len(ids), len(ids)), bool)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if len(left) and len(right):
            near[np.ix_(left, right)] = linked([sets[i] for i in left], [sets[i] for i in right], threshold)
            near |= near.T
    links = near @ many
    keep = links > 0
    return pa.table({"node": pa.array(ids[keep].tolist(), pa.binary()), "root": pa.array(ids[roots(near)][keep].tolist(), pa.binary()), "links": links[keep].astype(np.int64)})


def node_of(rep: Column, digest: Column) -> Column:
    """A set as 24 bytes that ascend by its least id, then by its digest."""
    return F.unhex(F.concat(F.lpad(F.hex(rep.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.hex(digest)))


def least_id(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, class_id, copy_of, n_links): the least id connected by links, the least id with the same n-grams, and how many
    texts of documents have a similarity of ``threshold`` or more with this one's."""
    bands, rows = banding(threshold, recall)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key")).where(F.col("doc").isNotNull())
    feats = checkpointed(in_small_batches(docs).mapInArrow(lambda b: features(b, n, bands, rows), "doc bigint, key bigint, set binary, chars int, bands array<bigint>"))
    # A set is a node, known by its least document and the text that this one has it from.
    of_doc = checkpointed(feats.groupBy("set", "doc").agg(F.min(F.struct("key", "chars")).alias("one")))
    nodes = of_doc.where("set is not null").groupBy("set").agg(F.min(F.struct("doc", "one.key", "one.chars")).alias("first"), F.count("*").alias("many"))
    nodes = checkpointed(nodes.select("set", "many", "first.*", node_of(F.col("first.doc"), F.col("set")).alias("node")))  # so that Spark can split the joins of a set with many copies
    first = feats.select("set", "doc", "key", "bands").join(nodes.select("set", "doc", "key", "node"), ["set", "doc", "key"]).dropDuplicates(["node"])
    rows_ = first.select("node", F.explode("bands").alias("band"))
    buckets = rows_.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    ties = rows_.join(buckets, "band").where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    coarse = components(ties)
    # Blocks are bounded in texts and, but for one long text alone, in characters.
    sized = coarse.join(nodes, "node")
    size = sized.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.col("chars").cast("long")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    size = size.withColumn("blocks", F.greatest("blocks", F.lit(1)))
    member = sized.join(size, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = checkpointed(member.select("node", "doc", "key", "label", "blocks", "block", "many"))
    texts = docs.join(member, ["doc", "key"])
    if not feats.groupBy("doc", "key").count().where("count > 1").isEmpty():  # rows that are there many times are compared once
        texts = texts.groupBy("node", "label", "blocks", "block", "many").agg(F.first("text").alias("text"))
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select("node", "text", "many", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    links = checkpointed(texts.groupBy("label", "p", "q").applyInArrow(lambda t: compared(t, n, threshold), "node binary, root binary, links bigint"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    # What several tasks found of a large component, and the texts of one document, are connected once more.
    split = member.where("blocks > 1").select("node")
    sets_of = of_doc.groupBy("doc").agg(F.count("*").alias("sets")).where("sets > 1")
    several = not sets_of.isEmpty()
    edges = links.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if several:
        sets_of = checkpointed(sets_of)
        texts_of = checkpointed(of_doc.where("set is not null").join(sets_of.select("doc"), "doc").join(nodes.select("set", "node"), "set").select("doc", "set", "node"))
        least = texts_of.groupBy("doc").agg(F.min("node").alias("v"))
        edges = edges.union(texts_of.join(least, "doc").select(F.col("node").alias("u"), "v"))
    elif not split.isEmpty():
        edges = links.join(split, "node", "left_semi").select(F.col("node").alias("u"), F.col("root").alias("v"))
    else:
        edges = None
    of_set = nodes.select("set", "node", "many", F.col("doc").alias("rep")).join(counts, "node", "left_outer")
    if edges is not None:
        of_set = of_set.join(components(edges), "node", "left_outer").withColumn("root", F.least("root", "label"))
    # What is known of a set is put together first, so the documents are joined once, on the set, and a set with many copies can be split.
    of_set = checkpointed(of_set.select("set", "rep", "many", least_id(F.coalesce("root", "node")).alias("class"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links")))
    out = feats.select("doc", "set").join(of_set, "set", "left_outer")
    if several:
        whole = texts_of.join(of_set, "set").groupBy("doc").agg(F.min("class").alias("class"), F.min("rep").alias("rep"), F.sum("links").alias("links"))
        alone = out.join(sets_of, "doc", "left_anti").select("doc", "class", "rep", "links")
        out = alone.unionByName(feats.select("doc").join(checkpointed(whole), "doc"))
    return out.select(F.col("doc").alias(id_col), F.coalesce("class", "doc").alias("class_id"), F.coalesce("rep", "doc").alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
