"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and go to the
nearest signed axis.  A table's bucket is one full hash and shorter ones, whose number of axes follows the size of the
index, so that buckets stay of moderate size.  Queries look into the ``probes`` best buckets of each of ``tables`` tables;
all candidates there are ranked by exact Euclidean distance in double precision.

Buckets are dealt to groups of about ``block`` rows: by the full hash, then by the others.  A query goes only to the groups
of its buckets, and in a group it looks at the rows of its buckets alone, found by binary search.  A bucket of more than
``block`` rows is spread over several groups, and where very many queries meet in one group they are split and the group's
rows repeated, so a task's share is bounded on both sides.  Vectors travel in the precision they have, once a table.
Equal vectors are hashed once, with the ids of as many of them as can be among the nearest.  A query that finds too few
neighbours is compared with all rows, in blocks.

Defined results: vectors that are null or zero or hold null or non-finite components, and rows with a null id, take no
part; only vectors of equal length are compared; of equal distances the smaller id is first; an empty index gives no rows;
rows that repeat an id and vector count once; further columns, also of the same names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed, mix

TABLES, PROBES, BLOCK = 8, 256, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def axes_of(size: int, width: int) -> list[int]:
    """Axes of each hash of a table: a full one, then shorter ones for about a quarter of the bits of the index size more."""
    bits, out = max(1, int(math.log2(max(size, 2)) / 2) - 1), [width]
    most = int(math.log2(2 * width))
    while bits > 0:
        out.append(1 << (min(bits, most) - 1))
        bits -= min(bits, most)
    return out


def hashed(x: np.ndarray, table: int, axes: list[int], seed: int) -> list[np.ndarray]:
    """For each hash of a table, the scores of the signed axes."""
    width = 1 << max(1, math.ceil(math.log2(max(2, x.shape[1]))))
    unit = np.zeros((len(x), width), np.float32)
    unit[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng, out = np.random.default_rng([seed, table, width]), []
    for n in axes:
        z = unit
        for _ in range(3):
            z = hadamard(z * rng.choice(np.array([-1, 1], np.float32), width))
        z = z[:, : min(n, width)]
        out.append(np.concatenate((z, -z), axis=1))
    return out


def best_rest(scores: list[np.ndarray], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first hash, code of the others) of the buckets with the least loss of score, for one query."""
    cost = (scores[0].max() - scores[0]) ** 2
    first = np.argsort(cost, kind="stable")[:probes]
    loss, code = cost[first], np.zeros(len(first), np.int64)
    for s in scores[1:]:
        cost = (s.max() - s) ** 2
        keep = np.argsort(cost, kind="stable")[:probes]
        total = (loss[:, None] + cost[keep]).ravel()
        order = np.argsort(total, kind="stable")[:probes]
        row = order // len(keep)
        loss, code, first = total[order], code[row] * len(s) + keep[order % len(keep)], first[row]
    return first, code


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, apart by the length of their vectors."""
    lengths = np.array([len(x) for x in batch.column(at).to_pylist()])
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n))


def width_of(length: int) -> int:
    return 1 << max(1, math.ceil(math.log2(max(2, length))))


def packed(x: np.ndarray, kind: str) -> pa.Array:
    """The rows of a matrix as binary values, in floats of the given kind."""
    x = np.ascontiguousarray(x, kind)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


class Layout:
    """How the buckets of an index are dealt to groups, for tables of one size."""

    def __init__(self, size: int, tables: int, block: int, seed: int, pieces: dict[tuple[int, int], tuple[int, int]], splits: dict[tuple[int, int], int]):
        self.size, self.tables, self.block, self.seed = size, tables, block, seed
        self.pieces, self.splits = pieces, splits  # of a length and group: parts and spreads; parts of the queries

    def hashes(self, x: np.ndarray, table: int) -> tuple[list[np.ndarray], int]:
        """Scores of the signed axes, and in how many groups a table's full hashes are."""
        width = width_of(x.shape[1])
        return hashed(x, table, axes_of(self.size, width), self.seed), max(1, min(2 * width, self.size // self.block))

    def group(self, table: int, first: np.ndarray, groups: int) -> np.ndarray:
        return table * groups + first % groups

    def codes(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(full hash, code of the whole bucket) of each row."""
        first = scores[0].argmax(axis=1)
        code = first.astype(np.int64)
        for s in scores[1:]:
            code = code * s.shape[1] + s.argmax(axis=1)
        return first, code

    def parts(self, length: int, g: int, code: np.ndarray) -> tuple[np.ndarray, int]:
        """The first part of each bucket of a group, and over how many parts in a row it is spread."""
        pieces, spread = self.pieces.get((length, g), (1, 1))
        return (mix(code.view(np.uint64)) % np.uint64(pieces)).astype(np.int64) * spread, spread


def counted(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """(length, g, code, n): rows of each bucket."""
    for batch in (b for whole in batches if whole.num_rows for b in by_length(whole, 0)):
        x = matrix(batch.column(0))
        for t in range(layout.tables):
            scores, groups = layout.hashes(x, t)
            first, code = layout.codes(scores)
            code, at, n = np.unique(code, return_index=True, return_counts=True)
            g = layout.group(t, first[at], groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), x.shape[1], np.int32)), pa.array(g.astype(np.int64)), pa.array(code), pa.array(n.astype(np.int64))], names=["length", "g", "code", "n"])


INDEX = "length int, g bigint, part bigint, code bigint, ids array<bigint>, vec binary"


def dealt(batches: Iterator[pa.RecordBatch], layout: Layout, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches if whole.num_rows for b in by_length(whole, 0)):
        x = matrix(batch.column(0))
        ids = batch.column(1)
        own = mix(np.array([i[0].as_py() for i in ids], np.int64).view(np.uint64))
        for t in range(layout.tables):
            scores, groups = layout.hashes(x, t)
            first, code = layout.codes(scores)
            g = layout.group(t, first, groups).astype(np.int64)
            part = np.zeros(len(g), np.int64)
            for one in np.unique(g):
                at = np.flatnonzero(g == one)
                base, spread = layout.parts(x.shape[1], int(one), code[at])
                part[at] = base + (own[at] % np.uint64(spread)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), x.shape[1], np.int32)), pa.array(g), pa.array(part), pa.array(code), ids, packed(x, kind)], names=["length", "g", "part", "code", "ids", "vec"])


ASKED = "length int, g bigint, part bigint, query bigint, vec binary, codes array<bigint>"


def asked(batches: Iterator[pa.RecordBatch], layout: Layout, probes: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches if whole.num_rows for b in by_length(whole, 1)):
        x, ids = matrix(batch.column(1)), batch.column(0)
        vectors = packed(x, kind)
        for t in range(layout.tables):
            scores, groups = layout.hashes(x, t)
            shape = int(np.prod([s.shape[1] for s in scores[1:]]))
            rows, g, parts, codes = [], [], [], []
            for i in range(len(x)):
                first, rest = best_rest([s[i] for s in scores], probes)
                code, of = first * shape + rest, layout.group(t, first, groups)
                for one in np.unique(of):
                    own = code[of == one]
                    base, spread = layout.parts(x.shape[1], int(one), own)
                    for p in np.unique(base):
                        for j in range(spread):
                            rows.append(i)
                            g.append(int(one))
                            parts.append(int(p) + j)
                            codes.append(own[base == p])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), x.shape[1], np.int32)), pa.array(g, pa.int64()), pa.array(parts, pa.int64()), ids.take(take), vectors.take(take), pa.array(codes, pa.list_(pa.int64()))], names=["length", "g", "part", "query", "vec", "codes"])


NOTHING = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def nearest(queries: pa.Table, index: pa.Table, k: int, kind: str) -> pa.Table:
    """The k nearest of the rows in a query's buckets, for each query of a group; a query with null codes looks at all rows."""
    if not (queries.num_rows and index.num_rows):
        return NOTHING
    rows = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(t.num_rows, -1).astype(np.float64)
    code = index.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    code, x = code[order], rows(index)[order]
    ids = index.column("ids").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0)
    ids = ids.take(pa.array(order))
    flat, start = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, v, codes in zip(queries.column("query").to_pylist(), rows(queries), queries.column("codes").to_pylist(), strict=True):
        if codes is None:
            some = np.arange(len(x))
        else:
            lo, hi = np.searchsorted(code, codes), np.searchsorted(code, codes, "right")
            n = hi - lo
            some = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        if not len(some):
            continue
        distance = np.sqrt(((x[some] - v) ** 2).sum(axis=1))
        if len(some) > k + 1:
            close = distance <= np.partition(distance, k)[k]  # one more than k: a class may hold the query alone
            some, distance = some[close], distance[close]
        n = start[some + 1] - start[some]
        i = flat[np.arange(n.sum()) + np.repeat(start[some] - (np.cumsum(n) - n), n)]
        d = np.repeat(distance, n)[i != q]
        i = i[i != q]
        best = np.lexsort((i, d))[:k]
        found.append((np.full(len(best), q), i[best], d[best]))
    if not found:
        return NOTHING
    q, i, d = map(np.concatenate, zip(*found, strict=True))
    return pa.table({"query_id": q.astype(np.int64), "vec_id": i.astype(np.int64), "score": d})


def top(df: DataFrame, k: int) -> DataFrame:
    ranked = df.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for the rows for which ``is_query`` (over column ``id``) holds."""
    spark, schema = df.sparkSession, "query_id bigint, vec_id bigint, score double"
    single = dict(df.dtypes)[vec_col] == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    fine = F.size("vec") > 0
    fine &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    # k + 1 ids of a vector are enough: the nearest of equal distance are those of smallest id, and one may be the query.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    classes = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = checkpointed(classes)
    lengths = classes.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("classes"), F.sum(F.size("ids")).alias("kept"))
    size = lengths.agg(F.sum("classes")).first()[0]
    if not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = rows.where(is_query).distinct()

    layout = Layout(size, tables, block, seed, {}, {})
    share = spark.sparkContext.broadcast
    if size > block:  # the tables below have a row for each length, table and group of full hashes
        plain = share(layout)
        counts = classes.select("vec").mapInArrow(lambda b: counted(b, plain.value), "length int, g bigint, code bigint, n bigint")
        counts = counts.groupBy("length", "g", "code").agg(F.sum("n").alias("n")).groupBy("length", "g").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        layout.pieces = {(r.length, r.g): (math.ceil(r.rows / block), math.ceil(r.most / block)) for r in counts.collect()}
    dealing = share(layout)
    probe = queries.select("id", "vec").mapInArrow(lambda b: asked(b, dealing.value, probes, kind), ASKED)
    splits = F.lit(1)
    if queries.count() > block:
        probe = checkpointed(probe)
        most = probe.groupBy("length", "g", "part").count().groupBy("length", "g").agg(F.ceil(F.max("count") / block).cast("int").alias("splits"))
        many = {(r.length, r.g): r.splits for r in most.where("splits > 1").collect()}
        if many:
            splits = F.coalesce(F.create_map(*(x for (n, g), v in many.items() for x in (F.lit(f"{n} {g}"), F.lit(v))))[F.concat_ws(" ", "length", "g")], F.lit(1))
    index = classes.select("vec", "ids").mapInArrow(lambda b: dealt(b, dealing.value, kind), INDEX)
    index = index.withColumn("split", F.explode(F.sequence(F.lit(0), splits - 1)))
    probe = probe.withColumn("split", F.pmod(F.xxhash64("query"), splits).cast("int"))
    keys = ["length", "g", "part", "split"]
    found = probe.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(lambda a, b: nearest(a, b, k, kind), schema)
    found = checkpointed(top(found, k))

    # Whoever has found fewer than there are is compared with every row, block by block; the query is one of those kept, or k + 1 of its copies are.
    there = found.groupBy(F.col("query_id").alias("id")).count()
    short = queries.withColumn("length", F.size("vec")).join(lengths, "length").join(there, "id", "left_outer")
    short = short.where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), F.col("kept") - 1)).select("id", "vec", "length")
    if not short.isEmpty():
        blocks = math.ceil(size / block)
        to_bytes = lambda b: (pa.RecordBatch.from_arrays([*x.columns[1:], packed(matrix(x.column(0)), kind)], names=[*x.schema.names[1:], "vec"]) for w in b if w.num_rows for x in by_length(w, 0))
        every = short.select("vec", "length", F.col("id").alias("query")).mapInArrow(to_bytes, "length int, query bigint, vec binary")
        every = every.select("*", F.lit(None).cast("array<bigint>").alias("codes"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.pmod(F.xxhash64("query"), F.lit(64)).cast("int").alias("split"))
        all_rows = classes.select("vec", F.size("vec").alias("length"), "ids", F.lit(0).cast("long").alias("code"), F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("part"))
        all_rows = all_rows.mapInArrow(to_bytes, "length int, ids array<bigint>, code bigint, part int, vec binary").join(every.select("length", "split").distinct(), "length")
        keys = ["length", "part", "split"]
        more = every.groupBy(*keys).cogroup(all_rows.groupBy(*keys)).applyInArrow(lambda a, b: nearest(a, b, k, kind), schema)
        found = top(found.select("query_id", "vec_id", "score").unionByName(more), k)
    return found.select("query_id", "rank", "vec_id", "score")
