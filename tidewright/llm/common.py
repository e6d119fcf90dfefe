"""Small helpers that the operators of this subpackage share.

Defined results: a null text counts as empty; a null id stays null, and is held out of no model; an empty batch gives
nothing; words are remembered up to a bound of their number and length, which changes no result.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

LONGEST = 64  # letters of a word that is remembered


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset a session that runs in this process alone
    takes a temporary one; on a cluster, whose executors would not see it, it has to be set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Spark's setting by which the shuffle files of an execution are deleted when it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound of the bytes that go to Python at a time, its default, and what is taken in place of the default.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python a few MB at a time; a bound that the session has of its own stays.

    By default a batch is 10,000 texts or 64 MB, of which an executor holds several outside the heap for each task.
    """
    if df.sparkSession.conf.get(BATCH) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder that the cluster shares.

    The shuffles behind a checkpoint are not read again, so their files go with its execution and not when the driver
    happens to collect what refers to them.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREES, None)
    conf.set(FREES, "true")
    try:
        return df.select("*").checkpoint()  # a plan made now takes the setting
    finally:
        conf.unset(FREES) if before is None else conf.set(FREES, before)


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Each batch with the rows at which ``column`` takes another value, and whether its first row goes on with the value before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(column)
        starts = np.concatenate(([0], 1 + np.flatnonzero(pc.not_equal(of.slice(1), of.slice(0, len(of) - 1)).to_numpy(zero_copy_only=False))))
        yield batch, starts, last is not None and last == of[0].as_py()
        last = of[len(of) - 1].as_py()


def ranked(df: DataFrame, by: str, order: list[str], out: str = "idx") -> DataFrame:
    """``df`` with the place of each row, from 0, among the rows of equal ``by`` (not null) in ascending ``order``, nulls first.

    Rows are dealt by ranges of (``by``, ``order``), so one value of ``by`` may hold any share of them; equal rows are dealt
    by their place in the input, which has to be a table or a checkpoint.  A task numbers its own rows; only the counts of
    the first and the last value of each partition are summed on the driver, which is as many as there are partitions.
    """
    laid = df.withColumn("_at", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(by, *order, "_at").sortWithinPartitions(by, *order, "_at").drop("_at")
    laid = checkpointed(laid.withColumn("_part", F.spark_partition_id()))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_last = None, 0
        for batch, starts, goes_on in runs(batches, 0):
            if part is None:
                part, first = batch.column(1)[:1], batch.column(0)[:1]
            n_last = (n_last if goes_on and len(starts) == 1 else 0) + batch.num_rows - int(starts[-1])
            last = batch.column(0)[-1:]
        if part is not None:
            yield pa.RecordBatch.from_arrays([part, first, last, pa.array([n_last], pa.int64())], names=["part", "first", "last", "n_last"])

    kind = df.schema[by].dataType.simpleString()
    base, last, so_far = {}, None, 0
    for e in sorted(laid.select(by, "_part").mapInArrow(edges, f"part int, first {kind}, last {kind}, n_last long").collect()):
        base[e.part] = so_far if last is not None and e.first == last else 0
        so_far = e.n_last + (base[e.part] if e.first == e.last else 0)
        last = e.last
    at, part = laid.columns.index(by), laid.columns.index("_part")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch, starts, goes_on in runs(batches, at):
            if done is None:
                done, goes_on = base[batch.column(part)[0].as_py()], True
            lengths = np.diff(np.append(starts, batch.num_rows))
            place = np.arange(batch.num_rows) - np.repeat(starts, lengths)
            if goes_on:
                place[: lengths[0]] += done
            done = int(place[-1]) + 1
            columns = [c for i, c in enumerate(batch.columns) if i != part]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int64())], names=[*(n for i, n in enumerate(batch.schema.names) if i != part), out])

    return laid.mapInArrow(number, StructType([f for f in laid.schema.fields if f.name != "_part"]).add(out, LongType()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model may learn from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], most_chars: int = 1 << 20, third: bool = False) -> Iterator[tuple[list, ...]]:
    """(ids, texts) of the first two columns, and the third if asked, in runs of about ``most_chars`` characters; a null text counts as empty."""
    for batch in batches:
        ids, texts, more, n = [], [], [], 0
        given = lambda: (ids, texts, more) if third else (ids, texts)
        for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if third else batch.column(0), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            if third:
                more.append(x)
            n += len(t) + 64
            if n >= most_chars:
                yield given()
                ids, texts, more, n = [], [], [], 0
        if ids:
            yield given()


def pieces(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut, without a copy, into runs of rows whose texts in ``column`` have ``most_bytes`` at most besides the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64
        starts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // most_bytes, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 1 << 17):
        import xxhash

        self.of, self.known, self.bound = xxhash.xxh3_64_intdigest, {}, bound

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = self.of(w)
                if len(w) <= LONGEST:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` neighbours in ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix(out)
