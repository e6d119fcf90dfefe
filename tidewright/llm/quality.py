"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word and every word shape has a sparse random index vector; its context vector is the sum of the index vectors around
it in all documents, summed in Spark, and its word vector is both together.  A document is the mean and the spread of its
word and shape vectors.  The network is trained in numpy on a bounded sample of the labelled rows, and a temperature that is
fitted on rows kept back from training makes its outputs probabilities.

Defined results: null and empty texts are scored like any other, from an empty pool; without labelled rows of both kinds
every score is the share of label 1 (0.5 without rows); repeated rows get equal scores; a null id is not held out; very
long texts are read whole, in parts; labels, language, source and id do not enter a score; further columns, also of the
same names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hashed

from tidewright.llm.common import LONGEST, chunks, held_out, in_small_batches
from tidewright.llm.learning import Adam, calibration_part, sample, sigmoid, temperature

SAMPLE = 5_000  # bound of the rows of each label that a fit uses
CUT = 0.5
BUCKETS, WIDTH, HIDDEN = 1 << 15, 48, 32
BLANK = re.compile(r"\s")
DIGITS, SMALL, CAPITALS, MARKS = re.compile(r"\d+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\W+")
ENDINGS = ".,;:!?"
KNOWN, MISSED, MOST_KNOWN = {}, [0], 1 << 17  # what a worker remembers of tokens, how many it met since it is full, and its bound


@lru_cache(1 << 12)
def shape_bucket(shape: str, length: int) -> int:
    return hashed(f"{shape} {length}", 1) % BUCKETS


def bucket_pair(token: str) -> int:
    """The buckets of a token's word (lower-case, without marks) and, above it, of its shape."""
    core, mark = (token[:-1], token[-1]) if token[-1] in ENDINGS else (token, "")
    if core.islower() and core.isalpha():  # most tokens are small letters, or with a mark behind: what is below gives the same for them
        return hashed(core) % BUCKETS | shape_bucket("x" + mark, len(token) // 3) << 32
    if core.isalpha() and "A" <= core[0] <= "Z" and core[1:].islower():
        return hashed(core.lower()) % BUCKETS | shape_bucket("Xx" + mark, len(token) // 3) << 32
    shape = CAPITALS.sub("X", SMALL.sub("x", DIGITS.sub("9", token)))
    bucket = shape_bucket if len(shape) <= LONGEST else shape_bucket.__wrapped__
    return hashed(MARKS.sub("", token.lower()) or token) % BUCKETS | bucket(shape, len(token) // 3) << 32


def token_ids(token: str) -> int:
    """The buckets of a token's word and shape, remembered while there is room; when much was not known, all is learned anew."""
    ids = bucket_pair(token)
    if len(KNOWN) >= MOST_KNOWN:
        MISSED[0] += 1
        if MISSED[0] >= 4 * MOST_KNOWN:
            MISSED[0] = 0
            KNOWN.clear()
    elif len(token) <= LONGEST:
        KNOWN[token] = ids
    return ids


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut at white space."""
    at = 0
    while len(text) - at > size and (gap := BLANK.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def ids_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and of their shapes."""
    known = KNOWN.get
    both = np.concatenate([np.array([i if (i := known(t)) is not None else token_ids(t) for t in part.split()], np.int64) for part in parts_of(text)])
    return both & 0xFFFFFFFF, both >> 32


@lru_cache(2)
def index_vectors(seed: int) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1 for all buckets, and one of zeros."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, WIDTH), np.int8)
    for _ in range(4):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] = rng.choice(np.array([-1, 1], np.int8), BUCKETS)
    return out


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def add_context(sums: np.ndarray, ids: np.ndarray, index: np.ndarray, reach: int = 2, block: int = 1 << 16) -> None:
    """Adds to the sums of each bucket the index vectors of its neighbours; ``BUCKETS`` stands between texts."""
    for lo in range(0, len(ids), block):
        here = ids[max(0, lo - reach) : lo + block + reach]
        own = index[here]
        around = np.zeros_like(own)
        for o in range(1, min(reach, len(here) - 1) + 1):
            around[o:] += own[:-o]
            around[:-o] += own[o:]
        skip = lo - max(0, lo - reach)
        here, around = here[skip : skip + block], around[skip : skip + block]
        order = np.argsort(here.astype(np.uint16), kind="stable")  # 16 bits are sorted by digits
        first = np.flatnonzero(np.diff(here[order], prepend=-1))
        sums[here[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)


MERGED = 64  # sums that one task adds up at a time


def context_vectors(docs: DataFrame, text_col: str, seed: int, slices: int = 64, merged: int = MERGED) -> np.ndarray:
    """The context sums of all buckets over all documents: each task adds up its own, and slices of them are added in Spark.

    The sums of ``merged`` tasks are added at a time, in as many rounds as it takes, so what one task reads does not grow
    with the number of tasks.  The result has ``BUCKETS`` rows whatever the number of documents is.
    """
    step = BUCKETS // slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, index, gap = np.zeros((BUCKETS + 1, WIDTH), np.int64), index_vectors(seed), np.full(2, BUCKETS)
        some = False
        for batch in batches:
            for _, texts in chunks([pa.RecordBatch.from_arrays([batch.column(0), batch.column(0)], names=["id", "text"])]):
                both = [ids_of(t) for t in texts]
                for k in (0, 1):
                    add_context(sums, np.concatenate([x for ids in both for x in (ids[k], gap)]), index)
                some = True
        used = np.flatnonzero(sums[:BUCKETS].any(axis=1)) if some else np.empty(0, int)
        part = TaskContext.get().partitionId()
        for i in np.unique(used // step).tolist():  # only buckets that the task met
            at = used[used // step == i]
            yield slice_of(i, part, at % step, sums[at])

    def slice_of(i: int, part: int, at: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["slice", "part", "at", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, part, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                into = total.setdefault((i, part), np.zeros((step, WIDTH), np.int64))
                into[np.frombuffer(at.as_py(), "<i4")] += np.frombuffer(x.as_py(), np.int64).reshape(-1, WIDTH)
        for (i, part), x in total.items():
            yield slice_of(i, part, np.arange(step), x)

    schema = "slice int, part int, at binary, sums binary"
    texts = in_small_batches(docs.select(text_col))
    groups, rows = texts.rdd.getNumPartitions(), texts.mapInArrow(run, schema)
    while groups > 1:
        groups = -(-groups // merged)
        rows = rows.withColumn("part", F.col("part") % groups).repartition("slice", "part").mapInArrow(added, schema)
    out = np.zeros((BUCKETS, WIDTH), np.int64)
    for r in rows.collect():
        out[r["slice"] * step + np.frombuffer(bytes(r.at), "<i4")] += np.frombuffer(bytes(r.sums), np.int64).reshape(-1, WIDTH)
    return out


def word_vectors(context: np.ndarray, seed: int) -> np.ndarray:
    """Index and context vectors of all buckets together, and beside them their squares."""
    v = normed(index_vectors(seed)[:BUCKETS].astype(np.float32)) + normed(context.astype(np.float32))
    return np.concatenate((v, v * v), axis=1).astype(np.float32)


def counted(owner: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, bucket), in order, as one number each, and how often they are there; owners come in order."""
    order = np.argsort(own.astype(np.uint16), kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16) if owner[-1] < 1 << 16 else owner[order], kind="stable")]
    key = owner[order] * BUCKETS + own[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.diff(np.append(first, len(key)))


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """The documents' vectors: mean and spread of words and of shapes, length and how much each repeats itself."""
    out = np.zeros((len(texts), 4 * WIDTH + 4), np.float32)
    both = [ids_of(t) for t in texts]
    n = np.array([len(ids[0]) for ids in both], np.int64)
    if not n.sum():
        return out
    owner = np.repeat(np.arange(len(texts)), n)
    full = np.flatnonzero(n)
    for k in (0, 1):
        own = np.concatenate([ids[k] for ids in both])
        key, counts = counted(owner, own)
        of = key // BUCKETS
        first = np.flatnonzero(np.diff(of, prepend=-1))
        both_sums = np.zeros((len(full), 2 * WIDTH), np.float64)
        for lo in range(0, len(key), 1 << 15):  # bounded in memory, and each text's rows are added in order
            part = slice(lo, lo + (1 << 15))
            at = np.flatnonzero(np.diff(of[part], prepend=-1))
            both_sums[np.searchsorted(full, of[part][at])] += np.add.reduceat(vectors[key[part] % BUCKETS] * counts[part, None], at, axis=0, dtype=np.float64)
        mean, square = np.split(both_sums / n[full, None], 2, axis=1)
        out[full, 2 * k * WIDTH : (2 * k + 1) * WIDTH] = mean
        out[full, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        if k == 0:
            again = np.zeros(len(own), bool)
            again[1:] = (own[1:] == own[:-1]) & (owner[1:] == owner[:-1])
            out[full, -4] = np.log1p(n[full]) / 5
            out[full, -3] = np.diff(np.append(first, len(key))) / n[full]
            out[full, -2] = np.maximum.reduceat(counts, first) / n[full]
            out[full, -1] = np.bincount(owner, again, len(texts))[full] / np.maximum(1, n[full] - 1)
    return out


def network(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ p["w1"] + p["b1"], 0)
    return hidden, hidden @ p["w2"] + p["b2"][0]


def logits(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The network's outputs, each row by itself, so that a text's score does not depend on the texts around it."""
    hidden = np.maximum(np.einsum("ij,jk->ik", x, p["w1"]) + p["b1"], 0)
    return np.einsum("ij,j->i", hidden, p["w2"]) + p["b2"][0]


def train(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 40) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
    adam = Adam(p, 3e-3)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            a, b = x[order[i : i + 128]], y[order[i : i + 128]]
            hidden, z = network(a, p)
            d = (sigmoid(z) - b) / len(b)
            back = np.outer(d, p["w2"]) * (hidden > 0)
            adam.step({"w1": a.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])})
    return p


class Model:
    """Word vectors, scaling, network and temperature; its size does not grow with the data."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], vectors: np.ndarray, weight: float = 1.0, seed: int = 11):
        y = np.array([r[1] for r in rows], np.float64)
        self.prior = float(y.sum() / (y.sum() + weight * (len(y) - y.sum()))) if len(y) else 0.5
        self.params: dict[str, np.ndarray] | None = None
        if len(y) and 0 < self.prior < 1:
            self.vectors = vectors
            x = np.stack([r[2] for r in rows]).astype(np.float64)
            kept = calibration_part(np.array([r[0] for r in rows]))
            if len(set(y[~kept])) < 2:
                kept[:] = False
            self.mean, self.spread = x[~kept].mean(axis=0), np.maximum(x[~kept].std(axis=0), 1e-3)
            x = np.clip((x - self.mean) / self.spread, -8, 8)
            self.params = train(x[~kept], y[~kept], seed)
            self.params["b2"] = self.params["b2"] - np.log(weight)  # the sample has its own share of labels
            self.temperature = temperature(logits(x[kept], self.params), y[kept], weight)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.params is None:
            return np.full(len(texts), self.prior)
        x = pooled(texts, self.vectors).astype(np.float64)
        return sigmoid(logits(np.clip((x - self.mean) / self.spread, -8, 8), self.params) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Model:
    vectors = word_vectors(context_vectors(docs, text_col, seed), seed)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows, weight = sample(docs, labels, label, bound, id_col, text_col, lambda texts: [x.tobytes() for x in pooled(texts, shared.value)], 1 << 26)
    return Model([(i, y, np.frombuffer(x, np.float32)) for i, y, x in rows], vectors, weight, seed)


def score(docs: DataFrame, model: object, cut: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, for a model with ``scores``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.scores(texts), pa.float64())], names=[id_col, "score"])

    out = in_small_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col)).mapInArrow(run, f"{id_col} bigint, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: object, cut: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text a model scores ``cut`` or more; a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["id", "text"]), 0
            for _, t in chunks([texts]):
                yield batch.slice(done, len(t)).filter(pa.array(shared.value.scores(t) >= cut, pa.bool_()))
                done += len(t)

    return in_small_batches(docs).mapInArrow(run, docs.schema)
