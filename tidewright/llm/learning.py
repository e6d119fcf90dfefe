"""What the two classifiers share: their sample of labelled rows, an optimiser, and calibration.

Defined results: null labels, null ids and held-out ids are not learned from; of several labels of an id the greatest
counts; an id with several texts has a row for each distinct one, within the bound; null texts count as empty; without
rows the sample is empty and the weight 1; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import chunks, held_out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


def labelled_ids(labels: DataFrame, label: str, bound: int, id_col: str) -> tuple[DataFrame, dict[int, int]]:
    """At most ``bound`` (id, label) of each label that may be learned from, in the order of a hash of the id; and how many there are.

    Of several labels of an id the greatest counts; null labels, null ids and held-out ids are left out.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    there = {r.label: r["count"] for r in rows.where("label in (0, 1)").groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(bound) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), there


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str, features: Callable[[list[str]], list[bytes]], most_bytes: int) -> tuple[list[tuple[int, int, bytes]], float]:
    """(id, label, features of the whole text) of the sample, sorted by id, and the weight of a row of label 0 in it that
    restores the share of the labels.  Texts become features on the executors.

    Besides ``bound`` rows of each label at most ``most_bytes`` bytes of features are taken of each: rows beyond them, in the
    order of a hash of the id, are left out whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = iter(batch.column(2).to_pylist())
            for ids, texts in chunks([batch]):
                got = features(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([next(labels) for _ in ids], pa.int32()), pa.array(got, pa.binary()), pa.array([len(x) for x in got], pa.int64())], names=["id", "label", "features", "bytes"])

    chosen, there = labelled_ids(labels, label, bound, id_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(run, "id bigint, label int, features binary, bytes bigint").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "features")
    rows = rows.withColumn("row", F.row_number().over(order)).where(F.col("row") <= bound).withColumn("so_far", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("so_far") <= most_bytes).select("id", "label", "features").collect()
    taken = [sum(r.label == k for r in rows) for k in (0, 1)]
    weight = (there[0] / taken[0]) / (there[1] / taken[1]) if all(taken) else 1.0
    return sorted((r.id, r.label, bytes(r.features)) for r in rows), weight


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


def temperature(logits: np.ndarray, labels: np.ndarray, weight: float = 1.0) -> float:
    """The temperature of least log loss, from a grid; ``weight`` is that of a row of label 0."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    w = np.where(labels == 1, 1.0, weight)
    loss = [-(w * np.log(np.clip(np.where(labels == 1, sigmoid(logits / t), sigmoid(-logits / t)), 1e-12, 1))).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    """To which of ``n`` folds each id belongs."""
    from tidewright.llm.common import mix

    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(int)


def calibration_part(ids: np.ndarray) -> np.ndarray:
    """True for the fifth of the sample that calibrates."""
    from tidewright.llm.common import mix

    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
