from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann
from tidewright.llm.queries import op6_ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, g int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    out = {}
    for q in queries:
        v = dict(rows)[q]
        d = sorted((float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = d[:k]
    return out


def test_small_tables_are_exact_with_ties_copies_and_bad_rows(spark):
    r = np.random.default_rng(0)
    good = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)] + [(i, [1.0] * 8) for i in range(100, 140)] + [(200, [2.0, 0.0]), (201, [1.0, 1.0])]
    bad = [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf"), *[1.0] * 7]), (305, []), (400, [0.0] * 8)]
    got = {}
    for x in ann.search(table(spark, good + bad), F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.score, x.vec_id))
    want = brute(good, [i for i, _ in good if i % 20 == 0], 5)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1))
        assert [(pytest.approx(s, abs=1e-12), i) for s, i in want[q]] == [(s, i) for _, s, i in sorted(rows)]


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = op6_ann(spark, "/root/testdata/sf0.01").collect()
    hits = sum((x.query_id, x.vec_id) in {(q, i) for q, d in want.items() for _, i in d} for x in got)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_transform_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


def test_split_groups_and_empty(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(80)]
    a = sorted(map(tuple, ann.search(table(spark, rows), F.col("id") % 20 == 0, k=3, block=4).collect()))
    b = sorted(map(tuple, ann.search(table(spark, rows), F.col("id") % 20 == 0, k=3).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert ann.search(table(spark, []), F.col("id") % 20 == 0).count() == 0


def test_hot_buckets_and_many_queries_are_split(spark):
    r = np.random.default_rng(3)
    rows = [(i, (np.array([1.0] * 8) + 0.01 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(300)] + [(1000 + i, r.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    got = ann.search(table(spark, rows), F.col("id") % 2 == 0, k=5, block=32).collect()
    want = brute(rows, [i for i, _ in rows if i % 2 == 0], 5)
    hits = sum((x.query_id, x.vec_id) in {(q, i) for q, d in want.items() for _, i in d} for x in got)
    assert len(got) == 5 * len(want) and hits / len(got) >= 0.9
    assert all(x.score == pytest.approx(dict((i, s) for s, i in brute(rows, [x.query_id], 500)[x.query_id])[x.vec_id], abs=1e-12) for x in got[:40])


def test_fewer_vectors_than_neighbours_and_doubles(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(30, [1.0, 2.5]), (31, [-1.0, 0.1]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for x in ann.search(df, F.col("id").isin(0, 19, 30, 40), k=10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert [i for _, i, _ in sorted(got[0])] == list(range(1, 11)) and [i for _, i, _ in sorted(got[19])] == list(range(10))
    assert [i for _, i, _ in sorted(got[30])] == list(range(10)) and 40 not in got


def test_recall_on_vectors_that_no_setting_was_chosen_by(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(6000, 40)) + 0.4 * r.normal(size=(30, 40))[r.integers(0, 30, 6000)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = ann.search(table(spark, rows), F.col("id") % 100 == 0).collect()
    f = np.array([v for _, v in rows], np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((f - f[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & {y.vec_id for y in got if y.query_id == q})
    assert hits / 600 >= 0.9
