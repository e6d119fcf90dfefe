from __future__ import annotations

import numpy as np
from helpers import docs, edge_rows, prose

from tidewright.llm import ngram_join as j
from tidewright.llm.components import components


def brute(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()
    ids, parent, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (root(i), links[i]) for i in ids}


def edited(text, seed, share):
    r = np.random.default_rng(seed)
    return " ".join(w if r.random() > share else f"new{seed}x{i}" for i, w in enumerate(text.split()))


def test_against_brute_force_with_and_without_splitting(spark):
    rows = [x for x in dict(edge_rows()).items()] + [(None, prose(1, 60))]
    rows += [(200 + i, edited(prose(8, 200), i, 0.008)) for i in range(30)] + [(300 + i, prose(9, 40)) for i in range(6)] + [(400 + i, edited(prose(10, 300), i, 0.02)) for i in range(8)]
    rows += [(500, "same four words here"), (501, "Same FOUR words here"), (502, "word"), (503, "word")]
    want = brute([r for r in rows if r[0] is not None])
    for block in (512, 6):
        got = {r.doc_id: (r.class_id, r.n_links) for r in j.similar(docs(spark, rows), block=block).collect()}
        assert got == want


def test_blocks_are_bounded_in_characters(spark, monkeypatch):
    rows = [(i, edited(prose(8, 200), i, 0.008)) for i in range(12)]
    monkeypatch.setattr(j, "BLOCK_CHARS", 4000)
    assert {r.doc_id: (r.class_id, r.n_links) for r in j.similar(docs(spark, rows)).collect()} == brute(rows)


def test_banding_reaches_its_recall_even_beyond_its_hashes():
    for t, most in ((0.02, 160), (0.8, 3), (1.0, 160)):
        bands, rows = j.banding(t, 0.999, most)
        assert 1 - (1 - t**rows) ** bands >= 0.999


def test_banding_reaches_its_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = j.banding(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= 160


def test_exact_links_in_blocks():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[i != k and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for k, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (j.linked(sets, None, 0.5) == want).all()
    assert (j.linked(sets[:15], sets[15:], 0.5) == want[:15, 15:]).all()


def test_empty(spark):
    assert j.similar(docs(spark, [])).count() == 0
    assert {(r.class_id, r.n_links) for r in j.similar(docs(spark, [(1, None), (2, "")])).collect()} == {(1, 0), (2, 0)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {99: 99, 100: 99, 101: 99}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    """Each text keeps its own links, and the texts of an id are in one class; repeated rows change nothing."""
    a, b = prose(11, 60), prose(12, 60)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    for again in ([], [(2, a + " z")] * 5 + [(1, a)] * 3):
        got = {(r.doc_id, r.class_id, r.copy_of, r.n_links) for r in j.similar(docs(spark, rows + again)).collect()}
        assert got == {(1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 3, 1)}
    assert j.similar(docs(spark, rows + [(2, a + " z")])).where("doc_id = 2").count() == 2
    mixed = [(9, a), (9, None), (9, ""), (4, a), (4, "one"), (5, "one"), (-6, "one")]
    got = {(r.doc_id, r.class_id, r.copy_of, r.n_links) for r in j.similar(docs(spark, mixed)).collect()}
    # 4 has two texts: one that 9 has too, and one that 5 and -6 have
    assert got == {(9, -6, 4, 1), (4, -6, -6, 3), (5, -6, -6, 2), (-6, -6, -6, 2)}


def test_nodes_ascend_by_their_least_id(spark):
    from pyspark.sql import functions as F

    ids = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(i, bytes([9 - k] * 16)) for k, i in enumerate(ids)], "i long, d binary")
    got = df.select("i", j.node_of(F.col("i"), F.col("d")).alias("n")).withColumn("back", j.least_id(F.col("n"))).orderBy("n").collect()
    assert [r.i for r in got] == [r.back for r in got] == ids and all(len(r.n) == 24 for r in got)
