from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest
from helpers import DOC_SCHEMA, edge_rows, prose
from pyspark.sql import functions as F

from tidewright.llm import merkle
from tidewright.llm.common import checkpointed, ranked

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(xs):
    return sha256("".join(xs).encode()).hexdigest()


def leaf(values):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, at, own, fan_out):
    """(siblings of ``at`` on the way up, root with ``own`` in its place, root)."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // fan_out * fan_out :][:fan_out]
        left, right = run[: at % fan_out], run[at % fan_out + 1 :]
        siblings += left + right
        own = h([*left, own, *right])
        nodes = [h(nodes[i : i + fan_out]) for i in range(0, len(nodes), fan_out)]
        at //= fan_out
    return siblings, own, nodes[0]


def brute(rows, fan_out):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    low = lambda x: (x is not None, x)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((low(r[0]), leaf(r), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:2])
    subroots = [climb([x[1] for x in trees[n]], 0, "", fan_out)[2] for n in names]
    out = []
    for i, n in enumerate(names):
        leaves = [x[1] for x in trees[n]]
        for at, (_, own, r) in enumerate(trees[n]):
            claimed = r if r[0] is None or crc32(str(r[0]).encode()) % 3 else (*r[:4], r[4] and r[4].translate(AZ))
            below, sub, _ = climb(leaves, at, leaf(claimed), fan_out)
            above, found, root = climb(subroots, i, sub, fan_out)
            out.append((r[0], own, subroots[i], root, h(below + above), found, found == root))
    return out


def claims():
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))}


def key(rows):
    return sorted(map(repr, rows))


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, 0.5, "x", 1, 2) for i, s, g, n, t in rows], DOC_SCHEMA).withColumn("tree", F.lit("t")).withColumn("digest", F.lit(1)).withColumn("idx", F.lit(7))


@pytest.mark.parametrize(("fan_out", "levels"), [(8, 4), (8, 1), (2, 1), (3, 2)])
def test_every_row_against_brute_force(spark, fan_out, levels):
    """Many blocks, trees of one leaf, of whole blocks and of one more, nulls, ties, repeated rows and clashing columns."""
    rows = [(i, f"s{i % 3}", "en", i, prose(i, 5).title()) for i in range(83)]
    rows += [(i, None, "de", None, "Grün") for i in range(64)] + [(1, "a", "fr", 1, "One")] + [(i, "a", f"l{i:02d}", 1, "T") for i in range(20)]
    rows += [(i, "s", None, 3, t) for i, t in edge_rows()] + [(None, "s", None, 3, "A"), (None, None, None, None, None), (None, None, "", None, ""), (5, "s", "en", 1, "B"), (5, "s", "en", 1, "B")]
    got = merkle.manifest(table(spark, rows).repartition(5), COLUMNS, "lang", "doc_id", claims(), fan_out, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(map(tuple, got.collect())) == key(brute(rows, fan_out))


def test_a_changed_row_is_found_and_only_that(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(40)]
    got = merkle.manifest(table(spark, rows), COLUMNS, "lang", "doc_id", {"text": F.when(F.col("doc_id") == 7, F.lit("text")).otherwise(F.col("text"))}).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]
    assert merkle.manifest(table(spark, rows), COLUMNS, "lang", "doc_id").where("not verified").isEmpty()


def test_empty_table_and_lone_row(spark):
    assert merkle.manifest(table(spark, []), COLUMNS, "lang", "doc_id", claims()).count() == 0
    (r,) = merkle.manifest(table(spark, [(2, "s", "en", 1, "a")]), COLUMNS, "lang", "doc_id").collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h([])


@pytest.mark.parametrize("levels", [None, 2, 3])
def test_witnesses_of_an_append_at_a_time(levels):
    for n in range(1, 28):
        tree, digests = merkle.Growing(3), [h([str(i)]) for i in range(n)]
        for d in digests:
            tree.append(d)
        if levels is not None and n > 3**levels:
            continue
        root = tree.close(levels)
        assert all(merkle.folded(d, w) == root for d, w in zip(digests, tree.witness, strict=True))
        if levels is None:
            assert root == climb(digests, 0, digests[0], 3)[2]


def test_places_over_many_partitions(spark):
    """One value that fills several partitions, equal rows and nulls in the order."""
    rows = [("a", i % 7 if i % 5 else None, i) for i in range(300)] + [("b", None, 0)] + [("c", 1, 5)] * 90 + [("d", i, i) for i in range(3)]
    df = checkpointed(spark.createDataFrame(rows, "g string, o int, x int").repartition(6))
    n = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, "g", ["o", "x"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n)
    for g in "abcd":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(len(mine)))
        assert [(r.o is not None, r.o, r.x) for r in mine] == sorted([(o is not None, o, x) for k, o, x in rows if k == g], key=lambda v: (v[0], v[1] or 0, v[2]))
