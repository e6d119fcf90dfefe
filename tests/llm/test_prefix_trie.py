from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewright.llm import prefix_trie as p
from tidewright.llm.queries import op12_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, name string, node string, size int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def sequences(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    h = {c: crc32(str(c).encode()) % 9 for c in own}
    base = {c: c - (c % 5 if c >= 0 else -(-c % 5)) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, ms in members.items():
        under = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        ends = ",".join(map(str, sorted(c for c in ms if len(seqs[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), sum(1 for x in members if x and x[:-1] == node), sum(x not in parents for x in under), saved, sha256(ends.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, rows))


def run(spark, rows, height, chunk):
    c = F.col("conv_id")
    turns = p.turns_of(table(spark, rows).repartition(3))
    return p.trie(p.rebuilt(turns, c - c % 5, F.crc32(c.cast("string")) % 9, 8, chunk), height, chunk)


def conversations(seed, n, most, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "é😀", "", None, "word"][:words])))
    return rows


@pytest.mark.parametrize(("height", "chunk", "most"), [(8, 4096, 6), (2, 3, 14), (1, 2, 9)])
def test_rebuilt_conversations_against_brute_force(spark, height, chunk, most):
    rows = conversations(height, 40, most) + [(None, 1, "user", "x"), (-7, 1, "user", "a"), (-5, 0, "user", "a"), (-5, 1, None, None), (5000003, 2, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "a")]
    got = run(spark, rows, height, chunk)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert key(map(tuple, got.collect())) == key(brute(sequences(rows)))


def test_long_conversations_and_copies(spark):
    """Depths of many halves, prefixes that end inside others, and many ids that end at one node."""
    long = [("user", f"t{i % 4}") for i in range(75)]
    seqs = {c: long[: n] for c, n in enumerate([75, 75, 74, 64, 63, 17, 16, 16, 1])} | {c: long[:40] + [("user", "other")] * (c % 3 * 9) for c in range(100, 140)}
    rows = [(c, i, *x) for c, s in seqs.items() for i, x in enumerate(s)]
    turns = p.turns_of(table(spark, rows))
    root = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(p.ROOT).alias("name"), F.lit(0).cast("long").alias("size"))
    for height, chunk in ((8, 4), (4, 4096)):
        got = p.trie(root.union(turns), height, chunk)
        assert key(map(tuple, got.collect())) == key(brute(seqs))


def test_conversations_without_turns_belong_to_the_root_alone(spark):
    c = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9 > 1)
    (r,) = run(spark, [(c, 0, "user", "gone")], 8, 4096).collect()
    assert tuple(r) == (c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_famous_parents_are_few(spark):
    """A root with most of the nodes as children, and others with some."""
    rows = [(c, t, "user", f"{c // 2 if t else c // 3}") for c in range(1500) for t in range(2)]
    turns = p.turns_of(table(spark, rows))
    root = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(p.ROOT).alias("name"), F.lit(0).cast("long").alias("size"))
    got = p.trie(root.union(turns)).collect()
    seqs = sequences(rows, rebuild=False)
    first, node = {}, {}
    for c in sorted(seqs):
        first.setdefault(seqs[c][0], c)
        node.setdefault(tuple(seqs[c]), c)
    assert {(r.conv_id, r.depth, r.parent_conv_id) for r in got} == {(0, 0, None)} | {(c, 1, 0) for c in first.values()} | {(c, 2, first[s[0]]) for s, c in node.items()}
