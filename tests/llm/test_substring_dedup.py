from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from helpers import docs, edge_rows, prose

from tidewright.llm import substring_dedup as s


def brute(rows, width=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[j : j + width])] < i:
                keep[j : j + width] = [False] * width
        out.append((i, len(w), keep.count(False), " ".join(a for a, k in zip(w, keep, strict=True) if k)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    shared = prose(7, 40)
    rows = [*edge_rows(), (None, prose(1, 60)), (30, prose(2, 50) + " " + shared + " " + prose(3, 20)), (31, shared), (29, prose(4, 5) + "\n" + shared.replace(" ", "\n")), (32, prose(5, 13)), (33, prose(5, 13)), (34, prose(6, 12)), (35, prose(6, 12)), (36, "a " * 300), (37, "a " * 20), (29, "other text under the same id")]
    rows += [(100 + i, prose(50 + i % 4, 30) + " " + shared) for i in range(30)] + [(i, prose(77, 70_000)) for i in (60, 61)]
    for parts in (1, 5):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in s.dedup(docs(spark, rows).repartition(parts)).collect()), key=str)
        assert got == brute(rows)


def test_blocks_and_batches_do_not_matter(spark, monkeypatch):
    rows = [(i, prose(i % 5, 80)) for i in range(20)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc", "text"])])

    def spans(block_words, batch_rows):
        monkeypatch.setattr(s, "BLOCK_WORDS", block_words)
        t = pa.Table.from_batches(list(s.stretches(batches(), 13, 3))).sort_by([("m", "ascending"), ("doc", "ascending")])
        out = set()
        for b in s.repeats(iter(t.to_batches(max_chunksize=batch_rows))):
            for doc, at, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out |= {(doc, at + j) for j in range(n)}
        return out

    assert spans(1 << 20, 10_000) == spans(100, 10_000) == spans(100, 3) == spans(300, 1)


def test_minimizers_are_those_of_the_window():
    h = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    at, best = s.minimizers(h, 13, 3)
    seeds = s.rolled(h, 3)
    for i in range(len(at)):
        assert best[i] == seeds[i : i + 11].min() and seeds[at[i]] == best[i] and i <= at[i] < i + 11


def test_columns_are_carried_and_empty_tables_work(spark):
    df = docs(spark, edge_rows())
    out = s.dedup(df, carry=("text", "m", "words"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "text", "m", "words"] and out.count() == len(edge_rows())
    assert s.dedup(df.where("false")).count() == 0


def test_crowded_minimizers_are_spread_and_equal_windows_still_meet(spark, monkeypatch):
    passage = prose(7, 40)
    rows = [(i, prose(1000 + i, 20) + " " + passage + " " + prose(2000 + i, 20)) for i in range(120)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc", "text"])])
    monkeypatch.setattr(s, "SAMPLED", 1.0)
    monkeypatch.setattr(s, "CROWDED", 60)
    crowded = s.crowded_minimizers(docs(spark, rows).selectExpr("doc_id doc", "text"), 13, 3)
    assert 0 < len(crowded) < 20

    def most(crowded):
        t = pa.Table.from_batches(list(s.stretches(batches(), 13, 3, crowded)))
        return max(t.filter(t["windows"].is_valid()).group_by("m").aggregate([("doc", "count")])["doc_count"].to_pylist())

    assert most(s.NONE) >= 60 > most(crowded)
    for least in (1, 60):
        monkeypatch.setattr(s, "CROWDED", least)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in s.dedup(docs(spark, rows).repartition(5)).collect()), key=str)
        assert got == brute(rows)


def test_windows_that_agree_in_most_bits_are_told_apart(monkeypatch):
    rows = [(i, prose(i, 40)) for i in range(9)]
    rolled, fresh = s.rolled, iter(range(10_000))
    monkeypatch.setattr(s, "rolled", lambda h, k: rolled(h, k) if k != 13 else np.array([next(fresh) << 48 for _ in range(len(h) - 12)], np.uint64))
    monkeypatch.setattr(s, "minimizers", lambda h, width, seed: (np.zeros(len(h) - 12, int), np.zeros(len(h) - 12, np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc", "text"])
    t = pa.Table.from_batches(list(s.stretches(iter([batch]), 13, 3))).sort_by([("m", "ascending"), ("doc", "ascending")])
    assert sum(b.num_rows for b in s.repeats(iter(t.to_batches()))) == 0


def test_clashing_columns_copies_of_ids_and_rewriting(spark):
    passage = prose(7, 40)
    rows = [(1, passage + " " + prose(1, 20)), (2, prose(2, 20) + " " + passage), (2, passage + " " + prose(3, 9)), (2, prose(2, 20) + " " + passage), (None, passage), (None, passage), (3, None), (4, "")]
    names = "doc_id bigint, text string, n_removed string, kept int, n_words bigint, n_chars int, src int, k int, spans string"
    df = spark.createDataFrame([(i, t, f"r{n}", n, n, len(t or ""), n, n, "s") for n, (i, t) in enumerate(rows)], names)
    out = s.rewritten(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.kept: r for r in out.collect()}
    for n, (_, n_words, removed, kept) in enumerate(brute_in_order(rows)):
        assert got[n].n_removed == f"r{n}" and got[n].n_words == n
        assert got[n].text == (kept if removed else rows[n][1]) and got[n].n_chars == (len(kept) if removed else len(rows[n][1] or ""))
    carried = s.dedup(df, carry=("kept", "n_removed", "text"))
    assert carried.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_", "n_removed_", "text"]
    assert {r.kept_: (r.n_words, r.n_removed, r.kept, r.text) for r in carried.collect()} == {n: (*x[1:], rows[n][1]) for n, x in enumerate(brute_in_order(rows))}


def brute_in_order(rows):
    found = {(i, n): x for i, n, x in ((x[0], n, x) for n, x in enumerate(brute_each(rows)))}
    return [found[i, n] for n, (i, _) in enumerate(rows)]


def brute_each(rows):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in sorted(zip(rows, words), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        for j in range(len(w) - 12) if i is not None else ():
            first.setdefault(tuple(w[j : j + 13]), i)
    for (i, _), w in zip(rows, words):
        keep = [i is None or not any(first[tuple(w[j : j + 13])] < i for j in range(max(0, k - 12), min(k, len(w) - 13) + 1)) for k in range(len(w))]
        yield i, len(w), keep.count(False), " ".join(a for a, k in zip(w, keep) if k)


def test_edges_that_only_look_equal_are_not_taken_out(spark, monkeypatch):
    """With every edge hash equal, the check of the words at both coordinates keeps all that is not there word for word."""
    rows = [(i, prose(i, 40)) for i in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc", "text"])
    t = pa.Table.from_batches(list(s.stretches(iter([batch]), 13, 3)))
    blobs = pa.array([None if b is None else bytes(len(b)) for b in t["windows"].to_pylist()], pa.binary())
    t = t.set_column(0, "m", pa.array([0] * len(t), pa.int64())).set_column(3, "windows", blobs).sort_by("doc")
    runs = [r for b in s.repeats(iter(t.to_batches())) for r in b.to_pylist()]
    assert runs and all(r["src"] == r["doc"] - 1 for r in runs)
    words = {i: s.WORDS.findall(x) for i, x in rows}
    for i, text in rows:
        spans = [r | {"proof": s.digest(words[r["src"]], r["src_at"], r["n"], 13)} for r in runs if r["doc"] == i]
        assert s.kept_words(text, spans, 13) == (40, 0, text)


def test_paths_go_on_over_stretches_and_end_at_branches(spark):
    rows = [(5, 1, 0, 4, 2, 10), (5, 1, 4, 3, 2, 14), (5, 1, 7, 2, 3, 0), (5, 1, 9, 2, 2, 19), (5, 1, 20, 2, 2, 30), (5, 9, 11, 1, 2, 21), (5, 1, 4, 3, 2, 14)]
    got = s.paths(spark.createDataFrame(rows, "doc long, sub long, at int, n int, src long, src_at int")).collect()
    assert sorted(map(tuple, got)) == [(5, 1, 0, 7, 2, 10), (5, 1, 7, 2, 3, 0), (5, 1, 9, 2, 2, 19), (5, 1, 20, 2, 2, 30), (5, 9, 11, 1, 2, 21)]


def test_texts_are_shuffled_once(spark):
    df = docs(spark, edge_rows())
    s.dedup(df).collect()
    out = s.dedup(df)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_sources_with_two_texts_under_one_id(spark):
    """A passage that goes from one text of a source to another, at the same places of both, goes whole."""
    w = [f"w{i}" for i in range(40)]
    filler = [f"f{i}" for i in range(12)]
    a, b, d = " ".join(w[:25]), " ".join(filler + w[12:]), " ".join(w)
    for first, second in ((1, 1), (1, 2)):
        got = {(r.doc_id, r.n_words): r.n_removed for r in s.dedup(docs(spark, [(first, a), (second, b), (5, d)])).collect()}
        assert got[5, 40] == 40 and got[first, 25] == 0
    # both texts of an id have a window, in one block and apart
    rows = [(1, " ".join(w[:20])), (1, " ".join(w[5:30])), (3, " ".join(w[:30] + filler)), (4, " ".join(filler + w))]
    for parts in (1, 4):
        got = {(r.doc_id, r.n_words): r.n_removed for r in s.dedup(docs(spark, rows).repartition(parts)).collect()}
        assert got == {(1, 20): 0, (1, 25): 0, (3, 42): 30, (4, 52): 30}
