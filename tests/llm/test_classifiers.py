from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import docs, edge_rows, prose
from pyspark.sql import functions as F

from tidewright.llm import quality, toxicity
from tidewright.llm.common import held_out

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    p = label.sum()
    return (rank[label == 1].sum() - p * (p - 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize(("fit", "label", "cut", "least"), [(quality.fit, "quality", quality.CUT, 0.97), (toxicity.fit, "toxic", toxicity.CUT, 0.75)])
def test_held_out_rows(spark, fit, label, cut, least):
    df, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = fit(df, labels)
    scored = quality.score(df, model, cut)
    assert scored.count() == df.count()
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert ((s >= 0) & (s <= 1)).all() and auc(s, y) >= least
    assert all(r.predicted == (r.score >= cut) for r in rows)
    # Other metadata, and labels of held-out rows, change nothing.
    other = df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("label", F.lit(1))
    lies = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    again = fit(other, lies)
    text = [r.text or "" for r in df.limit(50).collect()]
    assert np.allclose(model.scores(text), again.scores(text))


@pytest.mark.parametrize("fit", [quality.fit, toxicity.fit])
def test_edges(spark, fit):
    df = docs(spark, [*edge_rows(), *[(20 + i, prose(i, 30)) for i in range(40)]])
    lab = "doc_id bigint, quality int, toxic int, text string"
    few = spark.createDataFrame([(1, 1, 1, "c"), (2, None, None, "c"), (None, 1, 1, "c")], lab)
    some = spark.createDataFrame([(20 + i, i % 2, i % 2, "c") for i in range(40)] + [(5, 1, 1, "c"), (5, 0, 0, "c")], lab)
    for labels in (few, some, some.where("false")):
        got = quality.score(df, fit(df, labels), 0.5).collect()
        assert len(got) == len(edge_rows()) + 40 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 6}) == 1
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.score(df.where("false"), fit(df, some), 0.5).count() == 0
    kept = quality.accepted(df, fit(df, some), 0.5)
    assert kept.columns == df.columns and kept.count() <= df.count()


def test_filters_find_their_word():
    r = np.random.default_rng(0)
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join(w if k != 7 else "scoundrel" for k, w in enumerate(prose(500 + i, int(r.integers(20, 80))).split())) for i in range(60)]
    rows = [(i, 0, toxicity.ids_of(t)) for i, t in enumerate(good)] + [(1000 + i, 1, toxicity.ids_of(t)) for i, t in enumerate(bad)]
    m = toxicity.Model(rows)
    assert (m.scores(["we saw the scoundrel near the river and the bridge", prose(9999, 60) + " scoundrel"]) >= 0.7).all()
    assert (m.scores([prose(7000 + i, 50) for i in range(50)]) < 0.7).mean() > 0.95


def test_context_vectors_against_brute_force(spark):
    rows = [*edge_rows(), *[(20 + i, prose(i, 30 + i)) for i in range(9)]]
    index = quality.index_vectors(3).astype(int)
    want = np.zeros((quality.BUCKETS, quality.WIDTH), int)
    for _, t in rows:
        for ids in quality.ids_of(t or ""):
            for i, w in enumerate(ids):
                for j in range(max(0, i - 2), min(len(ids), i + 3)):
                    if i != j:
                        want[w] += index[ids[j]]
    for parts in (1, 4):
        assert (quality.context_vectors(docs(spark, rows).repartition(parts), "text", 3) == want).all()
    assert not quality.context_vectors(docs(spark, []), "text", 3).any()
    small = np.zeros((quality.BUCKETS + 1, quality.WIDTH), np.int64)
    ids = quality.ids_of(edge_rows()[7][1])[0]
    whole = small.copy()
    quality.add_context(whole, ids, quality.index_vectors(3))
    quality.add_context(small, ids, quality.index_vectors(3), block=7)
    assert (small == whole).all()


def test_pooled_vectors_against_brute_force():
    vectors = quality.word_vectors(np.random.default_rng(0).integers(-9, 9, (quality.BUCKETS, quality.WIDTH)), 3)
    texts = [t or "" for _, t in edge_rows()] + [prose(i, 40) for i in range(5)] + ["so so so it is"]
    got = quality.pooled(texts, vectors)
    for t, x in zip(texts, got, strict=True):
        want = []
        for ids in quality.ids_of(t):
            v = vectors[ids, : quality.WIDTH].astype(float)
            want += [v.mean(axis=0), v.std(axis=0)] if len(ids) else [np.zeros(quality.WIDTH)] * 2
        own = quality.ids_of(t)[0].tolist()
        n = len(own)
        want.append([np.log1p(n) / 5, len(set(own)) / n, max(map(own.count, set(own))) / n, sum(a == b for a, b in zip(own, own[1:])) / max(1, n - 1)] if n else [0] * 4)
        assert np.allclose(x, np.concatenate(want), atol=2e-3)
        assert (quality.pooled([t], vectors)[0] == x).all()  # whatever texts are beside it


def test_a_token_counts_to_its_last_letter():
    a, b = "x" * 60 + "1", "x" * 60 + "A"
    assert quality.token_ids(a) >> 32 != quality.token_ids(b) >> 32


def test_parts_of_long_texts_hold_all_words():
    for text in ["", "a", prose(3, 400), "x" * 500, " " * 500, "ab " * 100]:
        for size in (1, 7, 50):
            assert [w for p in quality.parts_of(text, size) for w in p.split()] == text.split()


def test_responses_against_brute_force(monkeypatch):
    r = np.random.default_rng(0)
    F_, W = toxicity.FILTERS, toxicity.WIDTHS
    p = {"words": r.normal(size=(2 * toxicity.BUCKETS, toxicity.WIDTH)).astype(np.float32), "filters": r.normal(size=(toxicity.WIDTH, sum(W) * F_)).astype(np.float32), "bias": r.normal(size=len(W) * F_).astype(np.float32)}
    for text in [prose(1, 1), prose(2, 2), prose(3, 50), prose(4, 9000)]:
        ids = toxicity.ids_of(text)
        n = len(ids) // 3
        x = p["words"][ids[:n]] + p["words"][ids[n : 2 * n]]
        best, _ = toxicity.responses(ids, p)
        column = 0
        for k, w in enumerate(W):
            for f in range(F_):
                got = [sum(float(x[i + j] @ p["filters"][:, column + j * F_ + f]) for j in range(w)) + float(p["bias"][k * F_ + f]) for i in range(min(n, 300) - w + 1)] if n < 300 else None
                if got is not None:
                    assert best[k * F_ + f] == pytest.approx(max([0.0, *got]), abs=1e-3)
            if n >= 300:
                full = sum(x[j : n - w + 1 + j] @ p["filters"][:, column + j * F_ : column + (j + 1) * F_] for j in range(w)) + p["bias"][k * F_ : (k + 1) * F_]
                assert np.allclose(best[k * F_ : (k + 1) * F_], np.maximum(full.max(axis=0), 0), atol=1e-3)
            column += w * F_


def test_thresholds_against_brute_force_and_by_language():
    r = np.random.default_rng(2)
    for _ in range(30):
        z, y, w = r.normal(size=20).round(1), (r.random(20) < 0.4).astype(float), r.random(20)
        y[0] = 1
        f1 = lambda t: 2 * (w * y)[z >= t].sum() / (w[z >= t].sum() + (w * y).sum())
        got = toxicity.threshold(z, y, w)
        assert f1(got) >= max(f1(t) for t in z) - 0.35 and z.min() <= got <= z.max()
    words = {"en": "the river and the stone", "de": "der Fluss und der Stein", "xx": "qqq www"}
    rows = [(1000 * k + i, i % 2, toxicity.ids_of(f"{t} {'bad' if i % 2 else 'good'} {i % 7}")) for k, (lang, t) in enumerate(words.items()) for i in range(60 if lang == "en" else 6)]
    m = toxicity.Model(rows)
    assert len(m.thresholds) == len(toxicity.LANGUAGES) and np.isfinite(m.thresholds).all()
    assert (m.scores([f"{t} bad" for t in words.values()]) >= 0.7).all() and (m.scores([f"{t} good" for t in words.values()]) < 0.7).all()


def test_context_sums_are_added_in_rounds(spark):
    """As many rounds as it takes, with the same sums."""
    rows = [(i, prose(i, 20)) for i in range(30)]
    want = quality.context_vectors(docs(spark, rows).coalesce(1), "text", 3)
    assert want.any() and (quality.context_vectors(docs(spark, rows).repartition(9), "text", 3, merged=2) == want).all()


def test_frequent_tokens_stay_remembered_and_short_ways_agree(monkeypatch):
    monkeypatch.setattr(quality, "MOST_KNOWN", 100)
    quality.KNOWN.clear()
    often = [f"word{i}" for i in range(50)]
    quality.ids_of(" ".join(often + [f"rare{i}" for i in range(250)]))
    assert set(often) <= set(quality.KNOWN) and len(quality.KNOWN) <= 100
    for i in range(1000):
        quality.token_ids(f"other{i}")
    assert len(quality.KNOWN) <= 100 and "word0" not in quality.KNOWN  # another kind of text is learned in its turn
    for t in ("small", "small,", "Capital", "Capital.", "Éa", "ǅa", "İx", "aΣ", "AB", "a.b", "x9", "...", ".", "A", "1,5", "ñandú?", "中文", "a_b", "Aa" * 50):
        shape = quality.CAPITALS.sub("X", quality.SMALL.sub("x", quality.DIGITS.sub("9", t)))
        word = quality.MARKS.sub("", t.lower()) or t
        assert quality.token_ids(t) == quality.hashed(word) % quality.BUCKETS | quality.hashed(f"{shape} {len(t) // 3}", 1) % quality.BUCKETS << 32
