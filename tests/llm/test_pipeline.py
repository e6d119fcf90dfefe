from __future__ import annotations

import corpus_pipeline as p
import pyarrow as pa
import pytest
from helpers import prose
from pyspark.sql import functions as F

from tidewright.llm import ngram_join, quality, substring_dedup
from tidewright.llm.common import BATCH, in_small_batches, table

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    model = quality.fit(docs, table(spark, DATA, "labels"))
    want = {r.doc_id for r in quality.score(docs, model, quality.CUT).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == columns and docs.dtypes == before.dtypes, name
        if k == 0:
            assert {r.doc_id for r in docs.collect()} == want
        if k == 1:
            assert ngram_join.similar(docs).where("n_links > 0").count() == 0
        if k == 2:
            assert docs.count() == before.count()
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    assert not [d for d in docs.collect() if any(i in d.text for i in items)]
    out = p.run(spark, DATA)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
    assert all(len(r.ids) == 4 * r.n_tokens for r in out.collect())


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (3, prose(1, 60)), (4, prose(1, 60)), (4, prose(1, 60))]])
def test_edges(spark, rows):
    schema = table(spark, DATA, "documents").schema
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() <= len(rows)


def test_repeats_leave_other_texts_alone(spark):
    a, b = prose(1, 60), prose(2, 30) + "\n\n" + prose(3, 30)
    docs = spark.createDataFrame([(1, a, "en", "s", len(a)), (2, b, "en", "s", len(b)), (3, b + " " + a, "en", "s", 9)], table(spark, DATA, "documents").schema)
    got = {r.doc_id: r for r in p.without_repeats(spark, docs, DATA).collect()}
    assert got[1].text == a and got[2].text == b and got[3].text == "" and got[3].n_chars == 0
    assert p.without_repeats(spark, docs.where(F.lit(False)), DATA).count() == 0


def test_clashing_columns_ties_and_repeated_rows(spark):
    names = ["n_removed", "kept", "n_words", "class_id", "n_links", "score", "spans", "item_id", "label", "set", "forms", "key"]
    passage = prose(7, 40)
    rows = [(1, passage + " " + prose(1, 40)), (1, passage + " " + prose(1, 40)), (2, prose(2, 40) + " " + passage), (3, prose(2, 40) + " " + passage), (None, prose(5, 60)), (6, None), (7, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in rows], schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        assert all(tuple(r[5:]) == tuple(range(len(names))) for r in out.collect()), name
        assert stage(spark, df.where("false"), DATA).count() == 0, name
    assert sorted(r.doc_id for r in p.one_of_each(spark, df, DATA).collect() if r.doc_id in (1, 2, 3)) == [1, 1, 2]
    assert p.STAGES[-1][1](spark, df, DATA).count() == len(rows)


def test_run_is_its_stages(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA).cache()
    assert sorted(map(tuple, p.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from tidewright.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpointed(Frame())


def test_texts_go_to_python_a_few_mb_at_a_time(spark):
    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))  # 30 MB
    kept = quality.accepted(rows, quality.Model([], None), 0.5)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert kept.count() == 300 and sizes.agg(F.max("n")).first()[0] < 5 << 20
    spark.conf.set(BATCH, "8m")
    assert in_small_batches(rows) is rows and spark.conf.get(BATCH) == "8m"  # the session's own bound stays
    spark.conf.unset(BATCH)


def test_results_leave_python_a_mb_at_a_time():
    texts = [None, "", *(f"{i} " * 30_000 for i in range(40)), "long " * 500_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts), pa.array([None] * len(texts), pa.list_(pa.int64()))], names=["k", "doc", "text", "spans"])
    out = list(substring_dedup.cut(iter([batch, batch.slice(0, 0)]), 13, lambda b, got: pa.RecordBatch.from_arrays([b.column(1), pa.array([g[2] for g in got], pa.string())], names=["doc", "kept"])))
    assert [d for b in out for d in b.column(0).to_pylist()] == list(range(len(texts))) and [x for b in out for x in b.column(1).to_pylist()] == [" ".join((t or "").split()) for t in texts]
    assert all(sum(len(x) for x in b.column(1).to_pylist()[1:]) <= 1 << 20 for b in out)
