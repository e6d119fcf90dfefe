"""A corpus pipeline in five stages over the documents table.

Each stage works on all rows that the one before it kept.  Rows with a null id are never duplicates or contaminated and
stay; of rows with equal texts the one of smallest id stays, and rows that repeat an id stay or go together; null and empty
texts are scored like others and lose nothing; very long texts are handled whole; further columns, whatever their names,
are carried through to the last stage; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, decontaminate, ngram_join, quality, substring_dedup
from tidewright.llm.common import checkpointed, table
from tidewright.llm.queries import rank_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")), quality.CUT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 0.8 or more connect, the one of smallest id."""
    dropped = ngram_join.similar(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that an earlier document has; the text of those that lose none stays as it is."""
    return substring_dedup.rewritten(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of what is left, with digests of them and of what they decode to."""
    out = byte_bpe.round_trip(docs, rank_file())
    return out.select("doc_id", "n_tokens", F.col("ids_le").alias("ids"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("benchmark", uncontaminated),
    ("tokens", tokens),
]
#: No SQL expresses the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
