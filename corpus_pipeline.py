"""The corpus pipeline: documents in, packed training sequences out.

Toxic and poor documents go, one document of each group of near copies stays,
documents with benchmark passages go, and the rest is packed. Every stage works
on all that the one before kept; all but the last return the columns of
``documents``. A stage keeps rows with a null doc_id, null or empty text unless
its own score says otherwise; an empty table passes through as one.

No stage is plain SQL (three fit or walk something that SQL cannot express), so
``ORACLE_SQL`` is None. The whole chain is tested against plain code, stage by stage,
and on odd rows; the classifiers also against held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontam, jaccard_join, q08_packing, quality, toxicity
from scriptorium.llm._common import materialise, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, jaccard_join.Params(words=5, percent=80))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return q08_packing.packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("quality classifier", poor_out), ("n-gram Jaccard join", copies_out), ("benchmark decontamination", benchmark_out), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
