"""op11: every document's weight, score and rank in a sample like the benchmark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance as I
from ._common import table

PARAMS = I.Params(buckets=10_000, min_words=20, percent=25, seed=7)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = I.weights(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text", PARAMS)
    return I.resample(weighed, PARAMS).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
