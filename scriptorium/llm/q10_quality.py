"""op10: a quality score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from ._common import table
from ._fit import held_out

AT = 0.3


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
