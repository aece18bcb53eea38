"""op7: components of all documents under Jaccard >= 0.9 on three-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join
from ._common import table

PARAMS = jaccard_join.Params(words=3, percent=90)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), PARAMS)
