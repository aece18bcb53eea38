"""op6: which documents hold which benchmark items."""

from pyspark.sql import DataFrame, SparkSession

from . import decontam
from ._common import table


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
