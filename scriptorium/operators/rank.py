"""Gapless global rank without sorting everything in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources.tables import shared_folder


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, ... in ``order``, which must be total: rows are dealt into ranges, a range
    is ranked alone and begins where the ranges before it end (one number each).

    The bounds of ranges come from a sample that differs from run to run, so the dealt
    rows are written once and both the sizes and the ranks are read from that table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/rank-{uuid.uuid4().hex}"
    df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_k", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")
