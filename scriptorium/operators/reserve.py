"""Reservations against a budget in order, without one task for a key.

A row is accepted if it still fits; a refused row uses nothing. With the room of a key in
[h, 2h) for a power of two h, rows of at most h all fit until the room falls below
h, and of larger rows at most the first that fits gets in, as it leaves less than h. So one
phase decides all rows up to the one that takes the room below h: prefix sums of small rows
give its place. The room halves at least, and the phases are as many as the budget has
binary digits, for all keys at once.

Rows are dealt once into ranges in order and written; sums of ranges run over the few
ranges of a key. A key of one range's rows at most needs no phases: its rows are folded in order.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources.tables import shared_folder

RANGE_ROWS = 1 << 20


def reserve(rows: DataFrame, key: str, order: str, size: str, budget: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, order, accepted), a row for each of ``rows``, taken in order of ``order`` and then of size within each ``key``.

    Null and negative sizes are 0, a null key is a key, a null order comes first. Of rows alike in key, order and size it does not
    matter which one is meant. Rows above the whole budget are refused without being dealt.
    """
    narrow = rows.select(F.col(key).alias("s"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    fitting = narrow.where(F.col("n") <= budget)
    large = fitting.groupBy(F.col("s").alias("k")).count().where(F.col("count") > range_rows).select("k")
    here = F.col("s").eqNullSafe(F.col("k"))

    def fold(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[("o", "ascending"), ("n", "ascending")], null_placement="at_start"))
        left, kept = budget, []
        for n in part["n"].to_pylist():
            kept.append(n <= left)
            left -= n if n <= left else 0
        return part.select(["s", "o"]).append_column("accepted", pa.array(kept, pa.bool_()))

    kinds = dict(narrow.dtypes)
    folded = fitting.join(large, here, "left_anti").groupBy("s").applyInArrow(fold, f"s {kinds['s']}, o {kinds['o']}, accepted boolean")
    out = folded.unionByName(narrow.where(F.col("n") > budget).select("s", "o", F.lit(False).alias("accepted")))
    if not large.isEmpty():
        out = out.unionByName(_by_phases(fitting.join(large, here, "left_semi"), budget, range_rows))
    return out.select(F.col("s").alias(key), F.col("o").alias(order), "accepted")


def _by_phases(fitting: DataFrame, budget: int, range_rows: int) -> DataFrame:
    """(s, o, accepted) of rows (s, o, n) that fit into the budget alone."""
    spark = fitting.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fitting.count() // range_rows))
    path = f"{shared_folder(spark)}/reserve-{uuid.uuid4().hex}"
    dealt = fitting.repartitionByRange(parts, "s", "o", "n").sortWithinPartitions("s", "o", "n")
    dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()).write.parquet(f"{path}/rows")
    dealt = spark.read.parquet(f"{path}/rows")
    spark.createDataFrame([], dealt.select("s").schema).select("s", F.lit(0).cast("int").alias("phase"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("room")).write.parquet(f"{path}/log")
    dealt.groupBy("s").agg(F.lit(0).alias("phase"), F.lit(-1).cast("long").alias("after"), F.lit(budget).cast("long").alias("room")).write.mode("append").parquet(f"{path}/log")
    half = F.when(F.col("room") > 0, F.expr("shiftleft(1L, length(bin(room)) - 1)")).otherwise(0)
    for phase in range(budget.bit_length() + 1):
        now = spark.read.parquet(f"{path}/log").where(F.col("phase") == phase).select(F.col("s").alias("k"), "after", "room", half.alias("half"))
        live = dealt.join(now, F.col("s").eqNullSafe(F.col("k"))).where("at > after AND n <= room")
        small = F.when(F.col("n") <= F.col("half"), F.col("n")).otherwise(0)
        sums = live.groupBy(F.col("s").alias("k"), F.col("range").alias("r")).agg(F.sum(small).alias("sum"))
        sums = sums.select("k", "r", F.coalesce(F.sum("sum").over(W.partitionBy("k").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        upto = F.sum(small).over(W.partitionBy("s", "range").orderBy("at"))
        left = live.drop("k").withColumn("upto", upto).join(sums, F.col("s").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r"))).withColumn("left", F.col("room") - F.col("before") - F.col("upto"))
        ending = F.when(F.col("n") > F.col("half"), F.when(F.col("n") <= F.col("left"), F.col("left") - F.col("n"))).when(F.col("left") < F.col("half"), F.col("left"))
        ends = left.withColumn("rest", ending).where("rest IS NOT NULL").groupBy("s").agg(F.min(F.struct("at", "rest")).alias("e"))
        ends.select("s", F.lit(phase + 1).alias("phase"), F.col("e.at").alias("after"), F.col("e.rest").alias("room")).write.mode("append").parquet(f"{path}/log")
        if spark.read.parquet(f"{path}/log").where(F.col("phase") == phase + 1).isEmpty():
            break
    log = spark.read.parquet(f"{path}/log").groupBy(F.col("s").alias("k")).agg(F.collect_list(F.struct("phase", "after", half.alias("half"))).alias("log"))  # a row for a binary digit of the budget
    last = F.filter("log", lambda p: p["after"] < F.col("at"))
    decided = dealt.join(log, F.col("s").eqNullSafe(F.col("k"))).withColumn("in", F.array_max(last))
    accepted = (F.col("n") <= F.col("in.half")) | F.exists("log", lambda p: p["after"] == F.col("at"))
    return decided.select("s", "o", accepted.alias("accepted"))
