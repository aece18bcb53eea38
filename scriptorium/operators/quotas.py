"""Quotas and pacing of requests in order, without one task for a key.

``admitted`` gives every request its answer under a cap a day and one in all: the
first request of an id counts, the same id with the same content is answered again,
with other content it is a conflict. Since a day admits its first requests up to what
both caps leave, only as many of a day as its cap are ever ranked.

``paced`` gives every request of a host the time at which it may start, at least
``gap`` after the one before: start(i) = max(t(i), start(i-1) + gap) is i * gap plus
the running maximum of t(j) - j * gap. Requests are dealt into ranges in order; counts
and maxima of ranges run over the few ranges of a host, and each range is finished alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources.tables import shared_folder

#: Requests admitted on a day, and in all.
DAILY, TOTAL = 50, 10_000
RANGE_ROWS = 1 << 20


def admitted(requests: DataFrame, at: str, seq: str, id_col: str, content: str, daily: int = DAILY, total: int = TOTAL) -> DataFrame:
    """``requests`` with ``answer``: admitted, daily (the day is full), total (all are), again or conflict. Days are those of ``at`` (a date or timestamp); a null id or time is invalid. ``seq`` is total in a day. A column ``answer`` is replaced."""
    rows = requests.drop("answer").withColumn("_order", F.struct(F.col(at), F.col(seq)))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(at).isNotNull())
    first = valid.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct("_order", F.col(content).alias("hash"))).alias("_first"))
    first = first.select("_id", F.col("_first._order").alias("_first"), F.col("_first.hash").alias("_hash"), F.to_date(F.col(f"_first._order.{at}")).alias("_day"))
    days = first.groupBy("_day").agg(F.least(F.count("*"), F.lit(daily)).alias("_wanted"))
    before = F.coalesce(F.sum("_wanted").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a day
    days = days.select(F.col("_day").alias("_d"), F.greatest(F.lit(0), F.least(F.col("_wanted"), total - before)).alias("_room"))
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy("_day").orderBy("_first"))).where(F.col("_k") <= daily)  # others never leave their task
    inside = ranked.join(F.broadcast(days), F.col("_day") == F.col("_d")).where("_k <= _room").select(F.col("_id").alias("_in"))
    full = days.where(F.col("_room") < daily).select(F.col("_d").alias("_f"))
    told = first.join(inside, F.col("_id") == F.col("_in"), "left").join(F.broadcast(full), F.col("_day") == F.col("_f"), "left")
    told = told.select("_id", "_first", "_hash", F.when(F.col("_in").isNotNull(), "admitted").when(F.col("_f").isNotNull(), "total").otherwise("daily").alias("_told"))
    joined = rows.join(told, F.col(id_col) == F.col("_id"), "left")
    answer = F.when(F.col(id_col).isNull() | F.col(at).isNull(), "invalid").when(F.col("_order") == F.col("_first"), F.col("_told")).when(F.col(content).eqNullSafe(F.col("_hash")), "again").otherwise("conflict")
    return joined.withColumn("answer", answer).drop("_order", "_id", "_first", "_hash", "_told")


def paced(requests: DataFrame, host: str, at: str, seq: str, gap: int) -> DataFrame:
    """``requests`` with ``start`` (in the unit of the integer ``at``), in order of ``at`` and ``seq`` in each ``host``. A null time has a null start; a null host is a host. Columns ``start`` are replaced."""
    spark = requests.sparkSession
    rows = requests.drop("start")
    timed = rows.where(F.col(at).isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-timed.count() // RANGE_ROWS))
    path = f"{shared_folder(spark)}/paced-{uuid.uuid4().hex}"
    order = [F.col(host), F.col(at), F.col(seq)]
    timed.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    inner = W.partitionBy(host, "_range").orderBy(at, seq)
    numbered = dealt.withColumn("_k", F.row_number().over(inner))
    ahead = W.partitionBy(host).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sizes = dealt.groupBy(host, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    sizes = sizes.select(F.col(host).alias("_h"), F.col("_range").alias("_r"), "_before")
    same = F.col(host).eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_r"))
    placed = numbered.join(sizes, same).drop("_h", "_r").withColumn("_i", F.col("_before") + F.col("_k")).withColumn("_v", F.col(at) - F.col("_i") * gap)
    tops = placed.groupBy(host, "_range").agg(F.max("_v").alias("_top")).withColumn("_upto", F.max("_top").over(ahead))
    tops = tops.select(F.col(host).alias("_h"), F.col("_range").alias("_r"), "_upto")
    running = F.max("_v").over(inner.rowsBetween(W.unboundedPreceding, 0))
    done = placed.withColumn("_run", running).join(tops, same)
    out = done.withColumn("start", (F.col("_i") * gap + F.greatest("_run", "_upto")).cast("long")).select(*rows.columns, "start")
    return out.unionByName(rows.where(F.col(at).isNull()).withColumn("start", F.lit(None).cast("long")))
