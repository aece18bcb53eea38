"""The nearest point of another table on a line, without pairs of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """group, at, nearest: for each different (group, at) of ``left`` the id of the closest
    (group, at, id) of ``right`` in its group; ties go to the smaller id, groups without any are left out.

    Points are sorted inside cells of ``width``, so no group is sorted in one task, and each
    looks at the neighbour before it (or level with it) and after it; where its own cell holds
    none, at the last and first points of the cells around, one row a cell. Nulls match nothing.
    """
    points = right.where("at IS NOT NULL").groupBy("group", "at").agg(F.min("id").alias("id")).withColumn("asks", F.lit(0))
    asked = left.where("at IS NOT NULL").select("group", "at").distinct().withColumn("id", F.lit(None).cast(right.schema["id"].dataType)).withColumn("asks", F.lit(1))
    rows = points.unionByName(asked).withColumn("cell", F.floor(F.col("at") / width))
    point = F.when(F.col("asks") == 0, F.struct("at", "id"))

    inside = W.partitionBy("group", "cell").orderBy("at", "asks")
    below = F.last(point, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    above = F.first(point, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
    own = rows.withColumn("below", below).withColumn("above", above).where("asks = 1").select("group", "cell", "at", "below", "above")

    along = W.partitionBy("group").orderBy("cell")
    ends = rows.groupBy("group", "cell").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    earlier = F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    later = F.first("first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing))
    around = ends.select("group", "cell", earlier.alias("earlier"), later.alias("later"))

    candidates = F.array_compact(F.array(F.coalesce("below", "earlier"), F.coalesce("above", "later")))
    best = F.array_min(F.transform(candidates, lambda p: F.struct(F.abs(p["at"] - F.col("at")).alias("d"), p["id"].alias("id"))))
    return own.join(around, ["group", "cell"]).select("group", "at", best["id"].alias("nearest")).where("nearest IS NOT NULL")
