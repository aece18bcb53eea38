"""Saves that name the revision they build on, replayed without a loop over a path.

A save is accepted if the revision that it expects is its path's current one; then its
own is. The accepted saves of a path are a chain: behind each the next one is the
first later save that expects its revision. That pointer is one window over (path,
revision), and the saves that the start reaches are found by pointer doubling: each
round joins what is known to jumps twice as long, so a path with a million saves takes
twenty joins, dealt by (path, number), and is never one task.

A request id that was seen is answered as before if its content is the same, else it
is a conflict of ids. A null expected revision means that the path is new. A null path,
id or number is invalid.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources.tables import shared_folder

START = -(1 << 62)


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/revisions-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def replayed(saves: DataFrame, path: str, seq: str, request: str, expected: str, revision: str) -> DataFrame:
    """``saves`` with ``answer``: accepted, conflict (of revisions), again, reused (a seen id with other content) or invalid. ``seq`` is a number without repetitions. A column ``answer`` is replaced."""
    rows = saves.drop("answer")
    valid = rows.where(F.col(path).isNotNull() & F.col(request).isNotNull() & F.col(seq).isNotNull())
    body = F.struct(F.col(path).alias("p"), F.col(expected).alias("e"), F.col(revision).alias("r"))
    first = valid.groupBy(F.col(request).alias("_id")).agg(F.min(F.struct(F.col(seq).cast("long").alias("s"), body.alias("b"))).alias("_f")).select("_id", F.col("_f.s").alias("_first"), F.col("_f.b").alias("_body"))
    nodes = _stored(first.select(F.col("_body.p").alias("p"), F.col("_first").alias("s"), F.col("_body.e").alias("e"), F.col("_body.r").alias("r")))
    offers = nodes.select("p", "s", F.col("r").alias("rev"), F.lit(None).cast("long").alias("ask"))
    starts = nodes.select("p").distinct().select("p", F.lit(START).alias("s"), F.lit(None).cast(dict(nodes.dtypes)["r"]).alias("rev"), F.lit(None).cast("long").alias("ask"))
    asks = nodes.select("p", "s", F.col("e").alias("rev"), F.col("s").alias("ask"))
    # backwards in order; a save's own request comes behind its own revision, as it cannot follow itself
    back = W.partitionBy("p", "rev").orderBy(F.desc("s"), F.col("ask").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    jumps = _stored(offers.unionByName(starts).unionByName(asks).withColumn("to", F.last("ask", ignorenulls=True).over(back)).where("ask IS NULL AND to IS NOT NULL").select("p", "s", "to"))
    reached = _stored(jumps.where(F.col("s") == START).select("p", F.col("to").alias("s")))
    known = reached.count()
    while True:
        step = jumps.join(reached, ["p", "s"]).select("p", F.col("to").alias("s"))
        more = _stored(reached.unionByName(step).distinct())
        now = more.count()
        if now == known:
            break
        reached, known = more, now
        far = jumps.select("p", F.col("s").alias("to"), F.col("to").alias("further"))
        jumps = _stored(jumps.join(far, ["p", "to"]).select("p", "s", F.col("further").alias("to")))
    accepted = reached.select(F.col("p").alias("_p"), F.col("s").alias("_s"), F.lit(True).alias("_in"))
    told = first.join(accepted, (F.col("_body.p") == F.col("_p")) & (F.col("_first") == F.col("_s")), "left").select("_id", "_first", "_body", "_in")
    joined = rows.join(told, F.col(request) == F.col("_id"), "left")
    bad = F.col(path).isNull() | F.col(request).isNull() | F.col(seq).isNull()
    answer = F.when(bad, "invalid").when(F.col(seq) == F.col("_first"), F.when(F.col("_in"), "accepted").otherwise("conflict")).when(body.eqNullSafe(F.col("_body")), "again").otherwise("reused")
    return joined.withColumn("answer", answer).drop("_id", "_first", "_body", "_in")
