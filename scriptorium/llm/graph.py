"""Connected components of an edge list, distributed.

Alternating large-star and small-star rounds: each round every node points its
neighbours at the smallest node it knows, so the longest chain shrinks
geometrically. Edges are written after each round; nothing but a count and a
checksum reaches the driver. Self-loops and repeated edges are dropped; an
empty list has no component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, release


def _smaller(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v); label is the smallest node reachable."""
    e = materialise(_smaller(edges), "cc")
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = materialise(_smaller(small.unionByName(low.select("u", F.col("m").alias("v")))), "cc"), e
        release(old)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
