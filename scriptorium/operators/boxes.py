"""Points to the boxes that contain them, by a tree of cells.

All boxes of a page begin in one cell. A cell that a box covers whole needs of that box
only its order: the least such order is the cell's ``cover``, and no box of a later order
is looked at there again. A cell that more than ``FEW`` boxes cross is parted in sixteen,
and only those boxes go on. A point meets at most one cell a depth: it takes the least of
the covers, and compares coordinates with the few boxes of the cell that is not parted.
No row is made for a pair of a point and a box.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import shared_folder

#: Boxes that cross a cell without its being parted, the greatest depth (a side is parted in four at each), and entries for each box at which parting ends.
FEW, DEPTH, SPREAD = 8, 10, 32
_SIDE = 4**DEPTH


def first_box(points: DataFrame, boxes: DataFrame, page: str, x: str, y: str, order: str, box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """``points`` with ``box``: the least ``order`` of the boxes of the point's ``page`` that contain it, edges included; null without one.

    Corners may be given in any order. Points and boxes with a null or not a finite
    coordinate meet nothing, nor do null pages. ``order`` is an integer; of boxes with
    equal order it does not matter which one is meant. A column ``box`` is replaced.
    """
    points = points.drop("box")
    finite = lambda *cs: F.forall(F.array(*[F.col(c).cast("double") for c in cs]), lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    x0, y0, x1, y1 = box
    b = boxes.where(finite(*box) & F.col(page).isNotNull()).select(F.col(page).alias("_page"), F.col(order).cast("long").alias("_order"), F.least(x0, x1).cast("double").alias("_x0"), F.least(y0, y1).cast("double").alias("_y0"), F.greatest(x0, x1).cast("double").alias("_x1"), F.greatest(y0, y1).cast("double").alias("_y1"))
    b = b.where("_order IS NOT NULL").groupBy("_page", "_x0", "_y0", "_x1", "_y1").agg(F.min("_order").alias("_order"))  # of equal boxes only the first can be the answer
    path = f"{shared_folder(boxes.sparkSession)}/boxes-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")

    b = kept(b, "all")
    n, left, low, right, high = b.agg(F.count("*"), F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1")).first()
    if not n:
        return points.withColumn("box", F.lit(None).cast("long"))
    # places in the finest grid never fall as coordinates rise: what lies strictly between two places lies between their coordinates
    grid = lambda v, least, most: F.least(F.floor((F.col(v) / 4 - least / 4) / max(most / 4 - least / 4, 2.0**-1000) * _SIDE).cast("long"), F.lit(_SIDE - 1))
    # all points to look up are at the first edge of all boxes or behind it, and at the last or before it
    first = lambda v, least, most: F.when(F.col(v) <= least, -1).otherwise(grid(v, least, most)).cast("long")
    final = lambda v, least, most: F.when(F.col(v) >= most, _SIDE).otherwise(grid(v, least, most)).cast("long")
    pairs = b.select("*", first("_x0", left, right).alias("_gx0"), first("_y0", low, high).alias("_gy0"), final("_x1", left, right).alias("_gx1"), final("_y1", low, high).alias("_gy1"))
    pairs = pairs.withColumn("_nx", F.lit(0).cast("long")).withColumn("_ny", F.lit(0).cast("long"))
    node, found = ["_page", "_nx", "_ny"], []
    within = F.struct("_order", "_x0", "_y0", "_x1", "_y1")
    for depth in range(DEPTH + 1):
        width = _SIDE >> 2 * depth
        over = lambda at, a, z: (F.col(a) < F.col(at) * width) & (F.col(z) > F.col(at) * width + (width - 1))  # noqa: B023, E731
        seen = pairs.withColumn("_full", over("_nx", "_gx0", "_gx1") & over("_ny", "_gy0", "_gy1"))
        cover = seen.groupBy(node).agg(F.min(F.when(F.col("_full"), F.col("_order"))).alias("_cover"))
        seen = seen.join(cover, node).where(F.col("_cover").isNull() | (F.col("_order") < F.col("_cover"))).drop("_full", "_cover")
        count = seen.groupBy(node).agg(F.count("*").alias("_n"))
        seen = kept(seen.join(count, node), f"seen{depth}")
        last = depth == DEPTH
        if not last:
            smaller = width // 4
            children = lambda at, a, z: F.sequence(F.greatest(F.col(at) * 4, F.floor(F.col(a) / smaller).cast("long")), F.least(F.col(at) * 4 + 3, F.floor(F.col(z) / smaller).cast("long")))  # noqa: B023, E731
            parts = seen.where(F.col("_n") > FEW).drop("_n").withColumn("_cx", F.explode(children("_nx", "_gx0", "_gx1"))).withColumn("_cy", F.explode(children("_ny", "_gy0", "_gy1")))
            pairs = kept(parts.drop("_nx", "_ny").withColumnsRenamed({"_cx": "_nx", "_cy": "_ny"}), f"pairs{depth}")
            size = pairs.count()
            last = size == 0 or size > SPREAD * n
        leaves = seen.where(F.lit(True) if last else F.col("_n") <= FEW).groupBy(node).agg(F.array_sort(F.collect_list(within)).alias(f"_in{depth}"))
        found.append(cover.withColumnRenamed("_cover", f"_cover{depth}").join(leaves, node, "left").where(f"_cover{depth} IS NOT NULL OR _in{depth} IS NOT NULL"))
        if last:
            break
    inside = finite(x, y) & F.col(page).isNotNull() & F.col(x).cast("double").between(left, right) & F.col(y).cast("double").between(low, high)
    met = points.select(F.struct(*points.columns).alias("_point"), F.when(inside, F.col(page)).alias("_p"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    met = met.withColumn("_px", F.when(F.col("_p").isNotNull(), grid("_x", left, right))).withColumn("_py", F.when(F.col("_p").isNotNull(), grid("_y", low, high)))
    for depth, nodes in enumerate(found):
        width = _SIDE >> 2 * depth
        at = (F.col("_p") == F.col("_page")) & (F.floor(F.col("_px") / width).cast("long") == F.col("_nx")) & (F.floor(F.col("_py") / width).cast("long") == F.col("_ny"))
        met = met.join(nodes, at, "left").drop(*node)
    crossing = F.coalesce(*[F.col(f"_in{d}") for d in range(len(found))], F.array().cast("array<struct<_order:bigint,_x0:double,_y0:double,_x1:double,_y1:double>>"))
    holds = F.filter(crossing, lambda s: F.col("_x").between(s["_x0"], s["_x1"]) & F.col("_y").between(s["_y0"], s["_y1"]))
    orders = F.array(F.get(holds, F.lit(0))["_order"], *[F.col(f"_cover{d}") for d in range(len(found))])
    return met.select("_point.*", F.array_min(orders).alias("box"))
