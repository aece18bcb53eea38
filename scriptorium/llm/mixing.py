"""Mixing sources to target weights by hash thresholds, without sorting.

A source's target is its weighted part of a token budget, at most ``cap`` times
what it has; what stands above is shared again by weight. The whole passes that a
target holds are taken of every document, and the rest of a pass of the documents
whose hash lies below the source's threshold. The threshold comes from histograms:
tokens are summed by source and by the upper ``BITS`` bits of the hash, the bucket in
which the budget ends is found, and only its documents are summed by their next
bits, until that bucket holds one hash value. Budgets share the hashes, so what a
smaller budget takes, a larger one takes too.

Documents of the boundary value itself (one, unless rows are repeated whole) give
equal parts of what is still missing, rounded down, so a source of few documents or
of one text a million times meets its target as well.

A null source is a source of its own, behind the others. A null or negative size
counts 0. Rows are never told apart by place, so repeated rows get equal parts, ties
of hashes included. An empty table, or one without tokens, takes nothing. Other
columns pass through; columns of the names that ``mix`` makes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialise, release

HASH_BITS = 60
BITS = 12
#: Sources that are broadcast at most; with more of them, the rows are dealt by source and salt.
BROADCAST_SOURCES = 100_000
SALTS = 64


def hash60(seed: str, *parts: Column) -> Column:
    """60 bits of a digest of the parts, nulls as empty: the same at every run, on any cluster."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, weights: list[int], cap: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Sources in order of their caps by weight: the level with the first i of them
    capped rises while the next one's cap stands below it and falls after, so the
    level sought is the highest.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    ahead = W.orderBy("_cap_by_weight", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    known = sizes.withColumn("weight", weight).withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_cap_by_weight", F.col("_cap") / F.col("weight"))
    left = share * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))
    over = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    levels = known.withColumn("_level", left / over)
    return levels.select("source", "source_size", "weight", F.least("_cap", F.col("weight") * F.max("_level").over(every)).alias("target"))


def _with_sources(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table with few rows a source, nulls equal, without dealing a hot source into one task."""
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")
    salted = table.withColumnRenamed("source", "_s").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_lot", F.pmod(F.xxhash64("h", "size"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_lot") == F.col("_salt")), how).drop("_s", "_salt", "_lot")


def _boundaries(sums: DataFrame, shift: int) -> DataFrame:
    """The bucket in which each budget ends: (k, source, low, rest, held, edge, one)."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("k", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = sums.withColumn("_before", before).where((F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("n")))
    low = F.shiftleft("bucket", shift)
    return found.select("k", "source", low.alias("low"), (F.col("rest") - F.col("_before")).alias("rest"), F.col("n").alias("held"), F.col("first").alias("edge"), (F.col("first") == F.col("last")).alias("one"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(k, source, edge, rest, held): below hash ``edge`` all is taken, at ``edge`` ``rest`` of the ``held`` tokens.

    ``rows``: (source, size, h), cheap to read again. ``budgets``: (k, source, rest),
    each less than the source's tokens.
    """
    sums = lambda df, keys, shift: df.groupBy(*keys, F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
    shift = HASH_BITS - BITS
    top = sums(rows.where("size > 0"), ["source"], shift)
    found = materialise(_boundaries(_null_safe(top, budgets), shift), "mix-bounds")
    done = found.where("one")
    tables = [found]
    while shift and not (open_ := found.where("NOT one")).isEmpty():
        inside = _with_sources(rows.where("size > 0"), open_.select("k", "source", "low", "rest")).where(F.shiftright("h", shift) == F.shiftright("low", shift))
        shift -= BITS
        found = materialise(_boundaries(sums(inside, ["k", "source", "rest"], shift), shift), "mix-bounds")
        tables.append(found)
        done = done.unionByName(found.where("one"))
    out = materialise(done.select("k", "source", "edge", "rest", "held"), "mix-edges")
    release(*tables)
    return out


def _null_safe(top: DataFrame, budgets: DataFrame) -> DataFrame:
    """Bucket sums with each budget of their source: both sides are bounded by sources, not by rows."""
    b = budgets.withColumnRenamed("source", "_s")
    return top.join(b, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(rows: DataFrame, shares: dict[str, float], weights: list[int], cap: int = 2) -> DataFrame:
    """``rows`` (source, size >= 0, h of ``hash60``, any other columns; cheap to read again) with
    ``source_size``, and for each name and share of ``shares`` ``target_<name>`` and ``taken_<name>``:
    the source's tokens aimed at and the tokens taken of the row, repeats counted."""
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    plan, budgets = sizes, None
    for k, (name, share) in enumerate(shares.items()):
        t = targets(sizes, share, weights, cap).select(F.col("source").alias("_s"), F.col("target").alias(f"target_{name}"))
        plan = plan.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col(f"target_{name}") / F.col("source_size"))).otherwise(0).cast("long")
        plan = plan.withColumn(f"_whole_{name}", whole)
        rest = F.floor(F.col(f"target_{name}")).cast("long") - F.col(f"_whole_{name}") * F.col("source_size")
        one = plan.select(F.lit(k).alias("k"), "source", F.greatest(rest, F.lit(0)).alias("rest"))
        budgets = one if budgets is None else budgets.unionByName(one)
    found = thresholds(rows, budgets)
    for k, name in enumerate(shares):
        edge = found.where(F.col("k") == k).select(F.col("source").alias("_s"), F.struct("edge", "rest", "held").alias(f"_at_{name}"))
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = _with_sources(rows.drop("source_size", *[f"{c}_{n}" for n in shares for c in ("target", "taken")]), materialise(plan, "mix-plan"))
    for name in shares:
        at = F.col(f"_at_{name}")
        part = F.expr(f"CAST(size AS DECIMAL(20,0)) * _at_{name}.rest DIV _at_{name}.held")
        again = F.when(F.col("h") < at["edge"], F.col("size")).when(F.col("h") == at["edge"], part).otherwise(0)
        out = out.withColumn(f"taken_{name}", (F.col(f"_whole_{name}") * F.col("size") + again).cast("long")).drop(f"_whole_{name}", f"_at_{name}")
    release(sizes, found)
    return out
