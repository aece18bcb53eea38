"""Finite automata over ordered rows, by an associative scan.

A row's transition is a function from states to states, an array with the next state
for each. Functions compose, and composition is associative: blocks of ``WIDTH``
consecutive places fold into one function each, blocks of blocks again, until one is
left; then the states at which blocks begin run down the same tree. No key is ever
one task, however many rows it has: what is brought together is a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def _composed(steps: Column, states: int) -> Column:
    """The functions of an ordered array of structs (place, f, ...) one after the other."""
    same = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(steps, same, lambda f, x: F.transform(f, lambda s: F.get(x["f"], s)))


def _before(steps: Column, first: Column) -> Column:
    """The state before each step, from the state before the first."""
    return F.aggregate(steps, F.array(first), lambda seen, x: F.array_append(seen, F.get(x["f"], F.element_at(seen, -1))))


def states_before(rows: DataFrame, key: str, place: str, transition: Column, states: int, start: int = 0, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``state``, the automaton's state before each row of its ``key`` in order of ``place``.

    ``place`` is an integer without repetitions in a key; blocks are those of ``width``
    neighbouring values. A null key is a key; rows of null place see the start.
    A column ``state`` is replaced.
    """
    rows = rows.drop("state")
    placed = rows.where(F.col(place).isNotNull()).select(F.col(key).alias("k"), F.col(place).cast("long").alias("p"), transition.cast("array<int>").alias("f"), F.struct(*rows.columns).alias("row"))
    low, high = placed.agg(F.min("p"), F.max("p")).first()
    levels, reach = 1, width
    while high is not None and reach <= high - low:
        levels, reach = levels + 1, reach * width
    block = lambda p: F.floor(p / width).cast("long")
    step = placed.select("k", (F.col("p") - F.lit(low or 0)).alias("p"), "f", "row")
    trees = []
    for level in range(levels):
        cell = F.struct("p", "f", "row") if level == 0 else F.struct("p", "f")
        grouped = step.groupBy("k", block(F.col("p")).alias("b")).agg(F.array_sort(F.collect_list(cell), lambda x, y: F.when(x["p"] < y["p"], -1).when(x["p"] > y["p"], 1).otherwise(0)).alias("steps"))
        trees.append(grouped)
        step = grouped.select("k", F.col("b").alias("p"), _composed(F.col("steps"), states).alias("f"))
    entry = trees[-1].select("k", "b", F.lit(start).alias("s"))
    for level in range(levels - 1, -1, -1):
        t = trees[level]
        at = entry.select(F.col("k").alias("_k"), F.col("b").alias("_b"), "s")
        met = t.join(at, t["k"].eqNullSafe(at["_k"]) & (t["b"] == at["_b"]))
        met = met.select("k", F.explode(F.arrays_zip(F.col("steps").alias("step"), F.slice(_before(F.col("steps"), F.col("s")), 1, F.size("steps")).alias("s"))).alias("z"))
        entry = met.select("k", F.col("z.step.p").alias("b"), F.col("z.s").alias("s")) if level else met.select("z.step.row.*", F.col("z.s").alias("state"))
    return entry.unionByName(rows.where(F.col(place).isNull()).withColumn("state", F.lit(start)))
