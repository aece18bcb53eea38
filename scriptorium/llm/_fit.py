"""Bounded training samples and a small quasi-Newton minimiser for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces


def held_out(doc_id: Column) -> Column:
    """One document in five is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[pa.Table, dict[int, int]]:
    """At most ``most`` labelled texts of each class (by a hash of the id, so the same at every run), and how many there are.

    Ids are chosen first, so only the chosen texts are read and sent on; 2 * ``most``
    bounds what is broadcast and what the driver gets.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "text", "y")
    return rows.toArrow().sort_by([("id", "ascending"), ("text", "ascending")]), totals


def weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Each class counts as often as it occurs among all labels, mean 1."""
    w = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            w[y == k] = totals.get(k, 0) / (y == k).sum()
    return w / w.mean() if len(w) else w


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d = grad.copy()
        kept = []
        for s, g in reversed(pairs):
            a = s @ d / (s @ g)
            d -= a * g
            kept.append(a)
        if pairs:
            s, g = pairs[-1]
            d *= (s @ g) / (g @ g)
        for (s, g), a in zip(pairs, reversed(kept), strict=True):
            d += s * (a - g @ d / (s @ g))
        slope = grad @ d
        if slope <= 1e-12:
            break
        rate = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(d).sum()))
        while rate > 1e-12:
            new_value, new_grad = f(x - rate * d)
            if new_value <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, g = -rate * d, new_grad - grad
        if s @ g > 1e-12:
            pairs = [*pairs, (s, g)][-memory:]
        done = abs(value - new_value) < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def in_slices(scorer: Callable[[pa.Array], np.ndarray], most: int = 2 << 20) -> Callable[[pa.Array], np.ndarray]:
    """``scorer`` applied to about ``most`` bytes of text at a time, so a batch of long texts needs no more memory than one of short ones."""

    def run(texts: pa.Array) -> np.ndarray:
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
        cuts = pieces(np.concatenate(([0], np.cumsum(sizes))), most)
        return np.concatenate([scorer(texts.slice(i, j - i)) for i, j in cuts] or [np.zeros(0)])

    return run


def filter_by_score(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose score of ``text`` satisfies ``keep``, with all their columns and no other."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(scorer(b.column(at)))))

    return docs.mapInArrow(run, docs.schema)
