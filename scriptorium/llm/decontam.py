"""Benchmark decontamination by SimHash over item-sized windows.

A text is the sequence of its five-word shingles (words are runs of letters and
digits in lower case). A document is compared with a benchmark item through
windows as long as the item: a window's 64-bit SimHash adds up the bits of its
shingles, each weighted by how often it occurs. All items are indexed by their
fingerprints in eight byte-wide blocks, each under all values at most two bits
away, so by the pigeonhole principle no fingerprint within radius 23 is missed.
A window finds its items in that index alone, among items of the length that it
stands for; no word of theirs takes part. What is found is decided by the exact
weighted Jaccard similarity of the two shingle multisets.

``Params.gate`` is an optimisation that says where windows are fingerprinted: one
that reaches the threshold with an item of its length shares a known number of
shingles with it, so one of its first few positions holds a shingle of some item
of that length. Without the gate every position is fingerprinted for every length
of an item, with the same result at many times the cost.

Everything is a DataFrame expression. Benchmark shingles and the index are
broadcast only if they are counted and few enough; beyond that they are joined by
a shuffle. Null texts and texts without words match nothing; items without words
match nothing; items of fewer than five words are one shingle of their length; a
text shorter than an item is one window. Repeated rows and a null doc_id are
matched like any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
_LANES = 0x0000000100000001


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    broadcast_rows: int = 1_000_000  # benchmark shingles, index rows, or ids of documents with a hit, up to which they are broadcast
    gate: bool = True  # fingerprint only windows near a benchmark shingle


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty if there are fewer words.

    Words are taken by index: ``slice`` would copy the whole array for every run.
    """
    runs = F.size(words) - size + 1
    run = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(runs > 0, run).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits; bit b is set where more than half of the shingles have it. Two 32-bit counters are summed at a time."""
    n = F.size(hashes).cast("long")
    out = F.lit(0).cast("long")

    def pair_of(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(_LANES)))

    for b in range(32):
        pair = pair_of(b)
        over = F.shiftrightunsigned(pair + (F.lit((1 << 30) - 1) - F.floor(n / 2)) * F.lit(_LANES), 30).bitwiseAND(F.lit(_LANES))
        out = out.bitwiseOR(F.shiftleft(over, b))
    return out


def blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, 8 * k).bitwiseAND(F.lit(255)).alias("value")) for k in range(BLOCKS)])


def near_bytes(value: Column) -> Column:
    """All byte values at most FLIPS bits away."""
    masks = [m for m in range(256) if m.bit_count() <= FLIPS]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def common(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(single, F.size(F.array_intersect(a, b))).otherwise(counted)


def item_table(benchmark: DataFrame, p: Params) -> DataFrame:
    """item_id, key (a hash of the row), size (words a shingle), n, item (its shingles) and its fingerprint."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(p.words)))
    item = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in range(1, p.words + 1)])
    items = items.select("item_id", "size", item.alias("item")).distinct()
    return items.withColumn("key", F.xxhash64("item_id", "item")).withColumn("n", F.size("item")).withColumn("item_print", simhash(F.col("item")))


def _least(n: Column, m: Column, p: Params) -> Column:
    """Shared shingles that a window of m needs to reach the threshold with an item of n."""
    return F.ceil(p.similarity / (1 + p.similarity) * (n + m) - 1e-9).cast("int")


def _rows_of(docs: DataFrame, size: int) -> DataFrame:
    """row (a hash that equal rows share, also without a doc_id), doc_id, total windows of one shingle, s (the shingles)."""
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", words_of(F.col("text")).alias("w"))
    return texts.select("row", "doc_id", (F.size("w") - size + 1).alias("total"), shingles(F.col("w"), size).alias("s"))


def _gated(docs: DataFrame, items: DataFrame, sizes: list[int], p: Params) -> DataFrame:
    """row, doc_id, size, n, m, start of the windows for items of length n that have a shingle of such an item near their start."""
    known = items.select("n", "size", F.explode(F.array_distinct("item")).alias("h")).distinct()
    few, found = known.count() <= p.broadcast_rows, None
    for size in sizes:
        own = known.where(F.col("size") == size)
        # the outer form: from the inner one a filter on the shingles would be inferred and pushed below the words
        at = _rows_of(docs, size).select("row", "doc_id", "total", F.posexplode_outer("s").alias("pos", "h"))
        hits = at.join(F.broadcast(own) if few else own, "h")
        window = F.least("n", "total")
        slack = window - _least(F.col("n"), window, p)
        first, last = F.greatest(F.col("pos") - slack, F.lit(0)), F.least(F.col("pos"), F.col("total") - window)
        starts = hits.where((slack >= 0) & (first <= last)).select("row", "doc_id", "size", "n", window.alias("m"), F.explode(F.sequence(first, last)).alias("start"))
        found = starts if found is None else found.unionByName(starts)
    return found.distinct()


def _everywhere(docs: DataFrame, items: DataFrame, sizes: list[int], p: Params) -> DataFrame:
    """As ``_gated``, for every window of every length of an item."""
    lengths, found = items.select("size", "n").distinct().collect(), None  # no more than an item has shingles
    for size in sizes:
        own = F.array(*[F.lit(r.n) for r in lengths if r["size"] == size])
        at = _rows_of(docs, size).select("row", "doc_id", "total", F.explode(own).alias("n")).where("total > 0")
        window = F.least("n", "total")
        starts = at.where(_least(F.col("n"), window, p) <= window).select("row", "doc_id", F.lit(size).alias("size"), "n", window.alias("m"), F.explode(F.sequence(F.lit(0), F.col("total") - window)).alias("start"))
        found = starts if found is None else found.unionByName(starts)
    return found.distinct()


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, similarity (best window), start (its first word, from 0), windows (how many reach the threshold)."""
    items = materialise(item_table(benchmark, p), "decontam-items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `words` numbers
    if not sizes:  # no item has words
        none = docs.sparkSession.range(0)
        return none.select(*[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("item_id", "long"), ("similarity", "double"), ("start", "int"), ("windows", "long"))])
    found = materialise((_gated if p.gate else _everywhere)(docs, items, sizes, p), "decontam-starts")

    # the shingles of these windows, from the documents that have any
    asked = found.groupBy("row", "size").agg(F.collect_set(F.struct("start", "m", "n")).alias("spans"))
    ids = found.select("row").distinct()
    some = ids.count() <= p.broadcast_rows
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").join(F.broadcast(ids) if some else ids, "row", "left_semi")
    texts = texts.join(asked, "row").select("doc_id", "size", words_of(F.col("text")).alias("w"), "spans")
    hashes = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in sizes])
    texts = texts.select("doc_id", "size", hashes.alias("s"), "spans")
    spans = texts.select("doc_id", "size", "s", F.explode("spans").alias("span"))  # the hashes are made once, below the explode
    spans = spans.select("doc_id", "size", F.col("span.n").alias("n"), F.col("span.start").alias("start"), F.slice("s", F.col("span.start") + 1, F.col("span.m")).alias("window")).distinct()
    windows = materialise(spans.withColumn("window_print", simhash(F.col("window"))), "decontam-windows")

    # the index: items by (length, block, value); a pair counts at the first block in which it meets
    index = items.select("key", "size", "n", "item_print", F.explode(blocks(F.col("item_print"))).alias("b"))
    index = materialise(index.select("key", "size", "n", "item_print", "b.block", F.explode(near_bytes(F.col("b.value"))).alias("value")), "decontam-index")
    few = index.count() <= p.broadcast_rows
    probes = windows.select("*", F.explode(blocks(F.col("window_print"))).alias("b")).select("*", "b.block", "b.value").drop("b")
    apart = F.col("window_print").bitwiseXOR(F.col("item_print"))
    met_at = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(apart, 8 * k).bitwiseAND(F.lit(255))) <= FLIPS, k) for k in range(BLOCKS)])
    met = probes.join(F.broadcast(index) if few else index, ["size", "n", "block", "value"])
    near = met.where((F.col("block") == met_at) & (F.bit_count(apart) <= RADIUS)).select("doc_id", "key", "start", "window")

    # the exact similarity decides
    exact = near.join(F.broadcast(items) if few else items, "key")
    exact = exact.select("doc_id", "item_id", "start", "n", F.size("window").alias("m"), common(F.col("window"), F.col("item")).alias("both"))
    exact = exact.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("similarity") >= p.similarity - 1e-12)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("top"), F.count("*").alias("windows"))
    return best.select("doc_id", "item_id", F.col("top.similarity").alias("similarity"), (-F.col("top.back")).alias("start"), "windows")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without those that hold any item; all rows without a doc_id count as one document."""
    gone = materialise(matches(docs, benchmark, p).select(F.col("doc_id")).distinct(), "decontam-gone")
    gone = F.broadcast(gone) if gone.count() <= p.broadcast_rows else gone
    return docs.alias("all").join(gone.alias("gone"), F.col("all.doc_id").eqNullSafe(F.col("gone.doc_id")), "left_anti")
