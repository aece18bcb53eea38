"""Vector code compression: product codes from integer codebooks, exact at every size.

Vectors become integers, are cut into equal consecutive parts, and each part is
replaced by the number of the nearest entry of its part's codebook. The vectors
are written once as columnar NumPy blocks (part, place in the part, row). A round
is one ``treeAggregate`` over these blocks: squared distances accumulate one
dimension after the other, rows choose their entry, and ``np.add.at`` adds them to
sum and count tensors that merge through a reduction tree. Sums are integers, so a
lost executor, another partitioning or another order of merging changes nothing.
A tensor has parts x entries x width cells whatever the number of vectors; only it
and the codebooks reach the driver.

Rows whose vector is null or holds null or non-finite components are dropped.
Vectors of another length than most (of equally many the longer), or whose length
the parts do not divide, keep their row with null code and errors. Rows with equal
ids are rows of their own; the first entries take null ids last and equal ids in
order of their vectors. Fewer vectors than entries make a smaller codebook; ties of
distance go to the lower entry; unused entries stay. Components too large for
64-bit distances are reckoned with whole numbers of any length (slower); an error
that 64 bits cannot hold is null. An empty table gives an empty result, and the
digest of no entries.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import materialise, release

#: Components a block holds at most; a block is a row of the block table.
CELLS = 1 << 18
#: Integers of this size or more leave 64-bit arithmetic.
WIDE = 1 << 28
#: Labels whose sums are broadcast at most; more are joined by label and salt.
BROADCAST_LABELS = 100_000
SALTS = 64


@dataclass(frozen=True)
class Params:
    """``scale`` is a power of two, so that scaling is exact."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass(frozen=True)
class Encoded:
    """``rows``: (id, label, code, error); ``books``: for each part an array (entry, place) of integers."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as whole numbers of any length where a value is ``WIDE``."""
    down = np.floor(values.astype(np.float64) * scale)
    if not down.size or np.abs(down).max() < WIDE:
        return down.astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.astype(np.float64).ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def distances(block: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(row, entry) squared distances of a part's block (place, row) to its entries (entry, place)."""
    wide = block.dtype == object or book.dtype == object or len(block) * WIDE**2 * 4 >= 1 << 63
    kind = object if wide else np.int64
    total = np.zeros((block.shape[1], len(book)), kind)
    for place in range(len(block)):
        gap = block[place].astype(kind)[:, None] - book[:, place].astype(kind)[None, :]
        gap *= gap
        total += gap
    return total


def assign(blocks: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For blocks (part, place, row): the nearest entries (part, row) and the distance summed over parts."""
    codes, error = np.zeros((len(books), blocks.shape[2]), np.int64), 0
    for part, book in enumerate(books):
        far = distances(blocks[part], book)
        codes[part] = np.argmin(far, axis=1)
        error = error + far[np.arange(len(far)), codes[part]]
    return codes, error


def narrow(values: np.ndarray) -> np.ndarray:
    """int64 again where every value is small enough."""
    return values.astype(np.int64) if values.dtype == object and all(abs(x) < WIDE for x in values.ravel()) else values


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    big = any(x.dtype == object or (x.size and np.abs(x).max() >= 1 << 61) for x in (a, b))
    return a.astype(object) + b.astype(object) if big else a + b


Tensors = tuple[list[np.ndarray], np.ndarray]


def merge(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    if a is None or b is None:
        return a if b is None else b
    return [_add(x, y) for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]


def gather(total: Tensors | None, blocks: np.ndarray, books: list[np.ndarray]) -> Tensors:
    """Adds a block's rows to the sum and count tensors of the entries that they choose."""
    codes, _ = assign(blocks, books)
    sums, counts = [], np.zeros((len(books), len(books[0])), np.int64)
    for part, book in enumerate(books):
        s = np.zeros(book.shape, blocks.dtype)
        np.add.at(s, codes[part], blocks[part].T)
        np.add.at(counts[part], codes[part], 1)
        sums.append(s)
    return merge(total, (sums, counts))


def moved(books: list[np.ndarray], total: Tensors | None) -> list[np.ndarray]:
    """Each used entry becomes the floored mean of its parts."""
    if total is None:
        return books
    out = []
    for book, s, n in zip(books, total[0], total[1], strict=True):
        used = n > 0
        new = book.astype(s.dtype if book.dtype != object else object)
        new[used] = s[used] // n[used, None]
        out.append(narrow(new))
    return out


def _blocks(p: Params, width: int):
    most = max(1, CELLS // max(1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.asarray(batch["vector"].flatten(), np.float64).reshape(len(batch), width)
            large = (np.abs(whole) * p.scale >= WIDE).any(axis=1)
            for wide in (False, True):
                at = np.flatnonzero(large == wide)
                for lo in range(0, len(at), most):
                    rows = at[lo : lo + most]
                    ints = integers(whole[rows], p.scale)
                    if ints.dtype != object:
                        ints = ints.astype(np.int32)
                    block = np.ascontiguousarray(ints.reshape(len(rows), p.parts, width // p.parts).transpose(1, 2, 0))
                    take = batch.take(pa.array(rows))
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), take[c])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary()), one("id"), one("label")], ["block", "ids", "labels"])

    return pack


def _codes(books: list[np.ndarray], id_type: pa.DataType, label_type: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                codes, error = assign(pickle.loads(batch["block"][k].as_py()), books)
                text = np.frombuffer(np.ascontiguousarray(codes.T).astype(np.uint8).tobytes().hex().encode(), f"S{2 * len(books)}").astype(str)
                small = [int(e) if int(e) < 1 << 63 else None for e in error] if np.asarray(error).dtype == object else error
                yield pa.RecordBatch.from_arrays([batch["ids"].slice(k, 1).flatten().cast(id_type), batch["labels"].slice(k, 1).flatten().cast(label_type), pa.array(text, pa.string()), pa.array(small, pa.int64())], ["id", "label", "code", "error"])

    return encode


def encode(df: DataFrame, id_col: str, vector_col: str, label_col: str, p: Params = Params()) -> Encoded:
    """Codes and final squared errors of all kept vectors, and the codebooks (at most 256 entries each)."""
    if not 0 < p.entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(finite(F.col("vector")))
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()}
    width = next(iter(lengths), 0)
    fits = (F.size("vector") == width) & F.lit(width % p.parts == 0 and width > 0)
    even = rows.where(fits)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    lowest = [r.vector for r in even.orderBy(F.col("id").asc_nulls_last(), "vector").limit(p.entries).collect()]  # `entries` rows
    first = np.asarray(lowest, np.float64).reshape(len(lowest), width)
    start = integers(first, p.scale).reshape(len(first), p.parts, -1) if len(first) else np.zeros((0, p.parts, 0), np.int64)
    books = [narrow(start[:, k]) for k in range(p.parts)]
    shape = f"id {kinds['id'].simpleString()}, label {kinds['label'].simpleString()}"
    odd = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not len(first):
        return Encoded(odd, books)
    blocks = materialise(even.mapInArrow(_blocks(p, width), f"block binary, ids array<{kinds['id'].simpleString()}>, labels array<{kinds['label'].simpleString()}>"), "vector-blocks")
    for _ in range(p.rounds):
        packed = blocks.select("block").rdd
        total = packed.treeAggregate(None, lambda t, r, books=books: gather(t, pickle.loads(r[0]), books), merge, depth=3)
        books = moved(books, total)
    out = materialise(blocks.mapInArrow(_codes(books, to_arrow_type(kinds["id"]), to_arrow_type(kinds["label"])), f"{shape}, code string, error long"), "vector-codes")
    release(blocks)
    return Encoded(out.unionByName(odd), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over rows with equal labels, nulls together (null if 64 bits cannot hold it).

    One row a label is joined back: broadcast after a count, else by label and salt,
    so that a label with most of the rows is not one task's.
    """
    sums = rows.groupBy("label").agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(20, 0))) AS BIGINT)").alias("label_error")).withColumnRenamed("label", "_l")
    same = F.col("label").eqNullSafe(F.col("_l"))
    if rows.select("label").distinct().count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), same).drop("_l")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_lot", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_lot") == F.col("_salt"))).drop("_l", "_lot", "_salt")
