"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it meets the block size,
so chunk ends depend on content and an insertion moves only the chunks it
touches. Each chunk gives one of 64 characters; a fingerprint is
``block:signature:signature at twice the block``. Two fingerprints are compared
by edit distance where their block sizes are equal or one is twice the other.

Null texts count as empty, which has the fingerprint ``3::``. Equal texts have
equal fingerprints. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialise, mix

LEAST_BLOCK, LENGTH, WINDOW = 3, 64, 7
_TABLE = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the last seven bytes (fewer at the start)."""
    values = _TABLE[data]
    out = values.copy()
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += (values[:-k] << np.uint32(4 * k)) | (values[:-k] >> np.uint32(32 - 4 * k))
    return out


def _signature(ends: np.ndarray, sums: np.ndarray, n: int) -> str:
    """A character for each chunk; what lies after the 63rd is one chunk."""
    ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    total = sums[ends - 1]
    total = total - np.concatenate(([np.uint64(0)], total[:-1]))
    return _CHARS[(mix(total) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    states = rolling(data)
    sums = np.cumsum(states, dtype=np.uint64)
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    ends = np.flatnonzero(states % np.uint32(block) == block - 1) + 1
    while len(ends) < LENGTH // 2 and block > LEAST_BLOCK:
        block //= 2
        ends = np.flatnonzero(states % np.uint32(block) == block - 1) + 1
    twice = ends[states[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(ends, sums, n)}:{_signature(twice, sums, n)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 only for equal signatures, 0 at incompatible block sizes."""
    part = lambda c, k: F.split_part(c, F.lit(":"), F.lit(k))
    block = lambda c: part(c, 1).cast("long")

    def like(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)

    same = F.greatest(like(part(a, 2), part(b, 2)), like(part(a, 3), part(b, 3)))
    empty = (part(a, 2) == "") != (part(b, 2) == "")
    return (
        F.when(a == b, 1.0).when(empty, 0.0).when(block(a) == block(b), same)
        .when(block(a) == 2 * block(b), like(part(a, 2), part(b, 3))).when(2 * block(a) == block(b), like(part(a, 3), part(b, 2))).otherwise(0.0)
    )


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, part int, place int, text string, next_text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("text", pa.string()), ("next_text", pa.string())])


def _done(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edit(text, following)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(new), next_own, None, None, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one of its range; the range's first and last texts go on for the seam."""
    part, held, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                rows.append((None, None, None, None, None, None, part, 0, text, None))
            else:
                rows.append(_done(*held, text, own))
            held = (doc_id, text, own)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
    if held is not None:
        rows.append((held[0], None, None, None, None, None, part, 1, held[1], None))
    if rows:
        yield _batch(rows)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_done(i, t or "", fingerprint(t or ""), x or "", fingerprint(x or "")) for i, t, x in zip(*(batch.column(k).to_pylist() for k in (0, 8, 9)), strict=True)]
        if rows:
            yield _batch(rows)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited forms and of the next document's, by descending doc_id.

    Texts are dealt once, into ranges of doc_id; a range is streamed in order, and
    only its first and last text meet those of its neighbours. A null doc_id comes
    after all others, equal doc_ids follow by text. One document is its own next.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    rows = materialise(dealt.mapInArrow(_stream, _OUT), "ctph")
    seam = rows.where("part IS NOT NULL")
    heads, ends = seam.where("place = 0"), seam.where("place = 1")  # one row for each range
    in_order = W.orderBy("part")
    follows = F.coalesce(F.lead("part").over(in_order), F.min("part").over(W.partitionBy()))  # the first range follows the last
    numbers = F.broadcast(heads.select("part", follows.alias("then")))  # numbers of ranges alone: at most ``parts`` rows
    following = heads.select(F.col("part").alias("then"), F.col("text").alias("following"))
    last = ends.join(numbers, "part").join(following, "then")
    last = last.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "part", "place", "text", F.col("following").alias("next_text"))
    done = rows.where("part IS NULL").unionByName(last.mapInArrow(_seams, _OUT))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
