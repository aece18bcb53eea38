"""Importance resampling towards a target corpus, through a dictionary of distinct features.

Features are all runs of 1 to 2 consecutive words. Documents are cut into chunks of
about ``CHUNK`` bytes; a chunk keeps the numbers of its words and sends each of its
distinct features once, with its count and its place in the chunk. Sorted by the
features' text, all places of a string lie together: its count over the whole corpus
is their sum, its hash is taken once, and the bucket gets the count. The bucket's gain
then goes back to every chunk that sent the string, to be joined to the chunk's
feature counts document by document.

What is shuffled is each chunk's dictionary, compressed by ranges of strings, and 6
bytes for every entry back; a string that all documents hold is sent once a chunk, so
no range is hot. Nothing but the ``buckets`` sums reaches the driver. The lists of a
range are sorted by Spark, which spills, so memory does not depend on the ranges.

A null or empty text has no features and weight 0. Repeated rows are documents of
their own. An empty table gives an empty result; an empty target gives the gains of
no target text. Only the id and the text of ``docs`` are read, so other columns and
their names do not matter. A document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import flat_bytes, materialise, mix, release

CHUNK = 8 << 20
#: Bytes of features that a range is meant to hold.
RANGE = 64 << 20
#: Entries that a task gathers before it sends them back by chunk.
HELD = 1 << 18

_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = pa.scalar(" ", pa.large_string())


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7


def words_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts behind one another (A-Z lower-cased) and where each text's words begin."""
    data, offsets = flat_bytes(texts)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]  # a text's first byte never continues the one before
    at = at[at > 0]
    last[at - 1] = inside[at - 1]
    begins = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) - begins + 1))
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return words, np.searchsorted(begins, offsets)


def numbered(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Distinct words in order of their bytes, and each word's number."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


class Features:
    """A chunk's distinct features: its words, then its pairs of neighbouring words, each in order."""

    def __init__(self, words: pa.LargeStringArray, ids: np.ndarray, starts: np.ndarray):
        self.words, self.n = words, len(words)
        last = np.zeros(len(ids) + 1, bool)
        last[starts[1:]] = True  # a word that the next one does not follow in its document
        self.paired = ~last[1 : len(ids)]
        keys = ids[:-1].astype(np.int64) * self.n + ids[1:]
        self.pairs, self.pair_of, pair_counts = np.unique(keys[self.paired], return_inverse=True, return_counts=True)
        self.counts = np.append(np.bincount(ids, minlength=self.n), pair_counts)

    def ranges(self, n: int) -> np.ndarray:
        """A range for each feature, from its text alone: the same in every chunk."""
        data, offsets = flat_bytes(self.words)
        value = mix(data.astype(np.uint64) + (np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64) * np.uint64(257))
        one = mix(np.add.reduceat(value, offsets[:-1])) if self.n else np.zeros(0, np.uint64)
        two = mix(one[self.pairs // max(1, self.n)] * np.uint64(3) + one[self.pairs % max(1, self.n)])
        return (np.append(one, two) % np.uint64(n)).astype(np.int64)

    def size(self) -> int:
        """Bytes of all distinct features."""
        lens = pc.binary_length(self.words).to_numpy() if self.n else np.zeros(1, np.int64)
        return int(lens.sum() + lens[self.pairs // max(1, self.n)].sum() + lens[self.pairs % max(1, self.n)].sum() + len(self.pairs))

    def dealt(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Features by range, and where each range begins."""
        ranges = self.ranges(n)
        return np.argsort(ranges, kind="stable"), np.append(0, np.cumsum(np.bincount(ranges, minlength=n)))

    def texts(self, at: np.ndarray) -> pa.LargeStringArray:
        """Features by their ascending numbers."""
        single, double = at[at < self.n], self.pairs[at[at >= self.n] - self.n]
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(double // max(1, self.n))), self.words.take(pa.array(double % max(1, self.n))), _SPACE)
        return pa.concat_arrays([self.words.take(pa.array(single)), pairs])


def _zip(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unzip(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _shut(texts: pa.LargeStringArray) -> bytes:
    """Strings as their lengths, by byte planes, and their bytes, compressed."""
    data, offsets = flat_bytes(texts)
    lens = np.diff(offsets).astype(np.int32)
    raw = lens.view(np.uint8).reshape(-1, 4).T.tobytes() + data.tobytes()
    return np.array([len(lens), len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _open(packed: bytes) -> pa.LargeStringArray:
    n, size = np.frombuffer(packed[:16], np.int64).tolist()
    raw = pa.decompress(packed[16:], size, "zstd")
    lens = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view(np.int32).ravel()
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.append(0, np.cumsum(lens, dtype=np.int64))), raw.slice(4 * n))


def _row(schema: str, *cells: object) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], kinds[t]) for c, (_, t) in zip(cells, names, strict=True)], [n for n, _ in names])


CHUNKS = "chunk long, bytes long, docs binary, starts binary, ids binary, words binary"


def _cut(target: bool):
    """Chunks of (row, id, text); a chunk takes twice its first row's number, and one more if it is of the target."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        words, starts = words_of(rows["text"])
        known, ids = numbered(words)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.select(["id"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.select(["id"]))
        return _row(CHUNKS, 2 * rows["row"][0].as_py() + target, Features(known, ids, starts).size(), sink.getvalue().to_pybytes(), _zip(starts), _zip(ids), _shut(known))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(batch):
                run = np.cumsum(sizes[start:], dtype=np.int64)
                fits = int(np.searchsorted(run, CHUNK - size, side="right"))
                if held and not fits:
                    yield chunk(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
                    continue
                take = max(1, fits)
                held.append(batch.slice(start, take))
                size += int(run[take - 1])
                start += take
        if held:
            yield chunk(held)

    return cut


def _opened(row: dict) -> tuple[Features, np.ndarray, np.ndarray]:
    ids, starts = _unzip(row["ids"], np.int32), _unzip(row["starts"], np.int64)
    return Features(_open(row["words"]), ids, starts), ids, starts


DEALT = "range int, chunk long, first int, features binary, counts binary"


def _deal(n: int):
    """Each chunk's features by range; ``first`` counts its features in the ranges before."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            f, _, _ = _opened(row)
            order, bounds = f.dealt(n)
            for r in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[r] : bounds[r + 1]]
                yield _row(DEALT, int(r), row["chunk"], int(bounds[r]), _shut(f.texts(at)), _zip(f.counts[at]))

    return deal


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for batch in batches for r in batch.to_pylist()):
        texts, counts = _open(row["features"]), _unzip(row["counts"], np.int64)
        n = len(texts)
        at = np.arange(row["first"], row["first"] + n, dtype=np.int32)
        for lo in range(0, n, 1 << 16):
            part = slice(lo, min(n, lo + (1 << 16)))
            yield pa.RecordBatch.from_arrays([texts[part].cast(pa.string()), pa.array(np.full(part.stop - lo, row["chunk"])), pa.array(at[part]), pa.array(counts[part])], ["feature", "chunk", "at", "n"])


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32s(texts: pa.Array, short: int = 48) -> np.ndarray:
    """CRC-32 of each string: byte by byte for all short ones at once, one by one for longer ones."""
    data, offsets = flat_bytes(texts)
    lens = np.diff(offsets)
    crc = np.full(len(lens), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(lens <= short)
    for k in range(short):
        some = some[lens[some] > k]
        if not len(some):
            break
        now = crc[some]
        crc[some] = _CRC[(now ^ data[offsets[some] + k]) & 0xFF] ^ (now >> 8)
    crc = ~crc
    for k in np.flatnonzero(lens > short):
        crc[k] = zlib.crc32(data[offsets[k] : offsets[k + 1]].tobytes())
    return crc


FOUND = "chunk long, at binary, bucket binary"


def _runs(buckets: int):
    """Sorted entries to buckets: equal features lie together, the first of them is hashed.

    Gives the buckets of each chunk's entries, and at the end one row without a chunk:
    the counts of this range's features by side (corpus, target) and bucket.
    """

    def pack(held: list[pa.RecordBatch], sums: np.ndarray, last: tuple[str, int] | None):
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = rows["feature"].combine_chunks() if isinstance(rows["feature"], pa.ChunkedArray) else rows["feature"]
        new = np.ones(len(texts), bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(new)
        known = crc32s(texts.take(pa.array(heads))) % np.uint32(buckets)
        if last is not None and texts[0].as_py() == last[0]:
            known[0] = last[1]
        bucket = known[np.cumsum(new) - 1].astype(np.int32)
        chunk, at, n = (rows[c].to_numpy() for c in ("chunk", "at", "n"))
        for side in (0, 1):
            of = (chunk & 1) == side
            np.add.at(sums[side], bucket[of], n[of])
        order = np.lexsort((at, chunk))
        order = order[(chunk[order] & 1) == 0]  # nothing goes back to the target
        cuts = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0)) if len(order) else []
        out = [_row(FOUND, int(chunk[order[a]]), _zip(np.diff(at[order[a:b]], prepend=0).astype(np.int32)), _zip(bucket[order[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        return out, (texts[-1].as_py(), int(bucket[-1]))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last, sums = 0, None, np.zeros((2, buckets), np.int64)
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= HELD:
                out, last = pack(held, sums, last)
                yield from out
                held, size, out = [], 0, []
                pa.default_memory_pool().release_unused()
        if size:
            yield from pack(held, sums, last)[0]
        if sums.any():
            yield _row(FOUND, None, _zip(sums), None)

    return runs


def gains_of(sums: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 * ln of its smoothed share of the target by that of the corpus)."""
    b = sums.shape[1]
    s, t = (int(x.sum()) for x in sums)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(*sums.tolist(), strict=True)], np.int64)


def _weigh(n: int, gains: np.ndarray, kind: pa.DataType):
    """Joins a chunk's feature counts to its features' gains: a row for each document."""

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        back = right.to_pylist()
        for row in left.to_pylist():
            f, ids, starts = _opened(row)
            order, _ = f.dealt(n)
            gain = np.zeros(len(order), np.int64)
            for r in back:
                gain[order[np.cumsum(_unzip(r["at"], np.int32))]] = gains[_unzip(r["bucket"], np.int32)]
            of_word = gain[ids]
            of_word[:-1][f.paired] += gain[f.n + f.pair_of]
            upto = np.append(0, np.cumsum(of_word))
            words = np.diff(starts)
            features = words + np.maximum(words - 1, 0)
            weight = (upto[starts[1:]] - upto[starts[:-1]]) // np.maximum(features, 1)
            docs = pa.ipc.open_stream(row["docs"]).read_all()["id"].cast(kind)
            parts.append(pa.table({"id": docs, "n_words": words, "n_features": features, "weight": weight}))
        empty = pa.schema([("id", kind), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
        return pa.concat_tables(parts) if parts else empty.empty_table()

    return weigh


def weights(docs: DataFrame, id_col: str, text_col: str, target: DataFrame, target_text: str, p: Params = Params()) -> DataFrame:
    """(id, n_words, n_features, weight) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType
    cut = lambda df, key, text, side: materialise(df.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), F.col(text).alias("text")).mapInArrow(_cut(side), CHUNKS), "importance-chunks")
    chunks = cut(docs, F.col(id_col), text_col, False)
    wanted = cut(target, F.lit(None).cast(kind), target_text, True)
    both = chunks.unionByName(wanted)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(both.agg(F.sum("bytes")).first()[0] or 0) // RANGE))
    entries = both.mapInArrow(_deal(n), DEALT).repartitionById(n, F.col("range")).mapInArrow(_entries, "feature string, chunk long, at int, n long")
    found = materialise(entries.sortWithinPartitions("feature").mapInArrow(_runs(p.buckets), FOUND), "importance-found", tidy=True)
    sums = found.where("chunk IS NULL").select("at").rdd.map(lambda r: _unzip(r[0], np.int64)).treeAggregate(np.zeros(2 * p.buckets, np.int64), np.add, np.add, depth=3)
    gains = gains_of(sums.reshape(2, p.buckets))
    back = found.where("chunk IS NOT NULL")
    weigh = _weigh(n, gains, to_arrow_type(kind))
    out = chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda a, b: weigh(a, b), f"id {kind.simpleString()}, n_words long, n_features long, weight long")
    out = materialise(out, "importance-weights", tidy=True)
    release(chunks, wanted, found)
    return out


def gumbel(id_: Column, seed: int) -> Column:
    """The id's own draw, in thousandths: the k highest sums of weight and draw are a sample without replacement by weight. Null is the empty id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """``rows`` of ``weights`` with ``score`` and ``rank`` (null: not drawn).

    Ranks come without a global sort: scores are whole thousandths of logarithms, so
    their number is bounded by the formula and a table of counts by score tells how
    many stand above. Only drawn scores are dealt and ordered by id, equal rows as one.
    """
    scored = materialise(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), p.seed)), "importance-scores")
    fit = F.col("n_words") >= p.min_words
    by = scored.where(fit).groupBy("score").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    most = F.floor(F.sum("_n").over(W.partitionBy(F.lit(0))) * p.percent / 100)
    drawn = by.withColumn("_above", above).withColumn("_most", most.cast("long")).where("_above < _most").select(F.col("score").alias("_s"), "_above", "_most")
    seen = scored.join(F.broadcast(drawn), fit & (F.col("score") == F.col("_s")), "left").drop("_s")  # a row a score
    alike = seen.where("_most IS NOT NULL").groupBy("id", "n_words", "n_features", "weight", "score", "_above", "_most").agg(F.count("*").alias("_n"))
    inside = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "n_words").rowsBetween(W.unboundedPreceding, -1)
    first = alike.withColumn("_first", F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1)
    lots = first.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 4096))))
    one = lots.withColumn("rank", F.explode(F.sequence(F.col("_first") + F.col("_lot") * 4096, F.col("_first") + F.least(F.col("_n"), (F.col("_lot") + 1) * 4096) - 1)))
    columns = ["id", "n_words", "n_features", "weight", "score"]
    ranked = one.select(*columns, F.when(F.col("rank") <= F.col("_most"), F.col("rank")).alias("rank"))
    return ranked.unionByName(seen.where("_most IS NULL").select(*columns, F.lit(None).cast("long").alias("rank")))
