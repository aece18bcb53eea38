"""Helpers shared by the training-data operators.

``materialise`` cuts lineage through a Parquet table in the folder that all
executors share, so that an operator's later steps survive a lost executor and
never repeat the expensive pass over the texts.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return _LOCAL["dir"]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended; the cluster empties its own folder
        return


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def materialise(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """``df`` written and read again; ``tidy`` drops the shuffles of this write as soon as it is done."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(CLEAN_UP, None)
    if tidy:
        spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more; other DataFrames are passed over."""
    for df in tables:
        if id(df) in _WRITTEN:
            _, path = _WRITTEN.pop(id(df))
            _forget(df.sparkSession, path)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another and the offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> list[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes (one longer document is a run of its own)."""
    out, start = [], 0
    n = len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xA0761D6478BD642F)
_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and, per document, where its words begin.

    A word is hashed as a polynomial over its bytes, whole batches at a time; the
    white space bytes cannot occur inside a multi-byte UTF-8 sequence.
    """
    global _POWERS
    n_docs = len(offsets) - 1
    inside = ~SPACES[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] = inside[at]  # a document's first byte never continues the one before
    begins = np.flatnonzero(start)
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, begins)
    lens = np.diff(np.append(first, len(kept)))
    if lens.max() > len(_POWERS):
        _POWERS = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    pos = np.arange(len(kept)) - np.repeat(first, lens)
    hashes = mix(np.add.reduceat(_BYTE[_LOWER[data[kept]]] * _POWERS[pos], first) + lens.astype(np.uint64))
    return hashes, np.searchsorted(begins, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words (positional, order-sensitive)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0xE7037ED1A0B428DB) + words[i : i + n])
    return out


def rank_in(df: DataFrame, group: str, order: list[Column], salts: Column, name: str) -> DataFrame:
    """Gapless rank from 0 inside ``group`` without sorting a hot group in one task.

    Rows are dealt to ``salts`` lots by hash; a lot is ranked alone and starts
    where the lots before it end. ``df`` must be cheap to read twice.
    """
    from pyspark.sql import Window as W

    lot = df.withColumn("_lot", F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), salts).cast("long"))
    sizes = lot.groupBy(group, "_lot").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = W.partitionBy(group, "_lot").orderBy(*order)
    return lot.join(before, [group, "_lot"]).withColumn(name, (F.row_number().over(inner) - 1 + F.col("_before")).cast("long")).drop("_lot", "_before")
