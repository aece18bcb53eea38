"""Incremental copies of sources that tell what changed since a version.

A feed answers for a version with the rows changed since, the keys deleted since and
its own version. A copy is a chain of snapshots in a folder: the new one is written
beside the old one and its manifest, with the cursor, is published last, under the
next number, by whoever claims it first. A batch that dies leaves the old snapshot and
cursor; run again, it writes the same rows. A batch at or below the cursor changes
nothing. Feeds of one library (items, collections) have folders, and so cursors, of
their own. Deleted keys stay as tombstones with the version that deleted them, so a
row that comes late does not bring a key back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import index


@dataclass
class Batch:
    """What a feed says: ``changed`` (key, version, other columns), ``deleted`` (key, version), and the version it speaks for."""

    changed: DataFrame
    deleted: DataFrame
    version: int


Feed = Callable[[int], Batch | None]


def cursor(spark: SparkSession, path: str) -> int:
    m = index.load_json(spark, path)
    return m["cursor"] if m else 0


def rows(spark: SparkSession, path: str, tombstones: bool = False) -> DataFrame:
    """The newest snapshot: rows that are there, or with ``tombstones`` all, deleted ones with ``_gone``."""
    m = index.load_json(spark, path)
    if m is None:
        raise LookupError(f"nothing was synchronised into {path}")
    found = spark.read.parquet(f"{path}/{m['snapshot']}")
    return found if tombstones else found.where("NOT _gone").drop("_gone")


def merged(old: DataFrame | None, batch: Batch, key: str, version: str) -> DataFrame:
    """One row a key, that of the greatest version; of equal versions a deletion wins, then the greater row. A null key is a key.

    Rows of a key meet as partial maxima, so a key with most changes is no single task's.
    """
    columns = [c for c in batch.changed.columns if c not in (key, version)]
    said = batch.changed.select(key, version, *columns).withColumn("_gone", F.lit(False))
    said = said.unionByName(batch.deleted.select(key, version).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    every = said if old is None else old.unionByName(said, allowMissingColumns=True)
    payload = F.struct(F.col(version), F.col("_gone"), *[F.col(c) for c in columns])
    return every.groupBy(key).agg(F.max(payload).alias("_r")).select(key, "_r.*")


def sync(spark: SparkSession, path: str, feed: Feed, key: str, version: str) -> int:
    """Asks the feed for what changed since the cursor and takes it in; returns the cursor. Nothing modified (None): nothing written."""
    m = index.load_json(spark, path)
    since = m["cursor"] if m else 0
    batch = feed(since)
    if batch is None or m and batch.version <= since:
        return since
    name = f"snapshot-{uuid.uuid4().hex}"
    old = spark.read.parquet(f"{path}/{m['snapshot']}") if m else None
    number = index.next_number(spark, path)
    merged(old, batch, key, version).write.parquet(f"{path}/{name}")
    index.publish_json(spark, path, number, {"number": number, "cursor": int(batch.version), "snapshot": name})
    return int(batch.version)
