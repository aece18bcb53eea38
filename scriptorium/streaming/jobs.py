"""Incremental state as Structured Streaming: liveness, idempotent creation, leases, upserts.

Events have event_id, ts, user_id (the key), event_type and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_SECONDS = 300


def heartbeats(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Last time each key was seen in a window; state of closed windows is dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("beats"))


def first_requests(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One request per idempotency key; keys are remembered as long as the watermark needs them."""
    return events.withWatermark("ts", late).withColumn("key", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256)).dropDuplicatesWithinWatermark(["key"])


def leases(claims: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Claims on jobs (user_id asks for job event_type at ts): the holder of a live lease keeps it, others are refused."""

    def claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now = int(r.ts.timestamp())
            granted = holder is None or holder == r.user_id or until <= now
            if granted:
                holder, until = int(r.user_id), now + seconds
            out.append((key[0], r.event_id, r.user_id, granted))
        state.update((holder, until))
        yield pd.DataFrame(out, columns=["job", "event_id", "worker", "granted"])

    return claims.groupBy("event_type").applyInPandasWithState(claim, "job string, event_id long, worker long, granted boolean", "holder long, until long", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, key: str, version: str):
    """A ``foreachBatch`` sink: the latest row of each key, written beside the last snapshot and then named in its place.

    A batch that is run again reads the snapshot before it and writes the same rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = spark.read.parquet(f"{path}/epoch={epoch - 1}").unionByName(batch)
        columns = [c for c in rows.columns if c != key]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
