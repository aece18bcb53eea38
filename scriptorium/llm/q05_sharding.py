"""op5: all documents in shards 0 to 7, near equal in bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding as S
from ._common import fresh_path, materialise, table

SHARDS = 8
KEY = ["doc_id", "text_crc32", "size"]  # rows whose doc_id is null or repeated are spread too


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    docs = materialise(docs, "op5-sizes")
    stats = S.slot_bytes(docs, KEY, F.col("size"))
    store = fresh_path(spark, "op5-map")
    S.save(S.even_map(SHARDS), spark, store)
    S.save(S.rebalance(S.load(spark, store), stats), spark, store)
    mapping = S.load(spark, store)
    placed = S.place(S.assign(docs, KEY, mapping), mapping, stats, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(mapping.version).alias("map_version"))
