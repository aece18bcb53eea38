"""op12: how many words of every document the mix takes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from ._common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
SEED = "12"
SHARE, WEIGHTS, CAP = 1.5, [3, 1, 2], 2


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mixing.hash60(SEED, F.col("doc_id"), text).alias("h"))
    mixed = mixing.mix(materialise(docs, "op12-sizes"), {"mix": SHARE}, WEIGHTS, CAP)
    return mixed.select("doc_id", "size", "source_size", F.col("target_mix").alias("target"), F.col("taken_mix").alias("taken"))


#: The same targets from a sort by hash: what stands before a row in its source tells whether its last pass is taken.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, CAST({CAP} * source_size AS DOUBLE) AS cap, CAST({CAP} * source_size AS DOUBLE) / weight AS by_weight FROM w),
l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level FROM c WINDOW ahead AS (ORDER BY by_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source, h) AS held, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN upto <= rest THEN size WHEN upto - held > rest OR held = 0 THEN 0 ELSE size * (rest - (upto - held)) // held END AS BIGINT) AS taken FROM r
"""
