"""op2: a WARC round trip of all pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from ._common import fresh_path, materialise, table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "op2-warc")
    warc.write(pages, path, F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    records = materialise(warc.read(spark, path, with_block=False), "op2-records")
    return warc.resolve_revisits(warc.assemble(records))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (1 + 5 * i)::BIGINT, 5))::BIGINT) AS bits FROM d),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (bits[i // 4 + 1] >> (15 - 5 * (i % 4))::BIGINT) % 32, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS top FROM v)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
