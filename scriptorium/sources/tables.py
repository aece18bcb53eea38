"""Readers of the stand-in tables and the catalog view over ``documents``."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import squeeze


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """Where stored tables are kept: beside the checkpoints, else, on one machine only, in a folder of this process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="scriptorium-"))
    return "file://" + _OWN[0].name


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title (the first 60 characters with white space squeezed), body, lang, source, n_chars."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), squeeze(F.substring("text", 1, 60)).alias("title"), F.col("text").alias("body"), "lang", "source", "n_chars")


CATALOG_SQL = "cat AS (SELECT doc_id AS id, trim(regexp_replace(substr(text, 1, 60), '[ \\t\\n\\r]+', ' ', 'g')) AS title, text AS body, lang, source, n_chars FROM documents)"
