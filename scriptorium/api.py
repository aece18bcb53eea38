"""The library's functions for callers: each takes a session and a folder and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.search import any_word, bm25, stored_index
from scriptorium.plans.filters import page
from scriptorium.sources.tables import catalog, table


def article(spark: SparkSession, folder: str, key: int) -> DataFrame:
    """The article of that id; a KeyError if there is none."""
    found = catalog(spark, folder).where(F.col("id") == key).limit(1)
    if found.isEmpty():
        raise KeyError(key)
    return found


def library(spark: SparkSession, folder: str, text: str = "", limit: float = 100, offset: float = 0) -> DataFrame:
    """A page of articles by title; with a text, those whose title is like it or that a search finds."""
    rows = catalog(spark, folder)
    if text:
        hits = any_word(spark, stored_index(spark, folder), text)
        rows = rows.where(F.col("title").ilike(f"%{text}%")).select("id").unionByName(hits).distinct().join(rows, "id")
    return page(rows.select("id", "title", "lang", "source").orderBy(F.lower("title"), "id"), limit, offset)


def search(spark: SparkSession, folder: str, text: str, limit: int = 20) -> DataFrame:
    """Ranked hits, best first."""
    rows = catalog(spark, folder)
    best = bm25(spark, stored_index(spark, folder), text).orderBy("score", "id").limit(min(max(limit, 1), 100))
    return best.join(rows.select("id", "title"), "id").orderBy("score", "id")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """How many articles are labelled, good and warned of."""
    return table(spark, folder, "labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("warned"))
