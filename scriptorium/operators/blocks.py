"""Documents as paragraphs, blocks and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import arrow


def reading_order(boxes: DataFrame, page: str, full_width: Column, column: Column, y: Column, x: Column) -> DataFrame:
    """Adds ``ordinal``: full-width boxes are barriers; between them boxes go by column, then down, then right."""
    down = W.partitionBy(page).orderBy(y, x)
    marked = boxes.withColumn("_full", full_width.cast("int")).withColumn("_zone", 2 * F.sum(F.col("_full")).over(down.rowsBetween(W.unboundedPreceding, 0)) - F.col("_full"))
    place = W.partitionBy(page).orderBy("_zone", F.when(F.col("_full") == 1, -1).otherwise(column), y, x)
    return marked.withColumn("ordinal", F.row_number().over(place)).drop("_full", "_zone")


def merge_continuations(lines: Column) -> Column:
    """Lines of one document folded in order: a line that begins with a small letter or digit continues an
    open one, which lacks closing punctuation or closes fewer brackets than it opens."""
    return arrow.continuations(lines)


def markdown_blocks(text: Column) -> Column:
    """array<struct<ordinal, type, level, text>> of the lines of a Markdown text, without front matter and comments."""
    body = F.regexp_replace(F.regexp_replace(text, r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*\n", ""), r"(?s)<!--.*?-->", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    level = lambda x: F.length(F.regexp_extract(x, r"\A(#{1,6}) ", 1))
    return F.transform(lines, lambda x, i: F.struct(
        (i + 1).alias("ordinal"), F.when(level(x) > 0, "heading").when(x.rlike(r"\A[-*] "), "item").otherwise("text").alias("type"),
        level(x).alias("level"), F.trim(F.regexp_replace(x, r"\A(#{1,6}|[-*]) ", "")).alias("text")))
