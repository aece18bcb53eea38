"""Paragraphs of documents, as windows over a table of lines.

Every line gets its kind from what it is and from two facts that carry forward:
whether a footnote is open, and whether text of a paragraph is open. Both are the
last event that sets or ends them, so they are windows, not a loop; a paragraph is
the text between two breaks, an island of a running count. Lines that no paragraph
takes keep a row with the reason. One shuffle brings a document's lines together
and serves all windows.

Form feeds part pages; a footnote or paragraph ends with its page. Rows with equal
or null ids stay documents of their own. A null or empty text has no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: Footnote signs, and how lines of the publisher begin.
NOTE_SIGNS = "*†‡§¶"
PUBLISHER = ("author affiliation", "author affiliations", "author contribution", "author contributions", "the author declare", "the authors declare", "copyright", "to whom correspondence", "this article contains supporting information", "published by", "downloaded from")
#: A running edge is one of the first or last two lines of a page, digits aside, on 40 % of the pages and on three at least.
EDGE_LINES, EDGE_PAGES, EDGE_SHARE, EDGE_LENGTH = 2, 3, 0.4, (2, 160)


def table_of_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, page, pages, line, raw): stripped lines in order; ``row`` tells apart documents with equal ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(F.col(text_col), "\f").alias("_pages"))
    each = rows.select("row", "id", F.size("_pages").alias("pages"), F.posexplode("_pages").alias("page", "_p"))
    lines = each.select("row", "id", "pages", "page", F.posexplode(F.split("_p", r"\R")).alias("line", "_l"))
    return lines.select("row", "id", "pages", "page", "line", T.strip("_l").alias("raw")).repartition("row")


def _edges(lines: DataFrame) -> Column:
    """Whether a line is a running edge of its document."""
    seen = F.col("raw") != ""
    first = F.count_if(seen).over(W.partitionBy("row", "page").orderBy("line"))
    last = F.count_if(seen).over(W.partitionBy("row", "page").orderBy(F.desc("line")))
    outer = seen & (F.col("pages") >= EDGE_PAGES) & ((first <= EDGE_LINES) | (last <= EDGE_LINES))
    return outer


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table of lines with ``kind`` (blank, text, heading, none, or the reason of an omission) and ``group``, the island of its paragraph."""
    lines = table_of_lines(docs, id_col, text_col)
    lines = lines.withColumn("clean", T.speech("raw")).withColumn("_outer", _edges(lines))
    key = F.when(F.col("pages") >= EDGE_PAGES, F.regexp_replace(F.lower("clean"), r"[0-9]+", "#"))
    sized = F.length("_key").between(*EDGE_LENGTH)
    on = F.size(F.collect_set(F.when(F.col("_outer") & sized, F.col("page"))).over(W.partitionBy("row", "_key")))
    lines = lines.withColumn("_key", key).withColumn("_edge", sized & (on >= F.greatest(F.lit(EDGE_PAGES), F.ceil(EDGE_SHARE * F.col("pages")))))
    blank, edge = F.col("raw") == "", F.coalesce(F.col("_edge"), F.lit(False))
    sign = ~blank & ~edge & F.col("raw").rlike(rf"\A[{NOTE_SIGNS}]")
    closed = F.col("raw").rlike(r"[.!?]\z")
    before = W.partitionBy("row", "page").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    note = F.last(F.when(sign & ~closed, True).when(blank | (~edge & closed), False), ignorenulls=True).over(before)
    lines = lines.withColumn("_note", ~blank & ~edge & (sign | F.coalesce(note, F.lit(False)))).withColumn("_sign", sign)
    of_publisher = F.lower("clean").rlike(rf"\A(?:{'|'.join(PUBLISHER)})(?:\W|\z)")
    kind = F.when(blank, "blank").when(edge, "repeated-page-edge").when(F.col("_note"), "footnote").when(F.col("clean") == "", "none").when(of_publisher, "publisher-or-contact-furniture")
    kind = kind.when(T.heading_name("clean") == "significance", "heading").when(T.heading_level(F.col("clean")).isNotNull(), "maybe").otherwise("text")
    lines = lines.withColumn("kind", kind)
    breaks = (F.col("kind").isin("blank", "repeated-page-edge", "publisher-or-contact-furniture", "heading")) | (F.col("_sign") & (F.col("kind") == "footnote"))
    open_ = F.coalesce(F.last(F.when(F.col("kind") == "text", True).when(breaks, False), ignorenulls=True).over(before), F.lit(False))
    lines = lines.withColumn("kind", F.when(F.col("kind") == "maybe", F.when(open_, "text").otherwise("heading")).otherwise(F.col("kind")))
    upto = W.partitionBy("row", "page").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("group", F.count_if(breaks).over(upto)).select("row", "id", "page", "line", "raw", "clean", "kind", "group")


def blocks(lines: DataFrame) -> DataFrame:
    """(row, id, k, block): paragraphs and headings of ``classified`` lines in order; a short numbered heading parts from its text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("line", "raw")))), lambda x: x["raw"]), "\n")
    grouped = lines.where(F.col("kind").isin("text", "heading")).groupBy("row", "page", "group", "kind").agg(F.first("id").alias("id"), F.min("line").alias("line"), text.alias("_text"), F.first("clean").alias("_clean"))
    whole = F.when(F.col("kind") == "heading", F.col("_clean")).otherwise(T.speech(T.joined_lines("_text")))
    parts = grouped.withColumn("_block", whole).where("_block <> ''").select("row", "id", "page", "line", F.posexplode(T.heading_parts(F.col("_block"))).alias("_n", "block"))
    k = F.row_number().over(W.partitionBy("row").orderBy("page", "line", "_n")) - 1
    return parts.where("block <> ''").select("row", "id", k.cast("long").alias("k"), "block")


def omissions(lines: DataFrame) -> DataFrame:
    """(row, id, k, text, reason) of the lines that no paragraph takes, blank ones aside."""
    left = lines.where(~F.col("kind").isin("text", "heading", "blank", "none"))
    k = F.row_number().over(W.partitionBy("row").orderBy("page", "line")) - 1
    return left.select("row", "id", k.cast("long").alias("k"), F.col("clean").alias("text"), F.col("kind").alias("reason"))


def headed_section(lines: DataFrame, names: tuple[str, ...], closing: tuple[str, ...]) -> DataFrame:
    """(row, id, section): the text between the first line that is one of ``names`` and the next line that reads as a heading or begins with one of ``closing``."""
    opens = T.heading_name("clean").isin(*names)
    ends = T.heading_level(F.col("clean")).isNotNull() | F.lower("clean").rlike(rf"\A(?:{'|'.join(closing)})\b")
    upto = W.partitionBy("row").orderBy("page", "line").rowsBetween(W.unboundedPreceding, 0)
    state = lines.withColumn("_opened", F.count_if(opens).over(upto)).withColumn("_ended", F.count_if(ends & ~opens).over(upto))
    state = state.withColumn("_since", F.max(F.when(opens, F.col("_ended"))).over(upto))
    inside = state.where((F.col("_opened") == 1) & ~opens & (F.col("_ended") == F.col("_since")) & (F.col("kind") == "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "raw"))), lambda x: x["raw"])
    return inside.groupBy("row").agg(F.first("id").alias("id"), T.speech(T.joined_lines(F.array_join(parts, "\n"))).alias("section"))
