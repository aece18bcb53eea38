"""Bibliographies that extraction has left in the text, cut from ordered segments.

A heading of references opens a range that is left out, the next appendix heading
closes it. A run of numbered entries without a heading ends the readable text. The
narrator's own segments always stay. The three states (read, skipped, ended) are an
automaton that ``automaton.states_before`` runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import automaton

#: Names of bibliographies and of what follows them.
REFERENCE_NAMES = ("references", "bibliography", "works cited", "literature cited", "reference list")
APPENDIX_NAMES = ("appendix", "appendices", "supplementary")
#: Entries that make a run, segments in which they follow, and how far numbers may jump.
RUN_ENTRIES, RUN_AHEAD, RUN_JUMP, APPENDIX_WORDS = 3, 11, 5, 10
READ, SKIPPED, ENDED = range(3)


def entry_number(text: Column) -> Column:
    """The number of a bibliography entry ('4. Xu S, Pan Z.'): a surname of one to three words, then initials; else null."""
    word = F.split(F.trim(text), r"\s+")
    number = F.regexp_extract(F.get(word, F.lit(0)), r"\A([0-9]{1,3})\.\z", 1)
    initials = F.filter(F.slice(word, 3, 3), lambda w: w.rlike(r"\A\p{Lu}{1,3}[.,]"))
    named = F.get(word, F.lit(1)).rlike(r"\A\p{Lu}[\p{L}\p{N}_’'-]+\z") & (F.size(initials) > 0)
    return F.when((number != "") & named, F.when(number != "", number).cast("int"))


def is_reference_heading(text: Column) -> Column:
    """One of the names alone, with a number before it or a mark behind it."""
    return F.lower(F.trim(text)).rlike(rf"\A(?:[0-9]+\.? +)?(?:{'|'.join(REFERENCE_NAMES)})[.:]?\z")


def is_appendix_heading(text: Column) -> Column:
    """At most ten words that begin with a name of appendices, or with a letter and number and a capital word."""
    words = F.split(F.trim(text), r"\s+")
    named = F.lower(F.trim(text)).rlike(rf"\A(?:{'|'.join(APPENDIX_NAMES)})\b")
    lettered = F.get(words, F.lit(0)).rlike(r"\A[A-Z][0-9]{0,2}(?:\.[0-9]+)*\.?\z") & F.get(words, F.lit(1)).rlike(r"\A[A-Z]") & ~F.trim(text).rlike(r"[,“”\"]")
    return (F.size(words) <= APPENDIX_WORDS) & (named | F.coalesce(lettered, F.lit(False)))


def run_starts(rows: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, place) of entries that begin a run. Only entries are dealt, each to the places that look ahead to it."""
    entries = rows.select(F.col(key).alias("_key"), F.col(place).alias("_p"), entry_number(F.col(text)).alias("_n")).where("_n IS NOT NULL AND _p IS NOT NULL")
    seen = entries.select("_key", F.explode(F.sequence(F.col("_p") - RUN_AHEAD, F.col("_p"))).alias("at"), "_p", "_n")
    ahead = seen.groupBy("_key", "at").agg(F.array_sort(F.collect_list(F.struct("_p", "_n"))).alias("a"))
    own = ahead.where(F.element_at("a", 1)["_p"] == F.col("at"))
    follows = F.aggregate(F.slice("a", 2, RUN_AHEAD), F.struct(F.element_at("a", 1)["_n"].alias("last"), F.lit(1).alias("n")), lambda s, x: F.when(
        (x["_n"] > s["last"]) & (x["_n"] <= s["last"] + RUN_JUMP), F.struct(x["_n"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(s))
    return own.where(follows["n"] >= RUN_ENTRIES).select("_key", F.col("at").alias("_at"))


def without_bibliographies(segments: DataFrame, key: str, place: str, text: str, narrator: Column, width: int = automaton.WIDTH, alone: Column | None = None) -> DataFrame:
    """``segments`` with ``kept``; ``place`` is the segment's number in its ``key``. A null text is kept or left out as its range is.

    ``alone`` says which segments are set as headings or entries; the others are prose, whatever they look like. Without it any may be one.
    """
    alone = F.lit(True) if alone is None else F.coalesce(alone, F.lit(False))
    starts = run_starts(segments.where(alone), key, place, text)
    rows = segments.withColumn("_narrator", F.coalesce(narrator, F.lit(False))).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col(place) == F.col("_at")), "left")
    value = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_opens", alone & is_reference_heading(value)).withColumn("_closes", alone & is_appendix_heading(value)).withColumn("_run", F.col("_at").isNotNull()).drop("_key", "_at")
    to = lambda *s: F.array(*[F.lit(x) for x in s])
    run = F.col("_run")
    step = F.when(F.col("_narrator"), to(READ, SKIPPED, ENDED)).when(F.col("_opens"), to(SKIPPED, SKIPPED, ENDED))
    step = step.when(F.col("_closes"), F.when(run, to(ENDED, ENDED, ENDED)).otherwise(to(READ, READ, ENDED))).otherwise(F.when(run, to(ENDED, SKIPPED, ENDED)).otherwise(to(READ, SKIPPED, ENDED)))
    scanned = automaton.states_before(rows, key, place, step, 3, READ, width)
    read = (F.col("state") == READ) | ((F.col("state") == SKIPPED) & F.col("_closes"))
    kept = F.col("_narrator") | (read & ~F.col("_opens") & ~F.col("_run"))
    return scanned.withColumn("kept", kept).drop("state", "_narrator", "_opens", "_closes", "_run")
