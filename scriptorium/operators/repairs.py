"""Typesetting repaired on the evidence of the same document.

'co- operate', 'co-operate' and 'A BSTRACT' are joined only where the joined word is
used elsewhere in the document, and digits behind a word go only where the document
marks its citations so. A text is cut once into what may be broken and what lies
between; the candidates look up the counts of their own document's words, and what is
decided is put back between the rest. All evidence stands in the row itself, so no
text and no word is shuffled. Only documents with a candidate are counted, and of
their words only the forms that some candidate asks for.

A null text is passed through, as is one without candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that end a suspended compound, and citation lists that prove superscripts.
SUSPENDED = ("and", "or", "nor", "to", "versus", "vs")
LISTS = 3
PLAIN = r"(?<![\p{L}\p{N}_-])\p{L}{2,}(?![\p{L}\p{N}_-])"
COMPOUND = r"(?<![\p{L}\p{N}_-])\p{L}{2,}-\p{L}{2,}(?![\p{L}\p{N}_-])"
CAPS = r"(?<![\p{L}\p{N}])[A-Z] [A-Z]{2,}(?![\p{L}\p{N}])"
CITED = r"(?<![\p{L}\p{N}_])\p{L}*[a-z]{3}[0-9]{1,3}(?:[,–-][0-9]{1,3})*(?=[\s.,;:)]|\z)"
CITED_LIST = r"[a-z]{3}[0-9]{1,3}(?:[,–-][0-9]{1,3})+(?=[\s.,;:)]|\z)"
BROKEN = r"(?<![\p{L}\p{N}_-])\p{L}{2,}-(?: ?)[a-zà-ÿ]{2,}(?![\p{L}\p{N}_-])"
CANDIDATE = f"{BROKEN}|{CAPS}|{CITED}"


def words_of(text: Column) -> Column:
    """All words of a text (plain or compound, in lower case), as often as they stand there; fragments of small capitals are no words."""
    plain = F.regexp_replace(text, CAPS, " ")
    forms = F.concat(F.regexp_extract_all(plain, F.lit(PLAIN), F.lit(0)), F.regexp_extract_all(plain, F.lit(COMPOUND), F.lit(0)))
    return F.transform(forms, F.lower)


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(row, form, n): how often each word stands in its document; ``docs`` has ``row``, a number for each document."""
    return docs.select("row", F.explode(words_of(F.col(text))).alias("form")).groupBy("row", "form").agg(F.count("*").alias("n"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often and deep it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _counts(words: Column) -> Column:
    """How often each of the sorted words stands there: a form's count is the distance of the ends of two runs."""
    ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.coalesce(F.get(words, i) != F.get(words, i - 1), F.lit(True)))
    return F.when(F.size(words) > 0, _once(ends, lambda e: F.map_from_arrays(F.transform(e, lambda k: F.get(words, k - 1)), F.transform(e, lambda k, i: k - F.coalesce(F.get(e, i - 1), F.lit(0))))))


def cites_by_superscripts(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(CITED_LIST), F.lit(0))) >= LISTS


def _candidate(span: Column) -> Column:
    """A candidate's kind, its halves, and the two forms between which its document decides."""
    halves = F.split(span, r"- ?| ")
    left, right = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    caps = span.rlike(rf"\A{CAPS}\z")
    kind = F.when(caps, "small-caps").when(span.contains("- "), "spaced").when(span.rlike(r"[0-9]"), "cited").otherwise("fused")
    other = F.when(caps, F.lower(right)).otherwise(F.lower(F.concat_ws("-", left, right)))
    return F.struct(span.alias("span"), kind.alias("kind"), left.alias("left"), right.alias("right"), F.lower(F.concat(left, right)).alias("joined"), other.alias("other"))


def _decided(c: Column, counts: Column, cites: Column) -> Column:
    """(new, name) of a candidate: what is put in its place, and the kind of repair, null without one."""
    k, left, right = c["kind"], c["left"], c["right"]
    n = lambda form: F.coalesce(counts[form], F.lit(0))
    whole, a, b = F.concat(left, right), n(c["joined"]), n(c["other"])
    fixed = F.when((k == "spaced") & ~F.lower(right).isin(*SUSPENDED) & ((a > 0) | (b > 0)), F.when(b >= a, F.concat_ws("-", left, right)).otherwise(whole))
    fixed = fixed.when((k == "fused") & (a > b), whole)
    fixed = fixed.when((k == "small-caps") & (b == 0) & ((F.length(right) >= 4) | (a > 0)), whole)
    fixed = fixed.when((k == "cited") & cites, F.regexp_replace(c["span"], r"[0-9].*\z", ""))
    named = F.when(k == "small-caps", "repair-small-caps-split").when(k == "cited", "omit-superscript-citation").otherwise("repair-line-break-hyphenation")
    return _once(fixed, lambda f: F.struct(F.coalesce(f, c["span"]).alias("new"), F.when(f.isNotNull(), named).alias("name")))


def _spans(found: Column, text: Column) -> Column:
    """The candidates decided by the words of a text."""
    asked = F.flatten(F.transform(F.filter(found, lambda c: c["kind"] != "cited"), lambda c: F.array(c["joined"], c["other"])))
    met = lambda words: _once(F.array_intersect(asked, words), lambda forms: F.array_sort(F.filter(words, lambda w: F.array_contains(forms, w))))
    counts = F.when(F.size(asked) > 0, _once(_once(words_of(text), met), _counts))
    cites = F.when(F.exists(found, lambda c: c["kind"] == "cited"), cites_by_superscripts(text)).otherwise(False)
    return _once(F.struct(counts.alias("counts"), cites.alias("cites")), lambda d: F.transform(found, lambda c: _decided(c, d["counts"], d["cites"])))


def repaired(docs: DataFrame, id_col: str, text_col: str, evidence_col: str | None = None) -> DataFrame:
    """(id, text, repairs): every document's text, repaired, and the kinds of its repairs in order of the text.

    A part of a document is decided by the column ``evidence_col``, the words of the whole, in place of its own.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(evidence_col or text_col).alias("evidence"))
    candidates = F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), _candidate)
    put = lambda spans: F.array_join(F.zip_with(F.split(text, CANDIDATE), F.transform(spans, lambda s: s["new"]), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")
    names = lambda spans: F.filter(F.transform(spans, lambda s: s["name"]), lambda n: n.isNotNull())
    none = F.array().cast("array<string>")
    done = lambda found: F.when(F.size(found) > 0, _once(_spans(found, F.col("evidence")), lambda spans: F.struct(put(spans).alias("text"), names(spans).alias("repairs")))).otherwise(F.struct(text.alias("text"), none.alias("repairs")))
    # one array, exploded: what follows reads its parts and does not work them out again
    rows = rows.select("id", F.explode(F.transform(F.array(F.coalesce(candidates, F.array())), done)).alias("done"))
    return rows.select("id", "done.text", "done.repairs")
