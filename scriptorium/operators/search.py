"""Ranked full-text search over a stored inverted index of tokens.

Tokens are runs of letters and digits of any script, in lower case and without
the accents of Latin letters. The index (``operators.index``) is sorted by term, so
a query reads the row groups of its own terms and no text. When files of the table
change, the postings of new, changed and deleted documents alone are written. A term
of very many documents is split over tasks and files by document.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import index
from scriptorium.sources.tables import catalog, shared_folder

TOKEN = r"[\p{L}\p{N}]+"
VERSION = 2  # of the rule for tokens and of the index's columns
K1, B = 1.2, 0.75
WEIGHTS = {"title": 5.0, "body": 1.0}


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters in lower case, and the letters that they are without accents."""
    accented = [chr(k) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(k) == chr(k).lower()]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in accented}
    folded = [c for c in accented if len(bare[c]) == 1 and bare[c] != c]
    return "".join(folded), "".join(bare[c] for c in folded)


_ACCENTED, _BARE = _plain_letters()
_FOLD = str.maketrans(_ACCENTED, _BARE)


def tokens_of(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(c), _ACCENTED, _BARE), F.lit(TOKEN), 0)


def query_words(text: str, most: int = 32) -> list[str]:
    """The query's words; quoting is not needed, as they are only ever compared."""
    return re.findall(r"[^\W_]+", text.lower().translate(_FOLD))[:most]


def build_index(docs: DataFrame, key: str = "id", columns: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """(key, len, col, term, tf): one row per term, column and document; ``len`` is the length of all its columns.

    A document's terms are counted where it is read: nothing is shuffled.
    """
    arrays = docs.select(key, *[F.coalesce(tokens_of(F.col(c)), F.array().cast("array<string>")).alias(c) for c in columns])
    arrays = arrays.withColumn("len", reduce(lambda a, b: a + b, [F.size(c) for c in columns]).cast("long"))
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.array_sort(F.col(c)).alias("terms")) for c in columns])
    rows = arrays.select(key, "len", F.explode(parts).alias("p"))
    ends = F.filter(F.sequence(F.lit(1), F.size("p.terms")), lambda i: F.coalesce(F.get("p.terms", i) != F.get("p.terms", i - 1), F.lit(True)))
    rows = rows.where(F.size("p.terms") > 0).select(key, "len", "p.col", "p.terms", ends.alias("ends"))
    runs = F.transform("ends", lambda e, i: F.struct(F.get("terms", e - 1).alias("term"), (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("long").alias("tf")))
    return rows.select(key, "len", "col", F.explode(runs).alias("t")).select(key, "len", "col", "t.term", "t.tf")


def rule(columns: tuple[str, ...] = ("title", "body"), version: int = VERSION) -> index.Rule:
    return index.Rule(version, columns, lambda docs: build_index(docs, "id", columns))


def write_index(docs: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = ("title", "body")) -> str:
    """An index of all ``docs`` as the newest state of ``path``; returns its handle."""
    return index.build(docs.sparkSession, path, rule(columns), docs.select(F.col(key).alias("id"), *columns))


def table_state(spark: SparkSession, path: str) -> str:
    """A digest of a table's files, their sizes and times: Spark lists them, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    n, seen = files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return f"{n}:{seen}"


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """The handle of the catalog's index, brought up to the table's state first."""
    source = f"{sf_dir}/documents.parquet"
    path = f"{shared_folder(spark)}/index-{hashlib.sha256(source.encode()).hexdigest()[:32]}"
    return index.refresh(spark, path, rule(), catalog(spark, sf_dir).select("id", "title", "body"), table_state(spark, source))


def postings(spark: SparkSession, handle: str) -> DataFrame:
    return index.postings(spark, handle)


def bm25(spark: SparkSession, path: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of the documents with any word of the query; the more negative, the better.

    The terms reach the scan as a filter; corpus statistics are two numbers and one row per term.
    """
    weights = weights or WEIGHTS
    words = sorted(set(query_words(text)))
    weight = F.coalesce(*[F.when(F.col("col") == c, w) for c, w in weights.items()], F.lit(0.0))
    hits = postings(spark, path).where(F.col("term").isin(words) if words else F.lit(False))
    tf = hits.groupBy("id", "len", "term").agg(F.sum(weight * F.col("tf")).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term")  # a row per query word
    stats = index.load(spark, path)
    raw = F.log((stats.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (stats.avg_len or 1.0)))
    return joined.groupBy("id").agg((-F.sum(part)).alias("score"))


def any_word(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Ids of the documents with any word of the query."""
    words = query_words(text)
    return postings(spark, path).where(F.col("term").isin(words) if words else F.lit(False)).select("id").distinct()


def prefix_and(spark: SparkSession, path: str, text: str, column: str = "body") -> DataFrame:
    """Ids of the documents in which every word of the query begins some token of ``column``."""
    words = sorted(set(query_words(text[:500], 20)))
    if not words:
        return postings(spark, path).where(F.lit(False)).select("id")
    begins = [F.col("term").startswith(w) for w in words]
    hits = postings(spark, path).where((F.col("col") == column) & reduce(lambda a, b: a | b, begins))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(b, 1 << k).otherwise(0) for k, b in enumerate(begins)])
    return hits.groupBy("id").agg(F.bit_or(mask).alias("m")).where(F.col("m") == (1 << len(words)) - 1).select("id")


def snippet(text: Column, word: str, most: int = 48) -> Column:
    """The text itself around the first token that is ``word``: at most ``most`` tokens from four before it, ellipses for what is left out."""
    # only letters count in a prefix of the text: the folded text has the text's length
    folded = F.translate(F.lower(text), _ACCENTED, _BARE)
    gaps = F.split(folded, TOKEN)  # what stands before, between and behind the tokens
    tokens = tokens_of(text)
    at = F.array_position(tokens, word)
    start = F.greatest(F.lit(1), at - 4).cast("int")
    end = F.least(F.size(tokens), start + most - 1).cast("int")
    width = lambda parts, n: F.length(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(0))), ""))
    begin = width(gaps, start) + width(tokens, start - 1)
    stop = width(gaps, end) + width(tokens, end)
    body = F.substr(text, begin + 1, stop - begin)
    return F.when(at > 0, F.concat(F.when(start > 1, "… ").otherwise(""), body, F.when(F.size(tokens) > end, " …").otherwise("")))


#: Fixed value: the characters of a substring search's snippet.
SNIPPET_CHARS = 500


def substring_and(docs: DataFrame, text: str, columns: list[str], chars: int = SNIPPET_CHARS) -> DataFrame:
    """All rows whose columns together hold every word of the query, with a snippet about the first word and the number of such rows."""
    words = re.findall(r"\w+", text.lower())[:20]
    hay = F.lower(F.concat_ws("\n", *columns))
    cond = F.lit(bool(words))
    for w in words:
        cond = cond & hay.contains(w)
    found = docs.where(cond)
    total = found.agg(F.count("*").alias("total"))  # one row
    start = F.greatest(F.lit(1), F.instr(F.lower(F.col(columns[-1])), words[0] if words else "") - 100)
    return found.withColumn("snippet", F.substring(F.col(columns[-1]), start, F.lit(chars))).join(F.broadcast(total))
