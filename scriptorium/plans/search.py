"""Full-text search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import index
from scriptorium.operators import search as S
from scriptorium.plans.registry import query
from scriptorium.sources.tables import CATALOG_SQL, catalog, shared_folder, table

_Q = "stupid the reation"
_WORDS = ", ".join(f"'{w}'" for w in sorted(set(S.query_words(_Q))))


def _tok(c: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}]+')"


_BOTH = _tok("title || ' ' || body")


def _bm25_sql(title: float, body: float, tail: str) -> str:
    return f"""WITH {CATALOG_SQL}, a AS (SELECT id, {_tok('title')} AS t, {_tok('body')} AS b FROM cat),
 l AS (SELECT id, (len(t) + len(b))::DOUBLE AS len, t, b FROM a), s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
 h AS (SELECT id, len, unnest(t) AS term, {title}::DOUBLE AS w FROM l UNION ALL SELECT id, len, unnest(b), {body}::DOUBLE FROM l),
 f AS (SELECT id, len, term, sum(w) AS tf FROM h WHERE term IN ({_WORDS}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
 SELECT id, round(-sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score FROM f JOIN d USING (term), s GROUP BY id {tail}"""


@query(f"WITH {CATALOG_SQL} SELECT col, term, sum(tf)::BIGINT AS n, count(*) AS docs FROM (SELECT id, col, term, count(*) AS tf FROM (SELECT id, 'title' AS col, unnest({_tok('title')}) AS term FROM cat UNION ALL SELECT id, 'body', unnest({_tok('body')}) FROM cat) GROUP BY ALL) GROUP BY ALL")
def f1_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(spark, S.stored_index(spark, sf_dir)).groupBy("col", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {CATALOG_SQL} SELECT id FROM cat WHERE list_has_any({_BOTH}, ['stupid', 'worthless'])")
def f2_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.any_word(spark, S.stored_index(spark, sf_dir), "Stupid, worthless!")


@query(f"WITH {CATALOG_SQL} SELECT id FROM cat WHERE len(list_filter({_tok('body')}, lambda t: starts_with(t, 'ther'))) > 0 AND len(list_filter({_tok('body')}, lambda t: starts_with(t, 'stu'))) > 0")
def f3_prefix_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prefix_and(spark, S.stored_index(spark, sf_dir), "ther stu")


@query(_bm25_sql(5.0, 1.0, ""))
def f4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(spark, S.stored_index(spark, sf_dir), _Q).select("id", F.round("score", 6).alias("score"))


@query(rf"""WITH {CATALOG_SQL}, t AS (SELECT id, body, {_tok('body')} AS t, string_split_regex(strip_accents(lower(body)), '[\p{{L}}\p{{N}}]+') AS g FROM cat),
 p AS (SELECT *, greatest(1, list_position(t, 'stupid') - 4) AS s, least(len(t), greatest(1, list_position(t, 'stupid') - 4) + 47) AS e FROM t WHERE list_contains(t, 'stupid')),
 q AS (SELECT *, length(array_to_string(g[1:s], '')) + length(array_to_string(t[1:s - 1], '')) AS b, length(array_to_string(g[1:e], '')) + length(array_to_string(t[1:e], '')) AS z FROM p)
 SELECT id, CASE WHEN s > 1 THEN '… ' ELSE '' END || substr(body, b + 1, z - b) || CASE WHEN len(t) > e THEN ' …' ELSE '' END AS snippet FROM q""")
def f5_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that the index names; ids join before texts are cut, but their scan reads the column."""
    found = S.any_word(spark, S.stored_index(spark, sf_dir), "stupid")
    return catalog(spark, sf_dir).join(found, "id", "left_semi").select("id", S.snippet(F.col("body"), "stupid").alias("snippet")).where("snippet IS NOT NULL")


@query(_bm25_sql(1.0, 1.0, "ORDER BY score, id LIMIT 30"))
def f6_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.bm25(spark, S.stored_index(spark, sf_dir), _Q, weights={"title": 1.0, "body": 1.0}).select("id", F.round("score", 6).alias("score"))
    return found.orderBy("score", "id").limit(30)


@query("WITH h AS (SELECT page_id, html FROM pages WHERE contains(lower(url || '\n' || html), 'article') AND contains(lower(url || '\n' || html), 'spam')) SELECT page_id, substr(html, greatest(1, instr(lower(html), 'article') - 100), 500) AS snippet, (SELECT count(*) FROM h) AS total FROM h")
def f7_substring_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.substring_and(table(spark, sf_dir, "pages"), "article spam", ["url", "html"]).select("page_id", "snippet", "total")


@query("WITH h AS (SELECT doc_id, text FROM documents WHERE contains(lower(source || '\n' || text), 'idiot') AND contains(lower(source || '\n' || text), 'src')) SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'idiot') - 100), 500) AS snippet, (SELECT count(*) FROM h) AS total FROM h")
def f8_substring_and_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.substring_and(table(spark, sf_dir, "documents"), "idiot src", ["source", "text"]).select("doc_id", "snippet", "total")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'kept' END AS action FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def f9_index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").withColumn("hit", F.lit(True))
    action = F.when(F.col("hit").isNull(), "new").when(F.col("quality") == 0, "changed").otherwise("kept")
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", action.alias("action")).where("action <> 'kept'")


def _yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as it might have been: poor documents with another text, toxic ones not yet there, one since deleted for each good label."""
    cat = catalog(spark, sf_dir).select("id", "title", "body")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = cat.join(labels, "id", "left")
    old = known.where("toxic IS NULL OR toxic = 0").select("id", "title", F.when(F.col("quality") == 0, F.concat(F.lit("older text "), F.substring("body", 20, 10_000))).otherwise(F.col("body")).alias("body"))
    return old.unionByName(known.where("quality = 1 AND toxic = 0 AND id % 3 = 0").select((-1 - F.col("id")).alias("id"), "title", "body"))


@query(f"WITH {CATALOG_SQL} SELECT col, term, sum(tf)::BIGINT AS n, count(*) AS docs FROM (SELECT id, col, term, count(*) AS tf FROM (SELECT id, 'title' AS col, unnest({_tok('title')}) AS term FROM cat UNION ALL SELECT id, 'body', unnest({_tok('body')}) FROM cat) GROUP BY ALL) GROUP BY ALL")
def f9_index_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index that was built over yesterday's catalog and then brought up to today's by a delta with tombstones: those of an index built anew."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(spark, path, S.rule(), _yesterday(spark, sf_dir), "yesterday")
    handle = index.refresh(spark, path, S.rule(), catalog(spark, sf_dir).select("id", "title", "body"), "today")
    return S.postings(spark, handle).groupBy("col", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {CATALOG_SQL} SELECT id, len({_tok('title')}) + len({_tok('body')}) AS len, {S.VERSION} AS rule, count(*) OVER () AS n_docs FROM cat")
def f10_migrated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older rule for tokens is built anew, whole, when it is next asked for."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = catalog(spark, sf_dir).select("id", "title", "body")
    index.build(spark, path, S.rule(("title",), S.VERSION - 1), docs, "now")
    handle = index.refresh(spark, path, S.rule(), docs, "now")
    m = index.load(spark, handle)
    return index.documents(spark, handle).select("id", "len", F.lit(m.rule).alias("rule"), F.lit(m.n_docs).alias("n_docs"))
