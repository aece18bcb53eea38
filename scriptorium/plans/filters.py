"""Projections, predicates and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.sources.tables import CATALOG_SQL, catalog, table


@query(f"WITH {CATALOG_SQL} SELECT id, title, lang, CASE WHEN source = 'src0' THEN 'preferred' ELSE 'general' END AS reading_scope FROM cat")
def p1_public_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", "title", "lang", F.when(F.col("source") == "src0", "preferred").otherwise("general").alias("reading_scope"))


@query(f"WITH {CATALOG_SQL} SELECT id, title FROM cat WHERE title ILIKE '%th_n%'")
def p2_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).where(F.col("title").ilike("%th_n%")).select("id", "title")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www.')")
def p3_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://www.")).select("page_id", "url")


@query("SELECT event_id FROM events WHERE coalesce(props->>'$.scope', 'general') <> 'general' OR (props->>'$.k')::INT >= 50")
def p4_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.coalesce(F.get_json_object("props", "$.scope"), F.lit("general"))
    return table(spark, sf_dir, "events").where((scope != "general") | (F.get_json_object("props", "$.k").cast("int") >= 50)).select("event_id")


@query("SELECT event_id FROM events WHERE props IS NOT NULL AND coalesce((props->>'$.acknowledged')::INT, 0) = 0")
def p5_json_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("props").isNotNull() & (F.coalesce(F.get_json_object("props", "$.acknowledged").cast("int"), F.lit(0)) == 0)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p6_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).join(out, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src0' AND lang IN ('en', 'de')) OR n_chars >= 2025")
def p7_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = (F.col("source") == "src0") & F.col("lang").isin("en", "de")
    return table(spark, sf_dir, "documents").where(~scoped | (F.col("n_chars") >= 2025)).select("doc_id")


@query(f"WITH {CATALOG_SQL} SELECT id, title FROM cat ORDER BY lower(title), id LIMIT 100 OFFSET 200")
def p8_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(catalog(spark, sf_dir).select("id", "title").orderBy(F.lower("title"), "id"), 5000, 200, most=100)


def page(df: DataFrame, limit: float, offset: float, least: int = 1, most: int = 500, default: int = 50) -> DataFrame:
    """A clamped page: NaN gives the default, fractions are floored, offsets are not negative."""
    limit = default if limit != limit else int(limit // 1)
    return df.offset(max(0, int(offset // 1))).limit(min(max(limit, least), most))


@query(f"WITH {CATALOG_SQL}, hit AS (SELECT id, lower(title) AS t FROM cat) SELECT t, min(id) AS id FROM hit GROUP BY t HAVING count(*) = 1")
def p9_unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).groupBy(F.lower("title").alias("t")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(source || ', ' || lang, ','), lambda x: lower(trim(x))), 'fr')")
def p11_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.split(F.concat("source", F.lit(", "), "lang"), ",")
    return table(spark, sf_dir, "documents").where(F.exists(names, lambda c: F.lower(F.trim(c)) == "fr")).select("doc_id")
