"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


@query("SELECT count(*) AS n, sum((o_custkey IS NOT NULL)::BIGINT)::BIGINT AS keyed, sum((o_orderstatus IN ('O', 'P'))::BIGINT)::BIGINT AS live, max(o_orderdate) AS latest FROM orders")
def a1_boolean_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.sum(c.cast("long"))
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), flag(F.col("o_custkey").isNotNull()).alias("keyed"), flag(F.col("o_orderstatus").isin("O", "P")).alias("live"), F.max("o_orderdate").alias("latest"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a2_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS ready, count(*) FILTER (toxic = 1) AS warned, coalesce(max(doc_id)::VARCHAR, '') AS latest FROM labels")
def a3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("ready"), F.count_if(F.col("toxic") == 1).alias("warned"), F.coalesce(F.max("doc_id").cast("string"), F.lit("")).alias("latest"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")


@query("SELECT c.name, count(o_orderkey) AS n FROM (VALUES " + ", ".join(f"('{p}')" for p in _PRIORITIES) + ") c(name) LEFT JOIN orders ON o_orderpriority = c.name GROUP BY c.name")
def a4_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in _PRIORITIES])).alias("name"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT sum(n_chars)::BIGINT AS chars, count(*) AS texts FROM (SELECT n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) = 1)")
def a5_distinct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.max_by("n_chars", "doc_id").alias("n"))
    return one.agg(F.sum("n").alias("chars"), F.count("*").alias("texts"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def a6_dedupe_before_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY w")
def a7_bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM benchmark) WHERE length(w) > 2 GROUP BY ALL),
 d AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY ALL)
 SELECT item_id, round(sum(least(s.n, coalesce(d.n, 0)))::DOUBLE / greatest(1, sum(s.n)), 4) AS coverage FROM s LEFT JOIN d USING (w) GROUP BY item_id""")
def a8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0)).alias("w")
    s = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text"))).where(F.length("w") > 2).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").select(words(F.col("text"))).groupBy("w").agg(F.count("*").alias("m"))
    got = F.sum(F.least("n", F.coalesce("m", F.lit(0))))
    return s.join(d, "w", "left").groupBy("item_id").agg(F.round(got / F.greatest(F.lit(1), F.sum("n")), 4).alias("coverage"))


@query("""WITH l AS (SELECT source, doc_id, list_filter(string_split(text, '\n'), lambda x: trim(x) <> '') AS ls FROM documents),
 e AS (SELECT DISTINCT source, doc_id, regexp_replace(trim(unnest(ls[1:2] || ls[-2:])), '[0-9]', '#', 'g') AS line FROM l),
 p AS (SELECT source, greatest(3, ceil(0.02 * count(*)))::BIGINT AS need FROM documents GROUP BY source)
 SELECT source, line, count(*) AS pages FROM e JOIN p USING (source) WHERE length(line) BETWEEN 2 AND 160 GROUP BY source, line, need HAVING count(*) >= need""")
def a9_running_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    e = d.select("source", "doc_id", lines.alias("ls")).where(F.size("ls") > 0)
    edge = F.concat(F.slice("ls", 1, 2), F.slice(F.reverse("ls"), 1, 2))
    e = e.select("source", "doc_id", F.explode(edge).alias("line")).select("source", "doc_id", F.regexp_replace(F.trim("line"), "[0-9]", "#").alias("line")).distinct()
    need = d.groupBy("source").agg(F.greatest(F.lit(3), F.ceil(0.02 * F.count("*"))).alias("need"))
    return e.where(F.length("line").between(2, 160)).groupBy("source", "line").agg(F.count("*").alias("pages")).join(need, "source").where("pages >= need").drop("need")


@query("SELECT lang, coalesce(sum(n_chars), 0)::BIGINT AS chars, count(*) AS n FROM documents WHERE doc_id <> 7 GROUP BY lang HAVING sum(n_chars) <= 100000000000")
def a11_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").where("doc_id <> 7").groupBy("lang").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.count("*").alias("n"))
    return sums.where("chars <= 100000000000")


@query("SELECT event_type AS status, count(*) AS n, count(*) FILTER (value > 0) AS present FROM events GROUP BY 1")
def a12_retrieval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("present"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'retry_pending' WHEN bool_or(o_orderstatus = 'O') THEN 'pending' ELSE 'published' END AS status FROM orders GROUP BY o_custkey")
def a13_status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_ = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(any_("P"), "retry_pending").when(any_("O"), "pending").otherwise("published").alias("status"))


@query("SELECT o_orderkey, bool_and(l_discount <= 0.09) AS allowed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a14_all_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_discount") <= 0.09).alias("allowed"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def a15_daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) <= 2).alias("accepted"))


@query("SELECT count(*) AS added FROM (SELECT doc_id, sha256(text) FROM documents EXCEPT SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 5 <> 0)")
def a16_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.subtract(d.where("doc_id % 5 <> 0")).agg(F.count("*").alias("added"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')))::INT AS notes FROM documents")
def a17_distinct_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0))).alias("notes"))


_SEARCHED = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name", "c_mktsegment")}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, count(*) FILTER (contains({c}::VARCHAR, 'A')) AS hits FROM {t}" for t, cs in _SEARCHED.items() for c in cs) + ") WHERE hits > 0")
def a18_search_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cs in _SEARCHED.items():
        found = table(spark, sf_dir, t).agg(*[F.count_if(F.col(c).cast("string").contains("A")).alias(c) for c in cs])
        rows = found.select(F.lit(t).alias("tab"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("hits")) for c in cs])).alias("x")).select("tab", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out.where("hits > 0")
