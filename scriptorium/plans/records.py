"""Identity, collections, JSON, matching, precedence and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import records as R
from scriptorium.functions import text as T
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'id-' || doc_id END, CASE WHEN doc_id % 3 = 1 THEN 'doi:10.1234/x' || doc_id END, 'sha256:' || sha256(text)) AS key FROM documents")
def c1_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    raw = F.when(k == 1, F.concat(F.lit("https://doi.org/10.1234/X"), n))
    return _docs(spark, sf_dir).select("doc_id", R.identity(F.when(k == 0, F.concat(F.lit("id-"), n)), R.doi(raw), F.col("text")).alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '10.5555/abc.' || doc_id END AS doi FROM documents")
def c2_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    raw = F.concat(F.when(k == 0, "DOI: 10.5555/ABC.").when(k == 1, "http://dx.doi.org/10.5555/abc.").when(k == 2, " 10.5555/Abc.").otherwise("11.5555/abc."), n)
    return _docs(spark, sf_dir).select("doc_id", R.doi(raw).alias("doi"))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^http://', 'https://') AS u FROM pages),
 q AS (SELECT page_id, split_part(u, '?', 1) AS base, list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)='))) AS kept FROM b)
 SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS url FROM q""")
def c3_normal_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.normal_url(F.col("url")).alias("url"))


@query("SELECT page_id, regexp_matches(url, '^https://[a-z.-]+([/?#]|$)') AS public FROM pages")
def c4_public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.public_url(F.col("url")).alias("public"))


@query("SELECT item_id, array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') AS text FROM benchmark")
def c5_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("pos").alias("at"))
    back = index.select("item_id", F.explode("at").alias("pos"), "word").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), F.countDistinct("pos").alias("n"))
    whole = (F.size("w") == F.col("n")) & (F.element_at("w", -1)["pos"] + 1 == F.col("n"))
    return back.where(whole).select("item_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


@query("SELECT d.doc_id, coalesce(nullif(CASE WHEN quality = 0 THEN '' ELSE 'q' || quality END, ''), lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def c6_metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    new = F.when(F.col("quality") == 0, "").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string")))
    return j.select("doc_id", F.coalesce(F.nullif(new, F.lit("")), "lang").alias("tag"))


@query("SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"source\":\"' || source || '\"}') AS digest FROM documents")
def c7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", R.compact_digest([("source", F.col("source")), ("n", F.col("n_chars")), ("lang", F.col("lang"))]).alias("digest"))


@query("SELECT doc_id, sha256(text) AS content, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob FROM documents")
def c8_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content"), T.blob_id(F.col("text")).alias("blob"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lang || ', ' || source || ',,' || lang, ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM documents")
def c9_array_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.concat("lang", F.lit(", "), "source", F.lit(",,"), "lang"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_distinct(parts)), "|").alias("tags"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src4', 'src9')")
def c10_json_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.from_json(F.lit('["src1","src4","src9"]'), "array<string>")).alias("source"))
    return _docs(spark, sf_dir).join(wanted, "source", "left_semi").select("doc_id")


@query("WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS w FROM documents) SELECT doc_id, round(len(list_intersect(w, ['the', 'ing', 'with', 'that', 'and']))::DOUBLE / 5, 4) AS overlap FROM d")
def g2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.array(*[F.lit(w) for w in ("the", "ing", "with", "that", "and")])
    own = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0)
    return _docs(spark, sf_dir).select("doc_id", F.round(F.size(F.array_intersect(own, title)) / 5, 4).alias("overlap"))


@query("SELECT sha256(text) AS identity, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def g3_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("identity")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_CHAIN = "SELECT d.doc_id, coalesce('label:' || quality, CASE WHEN lang = 'en' THEN 'lang' END, CASE WHEN n_chars < 500 THEN 'short' END, 'not_found') AS provider FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(_CHAIN)
def g4_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = F.coalesce(F.concat(F.lit("label:"), F.col("quality").cast("string")), F.when(F.col("lang") == "en", "lang"), F.when(F.col("n_chars") < 500, "short"), F.lit("not_found"))
    return j.select("doc_id", first.alias("provider"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'catalog' WHEN n_chars <= 2000 THEN 'cache' ELSE 'excerpt' END AS coverage, substr(text, 1, CASE WHEN l.doc_id IS NOT NULL OR n_chars <= 2000 THEN 8000 ELSE 700 END) AS abstract FROM documents d LEFT JOIN labels l USING (doc_id)")
def g5_abstract_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    coverage = R.first_of([(F.col("hit").isNotNull(), "catalog"), (F.col("n_chars") <= 2000, "cache")], "excerpt")
    size = F.when(coverage == "excerpt", 700).otherwise(8000)
    return j.select("doc_id", coverage.alias("coverage"), F.substr(F.col("text"), F.lit(1), size).alias("abstract"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN toxic = 1 AND quality = 0 THEN 'conflict' WHEN toxic = 1 THEN 'denied' WHEN quality = 0 THEN 'denied' ELSE 'allowed' END AS licence FROM documents d LEFT JOIN labels l USING (doc_id)")
def g7_licence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t, q = F.col("toxic") == 1, F.col("quality") == 0
    return j.select("doc_id", R.first_of([(F.col("toxic").isNull(), "unresolved"), (t & q, "conflict"), (t, "denied"), (q, "denied")], "allowed").alias("licence"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN regexp_matches(text, '[%$#*&]{3}') THEN 'symbols' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents")
def g8_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    codes = R.findings([(t.contains("!!"), "shouting"), (t.contains(" | "), "table"), (t.rlike(r"[%$#*&]{3}"), "symbols"), (F.col("n_chars") < 200, "short")])
    return _docs(spark, sf_dir).select("doc_id", F.array_join(codes, ",").alias("codes"))


@query("WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, n < 40 AS short, n > 1000 AS long, ends_with(text, '…') AS truncated FROM w")
def g9_abstract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""))
    return _docs(spark, sf_dir).select("doc_id", (n < 40).alias("short"), (n > 1000).alias("long"), F.col("text").endswith("…").alias("truncated"))


@query("SELECT d.doc_id, (n_chars < 100 OR n_chars > 8000 OR quality IS NULL OR quality < 0.65) AS review FROM documents d LEFT JOIN labels l USING (doc_id)")
def g10_needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", ((F.col("n_chars") < 100) | (F.col("n_chars") > 8000) | F.col("quality").isNull() | (F.col("quality") < 0.65)).alias("review"))


@query("SELECT count(*) AS mismatches FROM documents WHERE length(text) <> n_chars")
def g11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count_if(F.length("text") != F.col("n_chars")).alias("mismatches"))


@query("SELECT count(*) AS urls, bool_and(length(url) < 500 AND starts_with(url, 'http')) AS healthy FROM (SELECT DISTINCT url FROM pages)")
def g12_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    return urls.agg(F.count("*").alias("urls"), F.bool_and((F.length("url") < 500) & F.col("url").startswith("http")).alias("healthy"))


@query("SELECT doc_id, lang, source FROM documents EXCEPT ALL SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE source END FROM documents")
def g13_identity_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    return d.exceptAll(d.withColumn("source", F.when(F.col("doc_id") % 10 == 0, "moved").otherwise(F.col("source"))))


@query("SELECT o_orderkey, abs(coalesce(t, 0) - o_totalprice) <= 0.25 AS ok FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def g21_timing_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("t"))
    return table(spark, sf_dir, "orders").join(t, "o_orderkey", "left").select("o_orderkey", (F.abs(F.coalesce("t", F.lit(0.0)) - F.col("o_totalprice")) <= 0.25).alias("ok"))
