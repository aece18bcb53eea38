"""Sources and sinks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import excerpt, formula_guard
from scriptorium.operators import tags
from scriptorium.plans.registry import query
from scriptorium.sources.tables import CATALOG_SQL, catalog, table


@query(f"WITH {CATALOG_SQL} SELECT id, title, lang, source FROM cat ORDER BY lower(title), id")
def s1_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", "title", "lang", "source").orderBy(F.lower("title"), "id")


@query(f"WITH {CATALOG_SQL} SELECT id, title, n_chars FROM cat WHERE id = 42")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).where("id = 42").select("id", "title", "n_chars")


@query("SELECT user_id, event_id AS version, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def s5_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value", "event_type")).alias("e"))
    return last.where("e.event_type <> 'error'").select("user_id", F.col("e.event_id").alias("version"), F.col("e.value").alias("value"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, min(source) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE source = first")
def s6_library_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("doi"))
    first = d.groupBy("doi").agg(F.min("source").alias("first"))
    return d.join(first, "doi").where("source = first").select("doc_id", "source")


@query(f"WITH {CATALOG_SQL} SELECT source, title, id FROM cat WHERE lang <> 'es' AND title <> '' QUALIFY row_number() OVER (PARTITION BY source, title ORDER BY id DESC) = 1")
def s7_discover_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).where("lang <> 'es' AND title <> ''").groupBy("source", "title").agg(F.max("id").alias("id"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def s10_landing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"))


@query()
def s10_landing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page says of itself, with the abstract that it shows; tested against the standard parser."""
    pages = table(spark, sf_dir, "pages")
    found = tags.evidence(pages, "page_id", "url", "html").join(tags.abstracts(pages, "page_id", "html"), "page_id", "left")
    meta = F.array_join(F.transform("meta", lambda m: F.concat(m["name"], F.lit("="), m["content"])), "\n")
    return found.select("page_id", "title", "base", meta.alias("meta"), F.array_join("pdfs", "\n").alias("pdfs"), F.size("links").alias("n_links"), F.size("data").alias("n_data"), "abstract")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gs') AS html FROM pages),
 h AS (SELECT page_id, url, unnest(l) AS href, unnest(range(len(l))) AS k FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l FROM p)),
 r AS (SELECT page_id, k, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS link FROM h)
 SELECT page_id, k, link, link IN (SELECT regexp_replace(url, '[?#].*', '') FROM pages) AS known FROM r WHERE link IS NOT NULL""")
def s10_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, and whether it leads to a page of the table, whose query and fragment do not count."""
    pages = table(spark, sf_dir, "pages")
    links = tags.links(pages, "page_id", "url", "html")
    known = pages.select(F.regexp_replace("url", "[?#].*", "").alias("link"), F.lit(True).alias("known")).distinct()
    return links.join(known, "link", "left").select("page_id", "k", "link", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT doc_id, sha256(text) AS revision, sha1(text) AS blob, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE octet_length(encode(text)) <= 20000")
def s12_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("revision"), F.sha1("text").alias("blob"), size.alias("bytes")).where("bytes <= 20000")


@query("SELECT k, event_id FROM (SELECT (props->>'$.k')::INT AS k, event_id FROM events) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id) = 1")
def s13_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")
    return e.where("k IS NOT NULL").groupBy("k").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@\\t\\r\\n-]') THEN '''' || text ELSE text END AS cell FROM documents")
def s14_csv_guard_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text whole behind the guard."""
    return table(spark, sf_dir, "documents").select("doc_id", formula_guard(F.col("text")).alias("cell"))


@query("SELECT conv_id, '---\n' || 'id: ' || conv_id || '\n---\n\n' || string_agg('## ' || role || '\n\n' || text, '\n\n' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def s15_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    blocks = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("t"))))
    body = F.array_join(F.transform(blocks, lambda b: b["t"]), "\n\n")
    return c.groupBy("conv_id").agg(body.alias("b")).select("conv_id", F.concat(F.lit("---\nid: "), "conv_id", F.lit("\n---\n\n"), "b").alias("markdown"))


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'labelled' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def s16_library_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return d.join(l, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("hit"), "labelled").otherwise("missing").alias("status"))


@query("SELECT conv_id, 'WEBVTT' || string_agg('\n\n' || (turn + 1) || '\n' || printf('%02d:%02d:%02d.000', ((10 * turn) // 3600)::INT, ((10 * turn) // 60 % 60)::INT, ((10 * turn) % 60)::INT) || '\n' || text, '' ORDER BY turn) AS vtt FROM conversations GROUP BY conv_id")
def s17_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("turn") * 10
    clock = F.format_string("%02d:%02d:%02d.000", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)
    cue = F.struct("turn", F.concat(F.lit("\n\n"), (F.col("turn") + 1).cast("string"), F.lit("\n"), clock, F.lit("\n"), "text").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cue)), lambda b: b["t"]), "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("WEBVTT"), joined).alias("vtt"))


@query("SELECT doc_id, substr(sha256(encode(sha256(text)) || '\\x00'::BLOB || encode(doc_id::VARCHAR)), 1, 24) AS entry FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def s18_outbox_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.substring(F.sha2(F.concat(F.encode(F.sha2("text", 256), "UTF-8"), F.lit(b"\x00"), F.encode(F.col("doc_id").cast("string"), "UTF-8")), 256), 1, 24)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", entry.alias("entry"))


@query("SELECT event_id, user_id, count(*) OVER () AS total FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 25 OFFSET 50")
def s19_feed_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = table(spark, sf_dir, "events").where("event_type = 'view'")
    total = unread.agg(F.count("*").alias("total"))
    page = unread.select("event_id", "user_id").orderBy(F.desc("event_id")).offset(50).limit(25)
    return page.withColumn("k", F.lit(1)).join(F.broadcast(total.withColumn("k", F.lit(1))), "k").drop("k")


@query("SELECT doc_id, CASE WHEN length(text) > 420 THEN regexp_replace(substr(text, 1, 417), '[ \\t\\n\\r]+[^ \\t\\n\\r]*$', '') || '…' ELSE text END AS excerpt FROM documents")
def s21_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


@query("SELECT DISTINCT c.doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE source = 'src1') c WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND c.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s22_publication_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    saved = d.where("lang = 'en'").select("doc_id").unionByName(d.where("source = 'src1'").select("doc_id"))
    return saved.join(l.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(l.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 AND l.toxic = 0 THEN 'reuse' ELSE 'refuse' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def s23_reuse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").withColumn("hit", F.lit(True))
    status = F.when(F.col("hit").isNull(), "new").when((F.col("quality") == 1) & (F.col("toxic") == 0), "reuse").otherwise("refuse")
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def s24_source_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("h")
