"""Document steps that parse, fold or match, and the rest of the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.records import first_of
from scriptorium.functions.text import squeeze
from scriptorium.functions import text as T
from scriptorium.operators import blocks, paragraphs
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""WITH b AS (SELECT p_partkey, p_brand, p_size > 45 AS wide, p_size % 2 AS col, p_retailprice AS y, p_partkey AS x FROM part),
 z AS (SELECT *, 2 * sum(wide::INT) OVER (PARTITION BY p_brand ORDER BY y, x) - wide::INT AS zone FROM b)
 SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY zone, CASE WHEN wide THEN -1 ELSE col END, y, x) AS ordinal FROM z""")
def s9_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return blocks.reading_order(p, "p_brand", F.col("p_size") > 45, F.col("p_size") % 2, F.col("p_retailprice"), F.col("p_partkey")).select("p_partkey", "ordinal")


@query()
def s11_article_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.arrow import html_markdown

    return table(spark, sf_dir, "pages").select("page_id", html_markdown("html").alias("markdown"))


@query("SELECT l_orderkey, count(*) AS outputs, count(*) = 1 AS ok FROM lineitem GROUP BY l_orderkey")
def s20_manifest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("outputs")).withColumn("ok", F.col("outputs") == 1)


@query("SELECT w AS word, count(*) AS n, count(*) FILTER (contains(w, '-')) AS compounds FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+(-\\p{L}+)*')) AS w FROM documents) GROUP BY w HAVING count(*) >= 3")
def a10_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(-\p{L}+)*"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("word").contains("-")).alias("compounds")).where("n >= 3")


@query()
def w6_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _docs(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", F.posexplode(blocks.merge_continuations(F.col("l"))).alias("k", "block"))


@query("SELECT doc_id, replace(replace(replace(text, '%', ' percent'), '&', ' and '), '±', ' plus or minus ') AS text FROM documents")
def t21_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    for mark, word in (("%", " percent"), ("&", " and "), ("±", " plus or minus ")):
        c = F.replace(c, F.lit(mark), F.lit(word))
    return _docs(spark, sf_dir).select("doc_id", c.alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://creativecommons.org/licenses/by/4.0/' END AS licence FROM documents")
def t23_licence_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, "http://www.CreativeCommons.org/licenses/by/4.0").otherwise("https://example.org/terms")
    place = F.regexp_replace(F.regexp_replace(F.lower(raw), r"\Ahttps?://(www\.)?", ""), r"/*\z", "")
    known = F.create_map(*[F.lit(x) for u in ("licenses/by/4.0", "licenses/by-sa/4.0", "publicdomain/zero/1.0") for x in (f"creativecommons.org/{u}", f"https://creativecommons.org/{u}/")])
    return _docs(spark, sf_dir).select("doc_id", F.try_element_at(known, place).alias("licence"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'CC0' END AS rights FROM documents")
def t25_rights_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "\nLicense: CC0\nend").otherwise("\nLicence unknown"))
    return _docs(spark, sf_dir).select("doc_id", F.nullif(F.regexp_extract(note, r"(?im)^(?:license|rights): *(cc0|cc by 4\.0) *$", 1), F.lit("")).alias("rights"))


@query("SELECT page_id, CASE WHEN ends_with(u, '/') THEN u || 'p/' || page_id WHEN contains(url, '?') THEN u || '&p=' || page_id ELSE u || '/p/' || page_id END AS link FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def t28_page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.regexp_replace("url", r"#.*\z", ""), F.col("page_id").cast("string")
    link = F.when(u.endswith("/"), F.concat(u, F.lit("p/"), k)).when(F.col("url").contains("?"), F.concat(u, F.lit("&p="), k)).otherwise(F.concat(u, F.lit("/p/"), k))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"))


@query()
def t30_readable_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.arrow import byte_cap

    return _docs(spark, sf_dir).select("doc_id", byte_cap(F.concat_ws(" — ", F.lit("2025"), squeeze(F.col("text")), "source")).alias("name"))


@query()
def t6_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.arrow import normalize_abstract

    return table(spark, sf_dir, "pages").select("page_id", normalize_abstract("html").alias("abstract"))


@query()
def t1_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normal("text").alias("text"))


@query()
def c11_citation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.arrow import citation_tags

    tagged = F.concat(F.lit('<meta name="citation_author" content="A"><meta name="citation_author" content="B">'), "html")
    return table(spark, sf_dir, "pages").select("page_id", citation_tags(tagged).alias("tags")).select("page_id", F.to_json("tags").alias("tags"))


@query("SELECT doc_id, struct_pack(t := title, y := 2024)::VARCHAR IS NOT NULL AS parsed, 2024 AS year FROM (SELECT doc_id, source AS title FROM documents)")
def c12_csl(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"title":["'), "source", F.lit('"],"issued":{"date-parts":[[2024,3]]}}'))
    csl = F.from_json(raw, "title array<string>, issued struct<`date-parts`:array<array<int>>>")
    return _docs(spark, sf_dir).select("doc_id", csl.alias("c")).select("doc_id", F.get("c.title", F.lit(0)).isNotNull().alias("parsed"), F.get(F.get(F.col("c.issued.`date-parts`"), F.lit(0)), F.lit(0)).alias("year"))


@query()
def g1_fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title against the first document of its class (equal titles), and all pairs of classes, by their first documents."""
    from scriptorium.functions.arrow import plain_title
    from scriptorium.operators.titles import alike

    t = _docs(spark, sf_dir).select("doc_id", plain_title(squeeze(F.substring("text", 1, 80))).alias("plain")).where("plain <> ''")
    first = t.groupBy("plain").agg(F.min("doc_id").alias("id"))
    equal = t.join(first, "plain").where("doc_id <> id").select("doc_id", F.col("id").alias("with"), F.lit(1.0).alias("ratio"))
    return equal.unionByName(alike(first, 0.65)).withColumn("strict", F.col("ratio") >= 0.94)


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'manual' WHEN l.quality = 1 THEN 'cached' WHEN lang = 'en' THEN 'source' WHEN n_chars > 3000 THEN 'pdf' ELSE 'unavailable' END AS chosen FROM documents d LEFT JOIN labels l USING (doc_id)")
def g6_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    return j.select("doc_id", first_of([(good & (F.col("toxic") == 0), "manual"), (good, "cached"), (F.col("lang") == "en", "source"), (F.col("n_chars") > 3000, "pdf")], "unavailable").alias("chosen"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS abstract FROM conversations WHERE turn < 3 GROUP BY conv_id HAVING sum(len(string_split(text, ' '))) <= 1000")
def g16_bounded_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("turn < 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), F.sum(F.size(F.split("text", " "))).alias("n"))
    return rows.where("n <= 1000").select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("abstract"))


@query("SELECT doc_id, lang IN ('en', 'de') AND source <> 'src0' AS generated FROM documents")
def g17_generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.split(F.concat_ws("\n", F.concat(F.lit("Language: "), "lang"), F.concat(F.lit("Source: "), F.when(F.col("source") == "src0", "?").otherwise("named"))), "\n")
    known = F.array(*[F.lit(x) for x in ("Language: en", "Language: de", "Source: named")])
    return _docs(spark, sf_dir).select("doc_id", F.forall(rows, lambda x: F.array_contains(known, x)).alias("generated"))


@query("SELECT doc_id, sha256('{\"rights\":\"CC0\",\"sha\":\"' || sha256(text) || '\",\"url\":\"https://doi.org/10.1/' || doc_id || '\"}') AS evidence FROM documents")
def g18_licence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.lit("CC0").alias("rights"), F.sha2("text", 256).alias("sha"), F.concat(F.lit("https://doi.org/10.1/"), F.col("doc_id").cast("string")).alias("url"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.to_json(row), 256).alias("evidence"))


@query("SELECT d.doc_id, CASE WHEN n = 1 THEN b.source END AS source FROM documents d JOIN (SELECT sha256(text) AS h, count(*) AS n, min(source) AS source FROM documents GROUP BY 1) b ON b.h = sha256(d.text)")
def g19_single_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    b = d.groupBy("h").agg(F.count("*").alias("n"), F.min("source").alias("s"))
    return d.join(b, "h").select("doc_id", F.when(F.col("n") == 1, F.col("s")).alias("source"))


@query("SELECT url, count(*) = 1 AS verified FROM pages GROUP BY url")
def g20_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("url").agg((F.count("*") == 1).alias("verified"))


_NAMES = ", ".join(f"'{n}'" for n in T.SECTION_NAMES)
#: Lines with kind and island in SQL, for texts of one page (the given ones have no form feeds, so no edge runs).
LINES_SQL = rf"""l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 c AS (SELECT doc_id, line, trim(t) AS raw, regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ([,.;:!?)])', '\1', 'g'), '\( ', '(', 'g') AS clean FROM l),
 n AS (SELECT *, raw <> '' AND contains('{paragraphs.NOTE_SIGNS}', raw[1]) AS sign, regexp_matches(raw, '[.!?]$') AS closed FROM c),
 o AS (SELECT *, raw <> '' AND (sign OR coalesce(last_value(CASE WHEN sign AND NOT closed THEN true WHEN raw = '' OR closed THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS note FROM n),
 p AS (SELECT *, regexp_extract(clean, '^(\S+)\s+\S', 1) AS word, CASE WHEN raw = '' THEN 'blank' WHEN note THEN 'footnote' WHEN clean = '' THEN 'none' WHEN regexp_matches(lower(clean), '^(?:{"|".join(paragraphs.PUBLISHER)})(?:\W|$)') THEN 'publisher-or-contact-furniture' WHEN rtrim(lower(clean), ':') = 'significance' THEN 'heading' END AS sure FROM o),
 q AS (SELECT *, coalesce(sure, CASE WHEN regexp_matches(clean, '^#{{2,6}}\s') OR rtrim(lower(clean), ':') IN ({_NAMES}) OR regexp_full_match(word, '{T.NUMBER}') AND length(clean) <= {T.HEADING_CHARS} AND CAST(regexp_extract(word, '[0-9]+') AS HUGEINT) <= {T.HEADING_NUMBER} THEN 'maybe' ELSE 'text' END) AS likely FROM p),
 r AS (SELECT *, likely IN ('blank', 'publisher-or-contact-furniture', 'heading') OR sign AND likely = 'footnote' AS breaks FROM q),
 s AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY doc_id ORDER BY line) AS island, CASE WHEN likely <> 'maybe' THEN likely WHEN coalesce(last_value(CASE WHEN likely = 'text' THEN true WHEN breaks THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'text' ELSE 'heading' END AS kind FROM r)"""


@query(rf"""WITH {LINES_SQL},
 g AS (SELECT doc_id, min(line) AS line, kind, CASE WHEN kind = 'heading' THEN min(clean) ELSE trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(string_agg(raw, chr(10) ORDER BY line), '-' || chr(10), '-'), chr(10), ' '), '\s+', ' ', 'g'), ' ([,.;:!?)])', '\1', 'g'), '\( ', '(', 'g')) END AS b FROM s WHERE kind IN ('text', 'heading') GROUP BY doc_id, island, kind),
 h AS (SELECT *, regexp_extract(b, '^({T.NUMBER})\s+\S', 1) AS num, string_split(regexp_replace(regexp_replace(b, '^\S+\s+', ''), '([^\n]{{2}})\.\s+([A-ZÀ-ÖØ-Þ][^\n])', '\1' || chr(1) || '\2'), chr(1)) AS w FROM g WHERE b <> ''),
 i AS (SELECT doc_id, line, CASE WHEN num <> '' AND len(w) = 2 AND length(w[1]) <= {T.INLINE_CHARS} AND len(string_split(trim(w[1]), ' ')) <= {T.INLINE_WORDS} THEN [num[1:-2] || '. ' || w[1], w[2]] ELSE [b] END AS parts FROM h),
 j AS (SELECT doc_id, line, unnest(range(0, len(parts))) AS n, unnest(parts) AS block FROM i)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, n) - 1 AS k, block FROM j""")
def x1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs.classified(_docs(spark, sf_dir), "doc_id", "text")
    return paragraphs.blocks(lines).select(F.col("id").alias("doc_id"), "k", "block")


@query(f"WITH {LINES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS k, clean AS text, kind AS reason FROM s WHERE kind NOT IN ('text', 'heading', 'blank', 'none')")
def x1_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that x1_paragraphs leaves out, each with its reason."""
    lines = paragraphs.classified(_docs(spark, sf_dir), "doc_id", "text")
    return paragraphs.omissions(lines).select(F.col("id").alias("doc_id"), "k", "text", "reason")


@query("SELECT conv_id, count(*) AS blocks, count(*) FILTER (turn % 2 = 0) AS headings FROM (SELECT conv_id, turn FROM conversations) GROUP BY conv_id")
def x4_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("turn") % 2 == 0, "## ").otherwise(""), F.lit("t"), F.col("turn").cast("string"))
    md = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("---\na: 1\n---\n<!-- pdf-page: 1 -->\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n\n")).alias("m"))
    b = md.select("conv_id", F.explode(blocks.markdown_blocks(F.col("m"))).alias("b"))
    return b.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("b.type") == "heading").alias("headings"))


@query("SELECT event_type AS job, event_id, user_id AS worker FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def z2_first_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job")).agg(F.min(F.struct("ts", "event_id", "user_id")).alias("m"))
    return first.select("job", F.col("m.event_id").alias("event_id"), F.col("m.user_id").alias("worker"))


@query("SELECT event_id, CASE WHEN max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'cancel_requested' ELSE event_type END AS status FROM events")
def z3_sticky_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.max((F.col("event_type") == "error").cast("int")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.when(seen == 1, "cancel_requested").otherwise(F.col("event_type")).alias("status"))


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars = length(text)")
def z17_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return _docs(spark, sf_dir).where(F.length("text") == F.col("n_chars")).join(l, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 11 = 0 ORDER BY doc_id LIMIT 15")
def z25_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    mirror = d.withColumn("h", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("h")))
    return d.join(mirror, ["doc_id", "h"], "left_anti").orderBy("doc_id").limit(15).select("doc_id")


@query("SELECT event_id, 'f' || event_id || '.pdf' AS file FROM events WHERE event_type IN ('view', 'click')")
def s4_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs by content type or file name; broken entries are left out."""
    kind = F.when(F.col("event_type") == "view", "application/pdf").when(F.col("event_type") == "click", "application/octet-stream").otherwise("text/html")
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "").otherwise(F.when(F.col("event_type").isin("view", "click"), ".pdf").otherwise(".html")))
    items = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), name.alias("file"))
    return items.where((F.col("kind") == "application/pdf") | F.lower("file").endswith(".pdf")).select("event_id", "file")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') ORDER BY (length(text) - length(replace(lower(text), 'stupid', ''))) DESC, doc_id LIMIT 20")
def o1_hits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    score = F.length("text") - F.length(F.replace(low, F.lit("stupid"), F.lit("")))
    hits = _docs(spark, sf_dir).where(low.contains("stupid") | low.contains("idiot")).select("doc_id", score.alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id")


@query("SELECT DISTINCT source, 2 AS version, count(*) OVER (PARTITION BY source) AS rebuilt FROM documents WHERE source NOT IN ('src0', 'src1')")
def f10_index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions whose stored version is not the current one are rebuilt whole."""
    d = _docs(spark, sf_dir).select("source", F.when(F.col("source").isin("src0", "src1"), 2).otherwise(1).alias("stored"))
    return d.where("stored <> 2").groupBy("source").agg(F.lit(2).alias("version"), F.count("*").alias("rebuilt"))


@query("SELECT doc_id, regexp_replace(text || ' end.12 and 34', '([.!?])[0-9]{1,3}( |$)', '\\1\\2', 'g') AS text FROM documents")
def t32_superscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace(F.concat("text", F.lit(" end.12 and 34")), r"([.!?])[0-9]{1,3}( |\z)", "$1$2").alias("text"))


@query()
def t9_typesetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken compounds ('co- opera') are joined only where the joined form is commoner in the same document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:- ?[a-z]+)?"), 0)
    each = _docs(spark, sf_dir).select("doc_id", F.explode(words).alias("w"))
    counts = each.select("doc_id", F.regexp_replace("w", "- ?", "").alias("joined"), F.col("w").contains("-").cast("int").alias("broken"))
    return counts.groupBy("doc_id", "joined").agg(F.sum("broken").alias("broken"), F.sum(1 - F.col("broken")).alias("whole")).where("broken > 0 AND whole > broken")


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'crossref' END, CASE WHEN toxic = 1 THEN 'datacite' END, CASE WHEN lang = 'en' THEN 'arxiv' END) AS provider FROM documents d LEFT JOIN labels l USING (doc_id)")
def g15_provider_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "crossref"), F.when(F.col("toxic") == 1, "datacite"), F.when(F.col("lang") == "en", "arxiv")).alias("provider"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'supplied' WHEN page_id % 3 = 1 THEN 'csl' ELSE 'tags' END AS resolved FROM pages")
def g22_import_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    supplied, csl = F.when(k == 0, "10.1/a"), F.when(k <= 1, "10.1/a")
    rule = first_of([(supplied.isNotNull() & (supplied == csl), "supplied"), (csl.isNotNull(), "csl")], "tags")
    return table(spark, sf_dir, "pages").select("page_id", rule.alias("resolved"))


@query()
def x3_inferred_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a document itself heads as its abstract, if it has 40 to 600 words and ends as a sentence; else null."""
    docs = _docs(spark, sf_dir)
    found = paragraphs.headed_section(paragraphs.classified(docs, "doc_id", "text"), ("abstract", "summary"), ("keywords", "key words"))
    words = F.size(F.split("section", " "))
    return found.select(F.col("id").alias("doc_id"), F.when(words.between(40, 600) & F.col("section").rlike(r"[.!?]\z"), F.col("section")).alias("abstract"))
