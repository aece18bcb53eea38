"""Document steps and incremental state as snapshot queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import arrow, text
from scriptorium.functions.records import first_of
from scriptorium.functions.text import digit_dense
from scriptorium.operators import changes, paragraphs, quotas, revisions
from scriptorium.operators.reserve import reserve
from scriptorium.plans.registry import query
from scriptorium.sources.tables import shared_folder, table
from scriptorium.streaming import queue as job_queue


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM documents) SELECT doc_id, count(*) FILTER (trim(line) <> '') AS included, count(*) FILTER (regexp_matches(line, '[%$#*&]{3}')) AS omitted FROM l GROUP BY doc_id")
def x2_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.trim("line") != "").alias("included"), F.count_if(F.col("line").rlike(r"[%$#*&]{3}")).alias("omitted"))


@query()
def x2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of a document with the first rule that omits it; rules on pages and titles need columns that documents lack."""
    entry = r"\A[0-9]+\.\s+[A-ZÀ-ÖØ-Þ]\.\s+"
    starts = text.heading_name("block").isin(*text.REFERENCE_NAMES) | F.col("block").rlike(entry)
    d = paragraphs.blocks(paragraphs.classified(_docs(spark, sf_dir), "doc_id", "text"))
    d = d.withColumn("first", F.min(F.when(starts, F.col("k"))).over(W.partitionBy("row"))).withColumnRenamed("id", "doc_id")
    reason = F.when(F.col("k") >= F.col("first"), "reference-section")
    #: How captions and notes begin.
    for form, name in ((r"(?i)\A(?:table|fig(?:ure)?)\s*[0-9]+[.:]", "table-or-figure-caption"), (r"(?i)\A(?:this (?:table|figure)|sample:|se in parentheses)", "table-or-figure-note")):
        reason = reason.when(F.col("block").rlike(form), name)
    reason = reason.when(digit_dense(F.col("block")), "probable-table-grid")
    return d.select("doc_id", "k", "block", reason.alias("omission_reason")).withColumn("included", F.col("omission_reason").isNull())


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, CASE WHEN turn = 0 THEN 700 WHEN role = 'user' THEN 500 ELSE 240 END AS pause FROM conversations")
def x5_speech_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("ordinal"), F.when(F.col("turn") == 0, 700).when(F.col("role") == "user", 500).otherwise(240).alias("pause"))


@query("SELECT conv_id, sum(w)::BIGINT AS words, sum(w) / 150.0::DOUBLE * 60 <= 600 AS bounded FROM (SELECT conv_id, len(string_split(text, ' ')) AS w FROM conversations WHERE role = 'user') GROUP BY conv_id")
def x6_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.sum(F.size(F.split("text", " "))).alias("words"))
    return w.withColumn("bounded", F.col("words") / 150.0 * 60 <= 600)


@query("SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text || '|v1')) AS reused FROM documents")
def x7_segment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.sha2(F.concat("text", F.lit("|v1")), 256).alias("key"))
    first = d.groupBy("key").agg(F.min("doc_id").alias("first"))
    return d.join(first, "key").select("doc_id", (F.col("doc_id") != F.col("first")).alias("reused"))


@query("SELECT event_type, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS claimed FROM events GROUP BY event_type")
def z1_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("event_type", F.col("m.event_id").alias("claimed"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'cancel_requested' ELSE o_orderstatus END AS status FROM orders")
def z4_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "O", "cancelled").when(s == "P", "cancel_requested").otherwise(s).alias("status"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(DISTINCT value) > 1 AS conflict FROM events GROUP BY ALL")
def z5_idempotent_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.min("value") != F.max("value")).alias("conflict"))


@query("SELECT DISTINCT sha256(event_type || '|' || user_id) AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)")
def z6_outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    done = e.where("event_type = 'signup' AND value > 100").select("user_id")
    return e.join(done, "user_id", "left_anti").select(F.sha2(F.concat("event_type", F.lit("|"), F.col("user_id").cast("string")), 256).alias("id")).distinct()


@query("SELECT user_id, arg_max(value, event_id) AS value, max(value) AS peak FROM events GROUP BY user_id")
def z7_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("value").alias("peak"))


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS tag, (quality = 1 AND lang <> 'good') IS TRUE AS changed FROM documents d LEFT JOIN labels l USING (doc_id)")
def z8_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    new = F.when(F.col("quality") == 1, "good")
    return j.select("doc_id", F.coalesce(new, "lang").alias("tag"), F.coalesce(new != F.col("lang"), F.lit(False)).alias("changed"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 f AS (SELECT source, k, doc_id, n <= 50000 AS accepted, CASE WHEN n <= 50000 THEN 50000 - n ELSE 50000 END AS room FROM o WHERE k = 1
 UNION ALL SELECT o.source, o.k, o.doc_id, n <= room, CASE WHEN n <= room THEN room - n ELSE room END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1) SELECT doc_id, accepted FROM f""")
def z9_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refused row leaves the budget to the ones after it."""
    return reserve(_docs(spark, sf_dir), "source", "doc_id", "n_chars", 50000).select("doc_id", "accepted")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'created' WHEN quality = 1 THEN 'saved' ELSE 'conflict' END AS result FROM documents d LEFT JOIN labels l USING (doc_id)")
def z10_optimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", first_of([(F.col("quality").isNull(), "created"), (F.col("quality") == 1, "saved")], "conflict").alias("result"))


@query("SELECT doc_id FROM documents WHERE sha256(text || lang) NOT IN (SELECT sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END) FROM documents) ORDER BY doc_id LIMIT 10")
def z11_fingerprint_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    now = d.select("doc_id", F.sha2(F.concat("text", "lang"), 256).alias("h"))
    old = d.select(F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))), 256).alias("h"))
    return now.join(old, "h", "left_anti").orderBy("doc_id").limit(10).select("doc_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS active FROM documents d LEFT JOIN labels l USING (doc_id)")
def z12_mark_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("hit"))
    return _docs(spark, sf_dir).select("doc_id").join(seen, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("active"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'edited' ELSE 'same' END AS state FROM documents")
def z13_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    now = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    return now.join(d.select("doc_id", F.sha2("text", 256).alias("was")), "doc_id").select("doc_id", F.when(F.col("now") != F.col("was"), "edited").otherwise("same").alias("state"))


@query("SELECT event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY 1")
def z14_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("event_type", F.col("m.value").alias("value"))


@query("SELECT user_id, max(ts) AS last_seen, epoch_us(TIMESTAMP '2024-01-30 23:59:00') - epoch_us(max(ts)) < 3600000000 AS online FROM events GROUP BY user_id")
def z15_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.withColumn("online", F.unix_micros(F.lit("2024-01-30 23:59:00").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) < 3_600_000_000)


@query("SELECT d.doc_id, sha256('label|' || d.doc_id) AS job FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def z16_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return missing.select("doc_id", F.sha2(F.concat(F.lit("label|"), F.col("doc_id").cast("string")), 256).alias("job"))


@query("SELECT user_id, max(ts) + INTERVAL 1 MINUTE AS next_allowed FROM events WHERE event_type = 'error' GROUP BY user_id")
def z18_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 1 MINUTE")).alias("next_allowed"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'absent' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 8 = 0 THEN text || '+' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id")
def z19_scan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("a"))
    new = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256).alias("b"))
    a, b = F.col("a"), F.col("b")
    return old.join(new, "doc_id", "full").select("doc_id", first_of([(a.isNull(), "added"), (b.isNull(), "absent"), (a != b, "changed")], "same").alias("state"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 0")
def z20_batch_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    complete = d.where("doc_id % 4 <> 0").withColumn("h", F.when(F.col("doc_id") % 9 == 0, "stale").otherwise(F.col("h")))
    return d.join(complete, ["doc_id", "h"], "left_anti").select("doc_id")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name ELSE p_name || ' [' || p_partkey || ']' END AS name FROM part")
def z21_collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    owner = p.groupBy("p_name").agg(F.min("p_partkey").alias("owner"))
    return p.join(owner, "p_name").select("p_partkey", F.when(F.col("owner") == F.col("p_partkey"), F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ["), F.col("p_partkey").cast("string"), F.lit("]"))).alias("name"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 50")
def z22_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    return _events(spark, sf_dir).where("event_type = 'purchase'").withColumn("k", F.row_number().over(w)).where("k <= 50").select("event_id")


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'DEBT' END, c_mktsegment) AS segment FROM customer")
def z23_settings_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") < 0, "DEBT"), "c_mktsegment").alias("segment"))


@query("SELECT 'snapshots/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path, count(*) AS copies FROM documents GROUP BY 1")
def z24_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    return _docs(spark, sf_dir).groupBy(F.concat(F.lit("snapshots/"), F.substring(h, 1, 2), F.lit("/"), h).alias("path")).agg(F.count("*").alias("copies"))


@query("SELECT event_id FROM events QUALIFY props IS DISTINCT FROM lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def z26_notification_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("props").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).withColumn("before", before).where(~F.col("props").eqNullSafe(F.col("before"))).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'none' WHEN o_totalprice > 200000 THEN 'outbox' ELSE 'icloud' END AS route FROM orders")
def z27_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", first_of([(F.col("o_orderpriority") == "5-LOW", "none"), (F.col("o_totalprice") > 200000, "outbox")], "icloud").alias("route"))


@query("SELECT event_id, CASE WHEN value > 100 THEN value - 100 ELSE value END AS wait FROM events")
def z28_quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.when(F.col("value") > 100, F.col("value") - 100).otherwise(F.col("value")).alias("wait"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'inbox', lang])), '|') AS tags FROM documents")
def z29_organise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_union(F.array("lang", "source"), F.array(F.lit("inbox"), F.col("lang")))), "|").alias("tags"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'prepared' ELSE 'preparing' END AS state FROM orders")
def z30_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", first_of([(s == "F", "completed"), (s == "P", "prepared")], "preparing").alias("state"))


@query("SELECT d.doc_id FROM documents d JOIN (SELECT DISTINCT sha256(text) AS h FROM benchmark) b ON sha256(d.text) = b.h WHERE n_chars <= 20000")
def z31_bound_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h"))
    return _docs(spark, sf_dir).where("n_chars <= 20000").withColumn("h", F.sha2("text", 256)).join(b, "h", "left_semi").select("doc_id")


@query()
def z2_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of leased job queues when all events are replayed as requests: a queue for every 20 users, four workers each."""
    e = _events(spark, sf_dir)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    n = F.pmod(F.xxhash64("event_id"), F.lit(12))
    kind = F.when(n <= 2, "submit").when(n <= 5, "claim").when(n <= 8, "update").when(n == 9, "cancel").when(n == 10, "retry").when(F.pmod(F.xxhash64(F.lit(1), "event_id"), F.lit(40)) == 0, "recover").otherwise("update")
    worker = F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(2), "event_id"), F.lit(4)).cast("string"))
    status = F.when(n == 6, "completed").when(n == 7, "failed").otherwise("running")
    requests = e.select(F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("queue"), F.col("event_id").alias("seq"), at.alias("at"), kind.alias("kind"), F.concat(F.lit("j"), F.floor(F.col("user_id") / 20).cast("string")).alias("job"), worker.alias("worker"), worker.alias("token"), status.alias("status"), F.lit(6 * 3_600_000).cast("long").alias("lease_ms"))
    return job_queue.answers(requests).select("queue", "seq", "kind", "answer", "job", "status", "worker")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def s5_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the newest event of every user, errors as deletions, kept up by a feed of thirds; a batch comes twice, one is late and one has nothing."""
    log = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    top = log.agg(F.max("event_id")).first()[0] or 0
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"

    def upto(version: int):
        def feed(since: int):
            part = log.where((F.col("event_id") > since) & (F.col("event_id") <= version))
            return changes.Batch(part.where("event_type <> 'error'"), part.where("event_type = 'error'"), version)

        return feed

    for feed in (upto(top // 3), upto(top // 3), upto(2 * top // 3), lambda _: None, upto(top // 2), upto(top)):
        changes.sync(spark, path, feed, "user_id", "event_id")
    return changes.rows(spark, path).select("user_id", "event_id", "event_type", "value")


@query("""WITH r AS (SELECT event_id, ts, user_id * 7 + event_id % 400 AS id, event_type AS content FROM events),
 f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS nth, first_value(content) OVER (PARTITION BY id ORDER BY ts, event_id) AS first FROM r),
 d AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM f WHERE nth = 1),
 w AS (SELECT day, least(count(*), 50) AS wanted FROM d GROUP BY day),
 m AS (SELECT day, greatest(0, least(wanted, 700 - coalesce(sum(wanted) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS room FROM w)
 SELECT f.event_id, CASE WHEN nth = 1 THEN CASE WHEN k <= room THEN 'admitted' WHEN room < 50 THEN 'total' ELSE 'daily' END WHEN content = first THEN 'again' ELSE 'conflict' END AS answer FROM f LEFT JOIN d USING (event_id) LEFT JOIN m USING (day)""")
def z22_coupled_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests under 50 a day and 700 in all; repeated ids are answered again, or conflict."""
    e = _events(spark, sf_dir).select("event_id", "ts", (F.col("user_id") * 7 + F.col("event_id") % 400).alias("id"), F.col("event_type").alias("content"))
    return quotas.admitted(e, "ts", "event_id", "id", "content", 50, 700).select("event_id", "answer")


@query("""WITH t AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events)
 SELECT event_id, i * 900000 + max(ms - i * 900000) OVER (PARTITION BY event_type ORDER BY i) AS start FROM t""")
def z18_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event may start if those of one type keep a quarter of an hour apart."""
    e = _events(spark, sf_dir).select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return quotas.paced(e, "event_type", "at", "event_id", 900_000).select("event_id", "start")


_SAVES = """r AS (SELECT event_id AS s, user_id AS p, 'r' || CASE WHEN event_id % 23 = 0 THEN event_id - 1 ELSE event_id END AS id, 'v' || event_id AS rev,
 lag('v' || event_id, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events)"""


@query(f"""WITH RECURSIVE {_SAVES}, f AS (SELECT *, min(s) OVER (PARTITION BY id) AS first FROM r), n AS (SELECT * FROM f WHERE s = first),
 c AS (SELECT p, min(s) AS s FROM n WHERE e IS NULL GROUP BY p UNION ALL SELECT n.p, min(n.s) FROM c JOIN n ON n.p = c.p AND n.e = 'v' || c.s AND n.s > c.s GROUP BY n.p)
 SELECT f.s AS event_id, CASE WHEN f.s <> first THEN 'reused' WHEN c.s IS NOT NULL THEN 'accepted' ELSE 'conflict' END AS answer FROM f LEFT JOIN c ON c.p = f.p AND c.s = f.s""")
def z10_replayed_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves of a user's file: most expect the newest revision, one in five the one before; one in 23 uses another's id."""
    k, user = F.col("event_id"), W.partitionBy("user_id").orderBy("event_id")
    rev = F.concat(F.lit("v"), k.cast("string"))
    e = _events(spark, sf_dir).select("event_id", "user_id", F.concat(F.lit("r"), F.when(k % 23 == 0, k - 1).otherwise(k).cast("string")).alias("id"), rev.alias("rev"), F.when(k % 5 == 0, F.lag(rev, 2).over(user)).otherwise(F.lag(rev, 1).over(user)).alias("e"))
    return revisions.replayed(e, "user_id", "event_id", "id", "e", "rev").select("event_id", "answer")
