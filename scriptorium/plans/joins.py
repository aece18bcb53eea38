"""Joins. Sides are left to Catalyst; only one-row scalars are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import boxes
from scriptorium.operators.nearest import nearest
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


@query("SELECT h.id, d.source, h.score FROM (SELECT doc_id AS id, quality + 2 * toxic AS score FROM labels) h JOIN documents d ON d.doc_id = h.id")
def j1_hits_to_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic")).alias("score"))
    return hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id").select("id", "source", "score")


@query("SELECT l_orderkey, l_linenumber, a.l_quantity, m.top FROM lineitem a JOIN (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL) m USING (l_orderkey, l_partkey) WHERE l_linenumber = 1")
def j2_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    top = li.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("top"))
    return li.where("l_linenumber = 1").join(top, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "top")


@query("SELECT d.doc_id, coalesce(CASE WHEN o.toxic = 1 THEN 'toxic' END, CASE r.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unknown') AS label FROM documents d LEFT JOIN labels r ON r.doc_id = d.doc_id LEFT JOIN labels o ON o.doc_id = d.doc_id AND o.toxic = 1")
def j3_results_and_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    override = l.where("toxic = 1").select("doc_id", F.lit("toxic").alias("o"))
    model = l.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("m"))
    return table(spark, sf_dir, "documents").select("doc_id").join(model, "doc_id", "left").join(override, "doc_id", "left").select("doc_id", F.coalesce("o", "m", F.lit("unknown")).alias("label"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS indexed FROM documents d LEFT JOIN labels l USING (doc_id)")
def j4_index_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("hit"))
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("indexed"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def j5_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.max_by("value", "event_id"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS roles FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def j6_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("v"))
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["v"]), ",").alias("roles"))


@query("WITH RECURSIVE up(leaf, id) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT leaf, (id - 1) // 2 FROM up WHERE id > 0) SELECT DISTINCT leaf, n_name AS ancestor FROM up JOIN nation ON n_nationkey = id")
def j7_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2)).alias("parent"))
    return ancestors(nation, "id", "parent").join(nation.select("id", F.col("n_name").alias("ancestor")), "id").select("leaf", "ancestor").distinct()


def ancestors(tree: DataFrame, key: str, parent: str) -> DataFrame:
    """(leaf, ``key``) for each node and all above it. Cycles end at the first node seen before."""
    view = f"tree_{abs(hash((key, parent, id(tree))))}"
    tree.select(F.col(key).cast("long").alias("k"), F.col(parent).cast("long").alias("p")).createOrReplaceTempView(view)
    return tree.sparkSession.sql(f"""
        WITH RECURSIVE up(leaf, k, seen) MAX RECURSION LEVEL 100 AS (
          SELECT k, k, array(k) FROM {view}
          UNION ALL SELECT u.leaf, t.p, array_append(u.seen, t.p) FROM up u JOIN {view} t ON t.k = u.k WHERE t.p IS NOT NULL AND NOT array_contains(u.seen, t.p))
        SELECT leaf, k AS {key} FROM up""")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j8_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O')")
def j9_no_live_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(live, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j10_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'completed' ELSE 'pending' END AS status FROM documents")
def j11_conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("completed").alias("s"))
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit("pending")).alias("status"))


@query("SELECT a.doc_id, min(b.doc_id) AS twin FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id > b.doc_id AND a.lang = b.lang GROUP BY a.doc_id")
def j12_same_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h", "lang").agg(F.min("doc_id").alias("twin"))  # no pairs: only the first of each group can be the answer
    return d.join(first, ["h", "lang"]).where("doc_id > twin").select("doc_id", "twin")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source, lang")
def j13_first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return new.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT a.conv_id, a.turn, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role <> a.role) AS paired FROM conversations a")
def j14_paired_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kinds = c.groupBy("conv_id").agg(F.min("role").alias("a"), F.max("role").alias("b"))
    return c.join(kinds, "conv_id").select("conv_id", "turn", (F.col("a") != F.col("b")).alias("paired"))


@query("SELECT c_custkey, n_name, s_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def j15_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("s_name"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").join(s, "c_nationkey", "left").select("c_custkey", "n_name", "s_name")


@query("SELECT s_suppkey, arg_min(c_custkey, struct_pack(d := abs(c_acctbal - s_acctbal), k := c_custkey)) AS nearest FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey")
def j16_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("group"), F.col("s_acctbal").alias("at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_acctbal").alias("at"), F.col("c_custkey").alias("id"))
    return s.join(nearest(s, c, 100.0), ["group", "at"]).select("s_suppkey", "nearest")


_BOXES = [(1, 0.0, 20.0), (2, 10.0, 60.0), (3, 50.0, 200.0)]


@query("SELECT event_id, min(box) AS box FROM events JOIN (VALUES " + ", ".join(str(b) for b in _BOXES) + ") b(box, lo, hi) ON value BETWEEN lo AND hi GROUP BY event_id")
def j17_first_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.lit(None).cast("int")
    for number, low, high in reversed(_BOXES):  # a fixed list of ranges is an expression, not a join
        box = F.when(F.col("value").between(low, high), number).otherwise(box)
    return table(spark, sf_dir, "events").select("event_id", box.alias("box")).where("box IS NOT NULL")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS page, l_quantity + l_tax AS x, l_extendedprice / 1000 AS y FROM lineitem),
 b AS (SELECT p_partkey AS ord, p_size % 4 AS page, p_size * 1.0 AS x0, p_retailprice / 100 AS y0, p_size + p_partkey % 13 * (CASE WHEN p_partkey % 97 = 0 THEN 9 ELSE 0.4 END) AS x1, p_retailprice / 100 + p_partkey % 7 AS y1 FROM part)
 SELECT l_orderkey, l_linenumber, (SELECT min(ord) FROM b WHERE b.page = p.page AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1)) AS box FROM p""")
def j17_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a point, every part as a box, a few of them wide: the first box that holds the point."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("page"), (F.col("l_quantity") + F.col("l_tax")).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    k = F.col("p_partkey")
    wide = F.when(k % 97 == 0, 9.0).otherwise(0.4)
    b = table(spark, sf_dir, "part").select(k.alias("ord"), (F.col("p_size") % 4).alias("page"), F.col("p_size").cast("double").alias("x0"), (F.col("p_retailprice") / 100).alias("y0"), (F.col("p_size") + k % 13 * wide).alias("x1"), (F.col("p_retailprice") / 100 + k % 7).alias("y1"))
    return boxes.first_box(p, b, "page", "x", "y", "ord").select("l_orderkey", "l_linenumber", "box")


@query("SELECT w.name, r.r_regionkey, r.r_regionkey IS NULL AS missing FROM (VALUES ('ASIA'), ('ATLANTIS')) w(name) LEFT JOIN region r ON r.r_name = w.name")
def j18_fixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(F.lit("ASIA"), F.lit("ATLANTIS"))).alias("name"))
    return wanted.join(table(spark, sf_dir, "region").withColumnRenamed("r_name", "name"), "name", "left").select("name", "r_regionkey", F.col("r_regionkey").isNull().alias("missing"))


@query("SELECT d.doc_id, coalesce(b.item_id::VARCHAR, d.source) AS title FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1) b ON b.h = sha256(d.text)")
def j19_cached_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("item_id").alias("item_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(b, "h", "left").select("doc_id", F.coalesce(F.col("item_id").cast("string"), "source").alias("title"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.v, b.v) AS v FROM (SELECT doc_id, lang AS v FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id, source AS v FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
def j20_merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = d.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("a")), d.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("a", "b").alias("v"))
