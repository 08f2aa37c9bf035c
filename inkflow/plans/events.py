"""Queries over events, conversations and the star schema; extensions are labelled ext_."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkflow.session import table


def thread_assembly(spark, sf_dir):
    """Each conversation's non-empty texts in turn order, as one digest."""
    c = table(spark, sf_dir, "conversations").where("coalesce(text, '') <> ''")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.md5(F.col("text").cast("binary")).alias("d"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda x: x["d"]), "\n").cast("binary")).alias("digest"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def post_author_enrich(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author"))
    return e.join(u, "user_id", "left").select("event_id", F.coalesce("author", F.lit("unknown")).alias("author"))


def engagement_score(spark, sf_dir):
    """Likes, reposts, replies and quotes of an author: clicks, views, purchases and signups."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg((n("click") + 2 * n("view") + n("purchase") + n("signup")).alias("score"), F.count("*").alias("n_events"))


def event_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("n_k"))


def failures_tail50(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def ingest_run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("date").cast("string").alias("day"))
    return e.agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "purchase").alias("extracted"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("total"))


def ext_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.grouping_id().cast("long").alias("gid"))
    return li


def ext_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def ext_topk_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "rk")


def ext_asof(spark, sf_dir):
    """Each error with the same user's last click before it, as one window over the union."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'click')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w)).where("event_type = 'error'").select("event_id", "last_click")


def ext_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("n_parts"))


def ext_set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    both, only = c.intersect(s).withColumn("op", F.lit("both")), c.exceptAll(s).withColumn("op", F.lit("only"))
    return both.unionByName(only)


def ext_join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n_with"))
    none = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_without"))
    return has.join(none, "c_mktsegment", "full_outer").select("c_mktsegment", F.coalesce("n_with", F.lit(0)).alias("n_with"), F.coalesce("n_without", F.lit(0)).alias("n_without"))


def ext_window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.dense_rank().over(w).alias("seq"), F.lag("o_orderkey").over(w).alias("before"))


def ext_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(disc), 2).alias("revenue"), F.count("*").alias("n"))


def ext_region_revenue(spark, sf_dir):
    li, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


CATALOGUE = {
    "thread_assembly": (thread_assembly, "SELECT conv_id, md5(string_agg(md5(text), chr(10) ORDER BY turn)) AS digest, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id"),
    "post_author_enrich": (post_author_enrich, "SELECT event_id, coalesce(c_name, 'unknown') AS author FROM events LEFT JOIN customer ON user_id = c_custkey"),
    "engagement_score": (engagement_score, "SELECT user_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS score, count(*) AS n_events FROM events GROUP BY user_id"),
    "event_props": (event_props, "SELECT event_type, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k FROM events GROUP BY event_type"),
    "failures_tail50": (failures_tail50, "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "ingest_run_stats": (ingest_run_stats, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS processed, count(*) FILTER (event_type = 'purchase') AS extracted, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "ext_rollup": (ext_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "ext_cube": (ext_cube, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "ext_topk_per_group": (ext_topk_per_group, "SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rk FROM customer QUALIFY rk <= 3"),
    "ext_asof": (ext_asof, "SELECT event_id, last_click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events WHERE event_type IN ('error', 'click')) WHERE event_type = 'error'"),
    "ext_approx_distinct": (ext_approx_distinct, None),
    "ext_set_ops": (ext_set_ops, "SELECT k, 'both' AS op FROM (SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'only' FROM (SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)"),
    "ext_join_semi_anti": (ext_join_semi_anti, "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_with, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_without FROM customer GROUP BY 1"),
    "ext_window_frames": (ext_window_frames, "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, CAST(dense_rank() OVER w AS INT) AS seq, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "ext_pricing_summary": (ext_pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "ext_region_revenue": (ext_region_revenue, "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
}
