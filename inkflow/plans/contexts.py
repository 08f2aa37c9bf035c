"""The wide context of chapters, over documents, pages, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.operators.context import Branch, wide_context
from inkflow.plans import fixtures as X
from inkflow.plans import sqltext as S
from inkflow.session import table

#: Items and characters of a memo's parts.
IDEAS, DRAFT_CHARS, AUTHOR_CHARS, POSTS, POST_CHARS, WEB_CHARS, TREND_CHARS = 25, 4000, 1500, 6, 1500, 4000, 2000
#: name: (table, key, ord, text, gap, items, chars); the texts are Spark's and DuckDB's.
BRANCHES = {
    "brief": ("orders", "CAST(o_orderkey % 11 AS INT)", "o_orderkey", "concat(o_orderpriority, ' ', o_orderstatus)", "\n", 1, None),
    "ideas": ("documents", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 13 AS INT) END", "doc_id", "text", "\n- ", IDEAS, None),
    "draft_notes": ("documents", "CAST(doc_id % 17 AS INT)", "doc_id", "text", "\n", None, DRAFT_CHARS),
    "author_notes": ("conversations", "CAST(conv_id % 11 AS INT)", "conv_id * 100 + turn", "text", "\n", None, AUTHOR_CHARS),
    "posts": ("events", "CAST(user_id % 11 AS INT)", "event_id", "concat(event_type, ' ', props)", "\n- ", POSTS, POST_CHARS),
    "web": ("pages", "CAST(page_id % 11 AS INT)", "page_id", "concat('URL: ', url, chr(10), html)", "\n\n", None, WEB_CHARS),
    "trends": ("events", "NULL", "event_id", "CASE WHEN value > 50 THEN CAST(user_id AS STRING) END", " ", None, TREND_CHARS),
}


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, order, text, *_ = BRANCHES[name]
    return table(spark, sf_dir, source).selectExpr(f"CAST({key} AS INT) AS key", f"{order} AS ord", f"{text} AS text")


def wide_contexts(spark, sf_dir):
    """Per silo the length and digest of each part of its memo."""
    keys = spark.createDataFrame(X.SILO_TITLES, "key int, title string")
    c = wide_context(keys, {n: Branch(_rows(spark, sf_dir, n), *b[4:]) for n, b in BRANCHES.items()})
    parts = [p for n in BRANCHES for p in (F.length(n).cast("long").alias(f"n_{n}"), F.md5(F.col(n).cast("binary")).alias(n))]
    return c.select(F.col("key").alias("silo"), "title", *parts)


def _part(name: str) -> str:
    source, key, order, text, gap, items, chars = BRANCHES[name]
    mine = f"""SELECT s.silo, string_agg(t, {S.quote(gap)} ORDER BY r) AS t FROM (
    SELECT s.silo, t, row_number() OVER (PARTITION BY s.silo ORDER BY k IS NULL, o, t) AS r FROM s JOIN (SELECT CAST({key} AS INT) AS k, {order} AS o, {text} AS t FROM {source}) ON k = s.silo OR k IS NULL WHERE t <> '') s
    {f"WHERE r <= {items}" if items else ""} GROUP BY s.silo"""
    return f"{name}_ AS (SELECT silo, {f'left(t, {chars})' if chars else 't'} AS t FROM ({mine}))"


CATALOGUE = {
    "wide_contexts": (
        wide_contexts,
        "WITH " + S.values("s", "silo, title", X.SILO_TITLES) + ", " + ", ".join(_part(n) for n in BRANCHES) + " SELECT s.silo, title, "
        + ", ".join(f"coalesce(length({n}_.t), 0) AS n_{n}, md5(coalesce({n}_.t, '')) AS {n}" for n in BRANCHES) + " FROM s " + " ".join(f"LEFT JOIN {n}_ ON s.silo = {n}_.silo" for n in BRANCHES),
    ),
}
