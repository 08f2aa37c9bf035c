"""Queries over what sinks wrote and scans read back: each writes its input into a new folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.plans import sqltext as S
from inkflow.session import table
from inkflow.sources import files
from inkflow.streaming.streams import shared

EVENT = "event_id long, user_id long, event_type string, value double"


def jsonl_append(spark, sf_dir):
    """Successes and failures appended to one log, read back as records."""
    path = shared(spark, "log")
    e = table(spark, sf_dir, "events").select(*[c.split()[0] for c in EVENT.split(", ")])
    for kind in ("purchase", "error"):
        files.append_json(e.where(F.col("event_type") == kind), path)
    spark.createDataFrame([("",), ("   ",)], "value string").coalesce(1).write.mode("append").text(path)
    return files.json_lines(spark, path, EVENT).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def jsonl_last(spark, sf_dir):
    """The last five records of a log."""
    path = shared(spark, "log")
    files.append_json(table(spark, sf_dir, "events").select(*[c.split()[0] for c in EVENT.split(", ")]), path)
    return files.tail(files.json_lines(spark, path, EVENT), 5, F.col("event_id")).select("event_id", "event_type", "back")


def status_overwrite(spark, sf_dir):
    """The last of three states of a run over pages: how many sources there are, how many have a page, how many are there twice."""
    path, pages = shared(spark, "status"), table(spark, sf_dir, "pages")
    for state, n in (("running", F.count("url")), ("cycle", F.count("html")), ("stopped", F.count("url") - F.count_distinct("url"))):
        files.overwrite_status(pages.agg(F.lit(state).alias("state"), n.alias("sources")), path)
    return files.json_lines(spark, path, "state string, sources long")


def text_scan(spark, sf_dir):
    """Documents written as files by source and read whole: the words of each source."""
    path = shared(spark, "texts")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", "text")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path)  # no source is one file
    rows = files.text_files(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", r"source=([^/]*)", 1).alias("source"), T.word_count(F.col("text")).alias("n_words")).groupBy("source").agg(F.sum("n_words").alias("n_words"))


def feed_scan(spark, sf_dir):
    """Feeds of twenty pages each: entries without a title drop, without a link their id stands for it, and a feed gives four."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).alias("feed"), "page_id")
    link = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<link>"), F.lit("http://x/"), F.col("page_id").cast("string"), F.lit("</link>")))
    title = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.lit("<![CDATA[Page "), F.col("page_id").cast("string"), F.lit("]]>")))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, F.lit("<guid isPermaLink='false'>id-"), F.col("page_id").cast("string"), F.lit("</guid></item>"))
    path = shared(spark, "feeds")
    rows = pages.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]), "\n").alias("value"))
    rows.repartition("feed").write.partitionBy("feed").text(path)
    got = files.feed_entries(spark, f"{path}/*/*.txt", 4)
    return got.select(F.regexp_extract("feed", r"feed=(\d+)", 1).cast("long").alias("feed"), "entry", "title", "link")


def patch_rows(spark, sf_dir):
    """Nations with new names for some and new regions for others."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("New "), "n_name")).alias("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(9)).cast("int").alias("n_regionkey"))
    return files.patched(n, p, "n_nationkey")


CATALOGUE = {
    "jsonl_append": (jsonl_append, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1"),
    "jsonl_last": (jsonl_last, "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY event_id DESC) AS INT) AS back FROM events QUALIFY back <= 5"),
    "status_overwrite": (status_overwrite, "SELECT 'stopped' AS state, count(url) - count(DISTINCT url) AS sources FROM pages"),
    "text_scan": (text_scan, f"SELECT source, CAST(sum({S.count('text')}) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL GROUP BY source"),
    "feed_scan": (feed_scan, "SELECT feed, entry, title, link FROM (SELECT page_id // 20 AS feed, CAST(row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS INT) AS entry, 'Page ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'id-' || page_id ELSE 'http://x/' || page_id END AS link FROM pages WHERE page_id % 4 <> 0) WHERE entry < 4"),
    "patch_rows": (patch_rows, "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'New ' || n_name ELSE n_name END AS n_name, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation"),
}
