"""Scans and sinks of files, as Spark reads and writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T

#: Suffixes that a conversion takes, and the most bytes of an upload.
SUFFIXES = (".txt", ".pdf", ".docx", ".md")
MOST_BYTES = 50 * 1024 * 1024


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, bytes, accepted: files by suffix and size, without their content."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = spark.read.format("binaryFile").load(path).select("path", suffix.alias("suffix"), F.col("length").alias("bytes"))
    return rows.withColumn("accepted", F.col("suffix").isin(*SUFFIXES) & (F.col("bytes") <= MOST_BYTES))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one or more files; blank lines drop, and a line that is no record gives nulls."""
    rows = spark.read.text(path).where(T.strip(F.col("value")) != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def feed_entries(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """feed, entry, title, link: items of RSS files in their order, the link or else the id, without those of blank titles; at
    most so many of each feed, all for None or 0.  A feed is one file, and its entries are found inside its row."""
    inside = lambda item, tag: T.strip(F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1))
    items = F.regexp_extract_all("text", F.lit(r"(?s)(<item[\s>].*?</item>)"), F.lit(1))
    items = F.filter(items, lambda x: inside(x, "title") != "")
    rows = text_files(spark, path).select(F.col("path").alias("feed"), F.posexplode(F.slice(items, 1, most) if most else items).alias("entry", "item"))
    link = F.coalesce(F.nullif(inside(F.col("item"), "link"), F.lit("")), F.nullif(inside(F.col("item"), "guid"), F.lit("")))
    return rows.select("feed", "entry", inside(F.col("item"), "title").alias("title"), link.alias("link"))


def tail(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last n rows of an order, numbered from the last: a task keeps n rows."""
    last = [o.desc_nulls_last() for o in order]
    return rows.orderBy(*last).limit(n).withColumn("back", F.row_number().over(Window.orderBy(*last)))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_status(rows: DataFrame, path: str) -> None:
    """One status in place of the one before."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the values that a patch gives; nulls leave them as they are.  A patch has one row a key."""
    given = {c for c in patch.columns if c != key}
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in given])
    joined = rows.join(p, rows[key] == p["_key"], "left")
    return joined.select(*[F.coalesce(p[f"_{c}"], rows[c]).alias(c) if c in given else rows[c] for c in rows.columns])
