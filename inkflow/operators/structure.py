"""Line-oriented structure extraction: sections and paragraphs as window queries over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T

#: What begins a section, on a stripped lower-case line.
HEADER = r"^(chapter|letter|part|section)\s+(\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|[a-z])"
NUMBERED = r"^(\d+|[ivxlcdm]+)\.(\s+\S.{0,40})?$"
ANCHORED = r"^(chapter|letter|part|section|foreword|prologue|epilogue|introduction|conclusion)\s*(\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|[a-z])?:?\s*$"


def is_header(stripped: Column) -> Column:
    low = F.lower(stripped)
    return low.rlike(HEADER) | low.rlike(NUMBERED)


def is_anchored_header(stripped: Column) -> Column:
    low = F.lower(stripped)
    return low.rlike(ANCHORED) | (low.rlike(r"^(\d+|[ivxlcdm]+)\.?$") & (F.length(low) < 10))


def with_chapters(docs: DataFrame, every: int = 8) -> DataFrame:
    """doc_id, line_no, line: a manuscript per document, with a chapter line before every 8th line but the first."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when((i % every == 0) & (i > 0), F.array(F.concat(F.lit("Chapter "), (i / every).cast("int").cast("string")), x)).otherwise(F.array(x)),
    )
    return docs.where("text is not null").select("doc_id", F.posexplode(F.flatten(lines)).alias("line_no", "line"))


def paragraphs(lines: DataFrame, main_content: bool = False) -> DataFrame:
    """doc_id, section_no (0: before the first header), title, paragraph_no, text.  One exchange by document serves
    the windows and the grouping.  With main_content, a document none of whose headers has a paragraph is one section, 0,
    of that title, in which headers are text like any other."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    flagged = lines.withColumn("s", T.strip(c("line"))).withColumn("header", (c("s") != "") & is_header(c("s")))
    if main_content:
        flagged = flagged.withColumn("after", F.sum(c("header").cast("long")).over(so_far))
        flagged = flagged.withColumn("kept", F.max(~c("header") & (c("s") != "") & (c("after") > 0)).over(Window.partitionBy("doc_id"))).withColumn("header", c("header") & c("kept"))
    marked = flagged.withColumn("section_no", F.sum(c("header").cast("long")).over(so_far)).withColumn(
        "break_no", F.sum((c("header") | (c("s") == "")).cast("long")).over(so_far)
    ).withColumn("title", F.last(F.when(c("header"), c("s")), True).over(so_far))
    if main_content:
        marked = marked.withColumn("title", F.when(c("kept"), c("title")).otherwise("Main Content"))
    body = marked.where(~c("header") & (c("s") != ""))
    grouped = body.groupBy("doc_id", "section_no", "break_no").agg(
        F.max("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.rstrip(c("line")).alias("line")))), lambda x: x["line"]).alias("lines")
    )
    rank = Window.partitionBy("doc_id", "section_no").orderBy("break_no")
    return grouped.select("doc_id", "section_no", "title", F.row_number().over(rank).cast("long").alias("paragraph_no"), T.dehyphenate(c("lines")).alias("text"))


def sections(paras: DataFrame) -> DataFrame:
    """Sections that keep a paragraph, without the preamble, which has no title; number is the count of kept ones so far plus
    one for titles that begin with chapter."""
    kept = paras.where("title is not null").groupBy("doc_id", "section_no").agg(
        F.max("title").alias("title"), F.count("*").alias("n_paragraphs"), F.sum(T.word_count(F.col("text"))).alias("n_words")
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")).cast("long")
    return kept.withColumn("number", F.when(F.lower("title").startswith("chapter"), rank))


def text_sections(lines: DataFrame) -> DataFrame:
    """sections(), and one Main Content section over all lines for documents that keep none: one scan and one exchange."""
    return sections(paragraphs(lines, True)).select("doc_id", "section_no", "title", "number", "n_paragraphs", "n_words")


def first_flags(blocks: DataFrame) -> DataFrame:
    """Adds first_after_heading: the paragraph right after a heading or a chapter's start; quotes do not count."""
    w = Window.partitionBy("doc_id", "section_no").orderBy("block_no")
    seen = blocks.where("type <> 'quote'").withColumn("before", F.lag("type").over(w))
    flag = (F.col("type") == "paragraph") & F.coalesce(F.col("before") == "heading", F.lit(True))
    return seen.select("doc_id", "section_no", "block_no", flag.alias("first_after_heading"))


def strip_gaps(lines: DataFrame) -> DataFrame:
    """Drop lines from an evidence-gap marker to the next heading."""
    low = F.lower(T.strip(F.col("line")))
    mark = F.when(low.startswith("**evidence") | low.startswith("evidence gap"), 1).when(F.col("line").startswith("#"), 0)
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("mark", mark).withColumn("state", F.coalesce(F.last("mark", True).over(so_far), F.lit(0))).where("state = 0").select("doc_id", "line_no", "line")


def heading_pairs(lines: DataFrame, most: int = 50) -> DataFrame:
    """Non-overlapping pairs of a short line and one more than twice as long, white space at the ends apart: odd ranks of
    each run of candidates.  indented: the second begins with two blanks or tabs."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    n, after = F.length(T.strip(F.col("line"))), F.length(T.strip(F.col("next")))
    pairs = lines.withColumn("next", F.lead("line").over(order)).withColumn("hit", F.coalesce((n > 0) & (n < most) & (after > 2 * n), F.lit(False)))
    runs = pairs.withColumn("run", F.sum((~F.col("hit")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = runs.where("hit").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no")))
    return ranked.where("rank % 2 = 1").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "next", F.col("next").rlike("^[ \t]{2}").alias("indented"))


def indentation(lines: DataFrame) -> DataFrame:
    """doc_id, indented, eligible, ratio: lines that begin with two blanks or tabs, of these and of those lines of more than
    ten characters that begin with neither a digit nor a capital."""
    s = T.strip(F.col("line"))
    inside = F.col("line").rlike("^[ \t]{2}")
    other = ~inside & (F.length(s) > 10) & ~s.rlike(r"^[\p{Lu}\p{Nd}\x{b2}\x{b3}\x{b9}]")
    n_in, n = F.count_if(inside), F.count_if(inside | other)
    return lines.where(F.length(s) > 0).groupBy("doc_id").agg(n_in.alias("indented"), n.alias("eligible"), F.round(F.try_divide(n_in.cast("double"), n), 6).alias("ratio"))
