"""Detected blocks as chapters, page text as sections, end notes, contents and metadata of books, and small functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.plans import sqltext as S
from inkflow.plans.derived import derived, derived_sql
from inkflow.session import table

BLOCK_COLUMNS = "doc int, ord int, type string, level int, text string, style string, attribution string, caption string, number string"
#: Blocks as a detector gives them: matter, chapters, a heading that stands for one, lost blocks, empty chapters, notes.
BLOCKS = [
    (1, 1, "front_matter", None, "Dedication", None, None, None, None), (1, 2, "paragraph", None, "lost before the chapter", None, None, None, None), (1, 3, "chapter", None, " Chapter One ", None, None, None, None),
    (1, 4, "paragraph", None, "First.", None, None, None, None), (1, 5, "quote", None, "Said so.", None, "Someone", None, None), (1, 6, "footnote", None, "A note", None, None, None, "[12]"),
    (1, 7, "chapter", None, "Empty", None, None, None, None), (1, 8, "footnote", None, "lost note", None, None, None, "3"), (1, 9, "chapter", None, "Chapter Two", None, None, None, None), (1, 10, "heading", 1, "Inside", None, None, None, None),
    (1, 11, "image", None, "A cat", None, None, "Its name", None), (1, 12, "paragraph", None, "Quoted", "blockquote", None, None, None), (1, 13, "footnote", None, "No number", None, None, None, "x"), (1, 14, "back_matter", None, "Thanks", None, None, None, None),
    (2, 1, "heading", None, "Stands for a chapter", None, None, None, None), (2, 2, "odd", None, "Unknown kinds are paragraphs", None, None, None, None), (2, 3, "heading", 2, "Sub", None, None, None, None), (2, 4, "paragraph", None, "  ", None, None, None, None),
    (3, 1, "paragraph", None, "No chapter", None, None, None, None), (3, 2, "heading", 2, "Nor here", None, None, None, None), (3, 3, "footnote", None, "lost", None, None, None, "1"),
    (4, 1, "paragraph", None, "lost", None, None, None, None), (4, 2, "chapter", None, "Nothing in it", None, None, None, None),
]


def block_mapping(blocks: DataFrame) -> DataFrame:
    """doc, ord, part (front, chapter, note or back), chapter_no, title, kind, text, style: a chapter starts at each chapter block
    and at a heading of the first level before any of them.  Blocks before the first chapter and notes outside of chapters
    drop, chapters without blocks drop, and a document without chapters is one, Main Content."""
    order = Window.partitionBy("doc").orderBy("ord")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    b = blocks.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("level", F.coalesce("level", F.lit(1)))
    chapter = (c("type") == "chapter") | (c("type") == "heading") & (c("level") == 1)
    b = b.withColumn("start", (c("type") == "chapter") | chapter & (F.coalesce(F.max(chapter).over(before), F.lit(False)) == F.lit(False)))
    b = b.withColumn("run", F.sum(c("start").cast("int")).over(so_far)).withColumn("title", F.last(F.when(c("start"), c("text")), True).over(so_far))
    b = b.withColumn("matter", c("type").isin("front_matter", "back_matter")).withColumn("content", ~c("matter") & ~c("start") & (c("type") != "footnote"))
    run = Window.partitionBy("doc", "run")
    b = b.withColumn("any", F.max("start").over(Window.partitionBy("doc"))).withColumn("kept", F.max("content").over(run) & ((c("run") > 0) | ~c("any")))
    first = F.row_number().over(Window.partitionBy("doc", "run").orderBy("ord")) == 1
    b = b.withColumn("new", (first & c("kept")).cast("int")).withColumn("chapter_no", F.sum("new").over(so_far))
    part = F.when(c("type") == "front_matter", "front").when(c("type") == "back_matter", "back").when(c("type") == "footnote", "note").otherwise("chapter")
    kind = F.when(c("type").isin("heading", "quote", "footnote", "image"), c("type")).otherwise("paragraph")
    text = F.when((c("type") == "image") & (F.coalesce("caption", F.lit("")) != ""), F.concat("text", F.lit("\n"), "caption")).otherwise(c("text"))
    style = F.when(c("type") == "quote", F.coalesce("attribution", F.lit(""))).when(c("type") == "footnote", F.coalesce(F.nullif(F.regexp_extract("number", r"\d+", 0), F.lit("")), F.lit("1"))).when(
        c("type") == "heading", c("level").cast("string")).when(c("type") == "image", "image").otherwise(F.coalesce("style", F.lit("normal")))
    out = b.where(c("matter") | c("kept") & (c("content") | (c("type") == "footnote") & (c("run") > 0)))
    inside = ~c("matter")
    return out.select(
        "doc", "ord", part.alias("part"), F.when(inside, c("chapter_no")).alias("chapter_no"), F.when(inside, F.when(c("run") > 0, c("title")).otherwise("Main Content")).alias("title"),
        kind.alias("kind"), text.alias("text"), style.alias("style"),
    )


def _blocks(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "blocks")


def endnotes(spark, sf_dir):
    """Notes in the order of chapters and of their places in them, numbered as they say."""
    notes = block_mapping(_blocks(spark, sf_dir)).where("part = 'note'")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("chapter_no", "ord"))
    return notes.select("doc", place.alias("place"), F.col("style").cast("int").alias("number"), "text")


def contents(spark, sf_dir):
    """A line for each chapter, with its number where its title says it is one."""
    rows = block_mapping(_blocks(spark, sf_dir)).where("part = 'chapter'").groupBy("doc", "chapter_no").agg(F.max("title").alias("title"), F.count("*").alias("n_blocks"))
    return rows.select("doc", "chapter_no", "title", "n_blocks", F.concat(F.lit("chapter_"), F.lpad(F.col("chapter_no").cast("string"), 3, "0"), F.lit(".xhtml")).alias("href"))


_FROM_BLOCKS = f"""
b0 AS (SELECT doc, ord, type, coalesce(level, 1) AS level, {S.strip("coalesce(text, '')")} AS text, style, attribution, caption, number FROM blocks),
b1 AS (SELECT *, type = 'chapter' OR type = 'heading' AND level = 1 AS head FROM b0 WHERE text <> ''),
b2 AS (SELECT *, type = 'chapter' OR head AND NOT coalesce(bool_or(head) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS start FROM b1),
b3 AS (SELECT *, sum(CAST(start AS INT)) OVER w AS run, last_value(CASE WHEN start THEN text END IGNORE NULLS) OVER w AS title, type IN ('front_matter', 'back_matter') AS matter FROM b2 WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)),
b4 AS (SELECT *, NOT matter AND NOT start AND type <> 'footnote' AS content, bool_or(start) OVER (PARTITION BY doc) AS chaptered FROM b3),
b5 AS (SELECT *, bool_or(content) OVER (PARTITION BY doc, run) AND (run > 0 OR NOT chaptered) AS kept FROM b4),
runs AS (SELECT doc, run, row_number() OVER (PARTITION BY doc ORDER BY run) AS no FROM (SELECT DISTINCT doc, run FROM b5 WHERE kept)),
mapped AS (SELECT b5.doc, ord, CASE type WHEN 'front_matter' THEN 'front' WHEN 'back_matter' THEN 'back' WHEN 'footnote' THEN 'note' ELSE 'chapter' END AS part, CASE WHEN NOT matter THEN no END AS chapter_no,
  CASE WHEN matter THEN NULL WHEN b5.run > 0 THEN title ELSE 'Main Content' END AS title, CASE WHEN type IN ('heading', 'quote', 'footnote', 'image') THEN type ELSE 'paragraph' END AS kind,
  CASE WHEN type = 'image' AND coalesce(caption, '') <> '' THEN text || chr(10) || caption ELSE text END AS text,
  CASE type WHEN 'quote' THEN coalesce(attribution, '') WHEN 'footnote' THEN coalesce(nullif(regexp_extract(number, '\\d+'), ''), '1') WHEN 'heading' THEN CAST(level AS VARCHAR) WHEN 'image' THEN 'image' ELSE coalesce(style, 'normal') END AS style
  FROM b5 LEFT JOIN runs ON b5.doc = runs.doc AND b5.run = runs.run WHERE matter OR kept AND (content OR type = 'footnote' AND b5.run > 0))"""

_MAPPED = derived_sql("blocks", "blocks") + "," + _FROM_BLOCKS

#: What begins a section of page text, a greeting, and words that begin a sentence, not a subtitle.
SECTION_LINE = re.compile(r"(?:(?:chapter|letter|part|section|foreword|prologue|epilogue|introduction|conclusion)\s*(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|[a-z])?:?\s*|letter\s+\d+\s*)$", re.IGNORECASE)
BARE_NUMBER = re.compile(r"(?:\d+|[ivxlcdm]+)\.?\s*$", re.IGNORECASE)
GREETING = re.compile(r"dear\s+[\w\s]+[,.]?\s*$", re.IGNORECASE)
STARTERS = ("The ", "A ", "An ", "I ", "My ", "It ", "This ", "They ", "As ", "And ", "But ", "So ", "When ", "If ", "Not ")
SUBTITLE_CHARS, GOES_ON_CHARS = 80, 60
PAGE_SECTIONS = "doc_id long, section_no long, title string, number long, block_no long, style string, text string"


def page_sections(text: str) -> list[tuple[int, str, int | None, int, str, str]]:
    """(section_no, title, number, block_no, style, text) of the blocks of a text as pages give it.  After a section's line, a
    short line that begins no sentence is its subtitle, blank lines in between, and so are the short lines that go on from it;
    a greeting is a block of its own.  What comes before the first section is an Introduction; without sections all is Content."""
    sections: list[tuple[str | None, list[list[str]]]] = [(None, [])]
    held: list[str] = []
    state = "body"

    def flush() -> None:
        if held:
            sections[-1][1].append(["normal", " ".join(held)])
            held.clear()

    for line in map(str.strip, text.split("\n")):
        if SECTION_LINE.match(line) or len(line) < 10 and BARE_NUMBER.match(line):
            flush()
            sections.append((line, []))
            state = "opened"
        elif not line:
            flush()
        elif GREETING.match(line):
            flush()
            sections[-1][1].append(["greeting", line])
            state = "body"
        elif state == "opened" and len(line) < SUBTITLE_CHARS and not line.startswith(STARTERS):
            flush()
            sections[-1][1].append(["subtitle", line])
            state = "subtitle"
        elif state == "subtitle" and len(line) < SUBTITLE_CHARS and (line[0] == "(" or line[-1] == ")" or len(line) < GOES_ON_CHARS and not line.startswith(STARTERS)):
            sections[-1][1][-1][1] += " " + line
        else:
            held.append(line)
            state = "body"
    flush()
    if not sections[0][1]:
        sections = sections[1:]
    elif len(sections) == 1:
        sections = [("Content", sections[0][1])]
    named = [(i, "Introduction" if title is None else title, None if title in (None, "Content") else i, blocks) for i, (title, blocks) in enumerate(sections, 1)]
    return [(i, title, number, k, style, t) for i, title, number, blocks in named for k, (style, t) in enumerate(blocks, 1)]


def pdf_structure(spark, sf_dir):
    """page_sections of every composed manuscript: a chapter line before every eighth line, a greeting after every second one.
    A document is a row and stays one until its blocks come out: no exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PAGE_SECTIONS.split(", ")]
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for r in page_sections(t)]
            yield pd.DataFrame(rows, columns=names).astype({"number": "Int64"})

    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 8 == 0, F.concat(F.lit("Chapter "), (i / 8 + 1).cast("int").cast("string"), F.when(i % 16 == 0, "\nDear Reader,\n").otherwise("\n\n"), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return docs.mapInPandas(run, PAGE_SECTIONS)


METADATA = [(1, "A Book", "An Author", "de", "978"), (2, "", None, None, None), (3, None, " ", "", "")]
SMALL = [
    (1, "my_first it's a_test", 7.456, 15, "0.5", "yes", 1536), (2, "draft", 0.004, 3, "1.51", "ON", 0), (3, "a b+c&d/é", 61.0, 500, "x", "no", 5 * 1024 * 1024), (4, "x\ny\n", 2.5, None, "1.5", "1", 1023),
]


def metadata_defaults(d):
    """What a book's metadata says, or what stands for it where it says nothing."""
    given = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return d.select("id", given("title", "Untitled").alias("title"), given("author", "Unknown Author").alias("author"), given("language", "en").alias("language"), F.concat(F.lit("ISBN:"), F.coalesce("isbn", F.lit(""))).alias("identifier"))


def small_functions(d):
    """Title case, lines, query quoting, rounding, clamping, number and truth parsing, byte sizes."""
    t = F.col("t")
    lines = F.split(t, "\n", -1)
    n_lines = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    margin = F.col("margin").try_cast("double")
    size = F.col("bytes")
    unit = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.round(size / 1024, 2).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(size / 1048576, 2).cast("string"), F.lit(" MB")))
    return d.select(
        "id", T.title_case(F.replace(t, F.lit("_"), F.lit(" "))).alias("title"), n_lines.cast("long").alias("n_lines"), F.url_encode(F.regexp_replace(t, "[^a-z ]", "")).alias("query"),
        F.round("seconds", 2).alias("seconds"), F.greatest(F.lit(10), F.least(F.coalesce("n", F.lit(10)), F.lit(100))).alias("clamped"), F.coalesce(margin.between(0.5, 1.5), F.lit(False)).alias("margin_ok"),
        F.lower("flag").isin("1", "true", "yes", "on").alias("flag"), unit.alias("size"),
    )


_TITLE = "array_to_string(list_transform(string_split(u, ''), lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(string_split(u, '')[i - 1], '\\p{L}') THEN CASE WHEN c = 'ß' THEN 'Ss' ELSE upper(c) END ELSE lower(c) END), '')"


def _over(fn, relation):
    return lambda spark, sf_dir: fn(derived(spark, sf_dir, relation))


CATALOGUE = {
    "block_mapping": (_over(block_mapping, "blocks"), f"WITH {_MAPPED} SELECT * FROM mapped"),
    "endnotes": (endnotes, f"WITH {_MAPPED} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY chapter_no, ord) AS INT) AS place, CAST(style AS INT) AS number, text FROM mapped WHERE part = 'note'"),
    "contents": (contents, f"WITH {_MAPPED} SELECT doc, chapter_no, max(title) AS title, count(*) AS n_blocks, 'chapter_' || lpad(CAST(chapter_no AS VARCHAR), 3, '0') || '.xhtml' AS href FROM mapped WHERE part = 'chapter' GROUP BY doc, chapter_no"),
    "pdf_structure": (pdf_structure, None),
    "metadata_defaults": (_over(metadata_defaults, "metadata"), f"WITH {derived_sql('metadata', 'r')} SELECT id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, coalesce(nullif(trim(author), ''), 'Unknown Author') AS author, coalesce(nullif(trim(language), ''), 'en') AS language, 'ISBN:' || coalesce(isbn, '') AS identifier FROM r"),
    "small_functions": (_over(small_functions, "small"), f"WITH {derived_sql('small', 'r')}, q AS (SELECT *, replace(t, '_', ' ') AS u FROM r) SELECT id, {_TITLE} AS title, CAST(len(string_split(t, chr(10))) - CASE WHEN ends_with(t, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines, replace(regexp_replace(t, '[^a-z ]', '', 'g'), ' ', '+') AS query, round(seconds::DOUBLE, 2) AS seconds, greatest(10, least(coalesce(n, 10), 100)) AS clamped, coalesce(TRY_CAST(margin AS DOUBLE) BETWEEN 0.5 AND 1.5, false) AS margin_ok, lower(flag) IN ('1', 'true', 'yes', 'on') AS flag, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CAST(round(bytes / 1024, 2) AS VARCHAR) || ' KB' ELSE CAST(round(bytes / 1048576, 2) AS VARCHAR) || ' MB' END AS size FROM q"),
}
