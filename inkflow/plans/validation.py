"""Rule engines over tables of facts: print files, style sheets and packaged books, one row a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.plans import sqltext as S
from inkflow.plans.derived import derived, derived_sql

PRINT_COLUMNS = (
    "doc string, mb double, pages int, version string, fonts int, embedded int, title string, author string, page_size string, width double, height double, "
    "first_page string, indented int, eligible int, spacing boolean, no_indent boolean, drop_caps boolean, starts int, indented_starts int, sparse int"
)
#: Facts of print files as an inspection gives them: good, poor, borderline, unreadable (nulls).
PRINT_FILES = [
    ("good", 12.0, 180, "1.6", 4, 4, "A Book", "An Author", "432 x 648 pts (6 x 9 in)", 432.0, 648.0, "Once upon a time", 80, 100, False, False, False, 6, 0, 0),
    ("poor", 501.0, 10, "1.3", 0, 0, None, None, "595 x 842 pts", 595.0, 842.0, " short", 40, 100, True, True, True, 5, 2, 3),
    ("edge", 100.0, 24, "1.7", 3, 2, "T", "", "612 x 792 pts", 612.0, 792.0, "eleven char", 70, 100, True, False, False, 0, 0, 1),
    ("wide", 100.5, 1001, "2.0", 2, 0, "T", "A", None, None, None, None, 3, 9, False, True, False, 0, 0, 0),
    ("none", None, None, None, None, None, None, None, None, None, None, None, None, None, False, False, False, None, None, None),
]
#: The rules in order.  A status is an SQL expression over the facts; a null one gives no row.
PRINT_RULES = [
    ("file_size", "CASE WHEN mb > 500 THEN 'fail' WHEN mb > 100 THEN 'warning' WHEN mb IS NULL THEN 'error' ELSE 'pass' END"),
    ("page_count", "CASE WHEN pages < 24 THEN 'fail' WHEN pages > 1000 THEN 'warning' WHEN pages IS NULL THEN 'error' ELSE 'pass' END"),
    ("file_version", "CASE WHEN version IS NULL THEN 'error' WHEN version LIKE '%1.4%' OR version LIKE '%1.5%' OR version LIKE '%1.6%' OR version LIKE '%1.7%' THEN 'pass' ELSE 'warning' END"),
    ("fonts", "CASE WHEN fonts IS NULL THEN 'error' WHEN fonts = 0 OR embedded = 0 THEN 'fail' WHEN embedded < fonts THEN 'warning' ELSE 'pass' END"),
    ("metadata", "CASE WHEN coalesce(title, '') <> '' AND coalesce(author, '') <> '' THEN 'pass' ELSE 'warning' END"),
    ("page_dimensions", "CASE WHEN page_size LIKE '%6 x 9%' OR page_size LIKE '%8.5 x 11%' THEN 'pass' ELSE 'warning' END"),
    ("text_extraction", "CASE WHEN pages IS NULL THEN 'error' WHEN length(trim(coalesce(first_page, ''))) > 10 THEN 'pass' ELSE 'warning' END"),
    ("first_paragraphs", "CASE WHEN indented_starts > 0 THEN 'fail' WHEN starts > 0 THEN 'pass' ELSE 'warning' END"),
    ("drop_caps", "CASE WHEN drop_caps THEN 'warning' ELSE 'pass' END"),
    ("page_breaks", "'warning'"),
    ("margin_accuracy", "CASE WHEN abs(width / 72 - 6.0) < 0.1 AND abs(height / 72 - 9.0) < 0.1 OR abs(width / 72 - 8.5) < 0.1 AND abs(height / 72 - 11.0) < 0.1 THEN 'pass' ELSE 'warning' END"),
    ("page_content", "CASE WHEN pages IS NULL THEN 'error' WHEN sparse > 0 THEN 'warning' ELSE 'pass' END"),
    ("standards_reference", "'pass'"),
    ("indentation", "CASE WHEN eligible IS NULL THEN 'error' WHEN eligible < 10 THEN 'warning' WHEN indented > 0.7 * eligible THEN 'pass' WHEN indented > 0.5 * eligible THEN 'warning' ELSE 'fail' END"),
    ("paragraph_spacing", "CASE WHEN spacing THEN 'warning' END"),
    ("paragraph_indentation", "CASE WHEN no_indent THEN 'warning' END"),
    ("formatting_style", "CASE WHEN spacing AND no_indent THEN 'info' WHEN NOT spacing AND NOT no_indent THEN 'pass' END"),
]

SHEETS = [
    ("good", "p { text-indent: 0.25in; orphans: 3; widows: 3 }\n.first-para { text-indent: 0 }\nh1 + p { text-indent: 0 }\n.chapter-title + p { text-indent: 0 }\n.chapter { page-break-before: always }\nh1 { page-break-after: avoid }\n@page {\n margin: 0.75in }\n.d::first-letter {\n line-height: 1.1; margin-right: 0.06em }"),
    ("poor", "p { text-indent: 0.5in; orphans: 2 }\n@page { margin: 1in }\n.d::first-letter { line-height: 0.8; margin: 0.01em }"),
    ("empty", ""),
]
#: What a sheet must say.  Patterns give facts; an issue holds where its condition over the facts does.
SHEET_FACTS = [
    ("orphans", r"orphans:\s*(\d+)", "int"), ("widows", r"widows:\s*(\d+)", "int"), ("indent", r"text-indent:\s*([\d.]+)in", "double"), ("first_para", r"(\.first-para.*text-indent:\s*0)", None),
    ("adjacent", r"(h[123]\s*\+\s*p.*text-indent:\s*0)", None), ("chapter_title", r"(\.chapter-title\s*\+\s*p.*text-indent:\s*0)", None), ("cap_line", r"(?s)first-letter.*line-height:\s*([\d.]+)", "double"),
    ("cap_margin", r"(?s)first-letter.*margin.*?([\d.]+)em", "double"), ("chapter_break", r"(\.chapter.*page-break-before:\s*always)", None), ("avoid_break", r"(page-break-after:\s*avoid)", None),
    ("margin", r"(?s)@page.*margin:\s*([\d.]+)in", "double"),
]
SHEET_ISSUES = [
    ("orphans", "orphans IS NULL OR orphans < 3"), ("widows", "widows IS NULL OR widows < 3"), ("indent", "indent IS NULL OR NOT (indent BETWEEN 0.2 AND 0.3)"), ("first paragraph", "NOT first_para"),
    ("paragraph after heading", "NOT adjacent"), ("paragraph after chapter title", "NOT chapter_title"), ("drop cap line height", "caps AND cap_line < 1.0 AND cap_line > 0"), ("drop cap margin", "caps AND cap_margin < 0.05 AND cap_margin > 0"),
    ("chapter break", "NOT chapter_break"), ("heading break", "NOT avoid_break"), ("margin", "margin > 0 AND abs(margin - wanted) > 0.01"),
]

MEMBERS = [
    ("good", "mimetype", 20), ("good", "META-INF/container.xml", 300), ("good", "book.opf", 900), ("good", "nav.xhtml", 400), ("good", "c1.xhtml", 9000), ("good", "Font.TTF", 90000), ("good", "OFL.txt", 4000),
    ("poor", "c1.html.txt", 10), ("poor", "big.png", 31 * 1024 * 1024), ("poor", "a.otf", 5), ("half", "mimetype", 20), ("half", "x.opf", 10), ("half", "a.html", 10),
    *[("many", f"c{i}.xhtml", 1) for i in range(301)], ("many", "toc.opf", 1),
]
PACKAGES = [
    ("good", "<package xmlns='http://www.idpf.org/2007/opf'><metadata><dc:title>A</dc:title><dc:creator>B</dc:creator><dc:language>en</dc:language></metadata></package>"),
    ("half", "<package><metadata><dc:title id='t'>A</dc:title><dc:creator/></metadata></package>"), ("many", "<package><spine/></package>"), ("poor", None),
]
#: Rules over what a book's member names and sizes give.
BOOK_RULES = [
    ("file_count", "CASE WHEN html > 300 OR html = 0 THEN 'fail' ELSE 'pass' END"), ("file_sizes", "CASE WHEN oversized > 0 THEN 'fail' ELSE 'pass' END"),
    ("metadata", "CASE WHEN opf = 0 OR NOT has_metadata OR missing <> '' THEN 'fail' ELSE 'pass' END"), ("navigation", "CASE WHEN nav = 0 THEN 'fail' ELSE 'pass' END"),
    ("fonts", "CASE WHEN fonts = 0 OR licences = 0 THEN 'warning' ELSE 'pass' END"), ("structure", "CASE WHEN mimetype = 0 OR container = 0 OR opf = 0 THEN 'fail' ELSE 'pass' END"),
]
_BOOK_COUNTS = {
    "html": "name LIKE '%.xhtml' OR name LIKE '%.html'", "oversized": "size > 31457280", "nav": "name LIKE '%nav.xhtml%'", "opf": "name LIKE '%.opf'",
    "fonts": "lower(name) LIKE '%.ttf' OR lower(name) LIKE '%.otf' OR lower(name) LIKE '%.woff' OR lower(name) LIKE '%.woff2'", "licences": "lower(name) LIKE '%ofl%' AND lower(name) LIKE '%.txt'",
    "mimetype": "name = 'mimetype'", "container": "name = 'META-INF/container.xml'",
}


def checks(facts: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """key, ord, check_name, status: one pass over the facts for all rules."""
    every = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("check_name"), F.expr(e).alias("status")) for i, (n, e) in enumerate(rules, 1)])
    return facts.select(key, F.explode(every).alias("r")).select(key, "r.*").where("status is not null")


def _checks_sql(rules: list[tuple[str, str]], key: str, facts: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, ord, check_name, status FROM (SELECT {key}, {i} AS ord, '{n}' AS check_name, {e} AS status FROM {facts}) WHERE status IS NOT NULL" for i, (n, e) in enumerate(rules, 1))


def print_checks(facts: DataFrame) -> DataFrame:
    return checks(facts, "doc", PRINT_RULES)


def rule_engine_print(spark, sf_dir):
    return print_checks(derived(spark, sf_dir, "print_files"))


def sheet_facts(sheets: DataFrame) -> DataFrame:
    """The facts of each style sheet (sheet, css); caps, whether drop caps are asked for, and wanted, the margin in inches, are
    the book's options, or else none and 0.75."""
    def fact(pattern, kind):
        got = F.regexp_extract("css", pattern, 1)
        return got != "" if kind is None else got.try_cast(kind)

    options = {"caps": F.lit(False), "wanted": F.lit(0.75)}
    sheets = sheets.withColumns({c: F.coalesce(F.col(c), v) if c in sheets.columns else v for c, v in options.items()})
    return sheets.select("sheet", "caps", "wanted", *[fact(p, k).alias(n) for n, p, k in SHEET_FACTS])


def sheet_checks(sheets: DataFrame) -> DataFrame:
    """sheet, status, issues: a sheet fails for any issue."""
    facts = sheet_facts(sheets)
    issues = F.array_join(F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in SHEET_ISSUES])), "; ")
    return facts.select("sheet", issues.alias("issues")).select("sheet", F.when(F.col("issues") == "", "pass").otherwise("fail").alias("status"), "issues")


def rule_engine_sheets(spark, sf_dir):
    return sheet_checks(derived(spark, sf_dir, "sheets"))


def book_facts(members: DataFrame, packages: DataFrame) -> DataFrame:
    """Counts of member names and sizes, and what the package file's metadata lacks."""
    counts = members.groupBy("book").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in _BOOK_COUNTS.items()])
    opf = F.coalesce("opf", F.lit(""))
    lacks = F.array_compact(F.array(*[F.when(~opf.rlike(rf"<dc:{tag}(\s[^>]*)?>[^<]"), n) for tag, n in (("title", "title"), ("creator", "author"), ("language", "language"))]))
    told = packages.select("book", opf.rlike(r"<metadata[\s>]").alias("has_metadata"), F.array_join(lacks, ", ").alias("missing"))
    return counts.join(told, "book", "left").withColumn("has_metadata", F.coalesce("has_metadata", F.lit(False))).withColumn("missing", F.coalesce("missing", F.lit("title, author, language")))


def book_checks(members: DataFrame, packages: DataFrame) -> DataFrame:
    return checks(book_facts(members, packages), "book", BOOK_RULES)


def rule_engine_books(spark, sf_dir):
    return book_checks(derived(spark, sf_dir, "members"), derived(spark, sf_dir, "packages"))




def _sheet_sql() -> str:
    facts = ", ".join((f"{g} <> ''" if k is None else f"TRY_CAST({g} AS {k.upper()})") + f" AS {n}" for n, p, k in SHEET_FACTS for g in [f"regexp_extract(css, {S.quote(p)}, 1)"])
    issues = ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in SHEET_ISSUES)
    return f"WITH {derived_sql('sheets', 'r')}, f AS (SELECT sheet, coalesce(caps, false) AS caps, coalesce(wanted, 0.75) AS wanted, {facts} FROM r), i AS (SELECT sheet, array_to_string(list_filter([{issues}], lambda x: x IS NOT NULL), '; ') AS issues FROM f) SELECT sheet, CASE WHEN issues = '' THEN 'pass' ELSE 'fail' END AS status, issues FROM i"


def _book_sql() -> str:
    counts = ", ".join(f"count(*) FILTER ({e}) AS {n}" for n, e in _BOOK_COUNTS.items())
    lacks = ", ".join(f"CASE WHEN NOT regexp_matches(coalesce(opf, ''), '<dc:{tag}(\\s[^>]*)?>[^<]') THEN '{n}' END" for tag, n in (("title", "title"), ("creator", "author"), ("language", "language")))
    return (
        f"WITH {derived_sql('members', 'm')}, {derived_sql('packages', 'p')}, c AS (SELECT book, {counts} FROM m GROUP BY book), "
        f"t AS (SELECT book, regexp_matches(coalesce(opf, ''), '<metadata[\\s>]') AS has_metadata, array_to_string(list_filter([{lacks}], lambda x: x IS NOT NULL), ', ') AS missing FROM p), "
        "facts AS (SELECT c.*, coalesce(has_metadata, false) AS has_metadata, coalesce(missing, 'all') AS missing FROM c LEFT JOIN t ON c.book = t.book) " + _checks_sql(BOOK_RULES, "book", "facts")
    )


CATALOGUE = {
    "rule_engine_print": (rule_engine_print, f"WITH {derived_sql('print_files', 'facts')} " + _checks_sql(PRINT_RULES, "doc", "facts")),
    "rule_engine_sheets": (rule_engine_sheets, _sheet_sql()),
    "rule_engine_books": (rule_engine_books, _book_sql()),
}
