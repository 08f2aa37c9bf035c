"""Printed pages of documents and the rules over windows of pages, each in one pass over a row: no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.functions import text as T

#: Pages that the rules look at, and their limits.
PARAGRAPH_PAGES, INDENT_PAGES, DISTRIBUTION_PAGES = 10, 20, 50
LEAST_PAGES, MANY_PAGES, FAIL_MB, WARN_MB = 24, 1000, 500, 100
INDENTED = "^[ \t]{2}"
UPPER_OR_DIGIT = r"^[\p{Lu}\p{Nd}\x{b2}\x{b3}\x{b9}]"


def pages(text: Column, budget: int) -> Column:
    """array<array<string>>: a form feed ends a page, and so does every budget-th line since the last break.  An empty text is
    one page of one empty line, a null text has no page."""
    lines = F.transform(F.split(text, "\f", -1), lambda part: F.split(part, "\n", -1))
    cut = lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / budget).cast("int")), lambda i: F.slice(ls, i * budget + 1, budget))
    return F.flatten(F.transform(lines, cut))


def lines_of(text: Column) -> Column:
    """array<struct<line, s>>: lines with what is left of them stripped, so that no rule strips a line again."""
    return F.transform(text, lambda x: F.struct(x.alias("line"), T.strip(x).alias("s")))


def filled(lines: Column) -> Column:
    """The lines_of() that are not blank."""
    return F.filter(lines, lambda x: x["s"] != "")


def heading_pairs(lines: Column, most: int = 50) -> Column:
    """struct(n, indented) of lines_of(): pairs of a short line and one more than twice as long; what ends a pair does not begin
    another."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("indented"), F.lit(True).alias("taken"), F.lit(0).alias("before"))

    def step(a, x):
        short, s = a["before"], F.length(x["s"])
        hit = ~a["taken"] & (short > 0) & (short < most) & (s > 2 * short)
        inside = hit & x["line"].rlike(INDENTED)
        return F.struct((a["n"] + hit.cast("int")).alias("n"), (a["indented"] + inside.cast("int")).alias("indented"), hit.alias("taken"), s.alias("before"))

    return F.aggregate(lines, start, step, lambda a: F.struct(a["n"], a["indented"]))


def page_facts(books: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes and what the rules need of a book's pages: n_pages, first_chars, first_filled, sparse (numbers from 1
    of pages 2 to 50 with one to four lines), indented and eligible lines of the first 20 pages, potential and indented first
    paragraphs and all paragraphs of the first 10.  The text is read once and no row meets another; repeated ids stay rows."""
    b = books.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(pages(F.col("text"), budget), F.array().cast("array<array<string>>")).alias("p"))
    first = F.array_join(F.try_element_at("p", F.lit(1)), "\n")
    b = b.select("doc_id", "n_bytes", F.size("p").cast("long").alias("n_pages"), first.alias("first"), F.transform(F.slice("p", 1, DISTRIBUTION_PAGES), lines_of).alias("p"))
    head = lambda n: F.flatten(F.slice("p", 1, n))
    short = F.transform("p", lambda page, i: F.when((i > 0) & F.size(filled(page)).between(1, 4), i + 1))
    b = b.select("doc_id", "n_bytes", "n_pages", "first", F.array_compact(short).alias("sparse"), filled(head(INDENT_PAGES)).alias("body"), head(PARAGRAPH_PAGES).alias("head"))
    other = lambda x: x["line"].rlike(INDENTED) | ((F.length(x["s"]) > 10) & ~x["s"].rlike(UPPER_OR_DIGIT))
    first, pair = F.col("first"), heading_pairs(F.col("head"))
    return b.select(
        "doc_id", "n_bytes", "n_pages", F.coalesce(F.length(first), F.lit(0)).cast("long").alias("first_chars"),
        F.coalesce(F.length(T.strip(first)) > 10, F.lit(False)).alias("first_filled"), "sparse",
        F.size(F.filter("body", lambda x: x["line"].rlike(INDENTED))).cast("long").alias("indented"), F.size(F.filter("body", other)).cast("long").alias("eligible"),
        pair["n"].cast("long").alias("potential_first_paras"), pair["indented"].cast("long").alias("indented_first_paras"),
        F.size(filled(F.col("head"))).cast("long").alias("paragraphs"),
    )


def page_checks(facts: DataFrame) -> DataFrame:
    """doc_id, ord, check_name, status, message: the rules of a printed book that its file and pages decide, from
    page_facts() with title and author."""
    c, lit = F.col, F.lit
    share = c("indented") / c("eligible")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else lit(p) for p in parts))
    number = lambda name: c(name).cast("string")
    rules = [
        ("file_size", F.when(c("n_bytes") > FAIL_MB << 20, "fail").when(c("n_bytes") > WARN_MB << 20, "warning").otherwise("pass"), F.format_string("%.1f MB", c("n_bytes") / (1024 * 1024))),
        ("page_count", F.when(c("n_pages") < LEAST_PAGES, "fail").when(c("n_pages") > MANY_PAGES, "warning").otherwise("pass"), text(number("n_pages"), " pages")),
        ("metadata", F.when((F.coalesce("title", lit("")) != "") & (F.coalesce("author", lit("")) != ""), "pass").otherwise("warning"), text("title ", F.coalesce("title", lit("")), ", author ", F.coalesce("author", lit("")))),
        ("text_extraction", F.when(c("n_pages") == 0, "error").when(c("first_filled"), "pass").otherwise("warning"), text(number("first_chars"), " characters on the first page")),
        (
            "text_indentation_patterns", F.when(c("eligible") < 10, "warning").when(share > 0.7, "pass").when(share > 0.5, "warning").otherwise("fail"),
            F.when(c("eligible") < 10, "too few lines").otherwise(text(number("indented"), "/", number("eligible"), " lines indented")),
        ),
        ("page_content_distribution", F.when(F.size("sparse") > 0, "warning").otherwise("pass"), F.when(F.size("sparse") > 0, text("pages with few lines: ", F.array_join(c("sparse").cast("array<string>"), ", "))).otherwise("no page with few lines")),
        ("kdp_page_breaks", lit("warning"), lit("page breaks are to be looked at by hand")),
        ("kdp_standards_reference", lit("pass"), lit("standards of print")),
    ]
    rows = F.array(*(F.struct(lit(i).alias("ord"), lit(n).alias("check_name"), s.alias("status"), m.alias("message")) for i, (n, s, m) in enumerate(rules, 1)))
    return facts.select("doc_id", F.inline(rows))
