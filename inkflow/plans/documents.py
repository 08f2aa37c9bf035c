"""Queries over documents and composed manuscripts: words, normalisers, chunks, structure, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import paging, structure
from inkflow.operators.rules import severity_rollup as rollup, status_pivot as pivot
from inkflow.plans import sqltext as S
from inkflow.session import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def doc_word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def silo_word_totals(spark, sf_dir):
    return docs(spark, sf_dir).groupBy((F.col("doc_id") % 11).alias("silo")).agg(F.sum(T.word_count(F.col("text"))).alias("n_words"), F.count("*").alias("n_docs"))


DRAFT_CAP = 25_000
#: Fixed value: how a draft cites a source.
CITATION = "[^src-"


def citation_counts(spark, sf_dir):
    """Citations of composed drafts, one in place of each "of"."""
    return docs(spark, sf_dir).select("doc_id", T.occurrences(F.replace("text", F.lit(" of "), F.lit(f" {CITATION}1] ")), CITATION).alias("n_hits"))


def web_snippets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 40), " ").alias("snippet"))


def _normal(fn):
    def run(spark, sf_dir):
        c = fn(F.col("text"))
        return docs(spark, sf_dir).select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("long").alias("n_chars"))

    return run


def chunk_paragraphs(spark, sf_dir):
    """Lines stand for paragraphs; at most 3500 characters a chunk."""
    parts = F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunk_by(parts, 3500, "\n\n", 2, True)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("chunk").cast("binary")).alias("digest"), F.length("chunk").cast("long").alias("n_chars"))


def chunk_words(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunk_by(T.words(F.col("text")), 2000, " ", 2, False)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("chunk").cast("binary")).alias("digest"), F.length("chunk").cast("long").alias("n_chars"))


def text_paragraphs(spark, sf_dir):
    return structure.paragraphs(structure.with_chapters(docs(spark, sf_dir)))


def text_sections(spark, sf_dir):
    return structure.text_sections(structure.with_chapters(docs(spark, sf_dir)))


def structure_counts(spark, sf_dir):
    s = text_sections(spark, sf_dir)
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("n_paragraphs").alias("n_paragraphs"), F.sum("n_words").alias("n_words"))


def _blocks(spark, sf_dir):
    """Each kept section as a heading block 0 and its paragraphs; every fifth paragraph is a quote."""
    p = structure.paragraphs(structure.with_chapters(docs(spark, sf_dir))).where("section_no > 0")
    no = F.col("paragraph_no")
    own = F.struct(no.alias("block_no"), F.when(no % 5 == 0, "quote").otherwise("paragraph").alias("type"), F.col("text"))
    head = F.struct(F.lit(0).cast("long").alias("block_no"), F.lit("heading").alias("type"), F.col("title").alias("text"))
    return p.select("doc_id", "section_no", F.inline(F.when(no == 1, F.array(head, own)).otherwise(F.array(own))))


def first_para_flags(spark, sf_dir):
    return structure.first_flags(_blocks(spark, sf_dir))


def render_plan(spark, sf_dir):
    """Style of each block, and a page break before every section but the first."""
    b = _blocks(spark, sf_dir)
    first = F.min("section_no").over(Window.partitionBy("doc_id"))
    style = F.when(F.col("type") == "heading", "title").when(F.col("type") == "quote", "quote").when(F.col("block_no") == 1, "first").otherwise("body")
    return b.select("doc_id", "section_no", "block_no", style.alias("style"), ((F.col("type") == "heading") & (F.col("section_no") > first)).alias("page_break"))


def block_to_html(spark, sf_dir):
    t = T.escape_html(F.col("text"))
    html = F.when(F.col("type") == "heading", F.concat(F.lit("<h1>"), t, F.lit("</h1>"))).when(F.col("type") == "quote", F.concat(F.lit("<blockquote>"), t, F.lit("</blockquote>"))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    return _blocks(spark, sf_dir).select("doc_id", "section_no", "block_no", F.md5(html.cast("binary")).alias("digest"))


def doc_html(spark, sf_dir):
    t = T.escape_html(F.col("text"))
    html = F.when(F.col("type") == "heading", F.concat(F.lit("<h1>"), t, F.lit("</h1>"))).when(F.col("type") == "quote", F.concat(F.lit("<blockquote>"), t, F.lit("</blockquote>"))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    rows = _blocks(spark, sf_dir).select("doc_id", F.struct("section_no", "block_no", html.alias("h")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["h"]), "\n")
    return rows.groupBy("doc_id").agg(F.md5(joined.cast("binary")).alias("digest"), F.count("*").alias("n_blocks"))


def strip_evidence_gaps(spark, sf_dir):
    lines = structure.with_chapters(docs(spark, sf_dir)).withColumn("line", F.when(F.col("line_no") % 7 == 3, F.concat(F.lit(" **Evidence gap: "), "line")).when(F.col("line_no") % 7 == 5, F.concat(F.lit("# "), "line")).otherwise(F.col("line")))
    return structure.strip_gaps(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("line_no").alias("line_sum"))


def heading_pairs(spark, sf_dir):
    return structure.heading_pairs(structure.with_chapters(docs(spark, sf_dir)))


def indent_ratio(spark, sf_dir):
    return structure.indentation(docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")))


def sparse_pages(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(T.strip(F.col("line"))) > 0)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")).where("n_lines < 5")


def manuscript_parts(spark, sf_dir):
    """source, doc_id, t: final text where there is one (even documents), else the draft, stripped; empty ones drop."""
    d = docs(spark, sf_dir)
    final = d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("Final. "), "text").alias("final"))
    return d.join(final, "doc_id", "left").select("source", "doc_id", T.strip(F.coalesce("final", "text", F.lit(""))).alias("t")).where("t <> ''")


def compile_manuscript(spark, sf_dir):
    """Each source's manuscript as its parts in order: where a part begins when they are joined by an empty line, its length
    and digest.  No source is gathered: offsets come from sums per range of doc_id."""
    parts = manuscript_parts(spark, sf_dir).select("source", "doc_id", (F.length("t") + 2).cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))
    return words_before(parts, ["source"]).select("source", "doc_id", F.col("before").alias("offset"), (F.col("n") - 2).alias("n_chars"), "digest")


def write_manuscripts(parts, path):
    """Text files by source, whose lines in the order of file names are the manuscript: parts with an empty line between
    them and a line feed at the end."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = words_before(parts.select("source", "doc_id", "t", F.lit(1).cast("long").alias("n")), ["source"])
    lines = first.select("source", "doc_id", F.when(F.col("before") == 0, F.col("t")).otherwise(F.concat(F.lit("\n"), "t")).alias("value"))
    lines.repartitionByRange(n, "source", "doc_id").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)


def size_bucket_avg(spark, sf_dir):
    n = T.word_count(F.col("text"))
    b = docs(spark, sf_dir).select(F.when(n < 5000, "small").when(n < 20000, "medium").otherwise("large").alias("bucket"), n.alias("n"))
    return b.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_words"))


#: Prices of a thousand tokens in and out; models without a price cost what the large one does.
PRICES = [("large", 0.01, 0.03), ("small", 0.0015, 0.002)]


def cost_rollup(spark, sf_dir):
    """Each source's run: calls, tokens in and out, cost, and the model of its last call.  A document is a call that reads its
    words and writes a fourth as many."""
    price = spark.createDataFrame(PRICES, "model string, p_in double, p_out double")
    model = F.when(F.col("lang") == "en", "large").when(F.col("lang") == "de", "small").otherwise("other")
    calls = docs(spark, sf_dir).select("source", "doc_id", model.alias("model"), T.word_count(F.col("text")).alias("n_in")).withColumn("n_out", F.floor(F.col("n_in") / 4))
    calls = calls.join(F.broadcast(price), "model", "left")  # two literal rows
    cost = F.col("n_in") / 1000 * F.coalesce("p_in", F.lit(PRICES[0][1])) + F.col("n_out") / 1000 * F.coalesce("p_out", F.lit(PRICES[0][2]))
    return calls.groupBy("source").agg(
        F.count("*").alias("n_calls"), F.sum(F.col("n_in") + F.col("n_out")).alias("tokens"), F.sum("n_in").alias("tokens_in"), F.sum("n_out").alias("tokens_out"),
        F.round(F.sum(cost), 6).alias("cost"), F.max_by("model", "doc_id").alias("model_used"),
    )


def words_before(rows, group, size=10_000):
    """rows (group, doc_id, n) with `before`, the sum of n over the rows of the group before it: sums per range of doc_id,
    their running totals, and a window inside each range, so that no group is one task."""
    key = [*group, "_range"]
    rows = rows.withColumn("_range", F.floor(F.col("doc_id") / size))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*key).agg(F.sum("n").alias("_sum")).select(*(F.col(c).alias(f"_of_{c}") for c in key), F.sum("_sum").over(earlier).alias("_base"))
    inside = Window.partitionBy(*key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.sum("n").over(inside))
    joined = rows.join(ranges, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]))
    return joined.withColumn("before", F.coalesce("_base", F.lit(0)) + F.coalesce("_inside", F.lit(0))).drop("_base", "_inside", "_range", *(f"_of_{c}" for c in key))


def draft_cap_gate(spark, sf_dir):
    """Per language, documents in order are admitted while the words before them stay under the cap: the one that crosses it
    is the last."""
    d = docs(spark, sf_dir).select("doc_id", "lang", T.word_count(F.col("text")).alias("n"))
    return words_before(d, ["lang"]).select("doc_id", "before", F.when(F.col("before") < DRAFT_CAP, "admitted").otherwise("draft_total_cap").alias("reason"))


#: Lines of a printed page, and documents set as books: a sentence a line, indented, and a page before each that begins with E.
PAGE_LINES = 6
_SET = "replace(replace(coalesce(text, ''), '. E', concat('.', chr(12), '  E')), '. ', concat('.', chr(10), '  '))"


def _page_facts(spark, sf_dir):
    return paging.page_facts(docs(spark, sf_dir).select("doc_id", F.expr(_SET).alias("text")), PAGE_LINES)


def page_windows(spark, sf_dir):
    """What the first 10, 20 and 50 pages of each document hold."""
    return _page_facts(spark, sf_dir).withColumn("sparse", F.array_join(F.col("sparse").cast("array<string>"), ","))


def rule_engine_docs(spark, sf_dir):
    """Rules of printed books; the source is the title, and a labelled document has its language as author."""
    names = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), "lang")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    named = names.join(labelled, "doc_id", "left").select("doc_id", "title", F.when(F.col("labelled"), F.col("lang")).alias("author"))
    return paging.page_checks(_page_facts(spark, sf_dir).join(named, "doc_id"))


def severity_rollup(spark, sf_dir):
    return rollup(rule_engine_docs(spark, sf_dir))


def status_pivot(spark, sf_dir):
    return pivot(rule_engine_docs(spark, sf_dir))


def blockers_list(spark, sf_dir):
    c = rule_engine_docs(spark, sf_dir).where("status in ('fail', 'error')").select("doc_id", F.struct("ord", F.concat_ws(": ", "check_name", "message").alias("m")).alias("x"))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]), "; ").alias("blockers"))


def accuracy_score(spark, sf_dir):
    """Lines found against an expected count: 100 when equal, 75 within tolerance, else 10 off for each that differs."""
    d = docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("found"))
    e = table(spark, sf_dir, "labels").select("doc_id", F.col("quality"), (F.col("doc_id") % 12 + 1).alias("expected"))
    j = d.join(e, "doc_id", "left")
    off = F.abs(F.col("found") - F.col("expected"))
    score = F.when(F.col("expected").isNull(), None).when(off == 0, 100).when(off <= 1, 75).otherwise(F.greatest(F.lit(0), 100 - 10 * off))
    return j.select("doc_id", "found", "expected", score.cast("long").alias("score"))


def detection_report(spark, sf_dir):
    """Counts, sums and averages by method, from labels as outcomes."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("method", F.when(F.col("doc_id") % 2 == 0, "ai").otherwise("regex"))
    return d.groupBy("method").agg(
        F.count_if(F.col("quality") == 1).alias("n_ok"), F.count_if(F.col("quality") == 0).alias("n_bad"), F.count_if(F.col("quality").isNull()).alias("n_unknown"),
        F.coalesce(F.round(F.avg("n_chars"), 6), F.lit(0.0)).alias("avg_chars"), F.round(F.try_divide(F.sum("n_chars").cast("double"), F.count("quality")), 6).alias("chars_per_label"),
    )


def method_overhead(spark, sf_dir):
    a = docs(spark, sf_dir).agg(F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))).alias("x"), F.avg(F.when(F.col("doc_id") % 2 == 1, F.col("n_chars"))).alias("y"))
    return a.select(F.round("x", 6).alias("avg_ai"), F.round("y", 6).alias("avg_regex"), F.round((F.col("x") - F.col("y")) / F.col("y") * 100, 6).alias("overhead_pct"))


def method_compare(spark, sf_dir):
    d = docs(spark, sf_dir).groupBy("source", (F.col("doc_id") % 2 == 0).alias("ai")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    ai, rx = (d.where("ai").select("source", F.col("n").alias("n_ai"), F.col("c").alias("chars_ai")), d.where("not ai").select("source", F.col("n").alias("n_regex"), F.col("c").alias("chars_regex")))
    return ai.join(rx, "source", "full_outer").withColumn("diff", F.coalesce("chars_ai", F.lit(0)) - F.coalesce("chars_regex", F.lit(0)))


def symbols(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]+"


def _digest(expr: str) -> str:
    return f"SELECT doc_id, md5(c) AS digest, CAST(length(c) AS BIGINT) AS n_chars FROM (SELECT doc_id, {expr} AS c FROM documents)"


def chunk_lists(parts: str, most: int, gap: str, extra: int, trim: bool, source: str = "documents") -> str:
    """CTEs up to c: doc_id, cs."""
    done = f"CASE WHEN a.cur <> '' THEN list_append(a.out, {S.strip('a.cur') if trim else 'a.cur'}) ELSE a.out END"
    fold = f"list_reduce(ps, lambda a, p: CASE WHEN length(a.cur) + length(p.cur) + {extra} > {most} THEN {{'out': {done}, 'cur': p.cur}} ELSE {{'out': a.out, 'cur': CASE WHEN a.cur <> '' THEN a.cur || {gap} || p.cur ELSE p.cur END}} END, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}})"
    return f"""f AS (SELECT doc_id, {fold} AS a FROM (SELECT doc_id, list_transform({parts}, lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': x}}) AS ps FROM {source})),
c AS (SELECT doc_id, {done} AS cs FROM f)"""


def _chunks(*how) -> str:
    return f"""WITH {chunk_lists(*how)}
SELECT doc_id, CAST(chunk_no - 1 AS BIGINT) AS chunk_no, md5(chunk) AS digest, CAST(length(chunk) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS chunk_no FROM c)"""


_ESC = S.replaced(S.replaced("text", T.SPACES), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])
_BLOCKS = f"""WITH {S.PARAGRAPHS}, blocks AS (
  SELECT doc_id, section_no, paragraph_no AS block_no, CASE WHEN paragraph_no % 5 = 0 THEN 'quote' ELSE 'paragraph' END AS type, text FROM paragraphs WHERE section_no > 0
  UNION ALL SELECT doc_id, section_no, 0, 'heading', max(title) FROM paragraphs WHERE section_no > 0 GROUP BY doc_id, section_no),
html AS (SELECT doc_id, section_no, block_no, CASE type WHEN 'heading' THEN '<h1>' || {_ESC} || '</h1>' WHEN 'quote' THEN '<blockquote>' || {_ESC} || '</blockquote>' ELSE '<p>' || {_ESC} || '</p>' END AS h FROM blocks)"""
_PAGES = f"""WITH set_ AS (SELECT doc_id, {_SET} AS t FROM documents),
parts AS (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS part_no FROM (SELECT doc_id, string_split(t, chr(12)) AS ps FROM set_)),
printed AS (SELECT doc_id, part_no, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS li FROM (SELECT doc_id, part_no, string_split(part, chr(10)) AS ls FROM parts)),
numbered AS (
  SELECT *, {S.strip('line')} AS s, dense_rank() OVER (PARTITION BY doc_id ORDER BY part_no, li // {PAGE_LINES}) AS page, row_number() OVER (PARTITION BY doc_id ORDER BY part_no, li) AS n FROM printed),
per_page AS (SELECT doc_id, page, count(*) FILTER (s <> '') AS filled, string_agg(line, chr(10) ORDER BY n) AS t FROM numbered GROUP BY ALL),
by_page AS (
  SELECT doc_id, max(page) AS n_pages, CAST(max(length(t)) FILTER (page = 1) AS BIGINT) AS first_chars, bool_or(page = 1 AND length({S.strip('t')}) > 10) AS first_filled,
         coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (page BETWEEN 2 AND 50 AND filled BETWEEN 1 AND 4), '') AS sparse
  FROM per_page GROUP BY doc_id),
followed AS (SELECT *, lead(s) OVER w AS next_s, lead(line) OVER w AS next_line FROM numbered WHERE page <= 10 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
hits AS (SELECT *, coalesce(length(s) > 0 AND length(s) < 50 AND length(next_s) > 2 * length(s), false) AS hit FROM followed),
runs AS (SELECT *, sum(CAST(NOT hit AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM hits),
taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, run, hit ORDER BY n) % 2 = 1 AS pair FROM runs),
by_pair AS (
  SELECT doc_id, count(*) FILTER (pair) AS potential_first_paras, count(*) FILTER (pair AND regexp_matches(next_line, '^[ \\t]{{2}}')) AS indented_first_paras, count(*) FILTER (s <> '') AS paragraphs
  FROM taken GROUP BY doc_id),
marked AS (SELECT *, regexp_matches(line, '^[ \\t]{{2}}') AS inside, length(s) > 10 AND NOT regexp_matches(s, '^[\\p{{Lu}}\\p{{Nd}}\\x{{b2}}\\x{{b3}}\\x{{b9}}]') AS other FROM numbered WHERE page <= 20 AND s <> ''),
by_line AS (SELECT doc_id, count(*) FILTER (inside) AS indented, count(*) FILTER (inside OR other) AS eligible FROM marked GROUP BY doc_id),
facts AS (
  SELECT doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, n_pages, first_chars, first_filled, sparse, coalesce(indented, 0) AS indented, coalesce(eligible, 0) AS eligible,
         potential_first_paras, indented_first_paras, paragraphs
  FROM set_ JOIN by_page USING (doc_id) JOIN by_pair USING (doc_id) LEFT JOIN by_line USING (doc_id))"""
_CHECKS = _PAGES + """, book AS (
  SELECT f.*, coalesce(d.source, '') AS title, CASE WHEN l.doc_id IS NULL THEN '' ELSE coalesce(d.lang, '') END AS author
  FROM facts f JOIN documents d ON f.doc_id = d.doc_id LEFT JOIN labels l ON f.doc_id = l.doc_id),
checks AS (
  SELECT doc_id, 1 AS ord, 'file_size' AS check_name, CASE WHEN n_bytes > 500 * 1048576 THEN 'fail' WHEN n_bytes > 100 * 1048576 THEN 'warning' ELSE 'pass' END AS status, printf('%.1f MB', n_bytes / 1048576.0::DOUBLE) AS message FROM book
  UNION ALL SELECT doc_id, 2, 'page_count', CASE WHEN n_pages < 24 THEN 'fail' WHEN n_pages > 1000 THEN 'warning' ELSE 'pass' END, n_pages || ' pages' FROM book
  UNION ALL SELECT doc_id, 3, 'metadata', CASE WHEN title <> '' AND author <> '' THEN 'pass' ELSE 'warning' END, 'title ' || title || ', author ' || author FROM book
  UNION ALL SELECT doc_id, 4, 'text_extraction', CASE WHEN first_filled THEN 'pass' ELSE 'warning' END, first_chars || ' characters on the first page' FROM book
  UNION ALL SELECT doc_id, 5, 'text_indentation_patterns', CASE WHEN eligible < 10 THEN 'warning' WHEN indented / eligible > 0.7 THEN 'pass' WHEN indented / eligible > 0.5 THEN 'warning' ELSE 'fail' END,
    CASE WHEN eligible < 10 THEN 'too few lines' ELSE indented || '/' || eligible || ' lines indented' END FROM book
  UNION ALL SELECT doc_id, 6, 'page_content_distribution', CASE WHEN sparse <> '' THEN 'warning' ELSE 'pass' END, CASE WHEN sparse <> '' THEN 'pages with few lines: ' || replace(sparse, ',', ', ') ELSE 'no page with few lines' END FROM book
  UNION ALL SELECT doc_id, 7, 'kdp_page_breaks', 'warning', 'page breaks are to be looked at by hand' FROM book
  UNION ALL SELECT doc_id, 8, 'kdp_standards_reference', 'pass', 'standards of print' FROM book)"""

CATALOGUE = {
    "doc_word_counts": (doc_word_counts, f"SELECT doc_id, {S.count('text')} AS n_words FROM documents"),
    "silo_word_totals": (silo_word_totals, f"SELECT doc_id % 11 AS silo, CAST(sum({S.count('text')}) AS BIGINT) AS n_words, count(*) AS n_docs FROM documents GROUP BY 1"),
    "citation_counts": (citation_counts, "SELECT doc_id, CAST((length(t) - length(replace(t, '[^src-', ''))) / 6 AS BIGINT) AS n_hits FROM (SELECT doc_id, replace(text, ' of ', ' [^src-1] ') AS t FROM documents)"),
    "web_snippets": (web_snippets, f"SELECT doc_id, array_to_string(({S.words('text')})[1:40], ' ') AS snippet FROM documents"),
    "normalize_pdf": (_normal(T.normalize_pdf), _digest(f"regexp_replace({S.replaced('text', T.SPACES)}, '{symbols(T.SYMBOL_RANGES)}', '', 'g')")),
    "normalize_latin1": (_normal(T.normalize_latin1), _digest(f"regexp_replace({S.replaced('text', T.LATIN1)}, '[^\\x{{0}}-\\x{{ff}}]', '', 'g')")),
    "normalize_html": (_normal(T.normalize_html), _digest(f"regexp_replace({S.replaced('text', T.HTML)}, '{symbols(T.SYMBOL_RANGES + T.DRAWING_RANGES)}', '', 'g')")),
    "normalize_epub": (_normal(T.normalize_epub), _digest(S.replaced("text", T.SPACES))),
    "escape_xml": (_normal(T.escape_xml), _digest(S.replaced("text", [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]))),
    "escape_markup": (_normal(T.escape_html), _digest(_ESC)),
    "chunk_paragraphs": (chunk_paragraphs, _chunks(f"list_filter(string_split(text, chr(10)), lambda x: {S.strip('x')} <> '')", 3500, "chr(10) || chr(10)", 2, True)),
    "chunk_words": (chunk_words, _chunks(S.words("text"), 2000, "' '", 2, False)),
    "text_paragraphs": (text_paragraphs, f"WITH {S.PARAGRAPHS} SELECT * FROM paragraphs"),
    "text_sections": (text_sections, f"WITH {S.PARAGRAPHS} SELECT * FROM text_sections"),
    "structure_counts": (structure_counts, f"WITH {S.PARAGRAPHS} SELECT doc_id, count(*) AS n_sections, CAST(sum(n_paragraphs) AS BIGINT) AS n_paragraphs, CAST(sum(n_words) AS BIGINT) AS n_words FROM text_sections GROUP BY doc_id"),
    "first_para_flags": (first_para_flags, _BLOCKS + " SELECT doc_id, section_no, block_no, type = 'paragraph' AND coalesce(lag(type) OVER (PARTITION BY doc_id, section_no ORDER BY block_no) = 'heading', true) AS first_after_heading FROM blocks WHERE type <> 'quote'"),
    "render_plan": (render_plan, _BLOCKS + " SELECT doc_id, section_no, block_no, CASE WHEN type = 'heading' THEN 'title' WHEN type = 'quote' THEN 'quote' WHEN block_no = 1 THEN 'first' ELSE 'body' END AS style, type = 'heading' AND section_no > min(section_no) OVER (PARTITION BY doc_id) AS page_break FROM blocks"),
    "block_to_html": (block_to_html, _BLOCKS + " SELECT doc_id, section_no, block_no, md5(h) AS digest FROM html"),
    "doc_html": (doc_html, _BLOCKS + " SELECT doc_id, md5(string_agg(h, chr(10) ORDER BY section_no, block_no)) AS digest, count(*) AS n_blocks FROM html GROUP BY doc_id"),
    "strip_evidence_gaps": (strip_evidence_gaps, f"""WITH {S.LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN ' **Evidence gap: ' || line WHEN line_no % 7 = 5 THEN '# ' || line ELSE line END AS line FROM lines),
s AS (SELECT *, last_value(CASE WHEN starts_with(lower({S.strip('line')}), '**evidence') OR starts_with(lower({S.strip('line')}), 'evidence gap') THEN 1 WHEN starts_with(line, '#') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS st FROM m)
SELECT doc_id, count(*) AS n_lines, CAST(sum(line_no) AS BIGINT) AS line_sum FROM s WHERE coalesce(st, 0) = 0 GROUP BY doc_id"""),
    "heading_pairs": (heading_pairs, f"""WITH {S.LINES}, p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM lines),
h AS (SELECT *, coalesce(length({S.strip('line')}) > 0 AND length({S.strip('line')}) < 50 AND length({S.strip('nxt')}) > 2 * length({S.strip('line')}), false) AS hit FROM p),
r AS (SELECT *, sum(CAST(NOT hit AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS rk FROM r WHERE hit)
SELECT doc_id, line_no, line, nxt AS next, regexp_matches(nxt, '^[ \\t]{{2}}') AS indented FROM k WHERE rk % 2 = 1"""),
    "indent_ratio": (indent_ratio, f"""WITH l AS (SELECT doc_id, regexp_matches(line, '^[ \\t]{{2}}') AS inside, {S.strip('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, inside, NOT inside AND length(s) > 10 AND NOT regexp_matches(s, '^[\\p{{Lu}}\\p{{Nd}}\\x{{b2}}\\x{{b3}}\\x{{b9}}]') AS other FROM l WHERE length(s) > 0)
SELECT doc_id, count(*) FILTER (inside) AS indented, count(*) FILTER (inside OR other) AS eligible, round(count(*) FILTER (inside) / nullif(count(*) FILTER (inside OR other), 0), 6) AS ratio FROM f GROUP BY doc_id"""),
    "sparse_pages": (sparse_pages, f"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length({S.strip('line')}) > 0 GROUP BY doc_id HAVING count(*) < 5"),
    "compile_manuscript": (compile_manuscript, f"SELECT source, doc_id, CAST(coalesce(sum(n + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n AS n_chars, digest FROM (SELECT source, doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT source, doc_id, {S.strip("CASE WHEN doc_id % 2 = 0 THEN 'Final. ' || text ELSE text END")} AS t FROM documents) WHERE t <> '')"),
    "size_bucket_avg": (size_bucket_avg, f"SELECT CASE WHEN n < 5000 THEN 'small' WHEN n < 20000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n_docs, round(avg(n), 6) AS avg_words FROM (SELECT {S.count('text')} AS n FROM documents) GROUP BY 1"),
    "cost_rollup": (cost_rollup, f"""WITH c AS (SELECT source, doc_id, CASE lang WHEN 'en' THEN 'large' WHEN 'de' THEN 'small' ELSE 'other' END AS model, {S.count('text')} AS n FROM documents),
p AS (SELECT *, n // 4 AS o, CASE model WHEN 'small' THEN 0.0015::DOUBLE ELSE 0.01::DOUBLE END AS i_price, CASE model WHEN 'small' THEN 0.002::DOUBLE ELSE 0.03::DOUBLE END AS o_price FROM c)
SELECT source, count(*) AS n_calls, CAST(sum(n + o) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum(n / 1000::DOUBLE * i_price + o / 1000::DOUBLE * o_price), 6) AS cost, arg_max(model, doc_id) AS model_used FROM p GROUP BY source"""),
    "draft_cap_gate": (draft_cap_gate, f"SELECT doc_id, b AS before, CASE WHEN b < {DRAFT_CAP} THEN 'admitted' ELSE 'draft_total_cap' END AS reason FROM (SELECT doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM (SELECT doc_id, lang, {S.count('text')} AS n FROM documents))"),
    "page_windows": (page_windows, _PAGES + " SELECT * FROM facts"),
    "rule_engine_docs": (rule_engine_docs, _CHECKS + " SELECT * FROM checks"),
    "severity_rollup": (severity_rollup, _CHECKS + " SELECT doc_id, CASE max(CASE status WHEN 'error' THEN 3 WHEN 'fail' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END AS overall FROM checks GROUP BY doc_id"),
    "status_pivot": (status_pivot, _CHECKS + " SELECT check_name, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("pass", "warning", "fail", "error", "info")) + " FROM checks GROUP BY check_name"),
    "blockers_list": (blockers_list, _CHECKS + " SELECT doc_id, string_agg(check_name || ': ' || message, '; ' ORDER BY ord) AS blockers FROM checks WHERE status IN ('fail', 'error') GROUP BY doc_id"),
    "accuracy_score": (accuracy_score, "SELECT doc_id, found, expected, CAST(CASE WHEN expected IS NULL THEN NULL WHEN found = expected THEN 100 WHEN abs(found - expected) <= 1 THEN 75 ELSE greatest(0, 100 - 10 * abs(found - expected)) END AS BIGINT) AS score FROM (SELECT d.doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS found, l.doc_id % 12 + 1 AS expected FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"),
    "detection_report": (detection_report, "SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'ai' ELSE 'regex' END AS method, count(*) FILTER (quality = 1) AS n_ok, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality IS NULL) AS n_unknown, round(avg(n_chars), 6) AS avg_chars, round(CAST(sum(n_chars) AS DOUBLE) / nullif(count(quality), 0), 6) AS chars_per_label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "method_overhead": (method_overhead, "SELECT round(x, 6) AS avg_ai, round(y, 6) AS avg_regex, round((x - y) / y * 100, 6) AS overhead_pct FROM (SELECT avg(n_chars) FILTER (doc_id % 2 = 0) AS x, avg(n_chars) FILTER (doc_id % 2 = 1) AS y FROM documents)"),
    "method_compare": (method_compare, "SELECT source, nullif(count(*) FILTER (doc_id % 2 = 0), 0) AS n_ai, CAST(sum(n_chars) FILTER (doc_id % 2 = 0) AS BIGINT) AS chars_ai, nullif(count(*) FILTER (doc_id % 2 = 1), 0) AS n_regex, CAST(sum(n_chars) FILTER (doc_id % 2 = 1) AS BIGINT) AS chars_regex, CAST(coalesce(sum(n_chars) FILTER (doc_id % 2 = 0), 0) - coalesce(sum(n_chars) FILTER (doc_id % 2 = 1), 0) AS BIGINT) AS diff FROM documents GROUP BY source"),
}
