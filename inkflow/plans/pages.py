"""Queries over pages: cleaning, ordered gates, URLs, source queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.plans import sqltext as S
from inkflow.session import table

TERMS = ["tion", "schen", "ación"]
MIN_WORDS = 300


def cleaned(pages) -> DataFrame:
    """page_id, clean, n_words: each page is cleaned and counted once."""
    both = T.bound(T.html_clean(F.col("html")), lambda t: F.struct(t.alias("clean"), T.word_count(t).alias("n_words")))
    return pages.select("page_id", both.alias("c")).select("page_id", "c.clean", "c.n_words")


def gated(spark, sf_dir) -> DataFrame:
    """page_id, words, reason: the first gate that a page fails, in the ingest order."""
    clean = cleaned(table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit(""))))
    t, n = F.col("clean"), F.col("n_words")
    return clean.select("page_id", "n_words", F.when(T.looks_blocked(t), "blocked").when(n < MIN_WORDS, "too_short").when(~T.mentions(t, TERMS), "off_topic").otherwise("accepted").alias("reason"))


_GATED = f"""gated AS (
  SELECT page_id, {S.count('t')} AS n_words, CASE WHEN {S.contains_any('substring(lower(t), 1, 2000)', T.BLOCKED)} THEN 'blocked' WHEN {S.count('t')} < {MIN_WORDS} THEN 'too_short'
         WHEN NOT {S.contains_any('lower(substring(t, 1, 8000))', TERMS)} THEN 'off_topic' ELSE 'accepted' END AS reason
  FROM (SELECT page_id, {S.HTML_CLEAN.replace('html', "coalesce(html, '')", 1)} AS t FROM pages))"""


def ingest_funnel(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n_pages"), F.sum("n_words").alias("n_words"))


def ingest_gate(spark, sf_dir):
    return gated(spark, sf_dir)


def html_clean(spark, sf_dir):
    return cleaned(table(spark, sf_dir, "pages"))


def blocked_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.looks_blocked(F.coalesce("html", F.lit(""))).alias("blocked"))


def topic_relevance(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.mentions(F.coalesce("html", F.lit("")), TERMS).alias("on_topic"))


#: Patterns that both engines read: what is no text, marks for the beginnings of headings, of paragraphs and of anything else
#: that ends them, and the tags that are left.  Quoted values may hold what looks like a tag's end.
NO_TEXT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_REST = r"""(?:"[^"]*"|'[^']*'|[^"'>])*>"""
MARKS = [
    (rf"(?i)<h[1-3](?:\s{_REST}|>)", "\x01H"), (rf"(?i)<p(?:\s{_REST}|>)", "\x01P"),
    (rf"(?i)</?(?:h[1-6]|p|div|section|article|main|header|footer|nav|aside|ul|ol|li|table|tr|td|blockquote|form|body|html|head|title)(?:\s{_REST}|>)", "\x01X"),
    (rf"(?i)</?[a-z]{_REST}", ""),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&nbsp;", "\u00a0"), ("&#39;", "'"), ("&amp;", "&")]


def html_sections(spark, sf_dir):
    """Headings and paragraphs in page order, whole texts without their inline tags; every heading starts a section.  Sections
    without paragraphs drop, and so do paragraphs before the first heading; a page without sections is one, Document Content,
    of all its paragraphs."""
    bare = F.regexp_replace(F.col("html"), NO_TEXT, "")
    for pattern, mark in MARKS:
        bare = F.regexp_replace(bare, pattern, mark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(bare, "\x01")).alias("pos", "tok"))
    rows = rows.select("page_id", "pos", F.left("tok", F.lit(1)).alias("kind"), T.strip(T.replaced(F.expr("substring(tok, 2)"), ENTITIES)).alias("txt"))
    rows = rows.where("pos > 0 and (kind = 'H' or kind = 'P' and txt <> '')")
    page = Window.partitionBy("page_id")
    head = F.col("kind") == "H"
    rows = rows.withColumn("section_no", F.sum(head.cast("long")).over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("any", F.max(~head & (F.col("section_no") > 0)).over(page))
    rows = rows.withColumn("section_no", F.when(F.col("any"), F.col("section_no")).otherwise(0)).where("section_no > 0 or not any")
    title = F.when(F.max("any"), F.max(F.when(head, F.col("txt")))).otherwise("Document Content")
    found = rows.groupBy("page_id", "section_no").agg(title.alias("title"), F.count_if(~head).alias("n_paragraphs"), F.sum(F.when(~head, F.length("txt"))).alias("n_chars"))
    return found.where("n_paragraphs > 0")


def _marked(c: str) -> str:
    for pattern, mark in [(NO_TEXT, ""), *MARKS]:
        c = f"regexp_replace({c}, {S.quote(pattern)}, {S.quote(mark)}, 'g')"
    return c


_SECTIONS = f"""WITH toks AS (SELECT page_id, string_split({_marked('html')}, chr(1)) AS t FROM pages),
r AS (SELECT * FROM (SELECT page_id, pos, tok[1:1] AS kind, {S.strip(S.replaced('tok[2:]', ENTITIES))} AS txt FROM (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM toks)) WHERE pos > 0 AND (kind = 'H' OR kind = 'P' AND txt <> '')),
n AS (SELECT *, sum(CAST(kind = 'H' AS INT)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM r),
a AS (SELECT *, bool_or(kind = 'P' AND k > 0) OVER (PARTITION BY page_id) AS found FROM n)
SELECT page_id, CAST(CASE WHEN found THEN k ELSE 0 END AS BIGINT) AS section_no, CASE WHEN bool_or(found) THEN max(CASE WHEN kind = 'H' THEN txt END) ELSE 'Document Content' END AS title,
       count(*) FILTER (kind = 'P') AS n_paragraphs, CAST(sum(CASE WHEN kind = 'P' THEN length(txt) END) AS BIGINT) AS n_chars
FROM a WHERE k > 0 OR NOT found GROUP BY 1, 2, found HAVING count(*) FILTER (kind = 'P') > 0"""


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.authority(url).alias("authority"), F.regexp_extract(url, r"/status/(\d+)", 1).alias("status_id"), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path")
    )


def url_routing(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(T.any_of(url, T.POST_DOMAINS), "post").when(T.any_of(url, T.READER_DOMAINS), "reader").otherwise("direct").alias("route"))


def queue_new_sources(spark, sf_dir):
    """New URLs against known ones (odd pages): repeats within the batch stay."""
    pages = table(spark, sf_dir, "pages")
    known = pages.where("page_id % 2 = 1").select("url")
    batch = pages.select("page_id", "url", F.lit(1).alias("copy")).unionByName(pages.where("page_id % 10 = 0").select("page_id", "url", F.lit(2).alias("copy")))
    return batch.where("coalesce(url, '') <> ''").join(known, "url", "left_anti").select("page_id", "url", "copy")


def ordered_distinct_urls(spark, sf_dir):
    """Each authority where it is first seen."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.authority(F.col("url")).alias("authority"))
    return pages.groupBy("authority").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def discovery_union(spark, sf_dir):
    """Two lists after one another, then first occurrences."""
    pages = table(spark, sf_dir, "pages")
    both = pages.where("page_id % 3 = 0").select("url", F.col("page_id").alias("ord")).unionByName(pages.select("url", (F.col("page_id") + 1000000000).alias("ord")))
    return both.groupBy("url").agg(F.min("ord").alias("ord"))


def search_pair_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(T.authority(F.col("url")).alias("site"), F.concat(F.lit("cse:silo_"), (F.col("page_id") % 11).cast("string")).alias("label"), "page_id")
    return pages.groupBy("site", "label").agg(F.min("page_id").alias("ord")).withColumn("silo", T.forced_silo(F.col("label")))


def sources_page(spark, sf_dir):
    """Bullets of ordered unique URLs, a row each, with the place of each in its authority's page below the heading.  No
    authority is gathered: places come from sums per range of ord."""
    from inkflow.plans.documents import words_before

    pages = table(spark, sf_dir, "pages").where("coalesce(url, '') <> ''")
    one = pages.groupBy("url").agg(F.min("page_id").alias("doc_id")).withColumn("authority", T.authority(F.col("url")))
    bullets = one.select("authority", "doc_id", F.concat(F.lit("- "), "url").alias("bullet"), (F.length("url") + 3).cast("long").alias("n"))
    heading = len("# Sources\n\n")
    return words_before(bullets, ["authority"]).select("authority", F.col("doc_id").alias("ord"), "bullet", (F.col("before") + heading).alias("offset"))


def _either(words: list[str]) -> str:
    return S.contains_any("url", words)


_AUTH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
CATALOGUE = {
    "ingest_funnel": (ingest_funnel, f"WITH {_GATED} SELECT reason, count(*) AS n_pages, CAST(sum(n_words) AS BIGINT) AS n_words FROM gated GROUP BY reason"),
    "ingest_gate": (ingest_gate, f"WITH {_GATED} SELECT * FROM gated"),
    "html_clean": (html_clean, f"SELECT page_id, t AS clean, {S.count('t')} AS n_words FROM (SELECT page_id, {S.HTML_CLEAN} AS t FROM pages)"),
    "blocked_pages": (blocked_pages, f"SELECT page_id, {S.contains_any('substring(lower(html), 1, 2000)', T.BLOCKED)} AS blocked FROM pages"),
    "topic_relevance": (topic_relevance, f"SELECT page_id, {S.contains_any('lower(substring(html, 1, 8000))', TERMS)} AS on_topic FROM pages"),
    "html_sections": (html_sections, _SECTIONS),
    "url_parts": (url_parts, rf"SELECT page_id, {_AUTH} AS authority, regexp_extract(url, '/status/(\d+)', 1) AS status_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"),
    "url_routing": (url_routing, f"SELECT page_id, CASE WHEN {_either(T.POST_DOMAINS)} THEN 'post' WHEN {_either(T.READER_DOMAINS)} THEN 'reader' ELSE 'direct' END AS route FROM pages"),
    "queue_new_sources": (queue_new_sources, "SELECT page_id, url, copy FROM (SELECT page_id, url, 1 AS copy FROM pages UNION ALL SELECT page_id, url, 2 FROM pages WHERE page_id % 10 = 0) b WHERE NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_id % 2 = 1 AND k.url = b.url) AND coalesce(url, '') <> ''"),
    "ordered_distinct_urls": (ordered_distinct_urls, f"SELECT {_AUTH} AS authority, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1"),
    "discovery_union": (discovery_union, "SELECT url, min(ord) AS ord FROM (SELECT url, page_id AS ord FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, page_id + 1000000000 FROM pages) GROUP BY url"),
    "search_pair_dedup": (search_pair_dedup, f"SELECT {_AUTH} AS site, 'cse:silo_' || CAST(page_id % 11 AS VARCHAR) AS label, min(page_id) AS ord, CAST(page_id % 11 AS INT) AS silo FROM pages GROUP BY 1, 2, 4"),
    "sources_page": (sources_page, f"SELECT authority, ord, '- ' || url AS bullet, CAST(11 + coalesce(sum(length(url) + 3) OVER (PARTITION BY authority ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT url, min(page_id) AS ord, {_AUTH} AS authority FROM pages WHERE coalesce(url, '') <> '' GROUP BY url)"),
}
