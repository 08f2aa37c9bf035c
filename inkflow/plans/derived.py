"""Small tables of the content pipeline, derived from the given tables by expressions that both engines read.

The given tables have no ideas, briefs, posts, style sheets or packaged books; these relations put such columns together
from the columns there are, one row a row, so that the queries over them grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkflow.session import table

#: name: (table, (column, expression), ...); two expressions are Spark's and DuckDB's.  DuckDB's cast of a double to a whole
#: number rounds, halves to even, and Spark's cuts.
RELATIONS: dict[str, tuple] = {
    "wrapped": ("documents", ("id", "doc_id"), ("t", "split(replace(replace(coalesce(text, ''), 'ti', concat('ti-', chr(10))), concat(chr(10), chr(10)), chr(10)), chr(10))")),
    "symbols": ("documents", ("id", "doc_id"), ("t", "replace(replace(replace(replace(coalesce(text, ''), '.', ' … • ● ✓☀.'), 'the', '‘the’'), 'an', 'a­&n '), 'or', '→<r>—\U0001f600''\"')")),
    "slugs": ("documents", ("id", "doc_id"), ("t", "coalesce(text, '')")),
    "lists": ("documents", ("id", "doc_id"), ("t", "concat(coalesce(text, ''), ',', source, ', ', coalesce(text, ''))")),
    "terms": ("documents", ("id", "doc_id"), ("name", "source"), ("kw", "split(replace(replace(coalesce(text, ''), chr(10), ''), 'e', '\"'), ',')")),
    "numbers": ("pages", ("id", "page_id"), ("t", "replace(replace(replace(coalesce(url, ''), '/', ' '), '?', ' '), '=', ' ')")),
    "labelled": ("documents", ("id", "doc_id"), ("t", "CASE WHEN doc_id % 5 = 0 THEN 'discovery' WHEN doc_id % 7 = 0 THEN concat('cse:silo_', lang) ELSE concat('cse:silo_', CAST(doc_id % 13 AS STRING)) END")),
    "placeholders": ("documents", ("id", "doc_id"), ("t", "replace(replace(replace(coalesce(text, ''), ' the ', ' [[image: a]] '), ' of ', ' [[Cover:b]] '), ' to ', ' [[BACK_COVER: c d ]][[IMAGE:a]] ')")),
    "ideas": (
        "documents", ("id", "doc_id"), ("topic_id", "doc_id % 5"), ("status", "CASE doc_id % 3 WHEN 0 THEN 'backlog' WHEN 1 THEN 'assigned' ELSE 'done' END"),
        ("silo", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 11 AS INT) END"), ("t", "coalesce(text, '')"),
    ),
    "briefs": ("orders", ("topic_id", "o_custkey"), ("silo", "CAST(o_orderkey % 11 AS INT)"), ("brief", "o_orderpriority")),
    "topics": ("customer", ("topic_id", "c_custkey"), ("name", "c_name"), ("created", ("CAST(rint(c_acctbal) AS BIGINT)", "CAST(c_acctbal AS BIGINT)"))),
    "topic_rows": ("customer", ("id", "c_custkey"), ("name", "c_name"), ("created", ("CAST(rint(c_acctbal) AS BIGINT)", "CAST(c_acctbal AS BIGINT)"))),
    "silos": ("orders", ("silo_id", "o_orderkey"), ("topic_id", "o_custkey"), ("silo", "CAST(o_orderkey % 11 AS INT)")),
    "trends": ("events", ("id", "event_id"), ("source", "event_type"), ("name", "CAST(user_id AS STRING)")),
    "known_trends": ("customer", ("source", "CASE c_mktsegment WHEN 'BUILDING' THEN 'click' WHEN 'MACHINERY' THEN 'view' ELSE 'purchase' END"), ("name", "CAST(c_custkey AS STRING)")),
    "sources": ("pages", ("id", "page_id"), ("topic_id", "page_id % 5"), ("status", "CASE page_id % 3 WHEN 0 THEN 'extracted' ELSE 'pending' END"), ("url", "url")),
    "reviews": ("events", ("id", "event_id"), ("t", "CASE event_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN NULL WHEN 2 THEN '{\"notes\": \"no score\"}' ELSE replace(props, '\"k\"', '\"score\"') END")),
    "questions": ("events", ("id", "event_id"), ("t", "CASE event_id % 3 WHEN 0 THEN concat('[\"', event_type, '\",\"b\",\"c\",\"d\",\"', CAST(user_id AS STRING), '\"]') WHEN 1 THEN '[\"a\",\"b\",\"c\",\"d\"]' ELSE 'oops' END")),
    "posts": (
        "events", ("id", "event_id"), ("author", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END"), ("likes", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 17 END"),
        ("reposts", "event_id % 5"), ("replies", "event_id % 3"), ("quotes", "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 1 END"), ("url", "CASE WHEN event_type = 'error' THEN NULL ELSE concat('http://e/', CAST(user_id % 40 AS STRING)) END"),
    ),
    "accuracy": (
        "documents", ("id", "doc_id"), ("found", "CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT)"), ("expected", "doc_id % 12 + 1"),
        ("low", "doc_id % 12"), ("high", "doc_id % 12 + 3"),
    ),
    "stamps": ("events", ("id", "event_id"), ("s", ("unix_timestamp(CAST(ts AS TIMESTAMP)) - 1704067200", "CAST(floor(epoch(ts)) AS BIGINT) - 1704067200"))),
    "output": (
        "events", ("id", "CAST(floor(event_id / 5.0) AS BIGINT)"), ("ord", "CAST(event_id % 5 AS INT)"),
        ("line", "CASE WHEN event_type = 'error' THEN concat('ERROR(', props, '): bad') WHEN event_type = 'view' THEN concat('  WARNING(X): ', CAST(user_id AS STRING)) WHEN event_id % 7 = 0 THEN 'No errors or warnings detected' ELSE 'strange' END"),
    ),
    "calls": ("events", ("id", "event_id"), ("post", "event_type = 'view'"), ("ok", "value >= 5")),
    "names": ("lineitem", ("id", "l_orderkey"), ("name", "CASE l_linenumber % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'author' ELSE 'language' END"), ("value", "CASE l_returnflag WHEN 'R' THEN '' WHEN 'N' THEN NULL ELSE l_linestatus END")),
    "results": (
        "lineitem", ("run", "l_orderkey"), ("silo", "l_linenumber"), ("result", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'chapter written' END"),
        ("error", "CASE WHEN l_returnflag = 'R' THEN concat('timeout ', CAST(l_partkey AS STRING)) ELSE NULL END"),
    ),
    "book_briefs": ("part", ("id", "p_partkey"), ("title", "p_name"), ("goal", "p_brand"), ("notes", "p_type")),
    "patches": ("supplier", ("id", "s_suppkey"), ("title", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END"), ("goal", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'New goal' END"), ("notes", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'y' END")),
    "sessions": ("events", ("id", "event_id"), ("seen_at", "CAST(ts AS STRING)")),
    "queries": ("documents", ("id", "doc_id"), ("q", "concat(coalesce(lang, ''), ' ', coalesce(source, ''), ' é&\"+/=', CAST(doc_id AS STRING))")),
    "print_files": (
        "documents", ("doc", "CAST(doc_id AS STRING)"), ("mb", "CASE WHEN lang = 'de' THEN NULL ELSE CAST(n_chars AS DOUBLE) / 20 END"), ("pages", "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(n_chars % 1100 AS INT) END"),
        ("version", "CASE doc_id % 4 WHEN 0 THEN '1.3' WHEN 1 THEN '1.6' WHEN 2 THEN '2.0' ELSE NULL END"), ("fonts", "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 4 AS INT) END"), ("embedded", "CAST(doc_id % 3 AS INT)"),
        ("title", "source"), ("author", "CASE WHEN lang = 'en' THEN 'An Author' ELSE '' END"), ("page_size", "CASE doc_id % 3 WHEN 0 THEN '432 x 648 pts (6 x 9 in)' WHEN 1 THEN '595 x 842 pts' ELSE NULL END"),
        ("width", "CASE doc_id % 3 WHEN 0 THEN CAST(432 AS DOUBLE) WHEN 1 THEN CAST(595 AS DOUBLE) ELSE NULL END"), ("height", "CASE doc_id % 3 WHEN 0 THEN CAST(648 AS DOUBLE) WHEN 1 THEN CAST(842 AS DOUBLE) ELSE NULL END"),
        ("first_page", "substring(text, 1, 12)"), ("indented", "CAST(n_chars % 101 AS INT)"), ("eligible", "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 100 END"), ("spacing", "doc_id % 2 = 0"), ("no_indent", "doc_id % 3 = 0"),
        ("drop_caps", "doc_id % 5 = 0"), ("starts", "CAST(doc_id % 6 AS INT)"), ("indented_starts", "CAST(doc_id % 2 AS INT)"), ("sparse", "CAST(doc_id % 4 AS INT)"),
    ),
    "sheets": (
        "documents", ("sheet", "CAST(doc_id AS STRING)"), ("caps", "CASE WHEN lang = 'en' THEN true WHEN lang = 'de' THEN false ELSE NULL END"), ("wanted", "CASE WHEN lang = 'fr' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END"),
        ("css", "concat('p { text-indent: 0.', CAST(doc_id % 6 AS STRING), 'in; orphans: ', CAST(doc_id % 5 AS STRING), '; widows: ', CAST(n_chars % 5 AS STRING), ' }', chr(10), CASE WHEN lang = 'en' THEN '.first-para { text-indent: 0 }' ELSE '' END, chr(10), "
         "CASE WHEN doc_id % 2 = 0 THEN 'h1 + p { text-indent: 0 }' ELSE '.chapter-title + p { text-indent: 0 }' END, chr(10), '.chapter { page-break-before: always }', chr(10), '@page {', chr(10), ' margin: 0.', CAST(n_chars % 100 AS STRING), 'in }', chr(10), "
         "CASE WHEN doc_id % 3 = 0 THEN concat('.d::first-letter { line-height: ', CAST(doc_id % 3 AS STRING), '.8; margin-right: 0.0', CAST(n_chars % 10 AS STRING), 'em }') ELSE 'h1 { page-break-after: avoid }' END)"),
    ),
    "members": (
        "lineitem", ("book", "CAST(l_suppkey AS STRING)"),
        ("name", "CASE WHEN l_linenumber = 1 THEN 'mimetype' WHEN l_linenumber = 2 THEN 'META-INF/container.xml' WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'book.opf' WHEN l_linenumber = 4 AND l_partkey % 9 = 0 THEN 'nav.xhtml' "
         "WHEN l_linenumber = 5 THEN concat('f', CAST(l_partkey AS STRING), '.OTF') WHEN l_linenumber = 6 AND l_partkey % 20 = 0 THEN 'OFL.txt' ELSE concat('c', CAST(l_partkey AS STRING), '.xhtml') END"),
        ("size", "CAST(l_quantity * 640000 AS BIGINT)"),
    ),
    "packages": (
        "supplier", ("book", "CAST(s_suppkey AS STRING)"),
        ("opf", "CASE s_suppkey % 4 WHEN 0 THEN concat('<package><metadata><dc:title>', s_name, '</dc:title><dc:creator>B</dc:creator><dc:language>en</dc:language></metadata></package>') WHEN 1 THEN '<package><metadata><dc:title id=''t''>A</dc:title><dc:creator/></metadata></package>' WHEN 2 THEN '<package><spine/></package>' ELSE NULL END"),
    ),
    "blocks": (
        "events", ("doc", "CAST(floor(event_id / 12.0) AS BIGINT)"), ("ord", "CAST(event_id % 12 AS INT)"),
        ("type", "CASE (event_id * 7 + user_id) % 11 WHEN 0 THEN 'chapter' WHEN 1 THEN 'heading' WHEN 2 THEN 'quote' WHEN 3 THEN 'footnote' WHEN 4 THEN 'image' WHEN 5 THEN 'front_matter' WHEN 6 THEN 'back_matter' ELSE 'paragraph' END"),
        ("level", "CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END"), ("text", "CASE WHEN event_id % 23 = 0 THEN '  ' ELSE concat(event_type, ' ', props, ' ') END"),
        ("style", "CASE WHEN user_id % 4 = 0 THEN 'blockquote' ELSE NULL END"), ("attribution", "CASE WHEN user_id % 2 = 0 THEN 'Someone' ELSE NULL END"), ("caption", "CASE WHEN event_id % 2 = 0 THEN 'Its name' ELSE NULL END"),
        ("number", "CASE WHEN event_id % 3 = 0 THEN 'x' ELSE concat('[', CAST(user_id AS STRING), ']') END"),
    ),
    "metadata": (
        "documents", ("id", "doc_id"), ("title", "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE substring(text, 1, 20) END"), ("author", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END"), ("language", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END"),
        ("isbn", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE CAST(n_chars AS STRING) END"),
    ),
    "small": (
        "documents", ("id", "doc_id"), ("t", "concat(replace(coalesce(text, ''), ' ', '_'), CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END)"), ("seconds", "CAST(n_chars AS DOUBLE) / 8"),
        ("n", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(n_chars % 200 AS INT) END"), ("margin", "CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE concat(CAST(doc_id % 2 AS STRING), '.', CAST(n_chars % 10 AS STRING)) END"),
        ("flag", "CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'ON' WHEN 2 THEN '1' ELSE 'no' END"), ("bytes", "n_chars * n_chars"),
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, *columns = RELATIONS[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in columns))


def derived_sql(name: str, alias: str) -> str:
    """A CTE of the relation."""
    source, *columns = RELATIONS[name]
    return f"{alias} AS (SELECT " + ", ".join(f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in columns) + f" FROM {source})"
