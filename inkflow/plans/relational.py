"""Relational queries of the content pipeline, and function queries over columns derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.plans import fixtures as X
from inkflow.plans import sqltext as S
from inkflow.plans.derived import derived, derived_sql
from inkflow.session import table


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


#: Cases worked out by hand, which the tests run through the same functions and SQL.
CASES: list[tuple] = []


def v(fn, name, columns, data, sql, schema, of):
    """A query over a derived relation, and its SQL."""
    CASES.append((fn, data, schema, "WITH " + S.values(name, columns, data) + " " + sql))
    return (lambda spark, sf_dir: fn(derived(spark, sf_dir, of)), "WITH " + derived_sql(of, name) + " " + sql)


def _fields(**kw):
    """Columns of functions of t; they are made when the query runs, as columns need a session."""
    return lambda d: d.select("id", *[fn(F.col("t")).alias(k) for k, fn in kw.items()])


#: Fixed value: ideas that a context takes.
CONTEXT_IDEAS = 25


def topic_silo_grid(spark, sf_dir):
    return derived(spark, sf_dir, "topics").select("topic_id", "name").crossJoin(F.broadcast(rows(spark, X.SILO_TITLES, "silo int, title string")))  # 11 literal rows


def ensure_briefs(spark, sf_dir):
    grid = topic_silo_grid(spark, sf_dir).where("silo > 0")
    return grid.join(derived(spark, sf_dir, "briefs"), ["topic_id", "silo"], "left_anti").select("topic_id", "silo", "title")


def trend_upsert(spark, sf_dir):
    new = derived(spark, sf_dir, "trends").groupBy("source", "name").agg(F.min("id").alias("id"))
    return new.join(derived(spark, sf_dir, "known_trends"), ["source", "name"], "left_anti")


def silo_title_lookup(spark, sf_dir):
    d = derived(spark, sf_dir, "numbers").select("id", T.silo_token(F.col("t")).alias("silo"))
    return d.join(F.broadcast(rows(spark, X.SILO_TITLES, "silo int, title string")), "silo", "left").select("id", "silo", F.coalesce("title", F.lit("Unclassified")).alias("title"))  # 11 literal rows


def search_query_grid(spark, sf_dir):
    t = rows(spark, X.TEMPLATE_ROWS, "silo int, template string")
    s = table(spark, sf_dir, "pages").select(T.authority(F.col("url")).alias("site")).distinct()
    return s.crossJoin(F.broadcast(t)).select("silo", "site", F.concat(F.replace("template", F.lit("{topic}"), F.lit("spark")), F.lit(" site:"), "site").alias("query"))  # thirty literal rows


def idea_pool(spark, sf_dir):
    d = derived(spark, sf_dir, "ideas")
    mine = d.where("silo = 3").select(F.lit(1).alias("branch"), "id", "t")
    return mine.unionByName(d.where("silo is null and status = 'backlog'").select(F.lit(2).alias("branch"), "id", "t"))


def chapter_context(spark, sf_dir):
    """Per silo: title, brief or default, and its first ideas in order: a task keeps so many of each silo before any row
    moves."""
    silos = rows(spark, X.SILO_TITLES, "silo int, title string")
    briefs = derived(spark, sf_dir, "briefs").where("topic_id = 1").groupBy("silo").agg(F.min("brief").alias("brief"))
    ideas = derived(spark, sf_dir, "ideas").where("silo is not null").withColumn("rank", F.row_number().over(Window.partitionBy("silo").orderBy("id", "t"))).where(F.col("rank") <= CONTEXT_IDEAS)
    ideas = ideas.groupBy("silo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "|").alias("ideas"))
    return silos.join(briefs, "silo", "left").join(ideas, "silo", "left").select("silo", "title", F.coalesce("brief", F.concat(F.lit("Silo "), F.col("silo").cast("string"))).alias("brief"), F.coalesce("ideas", F.lit("")).alias("ideas"))


def image_manifest(d):
    kinds = F.regexp_extract_all("t", F.lit(r"(?i)\[\[(IMAGE|COVER|BACK_COVER):(.+?)\]\]"), F.lit(1))
    what = F.regexp_extract_all("t", F.lit(r"(?i)\[\[(IMAGE|COVER|BACK_COVER):(.+?)\]\]"), F.lit(2))
    e = d.select("id", F.posexplode(F.arrays_zip(kinds.alias("k"), what.alias("w"))).alias("pos", "x"))
    return e.select("id", F.format_string("img-%03d", F.col("pos") + 1).alias("image"), F.upper("x.k").alias("kind"), F.trim("x.w").alias("description"))


def apply_images(d):
    """Every replacement in its order, all occurrences, in the text that those before it left."""
    each = F.array(*[F.struct(F.lit(a).alias("of"), F.lit(f"![Illustration]({b})").alias("to")) for a, b in X.IMAGES])
    return d.select("id", F.aggregate(each, F.col("t"), lambda t, r: F.replace(t, r["of"], r["to"])).alias("t"))


def checker_output_parse(d):
    """An output with the phrase of success passes, whatever else it says; else its errors and warnings, whole lines without
    the word; else one failure."""
    line = T.strip(F.col("line"))
    told = d.select("id", "ord", line.alias("line"), F.col("line").contains("No errors or warnings detected").alias("ok"))
    s = F.when(F.col("ok"), "pass").when(F.col("line").startswith("ERROR"), "fail").when(F.col("line").startswith("WARNING"), "warning")
    msg = F.when(F.col("ok"), "no errors or warnings").when(F.col("line").startswith("ERROR"), T.strip(F.expr("substring(line, 7)"))).otherwise(T.strip(F.expr("substring(line, 9)")))
    hit = told.select("id", "ord", s.alias("status"), msg.alias("message"))
    per = hit.groupBy("id").agg(F.min(F.when(F.col("status") == "pass", F.col("ord"))).alias("passed"), F.count("status").alias("n"))
    some = hit.where("status is not null").join(per, "id").where("passed is null or ord = passed").select("id", "ord", "status", "message")
    return some.unionByName(per.where("n = 0").select("id", F.lit(0).alias("ord"), F.lit("fail").alias("status"), F.lit("no result").alias("message")))


def json_fallback(d):
    score = F.from_json("t", "score int, notes string")
    return d.select("id", F.coalesce(score["score"], F.lit(0)).alias("score"), F.coalesce(score["notes"], F.lit("")).alias("notes"))


def questions(d):
    a = F.from_json("t", "array<string>")
    return d.select("id", F.when(F.size(a) == 5, F.array_join(a, "|")).otherwise(F.lit("canned")).alias("questions"))


def _score():
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return n("likes") + 2 * n("reposts") + n("replies") + n("quotes")


_POSTS = "id int, author string, likes int, reposts int, replies int, quotes int, url string"


def ranked(rows, k, *order):
    """The first k rows, numbered: the sort keeps k rows a task, and only these are numbered in one."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def trend_top_authors(d):
    """The best post of each author, first wins; authors in order of score, then first appearance."""
    s = d.withColumn("author", F.coalesce("author", F.lit("unknown"))).withColumn("score", _score())
    best = s.groupBy("author").agg(F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("b"), F.min("id").alias("first"))
    best = best.select("author", F.col("b.score").alias("score"), (-F.col("b.back")).alias("post"), "first")
    return ranked(best, 8, F.desc("score"), "first")


def trend_top_urls(d):
    n = d.where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return ranked(n, 10, F.desc("n"), "first")


def accuracy_tolerance(d):
    off = F.abs(F.col("found") - F.col("expected"))
    ok = F.col("found").between(F.col("low"), F.col("high"))
    return d.select("id", F.when(off == 0, 100).when(ok, 75).otherwise(F.greatest(F.lit(0), 100 - 10 * off)).alias("score"), ok.alias("within"))


_JSON_SCORE = "CASE WHEN json_valid(t) THEN coalesce(CAST(json_extract_string(t, '$.score') AS INT), 0) ELSE 0 END"
CATALOGUE = {
    "dehyphenate": v(_fields(t=T.dehyphenate), "r", "id, t", X.WRAPPED, f"SELECT id, replace(replace(array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 1 THEN x ELSE regexp_replace(x, '^{S.WS}+', '') END), chr(10)), '-' || chr(10), ''), chr(10), ' ') AS t FROM r", "id int, t array<string>", "wrapped"),
    "normalize_symbols": v(
        _fields(pdf=T.normalize_pdf, latin1=T.normalize_latin1, html=T.normalize_html, epub=T.normalize_epub, xml=T.escape_xml, esc=T.escape_html), "r", "id, t", X.SYMBOLS,
        "SELECT id, " + f"regexp_replace({S.replaced('t', T.SPACES)}, '{T.code_points(T.SYMBOL_RANGES)}+', '', 'g') AS pdf, regexp_replace({S.replaced('t', T.LATIN1)}, '[^\\x{{0}}-\\x{{ff}}]', '', 'g') AS latin1, regexp_replace({S.replaced('t', T.HTML)}, '{T.code_points(T.SYMBOL_RANGES + T.DRAWING_RANGES)}+', '', 'g') AS html, {S.replaced('t', T.SPACES)} AS epub, {S.replaced('t', [('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;')])} AS xml, "
        + S.replaced(S.replaced("t", T.SPACES), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]) + " AS esc FROM r", "id int, t string", "symbols"),
    "slugify_compat": v(_fields(slug=T.slugify_compat), "r", "id, t", X.SLUGS, r"SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9\\s-]', '', 'g'), '-+', '-', 'g'), ''), 'topic') AS slug FROM r", "id int, t string", "slugs"),
    "parse_lists": v(_fields(items=lambda t: F.array_join(T.parse_list(t), "|"), urls=lambda t: F.array_join(T.parse_url_list(t), "|")), "r", "id, t", X.LISTS,
        f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[,\\n]'), lambda x, i: CASE WHEN list_position(list_transform(regexp_split_to_array(t, '[,\\n]'), lambda y: {S.strip('y')}), {S.strip('x')}) = i THEN {S.strip('x')} ELSE '' END), lambda x: x <> ''), '|') AS items, array_to_string(list_filter(list_transform(string_split(t, CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE ',' END), lambda x, i: CASE WHEN list_position(list_transform(string_split(t, CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE ',' END), lambda y: {S.strip('y')}), {S.strip('x')}) = i THEN {S.strip('x')} ELSE '' END), lambda x: x <> ''), '|') AS urls FROM r", "id int, t string", "lists"),
    "or_query": v(lambda d: d.select("id", T.or_query(F.col("name"), F.col("kw")).alias("q")), "r", "id, name, kw", [(i, n, k) for i, n, k in X.TERMS],
        "SELECT id, CASE len(q) WHEN 0 THEN '' WHEN 1 THEN q[1] ELSE '(' || array_to_string(q, ' OR ') || ')' END AS q FROM (SELECT id, list_transform(list_filter(list_transform(list_filter(ts, lambda x, i: x <> '' AND list_position(ts, x) = i), lambda x: trim(replace(x, '\"', ''))), lambda x: x <> ''), lambda x: '\"' || x || '\"') AS q FROM (SELECT id, list_transform(list_concat([name], CAST(kw AS VARCHAR[])), lambda x: trim(x)) AS ts FROM r))", "id int, name string, kw array<string>", "terms"),
    "parse_silo_number": v(_fields(silo=T.silo_number), "r", "id, t", X.NUMBERS, r"SELECT id, coalesce(TRY_CAST(regexp_extract(t, '\b(10|[0-9])\b', 1) AS INT), 0) AS silo FROM r", "id int, t string", "numbers"),
    "parse_silo_token": v(_fields(silo=T.silo_token), "r", "id, t", X.NUMBERS, r"SELECT id, coalesce(TRY_CAST(list_filter(regexp_split_to_array(t, '\s+'), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS INT), 0) AS silo FROM r", "id int, t string", "numbers"),
    "forced_silo": v(_fields(silo=T.forced_silo), "r", "id, t", X.LABELS, "SELECT id, TRY_CAST(regexp_extract(t, '^cse:silo_(.*)$', 1) AS INT) AS silo FROM r", "id int, t string", "labelled"),
    "image_manifest": v(image_manifest, "r", "id, t", X.PLACEHOLDERS, r"SELECT id, printf('img-%03d', pos) AS image, upper(ks[pos]) AS kind, trim(ws[pos]) AS description FROM (SELECT id, ks, ws, unnest(range(1, len(ks) + 1)) AS pos FROM (SELECT id, regexp_extract_all(t, '(?i)\[\[(IMAGE|COVER|BACK_COVER):(.+?)\]\]', 1) AS ks, regexp_extract_all(t, '(?i)\[\[(IMAGE|COVER|BACK_COVER):(.+?)\]\]', 2) AS ws FROM r))", "id int, t string", "placeholders"),
    "apply_images": v(apply_images, "r", "id, t", X.PLACEHOLDERS, "SELECT id, " + S.replaced("t", [(a, f"![Illustration]({b})") for a, b in X.IMAGES]) + " AS t FROM r", "id int, t string", "placeholders"),
    "topic_silo_grid": (topic_silo_grid, "WITH " + derived_sql("topics", "t") + ", " + S.values("s", "silo, title", X.SILO_TITLES) + " SELECT topic_id, name, silo, title FROM t, s"),
    "ensure_briefs": (ensure_briefs, "WITH " + derived_sql("topics", "t") + ", " + S.values("s", "silo, title", X.SILO_TITLES) + ", " + derived_sql("briefs", "b") + " SELECT t.topic_id, s.silo, title FROM t, s WHERE s.silo > 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.topic_id = t.topic_id AND b.silo = s.silo)"),
    "trend_upsert": (trend_upsert, "WITH " + derived_sql("trends", "n") + ", " + derived_sql("known_trends", "k") + " SELECT source, name, min(id) AS id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = n.source AND k.name = n.name) GROUP BY source, name"),
    "silo_title_lookup": (silo_title_lookup, "WITH " + derived_sql("numbers", "r") + ", " + S.values("s", "silo, title", X.SILO_TITLES) + r" SELECT id, n AS silo, coalesce(title, 'Unclassified') AS title FROM (SELECT id, coalesce(TRY_CAST(list_filter(regexp_split_to_array(t, '\s+'), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS INT), 0) AS n FROM r) LEFT JOIN s ON n = s.silo"),
    "search_query_grid": (search_query_grid, "WITH " + S.values("t", "silo, template", X.TEMPLATE_ROWS) + ", " + r"s AS (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS site FROM pages)" + " SELECT silo, site, replace(template, '{topic}', 'spark') || ' site:' || site AS query FROM t, s"),
    "idea_pool": (idea_pool, "WITH " + derived_sql("ideas", "d") + " SELECT 1 AS branch, id, t FROM d WHERE silo = 3 UNION ALL SELECT 2, id, t FROM d WHERE silo IS NULL AND status = 'backlog'"),
    "idea_status_counts": v(lambda d: d.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("silo").isNull()).alias("unassigned")), "d", "id, status, silo, t", X.IDEAS, "SELECT status, count(*) AS n, count(*) FILTER (silo IS NULL) AS unassigned FROM d GROUP BY status", "id int, status string, silo int, t string", "ideas"),
    "pending_sources": v(lambda d: d.where("topic_id = 1 and status = 'pending'").select("id", "url"), "d", "id, topic_id, status, url", X.SOURCES, "SELECT id, url FROM d WHERE topic_id = 1 AND status = 'pending'", "id int, topic_id int, status string, url string", "sources"),
    "pending_count": v(lambda d: d.where("status = 'pending'").groupBy("topic_id").agg(F.count("*").alias("n")), "d", "id, topic_id, status, url", X.SOURCES, "SELECT topic_id, count(*) AS n FROM d WHERE status = 'pending' GROUP BY topic_id", "id int, topic_id int, status string, url string", "sources"),
    "chapter_context": (chapter_context, "WITH " + S.values("s", "silo, title", X.SILO_TITLES) + ", " + derived_sql("briefs", "b") + ", " + derived_sql("ideas", "d") + " SELECT s.silo, title, coalesce(brief, 'Silo ' || s.silo) AS brief, coalesce(i.ideas, '') AS ideas FROM s LEFT JOIN (SELECT silo, min(brief) AS brief FROM b WHERE topic_id = 1 GROUP BY silo) b ON b.silo = s.silo LEFT JOIN (SELECT silo, string_agg(t, '|' ORDER BY id) AS ideas FROM (SELECT * FROM d WHERE silo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY silo ORDER BY id, t) <= 25) GROUP BY silo) i ON i.silo = s.silo"),
    "checker_output_parse": v(checker_output_parse, "r", "id, ord, line", X.OUTPUT, f""", t AS (SELECT id, ord, {S.strip('line')} AS line, contains(line, 'No errors or warnings detected') AS ok FROM r),
h AS (SELECT id, ord, CASE WHEN ok THEN 'pass' WHEN starts_with(line, 'ERROR') THEN 'fail' WHEN starts_with(line, 'WARNING') THEN 'warning' END AS status, CASE WHEN ok THEN 'no errors or warnings' WHEN starts_with(line, 'ERROR') THEN {S.strip('substring(line, 7)')} ELSE {S.strip('substring(line, 9)')} END AS message FROM t),
p AS (SELECT id, min(CASE WHEN status = 'pass' THEN ord END) AS passed, count(status) AS n FROM h GROUP BY id)
SELECT h.* FROM h JOIN p ON h.id = p.id WHERE status IS NOT NULL AND (passed IS NULL OR ord = passed) UNION ALL SELECT id, 0, 'fail', 'no result' FROM p WHERE n = 0""", "id int, ord int, line string", "output"),
    "json_fallback": v(json_fallback, "r", "id, t", X.REVIEWS, f"SELECT id, coalesce({_JSON_SCORE}, 0) AS score, coalesce(CASE WHEN json_valid(t) THEN json_extract_string(t, '$.notes') END, '') AS notes FROM r", "id int, t string", "reviews"),
    "json_questions": v(questions, "r", "id, t", X.QUESTIONS, "SELECT id, CASE WHEN json_valid(t) AND json_array_length(CASE WHEN json_valid(t) THEN t ELSE '[]' END) = 5 THEN array_to_string(CAST(json(CASE WHEN json_valid(t) THEN t ELSE '[]' END) AS VARCHAR[]), '|') ELSE 'canned' END AS questions FROM r", "id int, t string", "questions"),
    "post_scores": v(lambda d: d.select("id", _score().alias("score")), "d", "id, author, likes, reposts, replies, quotes, url", X.POSTS, "SELECT id, coalesce(likes, 0) + 2 * coalesce(reposts, 0) + coalesce(replies, 0) + coalesce(quotes, 0) AS score FROM d", _POSTS, "posts"),
    "trend_top_authors": v(trend_top_authors, "d", "id, author, likes, reposts, replies, quotes, url", X.POSTS, "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank FROM (SELECT coalesce(author, 'unknown') AS author, max(coalesce(likes, 0) + 2 * coalesce(reposts, 0) + coalesce(replies, 0) + coalesce(quotes, 0)) AS score, CAST(arg_max(id, CAST(coalesce(likes, 0) + 2 * coalesce(reposts, 0) + coalesce(replies, 0) + coalesce(quotes, 0) AS BIGINT) * 1000000000 - id) AS BIGINT) AS post, min(id) AS first FROM d GROUP BY 1) QUALIFY rank <= 8", _POSTS, "posts"),
    "trend_top_urls": v(trend_top_urls, "d", "id, author, likes, reposts, replies, quotes, url", X.POSTS, "SELECT *, CAST(row_number() OVER (ORDER BY n DESC, first) AS INT) AS rank FROM (SELECT url, count(*) AS n, min(id) AS first FROM d WHERE url IS NOT NULL GROUP BY url) QUALIFY rank <= 10", _POSTS, "posts"),
    "accuracy_tolerance": v(accuracy_tolerance, "d", "id, found, expected, low, high", X.ACCURACY, "SELECT id, CASE WHEN found = expected THEN 100 WHEN found BETWEEN low AND high THEN 75 ELSE greatest(0, 100 - 10 * abs(found - expected)) END AS score, found BETWEEN low AND high AS within FROM d", "id int, found int, expected int, low int, high int", "accuracy"),
    "expired_sessions": v(lambda d: d.where("s < 7300 - 3600").select("id"), "d", "id, s", X.STAMPS, "SELECT id FROM d WHERE s < 7300 - 3600", "id int, s int", "stamps"),
}
