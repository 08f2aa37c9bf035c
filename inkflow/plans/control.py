"""Point queries, patches, orders and budgets of the content pipeline's small tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.plans import fixtures as X
from inkflow.plans import sqltext as S
from inkflow.plans.derived import derived, derived_sql

NOW = "2024-01-15 12:00:00"
MOST_CALLS = 50


def idea_filters(d):
    """Ideas of a topic by id where ids are given, else the backlog; and by a silo, of which 0 is one."""
    mine = d.where("topic_id = 1")
    by_ids = mine.where(F.col("id").isin(2, 3, 4)).select(F.lit("ids").alias("filter"), "id")
    backlog = mine.where("status = 'backlog'").select(F.lit("backlog").alias("filter"), "id")
    return by_ids.unionByName(backlog).unionByName(mine.where("silo = 0").select(F.lit("silo 0").alias("filter"), "id"))


def latest_topics(d):
    """The three newest, of equally new ones those of the least id."""
    return d.orderBy(F.desc_nulls_last("created"), F.asc_nulls_last("id")).limit(3).select("id", "name")


def call_budget(d):
    """Sources in order: posts are left pending once so many have been fetched; only successes count.  All succeed or fail as
    they do, so the count before a source is that of the successes among the posts before it, at most the budget."""
    from inkflow.plans.documents import words_before

    rows = d.withColumnRenamed("id", "doc_id").withColumn("n", (F.col("post") & F.col("ok")).cast("long")).withColumn("run", F.lit(1))
    status = F.when(F.col("post") & (F.col("before") >= MOST_CALLS), "pending").when(F.col("ok"), "extracted").otherwise("failed")
    return words_before(rows, ["run"]).select(F.col("doc_id").alias("id"), status.alias("status"))


def missing_names(d):
    """What each book's metadata lacks, in the order of names."""
    lacks = F.array_sort(F.collect_list(F.when(F.coalesce("value", F.lit("")) == "", F.col("name"))))
    return d.groupBy("id").agg(F.array_join(lacks, ", ").alias("missing"))


def task_outcome(d):
    """Completed tasks and errors of each run, which has a task a silo."""
    return d.groupBy("run").agg(F.count("result").alias("completed"), F.count("error").alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("silo", "error")))), lambda x: x["error"]), "; ").alias("errors"))


def silo_templates(spark, sf_dir):
    """Every silo of every topic with its templates in the topic's name; silo 0 has none."""
    silos = spark.createDataFrame(X.SILO_TITLES, "silo int, title string")
    t = spark.createDataFrame(X.TEMPLATE_ROWS, "silo int, template string").groupBy("silo").agg(F.array_join(F.array_sort(F.collect_list("template")), "|").alias("templates"))
    silos = silos.join(t, "silo", "left").select("silo", "title", F.coalesce("templates", F.lit("")).alias("templates"))
    return derived(spark, sf_dir, "topics").crossJoin(F.broadcast(silos)).select("topic_id", "silo", "title", F.replace("templates", F.lit("{topic}"), F.col("name")).alias("templates"))  # 11 literal rows


def topic_silos(spark, sf_dir):
    """Topics' silos by number, found by the topics' names."""
    t = derived(spark, sf_dir, "topics").where("name like '%7'")
    return t.join(derived(spark, sf_dir, "silos"), "topic_id").select("name", "silo_id", "silo")


def brief_patch(spark, sf_dir):
    """A form's patch: empty titles and goals leave the old ones, notes are always those of the form."""
    b = derived(spark, sf_dir, "book_briefs")
    p = derived(spark, sf_dir, "patches").select("id", *(F.col(c).alias(f"new_{c}") for c in ("title", "goal", "notes"))).withColumn("given", F.lit(True))
    keep = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)).alias(old)
    return b.join(p, "id", "left").select("id", keep("new_title", "title"), keep("new_goal", "goal"), F.when(F.col("given"), F.col("new_notes")).otherwise(F.col("notes")).alias("notes"))


def expired(d: DataFrame):
    """Sessions of more than an hour ago."""
    return d.where(F.col("seen_at").cast("timestamp_ntz") < F.expr(f"timestamp_ntz '{NOW}' - interval 1 hour")).select("id")


def feed_urls(d):
    """Search feeds of a query, quoted as forms are, and the tag's feed of its slug."""
    return d.select("id", F.concat(F.lit("https://example.com/search.rss?q="), F.url_encode("q"), F.lit("&sort=hot")).alias("search"), F.concat(F.lit("https://example.org/feed/tag/"), T.slugify_compat(F.col("q"))).alias("tag"))


def _over(fn, relation):
    return lambda spark, sf_dir: fn(derived(spark, sf_dir, relation))


def _with(relation: str, alias: str = "d") -> str:
    return "WITH " + derived_sql(relation, alias)


CATALOGUE = {
    "idea_filters": (_over(idea_filters, "ideas"), _with("ideas") + " SELECT 'ids' AS filter, id FROM d WHERE topic_id = 1 AND id IN (2, 3, 4) UNION ALL SELECT 'backlog', id FROM d WHERE topic_id = 1 AND status = 'backlog' UNION ALL SELECT 'silo 0', id FROM d WHERE topic_id = 1 AND silo = 0"),
    "latest_topics": (_over(latest_topics, "topic_rows"), _with("topic_rows") + " SELECT id, name FROM d ORDER BY created DESC, id LIMIT 3"),
    "call_budget": (_over(call_budget, "calls"), _with("calls") + f" SELECT id, CASE WHEN post AND coalesce(count(*) FILTER (post AND ok) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {MOST_CALLS} THEN 'pending' WHEN ok THEN 'extracted' ELSE 'failed' END AS status FROM d"),
    "missing_names": (_over(missing_names, "names"), _with("names") + " SELECT id, coalesce(string_agg(CASE WHEN coalesce(value, '') = '' THEN name END, ', ' ORDER BY name), '') AS missing FROM d GROUP BY id"),
    "task_outcome": (_over(task_outcome, "results"), _with("results") + " SELECT run, count(result) AS completed, count(error) AS failed, coalesce(string_agg(error, '; ' ORDER BY silo, error), '') AS errors FROM d GROUP BY run"),
    "silo_templates": (silo_templates, _with("topics", "t") + ", " + S.values("s", "silo, title", X.SILO_TITLES) + ", " + S.values("x", "silo, template", X.TEMPLATE_ROWS) + ", y AS (SELECT s.silo, title, coalesce(string_agg(template, '|' ORDER BY template), '') AS templates FROM s LEFT JOIN x ON s.silo = x.silo GROUP BY s.silo, title) SELECT topic_id, silo, title, replace(templates, '{topic}', name) AS templates FROM t, y"),
    "topic_silos": (topic_silos, _with("topics", "t") + ", " + derived_sql("silos", "s") + " SELECT name, silo_id, silo FROM t JOIN s ON t.topic_id = s.topic_id WHERE name LIKE '%7'"),
    "brief_patch": (brief_patch, _with("book_briefs", "b") + ", " + derived_sql("patches", "p") + " SELECT b.id, coalesce(nullif(p.title, ''), b.title) AS title, coalesce(nullif(p.goal, ''), b.goal) AS goal, CASE WHEN p.id IS NULL THEN b.notes ELSE p.notes END AS notes FROM b LEFT JOIN p ON b.id = p.id"),
    "session_expiry": (_over(expired, "sessions"), _with("sessions") + f" SELECT id FROM d WHERE CAST(seen_at AS TIMESTAMP) < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR"),
    "feed_urls": (_over(feed_urls, "queries"), _with("queries") + r" SELECT id, 'https://example.com/search.rss?q=' || replace(url_encode(q), '%20', '+') || '&sort=hot' AS search, 'https://example.org/feed/tag/' || coalesce(nullif(regexp_replace(regexp_replace(lower(trim(q)), '[^a-z0-9\\s-]', '', 'g'), '-+', '-', 'g'), ''), 'topic') AS tag FROM d"),
}
