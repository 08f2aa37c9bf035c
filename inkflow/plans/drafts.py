"""Queries over drafts: sources under both caps, ingest cycles, and drafts by version."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import caps
from inkflow.plans import pages as P, sqltext as S
from inkflow.plans.documents import docs
from inkflow.plans.fixtures import SILO_TITLES
from inkflow.session import table
from inkflow.sources.versions import VersionedTable
from inkflow.streaming.ingest import Ingest, Rules, chunk_list
from inkflow.streaming.streams import shared

#: Words of a draft that holds its title only: a mark and the title.
START = {n: len(title.split()) + 1 for n, title in SILO_TITLES}
MAX_TOTAL, MAX_SILO = 150_000, 16_000


def silo_of(chunk):
    """In place of a model that classifies: any rule by the chunk alone."""
    return F.length(chunk) % 11


def draft_caps(spark, sf_dir):
    """All documents as sources in order, their lines as paragraphs; what each adds to the drafts, and the cap that ends it."""
    rows = docs(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"), chunk_list(F.coalesce("text", F.lit("")), silo_of, "\n").alias("chunks"))
    got = caps.admit(rows, shared(spark, "draft-caps"), MAX_TOTAL, MAX_SILO, START, "doc_id", "tie")
    return got.select("doc_id", F.size("chunks").alias("n_chunks"), "taken", "taken_words", F.coalesce("reason", F.lit("extracted")).alias("reason"))


def stream_ingest(spark, sf_dir):
    """Pages as candidates of an ingest run: each source's status, why it failed, and the words it added to the drafts."""
    rules = Rules(min_words=P.MIN_WORDS, terms=P.TERMS, max_total=MAX_TOTAL, max_silo=3_000, start=START, silo=silo_of)
    schema = table(spark, sf_dir, "pages").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/pages.parque[t]")
    known = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), "html")
    run = Ingest(spark, shared(spark, "ingest-run"), rules, lambda waiting: known.join(waiting.select("source_id"), "source_id", "left_semi"))
    run.run(stream.select(F.col("page_id").alias("source_id"), "url", "html"))
    return run.current().select(F.col("source_id").alias("page_id"), "status", F.coalesce("reason", F.lit("")).alias("reason"), "n_words", "taken", "taken_words", "cycle")


def draft_versions(spark, sf_dir):
    """Drafts of sources that get a part a document, a language at a time, and are then written anew from their first part: every
    version that was, the one before the last included.  A step that is lost shows in none."""
    parts = docs(spark, sf_dir).select("source", "doc_id", "lang", T.strip(F.coalesce("text", F.lit(""))).alias("part"))
    drafts = VersionedTable(spark, shared(spark, "drafts"), "source string, doc_id long, part string")
    for lang in sorted(r.lang for r in parts.select("lang").where("lang is not null").distinct().collect()):
        drafts.commit(parts.where(F.col("lang") == lang), note={"lang": lang})
    drafts.stage(parts)
    first = drafts.read().groupBy("source").agg(F.min("doc_id").alias("first"))
    again = drafts.read().join(first.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.col("doc_id") == F.col("first")))
    drafts.commit(again.select("source", "doc_id", "part"), mode="overwrite", made_from=drafts.version())
    out = None
    for v in range(1, drafts.version() + 1):
        rows = drafts.read(v).groupBy("source").agg(F.count("*").alias("n_parts"), F.sum(F.length("part") + 2).cast("long").alias("n_chars")).withColumn("version", F.lit(v))
        out = rows if out is None else out.unionByName(rows)
    return out


def _fold(source: str, max_total: int, max_silo: int) -> str:
    """The sequential rule over source(ord, tie, chunks): `folded`, a row a source with chunks."""
    silos = len(SILO_TITLES)
    start = "[" + ", ".join(str(START[i]) for i in range(silos)) + "]"
    return f"""each AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord, tie, chunk_no) AS i FROM (
  SELECT ord, tie, generate_subscripts(chunks, 1) AS chunk_no, CAST(length(unnest(chunks)) % {silos} AS INT) AS silo, {S.count('unnest(chunks)')} AS n FROM {source})),
run(i, ord, tie, n, reason, w) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST({start} AS BIGINT[])
  UNION ALL
  SELECT i, ord, tie, n, reason, CASE WHEN reason = '' THEN list_transform(w, lambda x, k: CASE WHEN k = silo + 1 THEN x + n ELSE x END) ELSE w END FROM (
    SELECT e.i, e.ord, e.tie, e.n, e.silo, r.w, CASE WHEN e.ord IS NOT DISTINCT FROM r.ord AND e.tie = r.tie AND r.reason <> '' THEN r.reason
           WHEN list_sum(r.w) >= {max_total} THEN 'draft_total_cap' WHEN r.w[e.silo + 1] >= {max_silo} THEN 'draft_silo_cap' ELSE '' END AS reason
    FROM run r JOIN each e ON e.i = r.i + 1)),
folded AS (SELECT ord, tie, count(*) AS n_chunks, count(*) FILTER (reason = '') AS taken, coalesce(sum(n) FILTER (reason = ''), 0) AS words, max(reason) AS reason FROM run WHERE i > 0 GROUP BY ord, tie)"""


def _packed(parts: str, name: str, of: str, columns: str) -> str:
    """name(columns, chunks): greedy chunks of at most 3500 characters."""
    done = f"CASE WHEN a.cur <> '' THEN list_append(a.out, {S.strip('a.cur')}) ELSE a.out END"
    fold = f"list_reduce(ps, lambda a, p: CASE WHEN length(a.cur) + length(p.cur) + 2 > 3500 THEN {{'out': {done}, 'cur': p.cur}} ELSE {{'out': a.out, 'cur': CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || p.cur ELSE p.cur END}} END, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}})"
    return f"""{name} AS MATERIALIZED (SELECT {columns}, {done} AS chunks FROM (SELECT {columns}, {fold} AS a FROM (
  SELECT {columns}, list_transform(list_filter({parts}, lambda x: {S.strip('x')} <> ''), lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': x}}) AS ps FROM {of})))"""


CATALOGUE = {
    "draft_caps": (draft_caps, f"""WITH RECURSIVE d AS (SELECT doc_id AS ord, md5(coalesce(text, '')) AS tie, coalesce(text, '') AS text FROM documents),
{_packed("string_split(text, chr(10))", "c", "d", "ord, tie")},
{_fold("c", MAX_TOTAL, MAX_SILO)}
SELECT c.ord AS doc_id, CAST(coalesce(n_chunks, 0) AS INT) AS n_chunks, CAST(coalesce(taken, 0) AS INT) AS taken, CAST(coalesce(words, 0) AS BIGINT) AS taken_words,
       coalesce(nullif(reason, ''), 'extracted') AS reason FROM c LEFT JOIN folded f ON c.ord = f.ord AND c.tie = f.tie"""),
    "stream_ingest": (stream_ingest, f"""WITH RECURSIVE clean AS (SELECT page_id, url, t, {S.count('t')} AS n_words FROM (SELECT page_id, url, {S.HTML_CLEAN.replace('html', "coalesce(html, '')", 1)} AS t FROM pages)),
gated AS (SELECT *, CASE WHEN {S.contains_any('substring(lower(t), 1, 2000)', T.BLOCKED)} THEN 'blocked' WHEN n_words < {P.MIN_WORDS} THEN 'too_short'
  WHEN NOT {S.contains_any('lower(substring(t, 1, 8000))', P.TERMS)} THEN 'off_topic' ELSE '' END AS gate FROM clean WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
d AS (SELECT page_id AS ord, url AS tie, t AS text FROM gated WHERE gate = ''),
{_packed("string_split(text, chr(10) || chr(10))", "c", "d", "ord, tie")},
{_fold("c", MAX_TOTAL, 3_000)}
SELECT page_id, CASE WHEN gate <> '' OR coalesce(reason, '') <> '' THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN gate <> '' THEN gate ELSE coalesce(reason, '') END AS reason, n_words,
       CAST(coalesce(taken, 0) AS INT) AS taken, CAST(coalesce(words, 0) AS BIGINT) AS taken_words, CAST(1 AS BIGINT) AS cycle FROM gated LEFT JOIN folded ON page_id = ord"""),
    "draft_versions": (draft_versions, f"""WITH langs AS (SELECT lang, row_number() OVER (ORDER BY lang) AS v FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
p AS (SELECT source, doc_id, v, {S.strip("coalesce(text, '')")} AS part FROM documents JOIN langs USING (lang)),
last AS (SELECT source, min(doc_id) AS doc_id FROM p GROUP BY source)
SELECT source, count(*) AS n_parts, CAST(sum(length(part) + 2) AS BIGINT) AS n_chars, CAST(l.v AS INT) AS version FROM p JOIN langs l ON p.v <= l.v GROUP BY source, l.v
UNION ALL SELECT source, count(*), CAST(sum(length(part) + 2) AS BIGINT), (SELECT CAST(max(v) + 1 AS INT) FROM langs) FROM p JOIN last USING (source, doc_id) GROUP BY source"""),
}
