"""Queries of structure detection by chunks, with a port that fails for some."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import detection
from inkflow.plans import sqltext as S
from inkflow.plans.documents import chunk_lists, symbols
from inkflow.plans.manuscripts import _FROM_BLOCKS, block_mapping
from inkflow.session import table


def line_port(chunk: str, number: int, total: int) -> str:
    """A block a line, in place of a service: it raises for chunks of a length that five divides and answers prose for seven."""
    if len(chunk) % 5 == 0:
        raise ConnectionError("no answer")
    if len(chunk) % 7 == 0:
        return "Sorry, that is too much."
    out = []
    for i, line in enumerate(x for x in chunk.split("\n") if x):
        kind = "chapter" if i == 0 and number % 2 else "quote" if line.endswith("?") else "heading" if len(line) < 40 else "paragraph"
        out.append({"type": kind, "level": 2 if kind == "heading" else None, "text": line, "style": "normal", "metadata": {"attribution": str(total)}})
    return json.dumps({"blocks": out})


def _detected(spark, sf_dir):
    return detection.detected(table(spark, sf_dir, "documents"), line_port)


def detect_chunks(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc", "ord", "chunk_no", "failed", "type", "level", "attribution", F.md5(F.col("text").cast("binary")).alias("digest"))


def detect_mapped(spark, sf_dir):
    """The detected blocks as chapters."""
    return block_mapping(_detected(spark, sf_dir)).withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


_PARTS = f"list_filter(string_split(text, chr(10)), lambda x: {S.strip('x')} <> '')"
_SQL = f"""WITH normal AS (SELECT doc_id, regexp_replace({S.replaced("coalesce(text, '')", T.SPACES)}, '{symbols(T.SYMBOL_RANGES)}', '', 'g') AS text FROM documents),
{chunk_lists(_PARTS, detection.CHUNK_CHARS, 'chr(10) || chr(10)', 2, True, 'normal')},
asked AS (SELECT *, length(chunk) % 5 = 0 OR length(chunk) % 7 = 0 AS failed FROM (SELECT doc_id, len(cs) AS total, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS chunk_no FROM c)),
found AS (SELECT *, unnest(ls) AS text, generate_subscripts(ls, 1) AS pos FROM (SELECT *, CASE WHEN failed THEN [chunk] ELSE list_filter(string_split(chunk, chr(10)), lambda x: x <> '') END AS ls FROM asked)),
typed AS (
  SELECT *, CASE WHEN failed THEN 'paragraph' WHEN pos = 1 AND chunk_no % 2 = 1 THEN 'chapter' WHEN ends_with(text, '?') THEN 'quote' WHEN length(text) < 40 THEN 'heading' ELSE 'paragraph' END AS type FROM found),
blocks AS (
  SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, pos) AS ord, chunk_no, failed, type, CASE WHEN type = 'heading' THEN 2 END AS level, text, 'normal' AS style,
         CASE WHEN NOT failed THEN CAST(total AS VARCHAR) END AS attribution, CAST(NULL AS VARCHAR) AS caption, CAST(NULL AS VARCHAR) AS number FROM typed)"""

CATALOGUE = {
    "detect_chunks": (detect_chunks, _SQL + " SELECT doc, ord, chunk_no, failed, type, level, attribution, md5(text) AS digest FROM blocks"),
    "detect_mapped": (detect_mapped, _SQL + "," + _FROM_BLOCKS + " SELECT doc, ord, part, chapter_no, title, kind, style, md5(text) AS digest FROM mapped"),
}
