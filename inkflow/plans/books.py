"""Queries over the document model: nested JSON written and read back, and books as ordered pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkflow.operators import model, structure
from inkflow.plans import sqltext as S
from inkflow.session import table
from inkflow.streaming.streams import shared


def _paragraphs(spark, sf_dir):
    return structure.paragraphs(structure.with_chapters(table(spark, sf_dir, "documents")), True)


def document_model(spark, sf_dir):
    """The blocks of every document's model, from its JSON."""
    path = shared(spark, "document_model")
    model.write_models(model.document_model(table(spark, sf_dir, "documents"), _paragraphs(spark, sf_dir)), path)
    blocks = model.blocks_of(model.read_models(spark, path))
    return blocks.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


def book_pieces(spark, sf_dir):
    p = model.book_pieces(table(spark, sf_dir, "documents"), _paragraphs(spark, sf_dir))
    return p.withColumn("n_chars", F.length("piece").cast("long")).withColumn("digest", F.md5(F.col("piece").cast("binary"))).drop("piece")


_BLOCKS = f"""WITH {S.PARAGRAPHS}, own AS (
  SELECT doc_id, section_no, title, paragraph_no, text FROM paragraphs WHERE section_no > 0
  UNION ALL SELECT doc_id, 0, 'Main Content', row_number() OVER (PARTITION BY doc_id ORDER BY break_no), text FROM whole),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY section_no) AS rank FROM own),
blocks AS (
  SELECT doc_id, {S.count("coalesce(d.text, '')")} AS n_words, section_no, rank AS chapter_no, title, CASE WHEN lower(title) LIKE 'chapter%' THEN rank END AS number,
         CAST(paragraph_no AS BIGINT) AS block_no, r.text, source
  FROM ranked r JOIN documents d USING (doc_id))"""
q = S.quote

CATALOGUE = {
    "document_model": (document_model, _BLOCKS + " SELECT doc_id, n_words, chapter_no, title, number, block_no, 'paragraph' AS type, md5(text) AS digest FROM blocks"),
    "book_pieces": (
        book_pieces,
        _BLOCKS + f""", pieces AS (
  SELECT source, 1 AS part, doc_id, section_no, block_no,
         CASE WHEN block_no = 1 THEN {q(model.OPEN[0])} || to_json(title) || {q(model.OPEN[1])} || coalesce(CAST(number AS VARCHAR), 'null') || {q(model.OPEN[2])} ELSE '' END || {q(model.BODY[0])} || to_json(text) || {q(model.BODY[1])} ||
         CASE WHEN block_no < max(block_no) OVER (PARTITION BY doc_id, section_no) THEN ',' ELSE {q(model.CLOSE)} ||
           CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, section_no DESC, block_no DESC) = 1 THEN '' ELSE ',' END END AS piece
  FROM blocks WHERE source IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL SELECT source, 0, 0, 0, 0, {q(model.HEAD[0])} || sum({S.count("coalesce(text, '')")}) || {q(model.HEAD[1])} FROM documents WHERE doc_id IS NOT NULL AND source IN (SELECT source FROM blocks) GROUP BY source
  UNION ALL SELECT DISTINCT source, 2, 0, 0, 0, {q(model.TAIL)} FROM blocks WHERE source IS NOT NULL)
SELECT source, part, doc_id, section_no, block_no, length(piece) AS n_chars, md5(piece) AS digest FROM pieces""",
    ),
}
