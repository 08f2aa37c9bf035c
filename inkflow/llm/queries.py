"""The driver's queries over the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm import bitplanes, codes, decontaminate, html, licenses, media, neardup, packing, pii, quality, quotes, warc, whitening
from inkflow.llm.common import table

WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 2
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.encode_corpus(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), WORD_BPE_END)


def op2_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), BYTE_BPE_END, with_ids=False)


def op3_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode_media(media.store_media(table(spark, sf_dir, "documents")))


def op5_quality_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_block_tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op11_weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("templates")


def op13_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bitplane_tokens, op2_power_packing, op3_warc_shards, op4_progressive_jpeg, op5_quality_subword, op6_pii_crf,
        op7_prefix_decontamination, op8_quotation_linking, op9_order_minhash, op10_block_tree_html,
        op11_weighted_whitening, op12_license_scan, op13_equal_average_codes,
    )}


#: Equal payloads of at least 1000 bytes: the largest page_id is the response.
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND p.page_id <> m.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND p.page_id <> m.top THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""

#: Window starts of documents and items, joined on the whole window.
OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win), grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hits AS (SELECT grams.doc_id, grams.i, grams.size, win.item_id FROM grams JOIN win ON grams.size = win.size AND grams.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


#: Phrases at every place of the words; every block against every template.
OP12_SQL = (
    r"""
WITH phrase AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES """
    + _values(licenses.PHRASES)
    + r""") AS t(p, label)), template AS (
  SELECT k, label, list_distinct(regexp_extract_all("""
    + _LOW
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM (VALUES """
    + _values((k, *t) for k, t in enumerate(licenses.TEMPLATES))
    + r""") AS t(k, label, text)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all("""
    + _LOW
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         string_split_regex(regexp_replace(regexp_replace("""
    + _LOW
    + r""", '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n+') AS blocks
  FROM documents
), place AS (
  SELECT r, label, unnest(list_filter(range(0, greatest(len(w) - len(p), -1) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM d, phrase
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r
), block AS (SELECT r, list_distinct(regexp_extract_all(unnest(blocks), '[^ \n]+')) AS b FROM d), found AS (
  SELECT r, label, len(list_intersect(b, t)) / len(t) AS c FROM block, template WHERE len(list_intersect(b, t)) >= ceil(0.8 * len(t) - 1e-9)
), best AS (SELECT r, max(c) AS c FROM found GROUP BY r), labels AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM place) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN labels USING (r)
"""
)

_NEAREST = """
a{k} AS (
  SELECT r, p, min({{'d': d, 'e': e}}) AS b FROM (
    SELECT part.r, p, c.e, list_sum(list_transform(range(1, len(part.y) + 1), lambda i: (part.y[i] - c.y[i]) * (part.y[i] - c.y[i]))) AS d FROM part JOIN c{k} AS c USING (p)
  ) GROUP BY r, p
)"""
_MOVED = """
m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM (
    SELECT p, b.e AS e, i, sum(y[i]) AS s, count(*) AS n FROM part JOIN a{j} USING (r, p), range(1, 5) AS t(i) GROUP BY p, b.e, i
  ) GROUP BY p, e
), c{k} AS (SELECT p, e, coalesce(m{k}.y, c{j}.y) AS y FROM c{j} LEFT JOIN m{k} USING (p, e))"""

#: Every part against every entry, for vectors of 64 entries.
OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), part AS (SELECT r, vec_id, p, x[4 * p + 1 : 4 * p + 4] AS y FROM v, range(16) AS t(p)), c0 AS (
  SELECT p, e, y FROM (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part) WHERE e < 64
), {_NEAREST.format(k=0)}, {_MOVED.format(k=1, j=0)}, {_NEAREST.format(k=1)}, {_MOVED.format(k=2, j=1)}, {_NEAREST.format(k=2)}, coded AS (
  SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a2 GROUP BY r
), books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), books
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_shards": OP3_SQL, "op7_prefix_decontamination": OP7_SQL, "op12_license_scan": OP12_SQL, "op13_equal_average_codes": OP13_SQL}
