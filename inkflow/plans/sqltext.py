"""DuckDB SQL pieces that the oracles share."""

from __future__ import annotations

#: Unicode white space, with the separators that Python's str.split also takes.
WS = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def count(c: str) -> str:
    return f"CAST(len({words(c)}) AS BIGINT)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(quote, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE body over literal rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


def replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        c = f"replace({c}, {quote(a)}, {quote(b)})"
    return c


def contains_any(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(n)})" for n in needles) + ")"


HTML_CLEAN = strip(
    "regexp_replace(array_to_string(list_transform(string_split("
    + replaced(
        r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')",
        [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")],
    )
    + f", chr(10)), lambda x: {strip('x')}), chr(10)), '\\n{{2,}}', chr(10) || chr(10), 'g')"
)

#: doc_id, line_no, line of the composed manuscripts.
LINES = """lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (
    SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 8 = 0 AND i > 1 THEN ['Chapter ' || CAST((i - 1) // 8 AS VARCHAR), x] ELSE [x] END)) AS ls
    FROM documents WHERE text IS NOT NULL))"""
HEADER = r"(regexp_matches(lower(s), '^(chapter|letter|part|section)\s+(\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|[a-z])') OR regexp_matches(lower(s), '^(\d+|[ivxlcdm]+)\.(\s+\S.{0,40})?$'))"
#: The lines of a group joined to a paragraph.
_JOINED = (
    f"replace(replace(array_to_string(list_transform(list(line ORDER BY line_no), lambda x, i: regexp_replace(CASE WHEN i = 1 THEN x ELSE regexp_replace(x, '^{WS}+', '') END, "
    f"'{WS}+$', '')), chr(10)), '-' || chr(10), ''), chr(10), ' ')"
)
PARAGRAPHS = f"""{LINES}, flagged AS (SELECT *, s <> '' AND {HEADER} AS header FROM (SELECT *, {strip('line')} AS s FROM lines)),
marked AS (
  SELECT *, sum(CAST(header AS INT)) OVER w AS section_no, sum(CAST(header OR s = '' AS INT)) OVER w AS break_no,
         last_value(CASE WHEN header THEN s END IGNORE NULLS) OVER w AS title
  FROM flagged WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
paragraphs AS (
  SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(title) AS title, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY break_no) AS paragraph_no,
         {_JOINED} AS text
  FROM marked WHERE NOT header AND s <> '' GROUP BY doc_id, section_no, break_no),
kept AS (SELECT doc_id, section_no, max(title) AS title, count(*) AS n_paragraphs, CAST(sum({count('text')}) AS BIGINT) AS n_words FROM paragraphs WHERE section_no > 0 GROUP BY doc_id, section_no),
sections AS (SELECT *, CASE WHEN lower(title) LIKE 'chapter%' THEN row_number() OVER (PARTITION BY doc_id ORDER BY section_no) END AS number FROM kept),
whole AS (
  SELECT doc_id, break_no, {_JOINED} AS text FROM (
    SELECT doc_id, line_no, line, s, sum(CAST(s = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS break_no FROM flagged
    WHERE doc_id NOT IN (SELECT doc_id FROM sections)) WHERE s <> '' GROUP BY doc_id, break_no),
main AS (SELECT doc_id, 0 AS section_no, 'Main Content' AS title, NULL AS number, count(*) AS n_paragraphs, CAST(sum({count('text')}) AS BIGINT) AS n_words FROM whole GROUP BY doc_id),
text_sections AS (
  SELECT doc_id, section_no, title, number, n_paragraphs, n_words FROM sections
  UNION ALL SELECT doc_id, CAST(section_no AS BIGINT), title, CAST(number AS BIGINT), n_paragraphs, n_words FROM main)"""
