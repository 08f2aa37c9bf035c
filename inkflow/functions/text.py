"""Text functions as column expressions: white space as Python sees it, normalisers, lists, slugs, URLs, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the separators that Python's str.split also takes.
SPACE = r"(?U)[\s\x1c-\x1f]"

#: Replacements in their order, then what is removed.
SPACES = [("\u00a0", " "), ("\u2002", " "), ("\u2003", " "), ("\u2009", " "), ("\u200a", " "), ("\u200b", ""), ("\u00ad", "")]
LATIN1 = [
    ("\u00a0", " "), ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "--"),
    ("\u2026", "..."), ("\u2022", "-"), ("\u25cf", "*"), ("\u25cb", "o"), ("\u2192", "->"), ("\u2190", "<-"),
]
HTML = [
    ("\u00a0", " "), ("\u25cf", "*"), ("\u25cb", "o"), ("\u25e6", "-"), ("\u25aa", "-"), ("\u25ab", "-"), ("\u2192", "->"), ("\u2190", "<-"),
    ("\u2191", "^"), ("\u2193", "v"), ("\u2022", "-"), ("\u2026", "..."), ("\u2014", "--"), ("\u2013", "-"), ("\u2018", "'"),
    ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'),
]
SYMBOL_RANGES = [(0x1F300, 0x1F9FF), (0x2702, 0x27B0), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x2600, 0x26FF), (0x1FA00, 0x1FAFF)]
DRAWING_RANGES = [(0x2500, 0x25FF), (0x2190, 0x21FF)]
BLOCKED = ["403 forbidden", "access denied", "request blocked", "enable javascript", "captcha", "cloudflare", "robot check", "not authorized", "temporarily unavailable"]
READER_DOMAINS = ["medium.com", "substack.com", "blog.devgenius.io"]
POST_DOMAINS = ["x.com", "twitter.com"]


def code_points(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def far_code_points(ranges: list[tuple[int, int]]) -> str:
    """The same class; a code point below all ranges, as most are, is told by one comparison."""
    whole = (min(a for a, _ in ranges), max(b for _, b in ranges))
    return f"[{code_points([whole])[1:-1]}&&{code_points(ranges)}]"



def words(c: Column) -> Column:
    """str.split()"""
    return F.filter(F.split(c, SPACE + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def strip(c: Column) -> Column:
    """str.strip()"""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def normalize_pdf(c: Column) -> Column:
    return F.regexp_replace(replaced(c, SPACES), far_code_points(SYMBOL_RANGES) + "+", "")


def normalize_latin1(c: Column) -> Column:
    return F.regexp_replace(replaced(F.coalesce(c, F.lit("")), LATIN1), r"[^\x{0}-\x{ff}]", "")


def normalize_html(c: Column) -> Column:
    """Each pair is of one character that no other pair makes, so their order is free; those of LATIN1 come first, as a common
    expression of both is computed once."""
    pairs = [p for p in LATIN1 if p in HTML] + [p for p in HTML if p not in LATIN1]
    return F.regexp_replace(replaced(F.coalesce(c, F.lit("")), pairs), far_code_points(SYMBOL_RANGES + DRAWING_RANGES) + "+", "")


def normalize_epub(c: Column) -> Column:
    return replaced(c, SPACES)


def escape_xml(c: Column) -> Column:
    return replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_html(c: Column) -> Column:
    return replaced(normalize_epub(c), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def rstrip(c: Column) -> Column:
    """str.rstrip()"""
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def dehyphenate(lines: Column) -> Column:
    """Join wrapped lines: a hyphen at a line's end takes the break with it; later lines lose their indentation.  Only
    blank lines, which let one line's hyphens meet several breaks, need the fold."""
    body = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, rf"^{SPACE}+", "")))
    whole = replaced(F.array_join(body, "\n"), [("-\n", ""), ("\n", " ")])

    def join(held: Column, line: Column) -> Column:
        return F.when(held.endswith("-"), F.concat(F.left(held, F.length(held) - 1), line)).otherwise(F.concat(held, F.lit(" "), line))

    fold = F.aggregate(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), F.get(body, F.lit(0)), join)
    return F.when(F.exists(body, lambda x: x == ""), fold).otherwise(whole)


def slugify_compat(c: Column) -> Column:
    """White space is deleted, as a doubled backslash in the character class makes it; empty becomes topic."""
    low = F.lower(F.trim(c))
    kept = F.regexp_replace(low, r"[^a-z0-9\\s-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "-+", "-"), F.lit("")), F.lit("topic"))


def parse_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,\n]"), strip), lambda x: x != ""))


def parse_url_list(c: Column) -> Column:
    parts = F.when(c.contains("\n"), F.split(c, "\n")).otherwise(F.split(c, ","))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != ""))


def or_query(name: Column, keywords: Column) -> Column:
    terms = F.array_distinct(F.filter(F.transform(F.concat(F.array(name), keywords), strip), lambda x: x != ""))
    safe = F.filter(F.transform(terms, lambda x: strip(F.replace(x, F.lit('"'), F.lit("")))), lambda x: x != "")
    quoted = F.transform(safe, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.when(F.size(quoted) == 0, "").when(F.size(quoted) == 1, F.get(quoted, F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))


def silo_number(c: Column) -> Column:
    """The first whole word that is an integer from 0 to 10, else 0."""
    return F.coalesce(F.regexp_extract(c, r"\b(10|[0-9])\b", 1).try_cast("int"), F.lit(0))


def silo_token(c: Column) -> Column:
    """The first white-space token of digits, else 0."""
    digits = F.filter(words(c), lambda x: x.rlike("^[0-9]+$"))
    return F.coalesce(F.get(digits, F.lit(0)).try_cast("int"), F.lit(0))


def forced_silo(label: Column) -> Column:
    return F.when(label.startswith("cse:silo_"), F.regexp_extract(label, r"^cse:silo_(.*)$", 1).try_cast("int"))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def any_of(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def looks_blocked(c: Column) -> Column:
    return any_of(F.substring(F.lower(c), 1, 2000), BLOCKED)


def mentions(c: Column, terms: list[str], most: int = 8000) -> Column:
    if not terms:
        return F.lit(True)
    return any_of(F.lower(F.substring(c, 1, most)), [t.lower() for t in terms])


def occurrences(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def title_case(c: Column) -> Column:
    """str.title(): a letter after none is upper case, every other one lower case."""
    after = lambda cs, x, i: F.when((i == 0) | ~F.coalesce(F.get(cs, i - 1), F.lit("")).rlike(r"\p{L}"), F.when(x == "ß", "Ss").otherwise(F.upper(x))).otherwise(F.lower(x))
    return bound(F.split(c, ""), lambda cs: F.array_join(F.transform(cs, lambda x, i: after(cs, x, i)), ""))


def html_clean(c: Column) -> Column:
    """Text nodes on lines of their own, without script, style, noscript and comments; entities of the common kind."""
    bare = F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>", "")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    text = replaced(text, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")])
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return strip(F.regexp_replace(lines, "\n{2,}", "\n\n"))


def chunk_by(parts: Column, most: int, gap: str, extra: int, cast_trim: bool) -> Column:
    """Greedy packer: parts joined by gap while the held length plus the part's plus extra stays within most; larger
    parts stay whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    done = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"]) if cast_trim else a["cur"]))).otherwise(a["out"])

    def merge(a, p):
        over = F.length(a["cur"]) + F.length(p) + extra > most
        return F.when(over, F.struct(done(a).alias("out"), p.alias("cur"))).otherwise(
            F.struct(a["out"].alias("out"), F.when(a["cur"] != "", F.concat(a["cur"], F.lit(gap), p)).otherwise(p).alias("cur"))
        )

    return F.aggregate(parts, start, merge, done)
