"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block's features are its word count and link
density, those of the blocks before and after it, and whether its open elements are page furniture by name, by their
class, id or role (a hint), or the article; whether it says what, outside of an article, only notices and adverts say; and whether the heading
before it opens a list of references.  A class is a hint by its head word, the last one that says something (user-comments,
promo-box), or by a word that marks one wherever it stands (cookie-text); words that also name an article's parts (header,
form, search) need a class of nothing else, and a class that says what a page has (has-sidebar) is none.  The page, the
article and headings give no hints, and sections none by their id.  A hint holds whatever the block's length.  A decision
tree (binary splits by Gini impurity) is trained on the labelled table below (SHAPES by MARKS) at the start of a job and
sent to the tasks with the code.  Formulas and the words of buttons inside a paragraph are text.

Nulls: a null html is empty and gives an empty text; null page_id and url come back null.  Malformed markup never
fails: an unclosed comment, script or tag runs to the end of the page, stray end tags are ignored,
and a quote that is never closed ends with its tag.  Very long and deeply nested pages take time in proportion to their
length.  Repeated rows stay; other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import text_or_empty

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "hint", "article", "heading", "says", "cited")
EXTRACTED = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

#: Element names by their meaning.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template title textarea annotation object iframe head".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNHINTED = HEADINGS | {"html", "body", "article", "main"}
#: Words of a class, id or role that mark what is no article: wherever they stand; as the head of a class; and
#: in a class of nothing else.
MARKERS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies gdpr newsletter disqus".split())
HEADS = frozenset(
    "banner consent notice notices alert alerts popup modal subscribe signup login comment comments commenter respond reply replies discussion discussions sidebar "
    "widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu menus nav navigation navbar footer footers masthead topbar "
    "pagination pager toolbar contentinfo complementary".split()
)
ALONE = frozenset("header form search skip thread responses".split())
HINTS = MARKERS | HEADS | ALONE
#: Parts of a class that say nothing on their own, and those that begin a class that says what a page has.
NEUTRAL = frozenset(
    "site page global top bottom left right inner outer wrap wrapper container box block area bar list item items links link group row col column primary secondary section "
    "panel body text content title head holder region zone slot unit wrapped js id".split()
)
HAS = frozenset("has with no without is hide show".split())
#: What notices and adverts say, in lower case; a block of SAYS_WORDS or more says something else as well.
SAYS = (
    "we use cookies", "uses cookies", "accept all", "accept cookies", "cookie policy", "cookie settings", "manage preferences", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our",
    "sign up for our", "sign up for free", "log in to reply", "log in to comment", "leave a comment", "leave a reply", "share this", "share on", "follow us on", "sponsored by", "advertisement", "skip to content", "skip to main content",
)
SAYS_WORDS = 60
#: Headings of lists of references.
CITED = frozenset(
    "references|reference|bibliography|works cited|sources|citations|notes|footnotes|further reading|external links|literature|literatur|quellen|einzelnachweise|weblinks|références|bibliographie|notes et références|"
    "liens externes|referencias|bibliografía|enlaces externos".split("|")
)
ARTICLES = frozenset("article content post entry story main".split())

#: The labelled table's shapes of blocks: words and link density of the block, of the one before and of the one after,
#: heading, and four labels, 1 for main text: where no open element says more, inside an article, where the block outside of one
#: says what notices say, and under the heading of a list of references.
SHAPES = """
  1 0.0    0 0.0    0 0.0  0  1 1 0 1
  3 0.0    0 0.0    0 0.0  0  1 1 0 1
 12 0.0    0 0.0    0 0.0  0  1 1 0 1
  1 0.0    1 1.0   60 0.0  0  0 1 0 1
  1 0.0    2 1.0    1 1.0  0  0 1 0 1
  3 0.0    5 1.0    0 0.0  0  0 1 0 1
  2 0.0    0 0.0    2 1.0  0  0 1 0 1
  5 0.0    3 1.0    4 1.0  0  0 1 0 1
  9 0.0    2 1.0    2 1.0  0  0 1 0 1
  2 0.0   45 0.0    0 0.0  0  1 1 0 1
  3 0.0    0 0.0   50 0.0  0  1 1 0 1
  4 0.0    3 0.0    5 0.0  0  1 1 0 1
  6 0.0    0 0.0    4 0.0  0  1 1 0 1
  6 0.4   60 0.0    2 1.0  0  0 1 0 1
  8 0.0   12 0.0   60 0.0  0  1 1 0 1
  9 0.0   60 0.0    0 0.0  0  1 1 0 1
 11 0.0    2 1.0   80 0.0  0  1 1 0 1
 14 0.0    3 1.0    0 0.0  0  1 1 0 1
  7 0.0    9 0.0    3 1.0  0  1 1 0 1
  1 1.0    1 1.0    1 1.0  0  0 0 0 1
  1 1.0    0 0.0    2 1.0  0  0 0 0 1
  2 1.0    2 1.0    2 1.0  0  0 0 0 1
  2 1.0    1 1.0    9 0.0  0  0 0 0 1
  3 1.0    6 1.0   12 0.0  0  0 0 0 1
  3 1.0   40 0.0    3 1.0  0  0 0 0 1
  4 1.0    3 1.0   60 0.0  0  0 0 0 1
  4 1.0   40 0.0   50 0.0  0  0 1 0 1
  2 1.0    0 0.0    5 0.0  0  0 1 0 1
  5 1.0    6 1.0    5 0.9  0  0 0 0 1
  6 1.0    5 1.0    0 0.0  0  0 0 0 1
 12 0.9    3 1.0    9 1.0  0  0 0 0 1
 25 0.8   10 0.9    5 1.0  0  0 0 0 1
 30 0.9   28 0.9   30 0.9  0  0 0 0 1
 30 0.7   60 0.0   50 0.0  0  0 1 0 1
  3 0.3    0 0.0    0 0.0  0  1 1 0 1
  5 0.4    0 0.0   12 0.0  0  1 1 0 1
  4 0.5    8 0.0    7 0.0  0  1 1 0 1
  2 0.5   30 0.0    9 0.0  0  1 1 0 1
 12 0.6   20 0.0   14 0.0  0  1 1 0 1
  3 0.7    2 1.0    2 1.0  0  0 0 0 1
  5 0.0    2 1.0   80 0.0  1  1 1 0 1
 10 0.0   12 0.0   60 0.0  1  1 1 0 1
 14 0.0    4 1.0   15 0.0  1  1 1 0 1
  3 0.0    0 0.0   20 0.0  1  1 1 0 1
  2 0.0    3 1.0    1 1.0  1  0 1 0 1
  6 1.0    2 1.0    4 1.0  1  0 1 0 1
 20 0.0    8 0.0    0 0.0  0  1 1 0 1
 24 0.1    1 1.0   30 0.0  0  1 1 0 1
 35 0.1   60 0.1   40 0.0  0  1 1 0 1
 60 0.0   70 0.0   60 0.0  0  1 1 1 1
 70 0.0    6 0.0    3 1.0  0  1 1 1 1
150 0.2    0 0.0    0 0.0  0  1 1 1 1
250 0.0    9 0.0    9 0.0  0  1 1 1 1
 90 0.0   90 0.0   90 0.0  0  1 1 1 1
  1 0.0   60 0.0   70 0.0  0  1 1 0 1
  4 0.0   40 0.0   50 0.0  0  1 1 0 1
  8 0.0   60 0.0   60 0.0  0  1 1 0 1
 10 0.0   25 0.0   30 0.1  0  1 1 0 1
  6 0.2   30 0.1   45 0.0  0  1 1 0 1
 14 0.0   60 0.0   60 0.0  0  1 1 0 1
"""
#: What else there is, (furniture, hint, article, says, cited), which of the shape's labels holds (-1: none, not main text),
#: and how often such blocks count.
MARKS = """
0 0 0 0 0   0  4
0 0 1 0 0   1  4
0 0 0 1 0   2  1
0 0 1 1 0   1  1
0 0 0 0 1   3  1
0 0 1 0 1   3  1
0 1 0 0 0  -1  1
0 1 1 0 0  -1  1
0 1 0 1 0  -1  1
0 1 1 0 1  -1  1
1 0 0 0 0  -1  1
1 0 1 0 0  -1  1
1 1 0 0 0  -1  1
1 1 1 0 0  -1  1
1 0 0 1 0  -1  1
1 0 0 0 1  -1  1
"""

_TAG = re.compile(r"""<(?:!--(.*?)(?:--!?>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z))""", re.DOTALL)
_CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@lru_cache(maxsize=50_000)
def name_parts(name: str) -> tuple[str, ...]:
    """The words of a class, id or role: at hyphens and the like, and at capital letters."""
    return tuple(p.lower() for p in _PARTS.findall(name))


@lru_cache(maxsize=50_000)
def is_hint(name: str) -> bool:
    """Whether a whole class, id or role marks what is no article."""
    parts = name_parts(name)
    if not parts or parts[0] in HAS:
        return False
    if not MARKERS.isdisjoint(parts):
        return True
    said = [p for p in parts if p not in NEUTRAL]
    return bool(said) and (said[-1] in HEADS or HINTS.issuperset(said))


_SAYS = re.compile(r"\b(?:" + "|".join(map(re.escape, SAYS)) + r")\b")


def says_notice(text: str) -> bool:
    return _SAYS.search(text.lower()) is not None


def block_features(page: str) -> tuple[list[str], np.ndarray]:
    """The texts of the non-empty blocks and a matrix of FEATURES."""
    texts: list[str] = []
    rows: list[list[float]] = []
    parts: list[str] = []
    linked = 0  # words in links
    cited = False  # under the heading of a list of references
    stack: list[tuple[str, int, int, int, int]] = []  # name, furniture, hint, article, heading
    where: dict[str, list[int]] = {}  # places in the stack by name, so that an end tag needs no search
    depth = [0, 0, 0, 0]
    in_link, link_depth = False, 0  # a link ends with the element it was opened in
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = entities.unescape(raw)
            parts.append(raw)
            if in_link:
                linked += len(raw.split())

    def close_block() -> None:
        nonlocal linked, cited
        if parts:
            words = "".join(parts).split()
            if words:
                n = len(words)
                texts.append(" ".join(words))
                block = texts[-1]
                if depth[3]:
                    cited = block.lower().strip(" :.[]") in CITED
                rows.append([n, min(1.0, linked / n), *(float(d > 0) for d in depth), float(n < 2 * SAYS_WORDS and says_notice(block)), float(cited and not depth[3])])
            parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal in_link, link_depth
        for item in stack[k:]:
            where[item[0]].pop()
            for j in range(4):
                depth[j] -= item[j + 1]
        del stack[k:]
        if link_depth > k:
            in_link, link_depth = False, 0

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if name in BLOCKS and not (name == "button" and where.get("p") and not where.get("button")) or name in where and where[name]:
                close_block()
            if name == "a":
                in_link, link_depth = False, 0
            if where.get(name):
                pop(where[name][-1])
            continue
        if name in SKIPPED and name != "head":
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        names, hint = set(), False
        if m[4]:
            for kind, value in _CLASS.findall(m[4]):
                value = value.strip("\"'")
                names.update(name_parts(value))
                if not (name == "section" and kind.lower() == "id"):
                    hint = hint or any(map(is_hint, value.split()))
        if name == "a":
            in_link, link_depth = True, len(stack)
        if name == "button" and where.get("p"):
            continue  # a word of its paragraph
        if name in BLOCKS or hint and name not in VOID:  # a hint makes a block of an inline element too
            close_block()
            if stack and stack[-1][0] == "head" and name != "head":
                pop(len(stack) - 1)  # its end tag may be left out
            if name in VOID:
                continue
            if name in ("p", "li", "option") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            inside = depth[2] > 0
            item = (
                name, int(name in FURNITURE or (name == "header" and not inside) or name == "head"), int(hint and name not in UNHINTED),
                int(name in ("article", "main") or (name in BLOCKS and not ARTICLES.isdisjoint(names) and name not in ("body", "html"))), int(name in HEADINGS),
            )
            where.setdefault(name, []).append(len(stack))
            stack.append(item)
            for j in range(4):
                depth[j] += item[j + 1]
            if name == "a":
                link_depth = len(stack)
    close_block()
    x = np.array(rows, float).reshape(-1, 8)
    out = np.zeros((len(x), len(FEATURES)))
    out[:, :2], out[:, 6:] = x[:, :2], x[:, 2:]
    out[1:, 2:4], out[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    return texts, out


def labelled_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every shape with every mark: features, labels and weights."""
    shapes = [[float(v) for v in line.split()] for line in SHAPES.strip().splitlines()]
    marks = [[int(v) for v in line.split()] for line in MARKS.strip().splitlines()]
    x = [[*s[:6], *m[:3], s[6], *m[3:5]] for m in marks for s in shapes]
    y = [int(s[7 + m[5]]) if m[5] >= 0 else 0 for m in marks for s in shapes]
    return np.array(x, float), np.array(y), np.repeat([float(m[6]) for m in marks], len(shapes))


def impurity(y: np.ndarray, weight: np.ndarray) -> float:
    """Gini impurity by the weight of the rows."""
    total = weight.sum()
    p = (y * weight).sum() / total if total else 0.0
    return 2 * p * (1 - p) * total


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int = 14):
    """A tree: a class, or (feature, threshold, tree at or below it, tree above)."""
    most = int((y * weight).sum() * 2 > weight.sum())
    if depth == 0 or len(set(y.tolist())) < 2:
        return most
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            cost = impurity(y[low], weight[low]) + impurity(y[~low], weight[~low])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None or best[0] >= impurity(y, weight) - 1e-12:
        return most
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], weight[low], depth - 1), grow(x[~low], y[~low], weight[~low], depth - 1))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, classify(low, x), classify(high, x))


@lru_cache(maxsize=1)
def default_tree():
    return grow(*labelled_table())


def main_text(page: str, tree) -> tuple[str, int, int]:
    """(text, blocks, kept blocks)."""
    texts, x = block_features(page)
    keep = classify(tree, x) == 1 if len(texts) else []
    kept = [t for t, k in zip(texts, keep, strict=True) if k]
    return " ".join(kept), len(texts), len(kept)


def extract_pages(pages: DataFrame, tree=None) -> DataFrame:
    """EXTRACTED per page."""
    tree = tree if tree is not None else default_tree()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [main_text(h, tree) for h in pdf["html"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": [g[0] for g in got], "n_chars": [len(g[0]) for g in got],
                "n_blocks": [g[1] for g in got], "n_kept": [g[2] for g in got],
            })

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInPandas(run, EXTRACTED)
