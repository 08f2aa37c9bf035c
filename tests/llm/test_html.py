"""Main text of planted pages against what was planted, malformed markup, and the tree's use of its features."""

from __future__ import annotations

import random
import time

from inkflow.llm import html

WORDS = "river stone market winter letter garden bridge candle harbour morning".split()


def main_text(page: str) -> str:
    return html.main_text(page, html.default_tree())[0]


def planted(rng: random.Random, inside: str) -> tuple[str, list[str]]:
    """A page with the furniture that pages have, and its main text's blocks."""
    said = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    links = lambda n: "".join(f'<li><a href="/{i}">{said(1, 3)}</a></li>' for i in range(n))
    heading, blocks = said(2, 6), [said(1, 60) for _ in range(rng.randint(1, 9))]
    body = [f"<h1>{heading}</h1>"]
    for b in blocks:
        ws = b.split()
        if len(ws) > 6:
            ws[2] = f'<a href="/x">{ws[2]}</a>'
            ws[4] = f"<em>{ws[4]}</em>"
        body.append(f"<p>{' '.join(ws)}</p>")
    text = "\n".join(body)
    page = (
        f"<html><head><title>{said(2, 5)}</title><style>p{{}}</style></head><body><header>{said(1, 4)}</header><nav><ul>{links(6)}</ul></nav>"
        f'<div class="cookie-notice"><p>{said(5, 14)}</p></div>' + inside.format(text=text) + f'<div class="sidebar"><h3>{said(1, 3)}</h3><ul>{links(4)}</ul></div>'
        f'<form><label>{said(1, 2)}</label><button>{said(1, 1)}</button></form><div id="comments"><p>{said(3, 14)}</p></div><footer><p>{said(3, 20)}</p></footer></body></html>'
    )
    return page, [heading, *blocks]


def test_planted_pages():
    """Every planted block and nothing else, inside an article, a main element, a classed or a bare division."""
    rng = random.Random(1)
    for inside in ("<article>{text}</article>", "<main>{text}</main>", '<div class="post-content">{text}</div>', "<div>{text}</div>"):
        for _ in range(60):
            page, blocks = planted(rng, inside)
            assert main_text(page) == " ".join(blocks)


def test_numbers_decide():
    """Words and link densities split the blocks that no furniture holds, and the tree learns its whole table."""
    tree = html.default_tree()
    x, y, _ = html.labelled_table()
    assert (html.classify(tree, x) == y).all()

    def numeric(t, row) -> bool:
        return isinstance(t, tuple) and (t[0] < 6 or numeric(t[2] if row[t[0]] <= t[1] else t[3], row))

    assert all(numeric(tree, r) for r in x if not r[6] and not r[7] and not r[11])
    links = "".join(f'<p><a href="/{i}">Page {i}</a></p>' for i in range(8))
    words = "".join(f"<p>Page {i} of it</p>" for i in range(8))
    assert main_text(f"<body>{links}</body>") == "" and main_text(f"<body>{words}</body>").count("Page") == 8


NAMES = {
    "comments": ("user-comments", "disqus_thread", "readerComments", "comment-17", "post-comments", "comments-area", "article-discussion", "replies"),
    "adverts": ("promo-box", "ad-slot-3", "sponsored-content", "advert", "adsense_unit", "promo", "mid-article-ads", "sponsorBlock"),
    "notices": ("site-notice", "cookie-text", "gdpr-banner", "important-notice", "consentPopup", "newsletter-signup", "alert", "legal-notice"),
    "more": ("main-sidebar", "entry-footer", "related-posts-widget", "share", "breadcrumbs", "site-navigation", "socialLinks", "pager"),
}
PARTS = ("article-header", "has-sidebar", "entry-content", "post-body", "search-result", "comments-off", "lead", "pull-quote", "no-comments", "form-theory", "threaded-needle", "header-image-caption")


def test_furniture_of_any_length_and_name():
    """Comments, adverts, notices and the like of 5 to 200 words, inside the article and after it; article parts stay."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for names in NAMES.values():
        for name in names:
            for kind in ("class", "id"):
                for n in (5, 20, 60, 200):
                    one, two, extra = said(40), said(70), f'<div {kind}="{name}"><p>{said(n)}</p><p>{said(n)}</p></div>'
                    assert main_text(f"<body><article><p>{one}</p>{extra}<p>{two}</p></article></body>") == f"{one} {two}", name
                    assert main_text(f"<body><div><p>{one}</p><p>{two}</p></div>{extra}</body>") == f"{one} {two}", name
    for name in PARTS:
        one, two = said(40), said(9)
        assert main_text(f'<body><article><p>{one}</p><div class="{name}"><p>{two}</p></div></article></body>') == f"{one} {two}", name


def test_notices_without_names():
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for phrase in html.SAYS:
        for n in (0, 4, 20, 40):
            one, notice = said(80), f"{phrase.capitalize()} {said(n)}."
            assert main_text(f"<body><div><p>{notice}</p></div><div><p>{one}</p></div></body>") == one, phrase
    long = f"{said(50)} as most sites do, we use cookies {said(60)}"
    assert main_text(f"<article><p>{long}</p></article>") == main_text(f"<body><p>{long}</p></body>") == long
    assert main_text("<article><p>All rights reserved.</p><p>It oftheshare onstor.</p></article>") == "All rights reserved. It oftheshare onstor."


def test_formulas_buttons_and_references():
    assert main_text("<article><p>Let <math><mi>x</mi>=<mn>1</mn></math> be given.</p></article>") == "Let x=1 be given."
    assert main_text("<article><p>See <svg><title>icon</title><text>Figure</text></svg> here.</p></article>") == "See Figure here."
    assert main_text("<article><p>Press <button>Save</button> to go on with it.</p></article>") == "Press Save to go on with it."
    assert main_text("<article><p>One two three four.</p><button>Save</button></article>") == "One two three four."
    items = "".join(f'<li><a href="/{i}">Author {i}, a title of a paper</a></li>' for i in range(4))
    text = " ".join(f"Author {i}, a title of a paper" for i in range(4))
    for heading in ("References", "Further reading:", "Literatur"):
        got = main_text(f"<article><p>One two three four five.</p><h2>{heading}</h2><ol>{items}</ol><h2>After</h2><ul><li><a href='/'>Other page</a></li></ul></article>")
        assert got == f"One two three four five. {heading} {text} After"


def test_very_long_single_block():
    text = "word " * 200_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_malformed():
    cases = {
        '<article><p>Hi <a href="x>there</a> you': "Hi there you",
        '<article><p>a<span class="ad">Buy</span>b</p></article>': "a b",
        "<html><head><title>T</title><body><p>Only this here.</p>": "Only this here.",
        "<article><p><a href='/1'>One two<p>three four five six seven eight nine</article>": "One two three four five six seven eight nine",
        "<p>three small words</p>": "three small words",
        '<div class="comments-off"><article><p>Kept text.</p></article></div>': "Kept text.",
        '<article><p class="search-result">Result text.</p></article>': "Result text.",
        "<article><p>a</b></i></p></div>b</article>": "a b",
        "": "",
        "<": "<",
    }
    assert {k: main_text(k) for k in cases} == cases


def test_deep_and_long():
    began = time.time()
    assert main_text("<div>" * 20000 + "x y z" + "</b>" * 20000) == "x y z"
    assert main_text("<article>" + "<p>word</p>" * 50000 + "</article>").count("word") == 50000
    assert main_text("<p>" + "'<b>\"" * 50000)
    assert time.time() - began < 10


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, _row int"
    rows = [(1, "u", "<p>one two</p>", "clash", "clash", 1), (1, "u", "<p>one two</p>", "clash", "clash", 1), (None, None, None, None, None, None)]
    got = html.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "one two", 7), ("1", "one two", 7), ("None", "", 0)]
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0
