"""Document models and printed pages against models in Python."""

from __future__ import annotations

import json
import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from inkflow.operators import model, paging, structure

DOCS = "doc_id long, text string, lang string, source string"
TEXTS = ["Chapter 1\none two-\nthree\n\nfour \"five\" \\ ü中\n\nSection 2\nsix", None, "", " \n ", "plain\ttext\n\nmore", "before\nChapter one\nafter", "Chapter 1\nChapter 2"]


def lines(df):
    return df.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def paragraph(text):
    return {"type": "paragraph", "text": text, "style": "normal", "alignment": "left", "indent": 0.0, "spacing_before": 0.0, "spacing_after": 0.0, "footnote_refs": [], "is_quote": False, "heading_level": None}


def chapter(title, number, *texts):
    return {"title": title, "number": number, "blocks": [paragraph(t) for t in texts], "footnotes": [], "start_on_recto": True}


def meta(words, language="en"):
    return {"title": "", "author": "", "isbn": "", "language": language, "word_count": words, "page_count_estimate": 0, "has_front_matter": False, "has_back_matter": False, "detected_by_ai": False, "ai_cost": 0.0}


CHAPTERS = {
    0: [chapter("Chapter 1", 1, "one twothree", "four \"five\" \\ ü中"), chapter("Section 2", None, "six")], 1: [], 2: [], 3: [], 4: [chapter("Main Content", None, "plain\ttext", "more")],
    5: [chapter("Chapter one", 1, "after")], 6: [chapter("Main Content", None, "Chapter 1 Chapter 2")],
}
WORDS = {i: len((t or "").split()) for i, t in enumerate(TEXTS)}


def frame(spark):
    rows = [(i, t, None if i == 5 else "de", None if i == 4 else "s" if i < 4 else "t") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).withColumn("title", F.lit("a clash")).withColumn("piece", F.lit(1))


def test_document_model_json(spark):
    """The lines of JSON are the models, whatever the text: null, empty, blank, without a title, with text before the first."""
    docs = frame(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/models"
    models = model.document_model(docs, structure.paragraphs(lines(docs), True))
    model.write_models(models, path)
    got = {r["doc_id"]: r for f in Path(path).glob("part-*") for r in map(json.loads, f.read_text().splitlines())}
    for i in range(len(TEXTS)):
        want = {"doc_id": i, "metadata": meta(WORDS[i], "en" if i == 5 else "de"), "chapters": CHAPTERS[i], "front_matter": [], "back_matter": []}
        assert got[i] == want
    assert sorted(map(str, model.read_models(spark, path).collect())) == sorted(map(str, models.collect()))


def test_document_model_empty(spark):
    docs = frame(spark).where("false")
    p = structure.paragraphs(lines(docs), True)
    assert model.document_model(docs, p).count() == 0 and model.book_pieces(docs, p).count() == 0


def test_books_are_json(spark):
    """The files of a source, in the order of their names, are what a serialiser with two blanks a level gives."""
    docs = frame(spark)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/books"
    model.write_books(model.book_pieces(docs, structure.paragraphs(lines(docs), True)), path)
    for source, ids in (("s", range(4)), ("t", (5, 6))):
        text = "".join(f.read_text() for f in sorted(Path(path, f"source={source}").glob("part-*")))
        want = {"metadata": meta(sum(WORDS[i] for i in ids)), "chapters": [c for i in ids for c in CHAPTERS[i]], "front_matter": [], "back_matter": []}
        assert text == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    assert len(list(Path(path).glob("source=*"))) == 2


def test_hot_book_over_many_files(spark):
    """A book of 3,000 chapters lies in several files and is still one JSON."""
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat('Chapter 1\\nx', id, '\\n\\ny\\nPart 2\\nz') AS text", "'en' AS lang", "'hot' AS source")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/books"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        model.write_books(model.book_pieces(docs, structure.paragraphs(lines(docs), True)), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(path, "source=hot").glob("part-*"))
    got = json.loads("".join(f.read_text() for f in files))["chapters"]
    assert len(files) > 1 and len(got) == 3000
    assert [(c["number"], [b["text"] for b in c["blocks"]]) for c in got[:4]] == [(1, ["x0", "y"]), (None, ["z"]), (1, ["x1", "y"]), (None, ["z"])]


def pages_model(text, budget):
    if text is None:
        return []
    out = []
    for part in text.split("\f"):
        ls = part.split("\n")
        out += [ls[i : i + budget] for i in range(0, len(ls), budget)]
    return out


def facts_model(text, budget):
    p = pages_model(text, budget)
    filled = [[x for x in page if x.strip()] for page in p]
    first = "\n".join(p[0]) if p else ""
    flat, n, inside, i = [x for page in p[:10] for x in page], 0, 0, 0
    while i < len(flat) - 1:
        a, b = flat[i].strip(), flat[i + 1]
        hit = 0 < len(a) < 50 and len(b.strip()) > 2 * len(a)
        n, inside, i = n + hit, inside + (hit and len(b) - len(b.lstrip(" \t")) >= 2), i + 1 + hit
    body = [x for page in filled[:20] for x in page]
    indented = [len(x) - len(x.lstrip(" \t")) >= 2 for x in body]
    other = [not k and len(x.strip()) > 10 and not (x.strip()[0].isdigit() or x.strip()[0].isupper()) for k, x in zip(indented, body, strict=True)]
    sparse = [k + 1 for k, page in enumerate(filled[:50]) if k > 0 and 0 < len(page) < 5]
    return (len((text or "").encode()), len(p), len(first), len(first.strip()) > 10, sparse, sum(indented), sum(indented) + sum(other), n, inside, sum(map(len, filled[:10])))


def test_page_facts(spark):
    rng = random.Random(5)
    words = ["a", "Title", "  indented line of text", "\tx", "\t \ttabbed text of some length", "7 sins of a long line", "", " ", "lower case line that is long", "Été is a long line"]
    texts = [None, "", "\f", "\n\n", "\f\f\n", "x" * 100_000, "\n".join(["word"] * 9_000)]
    texts += ["".join(rng.choice(words) + rng.choice("\n\n\n\n\n\f") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_pages", F.lit("a clash"))
    for budget in (1, 6, 40):
        got = {r[0]: tuple(r)[1:] for r in paging.page_facts(df, budget).collect()}
        for i, t in enumerate(texts):
            assert got[i] == facts_model(t, budget), (i, budget)


def test_page_checks(spark):
    """Limits from both sides."""
    none = {"doc_id": 0, "title": "t", "author": "a", "n_bytes": 0, "n_pages": 24, "first_chars": 11, "first_filled": True, "sparse": [], "indented": 8, "eligible": 10}
    changes = [
        ({}, {}), ({"n_bytes": 100 << 20}, {}), ({"n_bytes": (100 << 20) + 1}, {"file_size": "warning"}), ({"n_bytes": (500 << 20) + 1}, {"file_size": "fail"}), ({"n_pages": 23}, {"page_count": "fail"}),
        ({"n_pages": 1000}, {}), ({"n_pages": 1001}, {"page_count": "warning"}), ({"title": None}, {"metadata": "warning"}), ({"author": ""}, {"metadata": "warning"}), ({"first_filled": False}, {"text_extraction": "warning"}),
        ({"n_pages": 0, "first_filled": False}, {"text_extraction": "error", "page_count": "fail"}), ({"sparse": [2, 3]}, {"page_content_distribution": "warning"}), ({"eligible": 9}, {"text_indentation_patterns": "warning"}),
        ({"indented": 7}, {"text_indentation_patterns": "warning"}), ({"indented": 5}, {"text_indentation_patterns": "fail"}), ({"indented": 6}, {"text_indentation_patterns": "warning"}),
    ]
    schema = "doc_id long, title string, author string, n_bytes long, n_pages long, first_chars long, first_filled boolean, sparse array<int>, indented long, eligible long"
    facts = spark.createDataFrame([tuple((none | c | {"doc_id": i}).values()) for i, (c, _) in enumerate(changes)], schema)
    got = {(r.doc_id, r.check_name): r.status for r in paging.page_checks(facts).collect()}
    for i, (_, want) in enumerate(changes):
        assert {n: s for (d, n), s in got.items() if d == i and s != "pass" and n != "kdp_page_breaks"} == want, i
