"""Operators against models of the rules that they rebuild, and small cases worked out by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import structure
from inkflow.plans import manuscripts, validation
from inkflow.plans.documents import write_manuscripts
from inkflow.sources import files
from inkflow.streaming.streams import shared


def test_chunk_words(spark):
    """A word counts with the blank after it."""
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(60))) for _ in range(100)] + ["x" * 90 + " a"]

    def model(words, size):
        chunks, now, n = [], [], 0
        for w in words:
            if now and n + len(w) + 1 > size:
                chunks.append(" ".join(now))
                now, n = [], 0
            now.append(w)
            n += len(w) + 1
        return chunks + ([" ".join(now)] if now else [])

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.chunk_by(T.words(F.col("t")), 40, " ", 2, False).alias("c"))
    assert {r.id: r.c for r in df.collect()} == {i: model(t.split(), 40) for i, t in enumerate(texts)}


def test_heading_pairs_and_indentation(spark):
    rng = random.Random(2)
    docs = {d: [" " * rng.randrange(3) + rng.choice("aA1é") * rng.randrange(0, 70) + " " * rng.randrange(2) for _ in range(30)] for d in range(40)}
    lines = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id int, line_no int, line string")
    pairs, ratios = set(), {}
    for d, xs in docs.items():
        i = 0
        while i + 1 < len(xs):
            if 0 < len(xs[i].strip()) < 50 and len(xs[i + 1].strip()) > 2 * len(xs[i].strip()):
                pairs.add((d, i, xs[i + 1][:2] == "  "))
                i += 1
            i += 1
        inside = sum(x[:2] == "  " for x in xs if x.strip())
        other = sum(x[:2] != "  " and len(x.strip()) > 10 and not (x.strip()[0].isdigit() or x.strip()[0].isupper()) for x in xs if x.strip())
        ratios[d] = (inside, inside + other)
    assert {(r.doc_id, r.line_no, r.indented) for r in structure.heading_pairs(lines).collect()} == pairs
    assert {r.doc_id: (r.indented, r.eligible) for r in structure.indentation(lines).collect()} == ratios


def test_main_content(spark):
    """Hyphens at line ends join words; headers without a paragraph are text; a kept section drops what comes before."""
    texts = ["exam-\nple text\n\nmore", "some words\nChapter 1", "lost\nChapter 1\nkept here"]
    lines = spark.createDataFrame([(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))], "doc_id int, line_no int, line string")
    got = sorted((r.doc_id, r.title, r.n_paragraphs, r.n_words) for r in structure.text_sections(lines).collect())
    assert got == [(0, "Main Content", 2, 3), (1, "Main Content", 1, 4), (2, "Chapter 1", 1, 2)]


def test_page_sections():
    got = manuscripts.page_sections("Before all.\nLetter 1\n\nOn being\n(very) late\nThe text begins\nhere.\nDear Me,\nBody.\n\n2.\nThe rest is text\nforeword:\nA short start\n")
    assert got == [
        (1, "Introduction", None, 1, "normal", "Before all."), (2, "Letter 1", 2, 1, "subtitle", "On being (very) late"), (2, "Letter 1", 2, 2, "normal", "The text begins here."),
        (2, "Letter 1", 2, 3, "greeting", "Dear Me,"), (2, "Letter 1", 2, 4, "normal", "Body."), (3, "2.", 3, 1, "normal", "The rest is text"), (4, "foreword:", 4, 1, "normal", "A short start"),
    ]
    assert manuscripts.page_sections("only\n\ntext") == [(1, "Content", None, 1, "normal", "only"), (1, "Content", None, 2, "normal", "text")] and manuscripts.page_sections(" \n") == []


def test_rules(spark):
    """Statuses worked out by hand from the rules."""
    got: dict = {}
    for r in validation.print_checks(spark.createDataFrame(validation.PRINT_FILES, validation.PRINT_COLUMNS)).collect():
        got.setdefault(r.doc, {})[r.check_name] = r.status
    assert {s for n, s in got["good"].items() if n not in ("page_breaks",)} == {"pass"} and len(got["good"]) == 15
    poor = {"file_size": "fail", "page_count": "fail", "file_version": "warning", "fonts": "fail", "metadata": "warning", "page_dimensions": "warning", "text_extraction": "warning", "first_paragraphs": "fail",
            "drop_caps": "warning", "margin_accuracy": "warning", "page_content": "warning", "indentation": "fail", "paragraph_spacing": "warning", "paragraph_indentation": "warning", "formatting_style": "info"}
    assert {k: got["poor"][k] for k in poor} == poor
    assert got["edge"]["file_size"] == "pass" and got["edge"]["fonts"] == "warning" and got["edge"]["indentation"] == "warning" and "formatting_style" not in got["edge"] and got["edge"]["margin_accuracy"] == "pass"
    assert got["none"]["file_size"] == got["none"]["page_count"] == "error" and got["wide"]["page_count"] == "warning" and got["wide"]["fonts"] == "fail"
    plain = spark.createDataFrame(validation.SHEETS, "sheet string, css string")
    sheets = {r.sheet: r for r in validation.sheet_checks(plain.selectExpr("*", "true AS caps")).collect()}
    asked = {r.sheet: r.issues for r in validation.sheet_checks(plain.selectExpr("*", "1.0D AS wanted")).collect()}
    assert "drop cap" not in asked["poor"] and asked["good"] == "margin" and not asked["poor"].endswith("margin")  # by the book's options
    assert sheets["good"].status == "pass" and sheets["good"].issues == ""
    assert sheets["poor"].issues.split("; ") == ["orphans", "widows", "indent", "first paragraph", "paragraph after heading", "paragraph after chapter title", "drop cap line height", "drop cap margin", "chapter break", "heading break", "margin"]
    assert len(sheets["empty"].issues.split("; ")) == 8
    books: dict = {}
    for r in validation.book_checks(spark.createDataFrame(validation.MEMBERS, "book string, name string, size long"), spark.createDataFrame(validation.PACKAGES, "book string, opf string")).collect():
        books.setdefault(r.book, {})[r.check_name] = r.status
    assert set(books["good"].values()) == {"pass"} and set(books["poor"].values()) == {"fail", "warning"} and books["many"]["file_count"] == "fail"
    assert books["half"] == {"file_count": "pass", "file_sizes": "pass", "metadata": "fail", "navigation": "fail", "fonts": "warning", "structure": "fail"}


def test_sinks(spark):
    """Manuscripts in files, and files by suffix."""
    path = shared(spark, "manuscripts")
    parts = spark.createDataFrame([("s", i, f"part {i}\nof s") for i in range(25)] + [("t", 3, "alone")], "source string, doc_id long, t string")
    write_manuscripts(parts, path)
    for source, want in (("s", "\n\n".join(f"part {i}\nof s" for i in range(25)) + "\n"), ("t", "alone\n")):
        found = spark.read.text(f"{path}/source={source}/*.txt", wholetext=True).select("value", "_metadata.file_path").collect()
        assert "".join(r.value for r in sorted(found, key=lambda r: r.file_path)) == want
    seen = files.uploads(spark, f"{path}/source=t").collect()
    assert len(seen) == 1 and seen[0].suffix == ".txt" and seen[0].accepted and seen[0].bytes == 6


def test_section_goldens(spark):
    """Sections of texts of the known shapes: letters without numbers, chapters with a numbered heading among them, a preamble."""
    body = "Some prose of this part.\nIt goes on."
    letters = "\n\n".join(["A title", "Foreword", body, *[f"Letter {i}\n\n{body}" for i in range(1, 6)]])
    medium = "\n\n".join(["Front matter", "Introduction: why", body, *[f"Chapter {i}\n{body}" for i in (1, 2, 3)], "2. Speaking with care", body, *[f"Chapter {i}\n\n{body}" for i in range(4, 9)], "Conclusion: so", body])
    short = "\n\n".join(["Title", "Introduction", body, *[f"Chapter {i}\n\n{body}" for i in (1, 2, 3)], "Conclusion", body])
    lines = spark.createDataFrame([(d, i, x) for d, t in enumerate((letters, medium, short)) for i, x in enumerate(t.split("\n"))], "doc_id int, line_no int, line string")
    got: dict = {}
    for r in sorted(structure.text_sections(lines).collect(), key=lambda r: (r.doc_id, r.section_no)):
        got.setdefault(r.doc_id, []).append((r.title, r.number))
    assert got[0] == [(f"Letter {i}", None) for i in range(1, 6)]
    assert got[1] == [("Chapter 1", 1), ("Chapter 2", 2), ("Chapter 3", 3), ("2. Speaking with care", None), *[(f"Chapter {i}", i + 1) for i in range(4, 9)]]
    assert got[2] == [(f"Chapter {i}", i) for i in (1, 2, 3)]
