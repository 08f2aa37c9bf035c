"""Python models of the sequential operators as a second opinion."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import structure


def test_dehyphenate(spark):
    rng = random.Random(1)
    cases = [["".join(rng.choice("a- ") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))] for _ in range(200)]

    def model(lines):
        out = lines[0]
        for x in lines[1:]:
            out = out[:-1] + x.lstrip() if out.endswith("-") else out + " " + x.lstrip()
        return out

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, t array<string>").select("id", T.dehyphenate(F.col("t")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {i: model(c) for i, c in enumerate(cases)}


def test_chunker(spark):
    rng = random.Random(2)
    cases = [["x" * rng.randrange(1, 30) for _ in range(rng.randrange(0, 12))] for _ in range(100)]

    def model(parts, most=40):
        out, cur = [], ""
        for p in parts:
            if len(cur) + len(p) + 2 > most:
                if cur:
                    out.append(cur.strip())
                cur = p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        return out + ([cur.strip()] if cur else [])

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, t array<string>").select("id", T.chunk_by(F.col("t"), 40, "\n\n", 2, True).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {i: model(c) for i, c in enumerate(cases)}


def test_pairs(spark):
    rng = random.Random(3)
    lines = [(d, i, "y" * rng.randrange(0, 40)) for d in range(30) for i in range(25)]
    got = {(r.doc_id, r.line_no) for r in structure.heading_pairs(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).collect()}
    want = set()
    for d in range(30):
        ls, i = [x for k, _, x in lines if k == d], 0
        while i + 1 < len(ls):
            if 0 < len(ls[i]) < 60 and len(ls[i + 1]) > 2 * len(ls[i]):
                want.add((d, i))
                i += 2
            else:
                i += 1
    assert got == want


def test_headers(spark):
    cases = {"part of the problem": True, "section a": True, "letter to a friend": True, "chapter": False, "chapter: one": False, "mild.": True, "1. hello": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", structure.is_header(F.col("s")).alias("h"))
    assert {r.s: r.h for r in df.collect()} == cases
    anchored = {"Parts": True, "Chapter 1: X": False, "did": True, "42": True, "Foreword": True}
    df = spark.createDataFrame([(k,) for k in anchored], "s string").select("s", structure.is_anchored_header(F.col("s")).alias("h"))
    assert {r.s: r.h for r in df.collect()} == anchored
