"""Detection by chunks: failing chunks are one paragraph each, the others as they would be without them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from inkflow.operators import detection

SCHEMA = "doc_id long, text string"
ROWS = [(i, "\n".join(f"line {j} of {i} " + "x" * ((i * 7 + j * 3) % 30) for j in range(i % 9))) for i in range(40)] + [(100, None), (101, " \n"), (102, "y" * 20_000), (103, "é z")]


def answer(chunk, number, total):
    return json.dumps({"blocks": [{"type": "quote", "text": x, "metadata": {"attribution": f"{number}/{total}"}} for x in chunk.split("\n\n")], "more": 1})


def flaky(chunk, number, total):
    kind = (len(chunk) + number) % 6
    if kind == 0:
        raise ValueError(chunk)
    return [None, "", "no {json", '["a", "list"]', "{}", answer(chunk, number, total)][kind]


def run(spark, port, **how):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("chunk", F.lit(0)).repartition(3)
    rows = detection.chunks(docs, F.coalesce("text", F.lit("")), 80).withColumn("error", F.lit("a clash"))
    return rows.collect(), detection.blocks(detection.answers(rows, port)).collect()


def test_failing_chunks(spark):
    chunks, got = run(spark, flaky)
    _, whole = run(spark, answer)
    kinds = {(c.doc_id, c.chunk_no): (c.chunk, 6 if (k := (len(c.chunk) + c.chunk_no) % 6) == 0 else k) for c in chunks}
    assert {k for _, k in kinds.values()} == set(range(1, 7))
    fails = {1, 2, 3, 6}
    want = {}
    for r in whole:
        chunk, kind = kinds[r.doc, r.chunk_no]
        mine = want.setdefault((r.doc, r.chunk_no), [])
        if kind == 5:
            mine.append(("quote", r.text, r.attribution, False))
        elif kind in fails:
            mine[:] = [("paragraph", chunk, None, True)]
    seen = {}
    for r in sorted(got, key=lambda r: (r.doc, r.ord)):
        seen.setdefault((r.doc, r.chunk_no), []).append((r.type, r.text, r.attribution, r.failed))
    assert seen == {k: v for k, v in want.items() if v}
    assert list(seen) == sorted(seen)
    for d in {d for d, _ in seen}:
        assert sorted(r.ord for r in got if r.doc == d) == list(range(1, 1 + sum(r.doc == d for r in got)))


def test_documents_without_chunks(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.doc: r.text for r in detection.detected(docs.where("doc_id >= 100"), answer).collect()}
    assert got == {102: "y" * 20_000, 103: "é z"}
    plain = detection.detected(docs.where("doc_id = 103"), answer, normalised=False).collect()
    assert [r.text for r in plain] == ["é z"]
    assert detection.detected(docs.where("false"), answer).count() == 0
