"""License scans against brute force over sets and places."""

from __future__ import annotations

import random
import re

import pytest

from inkflow.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def brute(text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    blocks = re.split(r"\n\n+", re.sub(r" ?\n ?", "\n", re.sub(r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ", low)))
    found = []
    for block in blocks:
        b = set(block.split(" ")) if "\n" not in block else set(re.split("[ \n]", block))
        for label, t in templates:
            t = set(WORD.findall(t.translate(LOWER)))
            if t and len(b & t) >= licenses.least_overlap(len(t), least):
                found.append((label, len(b & t) / len(t)))
    base = {label for _, label in places}
    score = 1.0 if places else max((c for _, c in found), default=0.0)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {k for k, _ in found})), score, len(found)


def texts():
    rng = random.Random(2)
    common = "the of and to in is that it for was on with as be at by software license under any".split()
    out = [None, "", " \n\n\t ", "MIT License", "mit-license, apache license apache license; CC\nBY cc by", "permit license", "mit  licensed", "gnu general public license gnu general public license"]
    out += ["The MİT License K apache license", "x" * 100_000 + " mit license", "apache\n\n\nlicense", "mit license " * 5000, "license mit license mit license"]
    for _, t in licenses.TEMPLATES:
        out.append(t)
        words = t.split()
        for share in (0.1, 0.2, 0.3, 0.5):
            ws = [w if rng.random() > share else rng.choice(common) for w in words]
            rng.shuffle(ws)
            pad = [rng.choice(common) for _ in range(200)]
            out.append("# " + "\n# ".join(" ".join(ws[i : i + 7]) for i in range(0, len(ws), 7)) + "\n#\n#\n" + " ".join(pad))
            out.append("\r\n".join([*pad[:50], *ws, *pad[50:]]))
        half = len(words) // 2
        out.append(" ".join(words[:half]) + "\n \t\n" + " ".join(words[half:]))  # in two blocks
    out += [" ".join(rng.choice(common) for _ in range(3000)) for _ in range(5)]
    return out


def test_scan_against_brute_force(spark):
    every = texts()
    rows = [(i if i % 7 else None, t, "row", 1, "words") for i, t in enumerate(every)] + [(3, every[3], "row", 1, "words")] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, row string, block int, words string").repartition(3))
    want = sorted(str((i, *brute(t))) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert sum(brute(t)[7] > 0 for t in every) > 10  # templates are found, also with words replaced


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_any_templates_and_thresholds(spark, least):
    rng = random.Random(7)
    letters = [f"w{i}" for i in range(30)]
    templates = [(f"t{k % 3}", " ".join(rng.sample(letters, rng.randint(1, 12)))) for k in range(8)] + [("none", "..."), ("t9", "w1")]
    rows = [(i, "\n\n".join(" ".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, least=least)
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute(t, templates, least)) for i, t in rows)


def test_no_rows_and_no_templates(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = licenses.scan(spark.createDataFrame([(1, "the mit license")], "doc_id long, text string"), templates=[]).first()
    assert (r.n_base, r.first_word, r.labels, r.score, r.templates) == (1, 1, "mit", 1.0, 0)


def test_no_python_on_the_way(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
