"""Quotation linking against a model that looks at every earlier message, and odd tables."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from inkflow.llm import quotes

MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
PUNCT = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def normal(words: str) -> str:
    plain = re.sub(rf"[ \t\n\r\f\v{PUNCT}]+", " ", words.lower()).strip(" ")
    return plain or re.sub(r"[ \t\n\r\f\v]+", " ", words).strip(" ")


def passages(text: str) -> list[tuple[int, str]]:
    out: list[tuple[int, list[str]]] = []
    for line in re.split("\r\n|\n", text):
        m = MARKS.match(line)
        level, words = (m[0].count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(words)
        else:
            out.append((level, [words]))
    return [(level, "\n".join(ls)) for level, ls in out] if ">" in text else [(0, text)]


def line_set(words: str) -> set[str]:
    return {normal(x) for x in words.split("\n")} - {""}


def model(messages: dict[int, str]) -> dict[int, int | None]:
    """reply_to of every turn of a conversation."""
    held = {}
    for turn, text in messages.items():
        own = [w for level, w in passages(text) if level == 0]
        whole = "\n".join(own)
        held[turn] = ({normal(x) for x in [*own, whole, *re.split(r"\n\s*\n", whole), *whole.split("\n")]} - {""}, line_set(whole))
    out = {}
    for turn, text in messages.items():
        found = []
        for level, words in passages(text):
            if level and normal(words):
                lines = line_set(words)
                of = [t for t, (units, own) in held.items() if normal(words) in units or len(lines) > 1 and lines <= own]
                if of and min(of) < turn:
                    found.append((-level, min(of)))
        out[turn] = max(found)[1] if found else None
    return out


def test_against_model(spark):
    rng = random.Random(8)
    vocab = ["Yes", "no way", "why not", "the cat", "a dog, too", "ok", "?!", "see you", "fine by me", ""]
    rows, want = [], {}
    for conv in range(120):
        messages: dict[int, str] = {}
        for turn in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(4)):
                if messages and rng.random() < 0.6:
                    taken = rng.choice(list(messages.values())).split("\n")
                    a = rng.randrange(len(taken))
                    lines += [("> " if rng.random() < 0.7 else ">") + x.upper() for x in taken[a : a + rng.randrange(1, 4)]]
                lines += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(3))]
            messages[turn] = "\n".join(lines)
        rows += [(conv, t, x) for t, x in messages.items()]
        want |= {(conv, t): r for t, r in model(messages).items()}
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == want and sum(x is not None for x in want.values()) > 150
    by = {(r.conv_id, r.turn): r for r in got}
    for r in got:  # the thread is where following replies ends
        at, depth = r, 0
        while at.reply_to is not None:
            at, depth = by[r.conv_id, at.reply_to], depth + 1
        assert (r.thread_turn, r.depth) == (at.turn, depth) and ">" not in r.text.replace("?!", "")


def test_odd_tables(spark):
    """A long quoting message, clashing names, an empty table."""
    long = "\n".join(f"line {i} of many" for i in range(3000))
    rows = [(1, 0, long), (1, 1, "\n".join("> " + x for x in long.split("\n")) + "\nAgreed."), (1, 2, "\n".join(("> " if i % 2 else "") + f"x{i}" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("u"))
    for name in ("parts", "lines", "begins", "hash", "depth", "raw"):
        docs = docs.withColumn(name, F.lit(1))
    began = time.time()
    got = {r.turn: r for r in quotes.link_quotes(docs).collect()}
    assert time.time() - began < 60
    assert got[1].reply_to == 0 and got[1].text == "Agreed." and got[2].reply_to is None and got[2].n_quotes == 1500
    assert quotes.link_quotes(docs.limit(0)).count() == 0
