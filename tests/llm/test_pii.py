"""What the random field adds to the base spans: planted repetitions of every kind, and look-alikes that are none."""

from __future__ import annotations

import random
import time

from inkflow.llm import pii

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def planted(rng: random.Random) -> list[tuple[str, str, tuple[str, int] | None]]:
    """(what, text, the span to add and its kind)"""
    word = lambda a, b: "".join(rng.choice(LETTERS) for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    said = lambda: " ".join(word(2, 9) for _ in range(rng.randint(3, 30)))
    out = []

    def add(what, once, again, kind):
        out.append((what, f"{said()} {once} {said()} {again} {said()}", None if kind is None else (again, kind)))

    for _ in range(100):
        phone = f"+{rng.choice('123456789')} {number(3)} {number(3)} {number(4)}"
        card = next(c for c in (number(15) + d for d in "0123456789" * 50) if pii.luhn(c))
        fours = [card[i : i + 4] for i in range(0, 16, 4)]
        ip = [str(rng.randrange(256)) for _ in range(4)]
        local, host = word(4, 8) + rng.choice([".", "_", ""]) + number(2), word(4, 9) + ".org"
        mail = f"{local}@{host}"
        add("number without sign", phone, phone[1:], 3)
        add("number in other groups", phone, phone[1:].replace(" ", rng.choice("-./")), 3)
        add("card in other groups", " ".join(fours), rng.choice([".", "/", "  "]).join(fours), 2)
        add("address in four words", ".".join(ip), rng.choice([" . ", "-", ", ", "[.]", " dot "]).join(ip), 1)
        add("address in words", mail, f"{local}{rng.choice([' (at) ', '[at]', ' at '])}{host.replace('.', rng.choice(['.', ' dot ', ' (dot) ']))}", 0)
        add("local part", mail, local, 0)
        add("another number", phone, number(11), None)
        add("a repeated number that is none", card[:15], card[:15], None)
        add("another card", " ".join(fours), number(16), None)
        add("other four numbers", ".".join(ip), " ".join(str(rng.randrange(256)) for _ in range(4)), None)
        add("a place", mail, f"us at {word(5, 8)}.org", None)
        add("a function", f"info@{host}", "info", None)
    return out


def rates(model: pii.Model, cases) -> tuple[dict[str, float], float]:
    """Recall by what was planted, and the precision of all that was added."""
    hits: dict[str, list[bool]] = {}
    right = wrong = 0
    for what, text, want in cases:
        base = pii.base_spans(text)
        got = {(text[a:b], k) for k, a, b in pii.added_spans(text, base, model)}
        right, wrong = right + len(got & {want}), wrong + len(got - {want})
        if want:
            hits.setdefault(what, []).append(want in got)
    return {k: sum(v) / len(v) for k, v in hits.items()}, right / (right + wrong)


def test_repetitions_are_found_without_a_corpus():
    recall, precision = rates(pii.general_model(), planted(random.Random(11)))
    assert len(recall) == 6 and min(recall.values()) >= 0.9 and precision >= 0.95, (recall, precision)


def test_repetitions_are_found_with_the_model_of_a_corpus(spark, sf_dir):
    model = pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    recall, precision = rates(model, planted(random.Random(12)))
    assert len(recall) == 6 and min(recall.values()) >= 0.9 and precision >= 0.95, (recall, precision)


def test_skip_edges_decide():
    """Without them, or with the first mention gone, numbers alone are none."""
    model = pii.general_model()
    apart = pii.Model({k: v.tolist() for k, v in model.unary.items()}, model.chain, model.skip * 0)
    for what, text, want in planted(random.Random(13)):
        if want and what.startswith(("number", "card")) and len(pii.base_spans(text)) == 1:  # "1.203.44.5" is an ip by the patterns
            assert pii.added_spans(text, pii.base_spans(text), model)
            assert not pii.added_spans(text, pii.base_spans(text), apart)
            alone = text[text.rindex(want[0]) - 1 :]
            assert not pii.added_spans(alone, pii.base_spans(alone), model)


def test_long_local_parts_are_whole():
    long = "a" * 300 + ".b"
    text = f"write to {long} (at) host.org today"
    assert [text[a:b] for _, a, b in pii.added_spans(text, [], pii.general_model())] == [f"{long} (at) host.org"]


def test_linear_time():
    began = time.time()
    for text in ("x" * 300_000 + " (at) ", " at " * 50_000, "a at b at c " * 20_000, "1 " * 100_000, "1.2.3.4-" * 20_000, "a@" * 50_000, "jane.doe@x.org " + "jane.doe " * 20_000):
        base = pii.base_spans(text)
        pii.added_spans(text, base, pii.general_model())
    assert time.time() - began < 60
