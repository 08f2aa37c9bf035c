"""Personal data by base patterns and a skip-chain conditional random field.

Base spans come from fixed patterns.  The field's nodes are the base spans and what resembles one: longer numbers in any
grouping, four small numbers in a row, addresses in words ("name (at) host.org"), and words that are the local part of an
address of the text.  Chain edges join neighbours; skip edges join a node to the last and the first node with the same or a
similar form (equal digits, equal last seven digits, equal four numbers, equal address or local part), so their number is
linear.  Loopy sum-product message passing gives each node's label; base nodes keep theirs, and other nodes whose label is
certain enough are added spans of that kind.

Weights are learned by pseudo-likelihood in numpy on at most TRAIN_ROWS documents (those with the least hash of
doc_id) and TRAIN_NODES nodes of each.  Base nodes have their labels and other nodes none, but those of the same form as a
base node have its label, and those of a similar form stay unlabelled.  Every base node is also learned masked, as a
repetition may write it (a number without its sign or in other groups, an address in words, its local part): with a skip
edge to the base node it has that node's label, and without one it is no personal data, unless its form alone tells (an
address in words).  The same is learned from PIECES spans of every kind that are made up, as a corpus may lack a kind, and
from numbers that are none.  So what a repetition is, skip edges decide.  All share one matrix of potentials: what label the
other end's label makes likely.

Nulls: a null text is empty and has no spans.  Null and repeated doc_ids stay separate rows; of repeated doc_ids, the
text of the least hash is learned from.  Documents without such nodes, and empty tables, need no model.  Very long texts:
patterns are linear, and edges are linear in nodes.  Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_ROWS, TRAIN_NODES, EPOCHS, RATE = 2000, 200, 8, 0.2
CERTAIN, ROUNDS, DAMPING = 0.9, 20, 0.5
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20()./-]{0,2}[0-9])++")
_FOUR = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?[.,-] ?|\[\.\]| dot | )[0-9]{1,3}){3}(?![0-9])")
_AT = re.compile(r" ?@ ?| ?[\[(]at[\])] ?| at ", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)+", re.IGNORECASE)
_DOT = re.compile(r" ?[\[(]dot[\])] ?| dot ", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]++")
_DIGIT = re.compile(r"[0-9]")
PIECES, LEAST_LOCAL = 60, 4
#: Local parts of functions, not of persons: as words they are no personal data.
ROLES = frozenset("info contact support sales admin administrator office mail email hello help team service services press jobs news newsletter webmaster postmaster noreply abuse billing shop privacy security".split())

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: only the at sign that ends a run of local characters can belong to it, so each at sign is
    tried once with the longest run before it that no earlier match holds."""
    at, free = text.find("@"), 0
    while at >= 0:
        k = at
        while k > free and (text[k - 1] in _LOCAL_CHARS):
            k -= 1
        m = _DOMAIN.match(text, at + 1) if k < at else None
        if m:
            yield k, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x) <= 255 if len(x) < 10 else int(x[-300:]) <= 255 and not x[:-300].strip("0") for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def spaced_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with blanks or words for the at sign or the dots: from each at sign the whole run of local characters before
    it and the host after it."""
    free = 0
    for m in _AT.finditer(text):
        k = m.start()
        while k > free and text[k - 1] in _LOCAL_CHARS:
            k -= 1
        host = _HOST.match(text, m.end()) if k < m.start() else None
        if host:
            yield k, host.end()
            free = host.end()


def local_part(piece: str) -> str:
    return piece.partition("@")[0]


def other_nodes(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Look-alikes that overlap no base span and not one another; of those that do, addresses come before numbers."""
    found = []
    low = text.lower()
    if "@" in text or " at " in low or "(at)" in low or "[at]" in low:
        found += [(a, b, 0) for a, b in spaced_addresses(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), 1) for m in _FOUR.finditer(text) if all(int(x) <= 255 for x in re.findall(r"[0-9]+", m[0]))]
        found += [(*m.span(), 2) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7]
    locals_ = {x for k, a, b in base if k == 0 and len(x := local_part(text[a:b])) >= LEAST_LOCAL}
    locals_ |= {x for a, b, k in found if k == 0 and len(x := local_part(address(text[a:b]))) >= LEAST_LOCAL}
    locals_ -= ROLES
    if locals_:
        found += [(a, a + len(t), 3) for m in _TOKEN.finditer(text) for t, a in [(m[0].rstrip(".-"), m.start())] if t.lower() in locals_ or t in locals_]
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[int, int]] = []
    for kind in range(4):
        more, k = [], 0
        for a, b, of in sorted(found):
            if of != kind:
                continue
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not (k < len(taken) and taken[k][0] < b) and not (more and a < more[-1][1]):
                more.append((a, b))
        out += more
        taken = sorted([*taken, *more])
    return sorted(out)


def address(piece: str) -> str:
    """An address in words as an address, in lower case."""
    return _DOT.sub(".", _AT.sub("@", piece.lower(), count=1))


def four(piece: str) -> list[int] | None:
    parts = [int(x) for x in re.findall(r"[0-9]+", piece)]
    return parts if len(parts) == 4 and max(parts) <= 255 and not piece.startswith("+") else None


def is_address(piece: str) -> bool:
    return _AT.search(piece) is not None and any(c.isalpha() for c in piece)


def features(piece: str, before: str) -> list[str]:
    digits = len(_DIGIT.findall(piece))
    if is_address(piece):
        low = piece.lower()
        return ["bias", f"sign{'@' in piece}", f"marked{'(at)' in low or '[at]' in low}", f"blank{' @' in low or '@ ' in low}", f"dots{_DOT.search(low) is not None}"]
    if digits < 7 and four(piece) is None:
        return ["bias", "word", f"plain{piece.isalpha()}"]
    out = ["bias", f"digits{min(digits, 20)}", f"dots{min(piece.count('.'), 4)}", f"four{four(piece) is not None}"]
    out += [f"space{' ' in piece}", f"dash{'-' in piece}", f"paren{'(' in piece}", f"slash{'/' in piece}"]
    if digits in range(16, 20):
        out.append(f"luhn{luhn(''.join(_DIGIT.findall(piece)))}")
    out.append(f"plus{piece.startswith('+') or before.endswith('+')}")
    return out


def forms(piece: str) -> list[str]:
    """Nodes that share one of these are linked."""
    if is_address(piece):
        low = address(piece)
        return [f"a{low}", f"l{local_part(low)}"]
    digits = "".join(_DIGIT.findall(piece))
    parts = four(piece)
    if len(digits) < 7 and parts is None:
        return [f"l{piece.lower()}"]
    out = [f"n{digits}", f"t{digits[-7:]}"] if len(digits) >= 7 else []
    return [*out, f"i{'.'.join(map(str, parts))}"] if parts else out


def links(pieces: list[str]) -> list[tuple[int, int]]:
    """Skip edges: to the last and to the first node of each form."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    out = set()
    for i, p in enumerate(pieces):
        for f in forms(p):
            if f in first:
                out |= {(first[f], i), (last[f], i)}
            first.setdefault(f, i)
            last[f] = i
    return sorted(out)


def regrouped(digits: str, by: str, rng: random.Random) -> str:
    out, at = [], 0
    while at < len(digits):
        n = rng.randint(2, 5)
        out.append(digits[at : at + n])
        at += n
    return by.join(out)


def masked(kind: int, piece: str, rng: random.Random) -> list[tuple[str, int]]:
    """How a repetition may write a span, each with its label when nothing is linked to it."""
    digits = "".join(_DIGIT.findall(piece))
    if kind == 0:
        local, _, host = piece.partition("@")
        at, dot = rng.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", " (dot) ")])
        out = [(local + at + host.replace(".", dot), 1), (f"{local} at {host}", 0)]
        return [*out, (local, 0)] if len(local) >= LEAST_LOCAL else out
    if kind == 1:
        return [(rng.choice([" . ", "-", ", ", " ", "[.]", " dot "]).join(re.findall(r"[0-9]+", piece)), 0)]
    if kind == 2:
        return [(regrouped(digits, rng.choice([".", "/", "  ", " - ", ""]), rng), 0)]
    return [(piece.lstrip("+"), 0), (regrouped(digits, rng.choice([" ", "-", ".", "/", ""]), rng), 0), ("0" + regrouped(digits[-rng.randint(7, 9) :], rng.choice([" ", "-", ""]), rng), 0)]


def made_up(rng: random.Random) -> list[tuple[int, str]]:
    """PIECES spans of every kind."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(PIECES):
        out.append((0, f"{word(4, 8)}{rng.choice(['', '.', '_'])}{rng.choice([word(3, 7), number(2)])}@{word(3, 9)}.{rng.choice(['com', 'org', 'example.net'])}"))
        out.append((1, ".".join(str(rng.randrange(256)) for _ in range(4))))
        body = number(rng.randint(15, 18))
        out.append((2, next(body + d for d in "0123456789" if luhn(body + d))))
        out.append((3, "+" + rng.choice("123456789") + regrouped(number(rng.randint(8, 12)), rng.choice(["", " ", "-"]), rng)))
    return out


class Model:
    """unary: weights by feature; chain and skip: label by label."""

    def __init__(self, unary: dict[str, list[float]] | None = None, chain=None, skip=None):
        n = len(LABELS)
        self.unary = {k: np.array(v) for k, v in (unary or {}).items()}
        self.chain = np.zeros((n, n)) if chain is None else np.array(chain)
        self.skip = np.zeros((n, n)) if skip is None else np.array(skip)

    def scores(self, fs: list[str]) -> np.ndarray:
        return sum((self.unary[f] for f in fs if f in self.unary), np.zeros(len(LABELS)))


class Graph:
    """Nodes of one text, in order, with their edges."""

    def __init__(self, text: str, base: list[Span], others: list[tuple[int, int]]):
        nodes = sorted([(a, b, kind + 1) for kind, a, b in base] + [(a, b, 0) for a, b in others])
        self.spans = [(a, b) for a, b, _ in nodes]
        self.base = [label for *_, label in nodes]
        self.pieces = [text[a:b] for a, b in self.spans]
        self.before = [text[max(0, a - 2) : a] for a, _ in self.spans]
        self.skips = links(self.pieces)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


Case = tuple[list[str], int, int, int, list[int]]  # features, label, labels of the neighbours (-1: none known) and of the skip edges' other ends


def repetitions(kind: int, piece: str, left: int, right: int) -> list[Case]:
    """A span masked, with a skip edge to itself and without one."""
    rng = random.Random(zlib.crc32(piece.encode()))
    out = []
    for text, alone in masked(kind, piece, rng):
        fs = features(text, "")
        out += [(fs, kind + 1, kind + 1, right, [kind + 1]), (fs, (kind + 1) * alone, left, right, [])]
        if not alone:
            out.append((fs, 0, kind + 1, right, []))  # beside another of its kind, and not linked
    return out


def cases(g: Graph, most: int = TRAIN_NODES) -> list[Case]:
    """What can be learned from each labelled node given its labelled neighbours, and from base nodes masked."""
    by_form = {forms(p)[0]: y for p, y in zip(g.pieces, g.base, strict=True) if y}
    similar = {i for a, b in g.skips for i, j in ((a, b), (b, a)) if g.base[j] and not g.base[i]}
    known = [y or by_form.get(forms(p)[0], -1 if i in similar or is_address(p) else 0) for i, (p, y) in enumerate(zip(g.pieces, g.base, strict=True))]
    beside: list[list[int]] = [[] for _ in known]
    for a, b in g.skips:
        beside[a].append(b)
        beside[b].append(a)
    out: list[Case] = []
    for i, y in enumerate(known[:most]):
        left, right = known[i - 1] if i else -1, known[i + 1] if i + 1 < len(known) else -1
        if y >= 0:
            out.append((features(g.pieces[i], g.before[i]), y, left, right, [known[j] for j in beside[i] if known[j] >= 0]))
        if g.base[i]:
            out += repetitions(g.base[i] - 1, g.pieces[i], left, right)
    return out


def general_cases(seed: int = 1) -> list[Case]:
    """Spans that are made up, as they are and masked, and numbers and words that are none, alone and repeated."""
    rng = random.Random(seed)
    out: list[Case] = []
    for kind, piece in made_up(rng):
        out.append((features(piece, ""), kind + 1, -1, -1, []))
        out += repetitions(kind, piece, -1, -1)
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 19)))
        for text in (digits, regrouped(digits, rng.choice([" ", "-", ".", "/"]), rng), " ".join(str(rng.randrange(256)) for _ in range(4))):
            out += [(features(text, ""), 0, -1, -1, []), (features(text, ""), 0, rng.randrange(5), -1, [0])]
    return out


def train(every: list[Case], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Pseudo-likelihood by stochastic gradient ascent."""
    rng, model, agree = np.random.default_rng(seed), Model(), 0.0
    same = np.eye(len(LABELS))
    for _ in range(epochs):
        for k in rng.permutation(len(every)):
            fs, y, left, right, skips = every[k]
            for f in fs:
                model.unary.setdefault(f, np.zeros(len(LABELS)))
            z = model.scores(fs)
            z = z + (model.chain[left] if left >= 0 else 0) + (model.chain[:, right] if right >= 0 else 0)
            for s in skips:
                z = z + model.skip[s] + agree * same[s]
            d = -softmax(z)
            d[y] += 1
            d *= rate
            for f in fs:
                model.unary[f] += d
            if left >= 0:
                model.chain[left] += d
            if right >= 0:
                model.chain[:, right] += d
            for s in skips:
                agree += d[s]
                model.skip[s] += d / 2
                model.skip[:, s] += d / 2
    # One weight for agreement, which labels without repeated forms have too, and what each pair of labels adds to it.
    model.skip = model.skip + agree * same
    return model


def marginals(g: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs by loopy sum-product message passing; base nodes are observed."""
    n, m = len(g.spans), len(LABELS)
    unary = np.array([model.scores(features(p, b)) for p, b in zip(g.pieces, g.before, strict=True)]).reshape(n, m)
    for i, y in enumerate(g.base):
        if y:
            unary[i] = -50.0
            unary[i, y] = 0.0
    edges = [(i, i + 1, 0) for i in range(n - 1)] + [(a, b, 1) for a, b in g.skips]
    if not edges:
        return softmax(unary)
    a, b, kind = (np.array(x) for x in zip(*edges, strict=True))
    potential = np.stack([model.chain, model.skip])[kind]  # [edge, label of a, label of b]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(src), m))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, message)
        z = (total[src] - message[back])[:, :, None] + pot
        top = z.max(1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < 1e-4:
            break
    total = unary.copy()
    np.add.at(total, dst, message)
    return softmax(total)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    others = other_nodes(text, base)
    if not others:
        return []
    g = Graph(text, base, others)
    p = marginals(g, model)
    best = p.argmax(1)
    return sorted((int(y) - 1, a, b) for (a, b), was, y, q in zip(g.spans, g.base, best, p.max(1), strict=True) if not was and y and q >= CERTAIN)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one mark, of the kind that starts first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def general_model() -> Model:
    """Learned without a corpus."""
    return train(general_cases())


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn in one task from the cases of at most `most` documents."""
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    has = key.where(F.col("doc_id").isNotNull() & (F.col("text").contains("@") | F.col("text").rlike("[0-9]{4}")))
    ids = [r.doc_id for r in has.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not ids:
        return general_model()
    keys = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = key.join(F.broadcast(keys), "doc_id").withColumn("h", F.xxhash64("text"))  # bounded: `most` long integers are sent

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for t in pdf["text"]:
                base = base_spans(t)
                got.append(json.dumps(cases(Graph(t, base, other_nodes(t, base)))))
            yield pdf[["doc_id", "h"]].assign(cases=got)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((i, c) for pdf in batches for i, c in zip(pdf["doc_id"].tolist(), pdf["cases"], strict=True))
        m = train([*general_cases(), *(tuple(c) for _, cs in got for c in json.loads(cs))])
        yield pd.DataFrame({"names": [list(m.unary)], "unary": [[x for v in m.unary.values() for x in v.tolist()]], "chain": [m.chain.ravel().tolist()], "skip": [m.skip.ravel().tolist()]})

    each = rows.mapInPandas(found, "doc_id long, h long, cases string").groupBy("doc_id").agg(F.min_by("cases", "h").alias("cases"))
    sample = each.repartition(1)  # at most `most` rows of TRAIN_NODES cases
    r = sample.mapInPandas(learn, "names array<string>, unary array<double>, chain array<double>, skip array<double>").first()
    if r is None:
        return general_model()
    n = len(LABELS)
    return Model({k: r.unary[n * i : n * i + n] for i, k in enumerate(r.names)}, np.reshape(r.chain, (n, n)), np.reshape(r.skip, (n, n)))


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """FOUND per document: base counts and digest, and all spans."""
    model = model or fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                more = added_spans(text, base, model)
                counts = [sum(k == kind for k, *_ in base) for kind in range(4)]
                rows.append([*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)])
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")][1:], index=pdf.index)
            yield pd.concat([pdf[["doc_id"]].astype({"doc_id": "Int64"}), out], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, FOUND)


def redacted(docs: DataFrame, model: Model | None = None) -> Column:
    """The text with every span replaced by its kind; null stays null."""
    model = model or fit(docs)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            base = base_spans(t)
            return redact(t, base + added_spans(t, base, model))

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(F.col("text").cast("string"))
