"""Whitening and code compression against brute force in plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from decimal import Decimal, getcontext

import numpy as np
import pytest

from inkflow.llm import codes, vectors, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, dim string, x string, code int, w string"


def kept(rows):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "x", 1, "w") for i, v, y in rows], SCHEMA).repartition(3)


def some_rows(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * (1.0 + np.arange(dim))
    rows = [(i, [float(c) for c in rng.normal(size=dim) @ mix / 10], int(i) % 3) for i in range(n)]
    rows += [(i, rows[7][1], None) for i in range(n, n + n // 2)]  # a third are copies of one vector
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[8][1], None), (n + n, None, 0), (n + n + 1, [NAN] + [0.0] * (dim - 1), 0)]
    return [*rows, (n + n + 2, [INF] * dim, 0), (n + n + 3, [None] + [0.0] * (dim - 1), 0), (n + n + 4, [0.5] * (dim + 1), 0), (n + n + 5, [], 0)]


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_whitening(spark, weights):
    rows = some_rows(60, 6)
    good = [(i, x) for i, x, _ in kept(rows) if len(x) == 6]
    fit = [(x, n if weights == "copies" else 1) for x, n in Counter(tuple(x) for _, x in good).items()]
    n = sum(w for _, w in fit)
    s = [sum(w * x[j] for x, w in fit) for j in range(6)]
    y = np.array([x for x, _ in fit], float) - np.array(s) / n
    w = np.array([w for _, w in fit], float)
    v = (y * w[:, None]).T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(table(spark, rows), weights=weights).collect()
    assert len(got) == 4 * len(good)
    white = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
        white.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
    for k in range(1, 5):
        want = [(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), float((np.array(x) - np.array(s) / n) @ u[:, k - 1] / math.sqrt(e[k - 1]))) for i, x in good]
        order = lambda t: (t[0] is None, t[0] or 0, t[1])
        have, want = sorted(white[k], key=order), sorted(want, key=order)
        assert [t[:2] for t in have] == [t[:2] for t in want]
        a, b = np.array([t[2] for t in have]), np.array([t[2] for t in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_what_does_not_vary(spark):
    one = whitening.whiten(table(spark, [(1, [0.5, 0.25], None), (2, [0.5, 0.25], None)])).collect()
    assert sorted((r.vec_id, r.component) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = whitening.whiten(table(spark, [(i, [i / 4, 1.0, i / 2], 0) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and {r.component for r in flat} == {1, 2, 3}
    assert max(r.identity_error for r in flat) < 1e-9
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(table(spark, rows)).collect() == []
    large = whitening.whiten(table(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 0.0], 0)]), components=1).collect()
    assert len(large) == 3 and any(r.deviation is None for r in large)  # beyond a long


def test_covariance_keeps_small_differences_of_large_values(spark):
    """Centred before it is multiplied: products of the values themselves would lose these."""
    rows = [(i, [2.0**20 + (i % 5) / 256, 2.0**20 + (i % 3) / 256], 0) for i in range(15)]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, embedding array<double>"), components=2).collect()
    getcontext().prec = 50
    fives = [Decimal(i % 5) - 2 for i in range(15)]
    assert abs(got[0].explained + got[1].explained - 1) < 1e-12 or {round(r.explained, 9) for r in got} == {0.75, 0.25}
    top = {r.vec_id: r.whitened for r in got if r.component == 1}
    want = [float(f / Decimal(2).sqrt()) for f in fives]
    assert min(max(abs(top[i] - want[i]) for i in range(15)), max(abs(top[i] + want[i]) for i in range(15))) < 1e-9


def test_bytes_of_vectors():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(1 << b), 1 << b, (20, 5)) for b in (3, 9, 20, 40)] + [np.array([[2**63 - 1, -(2**63), 0, 1, -1]])])
    assert (vectors.decoded(vectors.encoded(x), 5) == x).all()
    assert len({len(b) for b in vectors.encoded(x)}) == 4


def brute_codes(rows, parts, entries, rounds):
    dim = Counter(len(x) for _, x, _ in rows).most_common(1)[0][0]
    rows = [r for r in rows if len(r[1]) == dim]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, vectors.encoded(np.array([r[1]]))[0]))[:entries]
    cut = [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]
    books = [[r[1][a:b] for r in first] for a, b in cut]

    def assign():
        out = []
        for _, x, _ in rows:
            out.append([min((sum((p - q) ** 2 for p, q in zip(x[a:b], y, strict=True)), k) for k, y in enumerate(book)) for (a, b), book in zip(cut, books, strict=True)])
        return out

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(cut):
            for k in range(len(books[p])):
                own = [x[a:b] for (_, x, _), f in zip(rows, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, y), e in zip(rows, error, strict=True):
        total[y] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, total[y], digest) for (i, _, y), f, e in zip(rows, found, error, strict=True))


@pytest.mark.parametrize(("dim", "parts", "entries", "n"), [(16, 16, 8, 80), (32, 4, 64, 120), (10, 4, 5, 60), (3, 5, 4, 30), (8, 2, 500, 40)])
def test_codes(spark, dim, parts, entries, n):
    rows = some_rows(n, dim, seed=dim)
    rows = [r for r in rows if r[1] is None or len(r[1]) in (dim, dim + 1)]
    got = codes.compress(table(spark, rows), parts=parts, entries=entries)
    assert got.columns == [c.split()[0] for c in codes.CODED.split(", ")]
    assert sorted((str(r.vec_id), *r[1:]) for r in got.collect()) == brute_codes(kept(rows), parts, entries, 2)


def test_codes_of_few_rows(spark):
    assert codes.compress(table(spark, [])).collect() == []
    assert codes.compress(table(spark, [(1, None, 0), (2, [NAN], 0)])).collect() == []
    one = codes.compress(table(spark, [(9, [0.5] * 16, None)])).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)]
    large = codes.compress(table(spark, [(1, [3e38] * 4, 0), (2, [-3e38] * 4, 1), (3, [3e38] * 4, 1)]), parts=2, entries=1).collect()
    assert len(large) == 3 and all(r.error is None for r in large)  # beyond a long


def test_search_looks_at_ties_and_leaves_out_what_cannot_be_nearer():
    rng = np.random.default_rng(5)
    for size in (1, 2, 4, 9):
        entries = rng.integers(-4, 4, (64, size))  # many equal sums, distances and entries
        x = np.concatenate([rng.integers(-6, 6, (400, size)), entries])
        for scale in (1, 1 << 40):
            index, best = codes.Codebook(entries * scale).nearest(x * scale)
            every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
            assert (index == every.argmin(1)).all() and [int(b) for b in best] == [int(v) * scale**2 for v in every.min(1)]
