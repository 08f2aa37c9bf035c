"""Small cases of the findings of a round: each failed before its change."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from inkflow import catalogue
from inkflow.functions import text as T
from inkflow.llm import neardup as N
from inkflow.operators import context, detection, paging


def against_sql(spark, sf_dir, name, tables, ordered=False):
    """The query's rows over the parquet files of sf_dir are those of its SQL."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = c.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in got.description]
    want, rows = got.fetchall(), [tuple(r) for r in catalogue.queries()[name](spark, str(sf_dir)).select(*names).collect()]
    assert rows == want if ordered else sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_latest_topics_rounds_as_its_sql(spark, tmp_path):
    """9999.8 is 10000 and comes first; of 2.5 and 1.5 both are 2."""
    balances = {1: 9999.41, 2: 9999.8, 3: 9999.2, 4: 2.5, 5: 1.5, 6: None}
    for keep in ([1, 2, 3, 4, 5, 6], [4, 5, 6]):
        values = ", ".join(f"({i}, 'n{i}', {balances[i] if balances[i] is not None else 'NULL'}::DOUBLE)" for i in reversed(keep))
        folder = tmp_path / str(len(keep))
        folder.mkdir()
        duckdb.execute(f"COPY (SELECT * FROM (VALUES {values}) t(c_custkey, c_name, c_acctbal)) TO '{folder}/customer.parquet'")
        got = against_sql(spark, folder, "latest_topics", ["customer"], ordered=True)
        assert [i for i, _ in got] == {6: [2, 1, 3], 3: [4, 5, 6]}[len(keep)]


def test_linked_texts_share_a_first_shingle_and_few_others_do():
    """Every pair within a fifth shares one of its first shingles, at each length; of 1,000 unrelated texts over 300 words fewer
    pairs meet than there are texts, where the first words alone had tens of thousands meet."""
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(300)]
    counts = np.zeros(N.SLOTS, np.uint8)
    first = lambda t: {(q, x) for q, xs in N.prefixes(N.word_hashes(t.split()), 0.8, counts).items() for x in xs.tolist()}
    for n in [*range(1, 30), 60, 100, 126, 400]:
        for _ in range(40):
            a = [rng.choice(vocabulary[:40]) for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(0, n // 5 + 1)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary[:40])] * rng.randint(0, 1)
            x, y = " ".join(a), " ".join(b)
            if b and N.similar(x, y):
                assert first(x) & first(y), (x, y)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120))) for _ in range(1000)]
    meet = Counter(g for t in texts for g in first(t))
    assert sum(m * (m - 1) // 2 for m in meet.values()) < 1000


def test_wide_context_sends_few_rows_on(spark, monkeypatch):
    """Of 8 reading tasks each sends what fills 20 characters, not as many rows as have a character each."""
    rows = spark.range(0, 8000, 1, 8).selectExpr("1 AS key", "id AS ord", "repeat('x', 10) AS text")
    seen = []
    firsts = context._firsts
    monkeypatch.setattr(context, "_firsts", lambda *a: (seen.append(firsts(*a)), seen[-1])[1])
    got = context.wide_context(spark.createDataFrame([(1,)], "key int"), {"t": context.Branch(rows, chars=20)}).collect()
    assert got[0]["t"] == "xxxxxxxxxx\nxxxxxxxxx" and seen[0].count() <= 8 * 2


def test_detection_holds_few_responses():
    """A batch of any size is asked about in slices."""
    batch = pa.RecordBatch.from_pydict({"chunk": ["x"] * 1001})
    assert [b.num_rows for b in detection.slices(batch)] == [200] * 5 + [1]


def test_page_facts_strip_a_line_once(spark):
    """The plan holds one strip of each line and one of the first page."""
    df = paging.page_facts(spark.createDataFrame([(1, "a\n  b")], "doc_id int, text string"), 6)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("x1c-") <= 4


def test_common_passage_meets_once(spark, monkeypatch):
    """Of a passage that 60 texts share, one shingle is compared, not its hundreds; the pairs are all that a link may be."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    passage = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(20, 90)))]) for _ in range(60)]
    tables = {}
    kept = N.Scratch.store
    monkeypatch.setattr(N.Scratch, "store", lambda self, df, name: tables.setdefault(name, kept(self, df, name)))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "id AS root", "text")
    got = {(r.a, r.b) for r in N.filtered(rows, 0.8, N.Scratch(spark)).collect()}
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if N.similar(texts[i], texts[j])}
    assert linked <= got and 100 < len(linked) < 1770
    met = tables["live"].groupBy("gram", "lo", "hi").count().selectExpr("sum(count * count) AS n").first().n
    assert met <= 5 * 60 * 60
    assert len(got - linked) < (1770 - len(linked)) / 2  # bits tell most of the others apart


def test_first_common_shingle_stays(spark):
    """Of texts' ordered shingles, the first one that two texts share is kept, whatever else goes."""
    rng = random.Random(7)
    lists = {i: sorted(rng.sample(range(40), rng.randint(1, 20)) if i % 3 else range(rng.randint(5, 40))) for i in range(50)}
    many = Counter(g for x in lists.values() for g in x)
    rows = [(i, i, 9, 3, at, g, many[g]) for i, x in lists.items() for at, g in enumerate(x)]
    places = spark.createDataFrame(rows, "id long, root long, n int, q int, at int, gram long, many long")
    scratch = N.Scratch(spark)
    left = {(r.id, r.gram, r.at) for r in N.uncovered(places, scratch).collect()}
    assert left <= {(i, g, at) for i, _, _, _, at, g, _ in rows}
    for i, x in lists.items():
        for j, y in lists.items():
            if i < j and set(x) & set(y):
                first = min(set(x) & set(y))
                assert (i, first, x.index(first)) in left and (j, first, y.index(first)) in left
    nested = [(i, i, 9, 3, at, at, 50 - at) for i in range(50) for at in range(i + 1)]
    assert {r.gram for r in N.uncovered(spark.createDataFrame(nested, places.schema), scratch).collect()} == {0}
    scratch.clear()


def test_texts_go_to_python_by_few(spark, monkeypatch):
    """Steps that send whole texts to Python are written with small batches; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, kept, plain = spark.conf.get(key), {}, N.Scratch.store, N.store
    note = lambda name: seen.setdefault(name, int(spark.conf.get(key)))
    monkeypatch.setattr(N.Scratch, "store", lambda self, df, name: (note(name), kept(self, df, name))[1])
    monkeypatch.setattr(N, "store", lambda df, path: (note(path.rsplit("/", 1)[1].split("-")[0]), plain(df, path))[1])
    N.classes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")).collect()
    assert {seen[x] for x in ("sketches", "links", "grams", "live", "more")} == {256}
    assert seen["runs"] == int(before) and spark.conf.get(key) == before


def test_normalizers_share_their_replacements(spark):
    """The Latin-1 and HTML forms have their common replacements as one expression, with the results of the rules in order."""
    from pyspark.sql import functions as F

    c = F.col("t")
    both = str(T.replaced(F.coalesce(c, F.lit("")), T.LATIN1)).removeprefix("Column<'").removesuffix("'>")
    assert both in str(T.normalize_html(c)) and both in str(T.normalize_latin1(c))
    rng = random.Random(2)
    odd = [a for a, _ in T.HTML + T.SPACES] + [chr(x + d) for r in T.SYMBOL_RANGES + T.DRAWING_RANGES for x in r for d in (-1, 0, 1)] + list("ab<>-*\n")
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(400)]

    def model(text, pairs, ranges):
        for a, b in pairs:
            text = text.replace(a, b)
        return "".join(x for x in text if not any(a <= ord(x) <= b for a, b in ranges))

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_html(c).alias("h"), T.normalize_pdf(c).alias("p"), T.normalize_latin1(c).alias("l")).collect()
    for r in rows:
        assert r.h == model(r.t, T.HTML, T.SYMBOL_RANGES + T.DRAWING_RANGES)
        assert r.p == model(r.t, T.SPACES, T.SYMBOL_RANGES)
        assert r.l == model(r.t, T.LATIN1, [(256, 0x10FFFF)])
