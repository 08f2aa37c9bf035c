"""What a passage or an exchange of many texts costs, and how words are hashed."""

import random

from inkflow.llm import neardup as N


def test_words_are_hashed_as_split_has_them(monkeypatch):
    """Equal words have equal hashes, others differ, whatever parts them, in texts of one piece and of many."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcxyz019.,é語\x00\x1b") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for blanks in (" ", " \t\n\v\f\r\x1c\x1d\x1e\x1f", " \x85\xa0 　 "):
        for some in (words, [w for w in words if w.isascii()], [], ["x"], ["x" * 300, "y", "x" * 300]):
            text = "".join(rng.choice(blanks) * rng.randint(1, 3) + w for w in some) + rng.choice(["", blanks])
            assert text.split() == some
            whole = N.text_hashes(text).tolist()
            assert len(whole) == len(some) and len(set(whole)) == len(set(some)) == len(set(zip(some, whole, strict=True)))
            with monkeypatch.context() as m:
                m.setattr(N, "PIECE", 64)
                assert N.text_hashes(text).tolist() == N.text_hashes(" ".join(some)).tolist() == whole


def stored(spark, monkeypatch, texts, roots):
    """The pairs of the prefix filter, and the tables that it writes, by name."""
    tables, kept = {}, N.Scratch.store
    monkeypatch.setattr(N.Scratch, "store", lambda self, df, name: tables.setdefault(name, kept(self, df, name)))
    rows = spark.createDataFrame([(i, roots[i], t) for i, t in enumerate(texts)], "id long, root long, text string")
    return {(r.a, r.b) for r in N.filtered(rows, 0.8, N.Scratch(spark)).collect()}, tables


def test_common_passage_makes_few_rows(spark, monkeypatch):
    """Of a passage of 300 words in 60 texts no table has a row for each of its shingles and texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    passage = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(20, 90)))]) for _ in range(60)]
    _, tables = stored(spark, monkeypatch, texts, list(range(60)))
    rows = {name: t.count() for name, t in tables.items() if "gram" in t.columns}
    assert rows and max(rows.values()) <= 10 * 60, rows


def test_large_class_is_not_compared_with_itself(spark, monkeypatch):
    """Many nodes of one class and few of others: every pair that may be linked comes, in blocks as well, and only the few look."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(20_000)]
    base = [rng.choice(vocabulary) for _ in range(120)]

    def changed(n):
        out = list(base)
        for p in rng.sample(range(120), n):
            out[p] = rng.choice(vocabulary)
        return " ".join(out)

    texts = [changed(rng.randint(0, 14)) for _ in range(90)]
    roots = [0] * 80 + list(range(80, 90))
    linked = {(i, j) for j in range(80, 90) for i in range(j) if N.similar(texts[i], texts[j])}
    for block in (1000, 8):
        with monkeypatch.context() as m:
            m.setattr(N, "BLOCK", block)
            m.setattr(N, "RUN", 2)
            got, tables = stored(spark, m, texts, roots)
            live = tables["major"]
            assert linked <= got and all(j >= 80 for _, j in got) and len(linked) > 100
            assert live.where("many > 2 and minor and root = 0").isEmpty() and live.where("not minor and root <> 0 and others >= 10").isEmpty()
            if block == 8:
                # Blocks multiply a row by those outside of its class, not by all: 12 blocks of 90 would make each row 12.
                assert tables["live"].count() <= 2 * live.count()


def test_pipeline_sends_few_texts_at_once(spark, sf_dir):
    """After each stage the session sends few rows to Python, as the stage's caller writes its table; run() sets it back."""
    import corpus_pipeline

    before = spark.conf.get(N.ROWS_AT_ONCE)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(N.ROWS_AT_ONCE, "10000")
            stage(spark, docs, sf_dir)
            assert spark.conf.get(N.ROWS_AT_ONCE) == str(N.TEXTS)
    finally:
        spark.conf.set(N.ROWS_AT_ONCE, before)
