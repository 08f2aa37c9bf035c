"""Quality classifier: supervised subword embeddings.

A word is itself and its character n-grams, each hashed to one of BUCKETS learned vectors of DIM numbers; a document
is the average of all vectors of all its words, and a softmax over two classes gives the score of label 1.  numpy
stochastic gradient descent learns vectors and output on at most TRAIN_ROWS labelled documents (those with the
least hash of doc_id), whole texts: the tasks that read them turn each into its buckets and shares, at most BUCKETS
numbers, and one task learns from these; the model is a few megabytes.  Scoring reads every whole text: with
the model fixed, a word adds a constant, so it is hashed once per worker and kept in a bounded dictionary.

Nulls: a null text is empty, and a text without words gets the score of the output's bias.  Rows with a null doc_id
are scored and count as not held out, but are never used to learn.  Without labelled rows every score is 0.5.
Repeated rows are scored alike; of repeated doc_ids, the text of the least hash is learned from, and of labels that
disagree on one doc_id the smallest.  Very long texts are scored word by word.  Columns named score and predicted are
replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import text_or_empty

DIM, BUCKETS, GRAMS = 8, 1 << 17, (3, 4)
TRAIN_ROWS, EPOCHS, RATE = 4000, 6, 0.5
KEPT_WORDS = 1 << 17


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its n-grams, with marks at both ends."""
    raw = word.encode()
    marked = b"<" + raw + b">"
    out = [zlib.crc32(raw, 1) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    every: list[int] = []
    for w in text.split():
        every += word_features(w)
    ids, n = np.unique(np.array(every, np.int64), return_counts=True)
    return ids, (n / max(1, len(every))).astype(np.float32)


def train(seen: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, output) after stochastic gradient descent over (buckets, shares, label), in a fixed order of documents."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) * (2 / DIM)).astype(np.float32)
    output = np.zeros((DIM + 1, 2), np.float32)  # the last row is the bias
    steps, done = max(1, epochs * len(seen)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(seen)):
            ids, share, y = seen[k]
            h = np.append(share @ vectors[ids], np.float32(1)) if len(ids) else np.append(np.zeros(DIM, np.float32), np.float32(1))
            z = h @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the loss by z
            now = np.float32(rate * (1 - done / steps))
            back = output[:DIM] @ p
            output -= now * np.outer(h, p)
            if len(ids):
                vectors[ids] -= now * share[:, None] * back[None, :] * np.float32(len(ids) ** 0.5)
            done += 1
    return vectors, output


def packed(vectors: np.ndarray, output: np.ndarray) -> bytes:
    """What scoring needs: each bucket's weight for label 1 over label 0, and the bias."""
    out = io.BytesIO()
    np.savez(out, weight=(vectors @ (output[:DIM, 1] - output[:DIM, 0])).astype(np.float32), bias=np.float32(output[DIM, 1] - output[DIM, 0]))
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> bytes:
    """The model, learned in one task on at most `most` labelled rows that are not held out."""
    by_id = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    usable = by_id.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` pairs of integers
    keys = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in ids.collect()], "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = rows.join(F.broadcast(keys), "doc_id").withColumn("h", F.xxhash64("text"))  # bounded: `most` pairs of integers are sent

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [document_features(t) for t in pdf["text"]]
            yield pdf[["doc_id", "y", "h"]].assign(
                buckets=pd.Series([f[0].astype(np.int32) for f in found], dtype=object, index=pdf.index), share=pd.Series([f[1] for f in found], dtype=object, index=pdf.index)
            )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for pdf in batches:
            found += zip(pdf["doc_id"].tolist(), pdf["buckets"], pdf["share"], pdf["y"].tolist(), strict=True)
        found.sort(key=lambda f: f[0])
        if found:
            seen = [(np.asarray(b, np.int64), np.asarray(s, np.float32), y) for _, b, s, y in found]
            yield pd.DataFrame({"model": [packed(*train(seen))]})

    each = sample.mapInPandas(featured, "doc_id long, y int, h long, buckets array<int>, share array<float>")
    one = each.groupBy("doc_id", "y").agg(F.min_by(F.struct("buckets", "share"), "h").alias("f")).select("doc_id", "y", "f.*")  # a row an id
    got = one.repartition(1).mapInPandas(learn, "model binary").first()
    return bytes(got.model) if got else packed(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM + 1, 2), np.float32))


class Scorer:
    """Scores of texts: a word's part is the sum of its buckets' weights."""

    def __init__(self, model: bytes):
        loaded = np.load(io.BytesIO(model))
        self.weight, self.bias = loaded["weight"], float(loaded["bias"])
        self.kept: dict[str, tuple[float, int]] = {}

    def _word(self, w: str) -> tuple[float, int]:
        ids = word_features(w)
        got = (float(self.weight[ids].sum(dtype=np.float64)), len(ids))
        if len(self.kept) < KEPT_WORDS and len(w) <= 40:
            self.kept[w] = got
        return got

    def __call__(self, text: str) -> float:
        kept, total, n = self.kept, 0.0, 0
        for w in text.split():
            s, k = kept.get(w) or self._word(w)
            total += s
            n += k
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


_scorers: dict[int, Scorer] = {}


def scorer(sent) -> Scorer:
    """One per worker process and model."""
    if sent.id not in _scorers:
        _scorers.clear()
        _scorers[sent.id] = Scorer(sent.value)
    return _scorers[sent.id]


class _Sent:
    """A broadcast model with a name that stays the same in a reused worker."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def score_column(docs: DataFrame, model: bytes, text: Column) -> Column:
    sent = _Sent(docs.sparkSession.sparkContext.broadcast(model), f"{zlib.crc32(model)}")

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer(sent)
        for s in texts:
            yield pd.Series([of(t) for t in s], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """All columns of docs, with score and predicted in place of columns of these names."""
    scored = docs.withColumn("score", score_column(docs, fit(docs, labels, most), text_or_empty()))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
