"""Vector code compression: a codebook a part, searched in order of the entries' means.

Vectors become integers (vectors.py), written once as bytes, and are cut into `parts` equal consecutive parts.  Codebooks
start as the parts of the first kept vectors by id; each round assigns every part to its nearest entry and replaces an
entry by the floor of its parts' mean.  Tasks add their parts by entry before Spark adds the tasks' sums, which are exact;
the codebooks, of `entries` vectors whatever the number of rows, are all that the driver holds and sends.

Nearest entry: a part's squared distance to an entry is at least the squared gap of their component sums over the
dimension, as equal sums (equal means) are necessary for equal parts.  Entries are sorted by sum; from the part's own sum
the search goes outward to the nearer side, until the bound strictly exceeds the best distance, so every entry that could
tie is looked at and ties go to the lower index.  A task searches a batch of parts side by side, and those that are done
drop out.

Nulls: rows with a null vector, or with null or non-finite entries, go; a null vec_id stays and counts as the last of ids;
null labels are one label.  Repeated rows and ids stay, each an initial entry of its own if it is among the first (ids
that tie go by their vectors' bytes).  Fewer vectors than entries: codebooks of that many.  Vectors of another length than
the most common one (the longer of equally common) go; a length that `parts` does not divide is cut as evenly as can be,
so short vectors have empty parts, of code 0 and error 0.  Errors that no long holds are null.  Other columns, of whatever
name, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store
from inkflow.llm.vectors import common_dim, decimals, decoded, exact, integer_vectors, longs, span

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CODED = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]


class Codebook:
    """One part's entries in order of their sums."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.dim = entries, entries.shape[1]
        self.most = span(entries)
        sums = exact(entries, self.dim * self.most).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.sums, self.sorted = sums[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the lower index of equally near ones."""
        n, count = len(x), len(self.sorted)
        if not self.dim:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        far = 2 * self.dim * max(span(x), self.most) + 1  # beyond every gap; its square is beyond every bound
        x, sums, entries = (exact(v, far * far) for v in (x, self.sums, self.sorted))
        own = x.sum(1)
        right = np.searchsorted(sums, own)
        left = right - 1
        index, best = np.zeros(n, np.int64), np.zeros(n, x.dtype)
        live, first = np.arange(n), True
        while len(live):
            a, b, s = left[live], right[live], own[live]
            low = np.where(a >= 0, s - sums[np.maximum(a, 0)], far)
            high = np.where(b < count, sums[np.minimum(b, count - 1)] - s, far)
            gap = np.minimum(low, high)
            if not first:
                goes_on = (gap * gap <= best[live] * self.dim).astype(bool)
                live, a, b, low, high = live[goes_on], a[goes_on], b[goes_on], low[goes_on], high[goes_on]
            lower = (low <= high).astype(bool)
            at = np.where(lower, a, b)
            left[live] -= lower
            right[live] += ~lower
            d = x[live] - entries[at]
            d = (d * d).sum(1)
            which = self.order[at]
            better = np.ones(len(live), bool) if first else ((d < best[live]) | ((d == best[live]) & (which < index[live]))).astype(bool)
            index[live[better]], best[live[better]] = which[better], d[better]
            first = False
        return index, best


class Codebooks:
    def __init__(self, vectors: np.ndarray, parts: int):
        """vectors: one a codebook entry, all parts side by side."""
        self.vectors, self.cuts = vectors, cuts(vectors.shape[1], parts)
        self.books = [Codebook(vectors[:, a:b]) for a, b in self.cuts]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector by part, and the sum of its parts' squared distances."""
        found = [book.nearest(x[:, a:b]) for book, (a, b) in zip(self.books, self.cuts, strict=True)]
        far = 2 * max(span(x), span(self.vectors)) + 1
        wide = far * far * x.shape[1] >= 1 << 62
        return np.stack([i for i, _ in found], 1), sum(d.astype(object) if wide else d for _, d in found)

    def digest(self) -> str:
        every = (str(v) for a, b in self.cuts for entry in self.vectors[:, a:b].tolist() for v in entry)
        return hashlib.sha256(",".join(every).encode()).hexdigest()


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> Codebooks:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return Codebooks(decoded([bytes(r.x) for r in first], dim), parts)


def moved(rows: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """One round: the codebooks at the floors of the means of the parts assigned to them."""
    size = len(books.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((size, dim), object), np.zeros((size, dim), np.int64)
        for batch in batches:
            x = decoded(batch["x"].to_pylist(), dim)
            codes, _ = books.assign(x)
            wide = exact(x, span(x) * len(x))
            for k, (a, b) in enumerate(books.cuts):
                part = np.zeros((size, b - a), wide.dtype)
                np.add.at(part, codes[:, k], wide[:, a:b])
                total[:, a:b] += part.astype(object)
                count[:, a:b] += np.bincount(codes[:, k], minlength=size)[:, None]
        used = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "s": decimals(total.ravel()[used]), "n": pa.array(count.ravel()[used], pa.int64())})

    added = rows.select("x").mapInArrow(run, "at long, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.vectors.copy().ravel()
    for r in added.collect():  # at most one row an entry and dimension
        out[r["at"]] = int(r.s) // r.n
    return Codebooks(out.reshape(size, dim), len(books.cuts))


def coded(rows: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = books.assign(decoded(batch["x"].to_pylist(), dim))
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"], "code": pa.array(text), "error": longs(error)})

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(
    docs: DataFrame, vector: str = "embedding", row_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """CODED of every kept row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    rows = store(integer_vectors(rows, "v", f"vec_id long, label {kind}"), shared_dir(spark, "integer-vectors"))
    dim = common_dim(rows)
    if not rows.head(1):
        return spark.createDataFrame([], CODED)
    rows = rows.where(F.col("dim") == dim)
    books = first_books(rows, dim, parts, entries)
    for _ in range(rounds):
        books = moved(rows, books, dim)
    out = store(coded(rows, books, dim), shared_dir(spark, "codes"))
    by_label = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("of"), F.col("total").try_cast("long").alias("label_error"))
    by_label = store(by_label, shared_dir(spark, "label-errors"))  # so that Spark knows its size
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
