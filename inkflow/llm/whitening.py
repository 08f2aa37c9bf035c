"""Embedding whitening by a weighted multiplicity covariance.

1. Vectors become integers (vectors.py) and equal ones are grouped, summed in the map tasks first: a vector that a third
   of all rows share is one row from then on.  Its fit weight is one, or its number of copies.
2. Weights n and sums S are added exactly.
3. Centred weighted products: n*x - S is exact, so (n*x - S)/n is centred before it is multiplied; a task multiplies
   blocks of rows and sends one d by d matrix, which Spark adds by cell.
4. The driver takes the eigenvectors of that one matrix, of d by d whatever the number of rows.
5. Every distinct vector is whitened once, and the result is written.  The covariance of what was written, by Spark, gives
   the error against the identity.
6. Rows are joined to it by a digest of 128 bits of their vector; Spark splits a vector that many rows share.

Nulls: rows with a null vector, or with null or non-finite entries, go; a null vec_id stays null.  Repeated rows each
get their rows, as do repeated vec_ids.  Vectors of another length than the most common one (the longer of equally common)
go.  Very long vectors have their product of d by d in a task's memory.  A component without variance (the only vector,
or fewer independent vectors than components) has null for whitened, and is left out of the identity's error, which is null
if no component is left; explained is null if nothing varies.  Vectors of fewer than `components` entries have that many
components; empty ones have none, so no rows.  Deviations that no long holds are null.  Other columns, of whatever
name, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store
from inkflow.llm.vectors import common_dim, decimals, decoded, encoded, exact, integer_vectors, integers, longs, span

COMPONENTS = 4
#: Of the trace: below it, a variance is that of rounding.
LEAST_SHARE = 1e-12
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(x, dim, copies) of every different vector."""
    return integer_vectors(rows, vector, "").groupBy("x", "dim").agg(F.count("*").alias("copies"))


def sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The weights' sum and the weighted sums by dimension, exact; distinct has x and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x, w = decoded(batch["x"].to_pylist(), dim), batch["w"].to_numpy(zero_copy_only=False)
            n += int(w.sum())
            total = total + (exact(x, span(x) * int(w.sum())) * w[:, None]).sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dim), pa.int32()), "s": decimals([n, *total])})

    got = {r.at: int(r.s) for r in distinct.select("x", "w").mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    return got[-1], [got[i] for i in range(dim)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    most = n * span(x) + max(map(abs, total), default=0)
    s = np.array(total, np.int64 if most < 1 << 62 else object)
    return exact(x, most) * n - s


def covariance(distinct: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """Of the centred vectors by weight, divisor n; distinct has x and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((dim, dim))
        for batch in batches:
            y = (centred(decoded(batch["x"].to_pylist(), dim), n, total) / n).astype(float)
            product += (y * batch["w"].to_numpy(zero_copy_only=False)[:, None]).T @ y
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(i * dim + j, pa.int64()), "v": pa.array(product[i, j])})

    cells = distinct.select("x", "w").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros(dim * dim)
    v[cells["cell"].to_numpy()] = cells["v"].to_numpy() / n
    v = v.reshape(dim, dim)
    return np.triu(v) + np.triu(v, 1).T


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors as columns, their largest entry positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whitened(distinct: DataFrame, dim: int, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, sound: np.ndarray) -> DataFrame:
    """(key, w, deviation, white) of every distinct vector; null in the components that are not sound."""
    scaled = vectors / np.where(sound, np.sqrt(np.where(sound, values, 1.0)), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch["x"].to_pylist()
            d = centred(decoded(data, dim), n, total)
            squares = exact(d, dim * span(d) ** 2)
            white = (d / n).astype(float) @ scaled
            white = [[v if s else None for v, s in zip(row, sound, strict=True)] for row in white.tolist()]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([xxhash.xxh3_128_digest(b) for b in data], pa.binary()), "w": batch["w"],
                "deviation": longs((squares * squares).sum(1)), "white": pa.array(white, pa.list_(pa.float64())),
            })

    return distinct.select("x", "w").mapInArrow(run, "key binary, w long, deviation long, white array<double>")


def identity_error(white: DataFrame, sound: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the sound components minus the identity."""
    if not sound:
        return None
    at = {k: F.get("white", F.lit(k)) for k in sound}
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    r = white.agg(
        F.sum("w").alias("n"), *(F.sum(at[k] * F.col("w")).alias(f"s{k}") for k in sound), *(F.sum(at[i] * at[j] * F.col("w")).alias(f"p{i}_{j}") for i, j in pairs)
    ).first()
    return max(abs(r[f"p{i}_{j}"] / r["n"] - r[f"s{i}"] / r["n"] * (r[f"s{j}"] / r["n"]) - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """WHITENED rows: each kept row by component.  weights: "one" a distinct vector, or "copies"."""
    if weights not in ("one", "copies"):
        raise ValueError(f"weights are one or copies, not {weights}")
    spark = rows.sparkSession
    rows = rows.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    distinct = store(distinct_vectors(rows, "v"), shared_dir(spark, "distinct-vectors"))
    dim = common_dim(distinct, "copies")
    if not dim:
        return spark.createDataFrame([], WHITENED)
    distinct = distinct.where(F.col("dim") == dim).withColumn("w", F.lit(1).cast("long") if weights == "one" else F.col("copies"))
    n, total = sums(distinct, dim)
    v = covariance(distinct, dim, n, total)
    values, vectors = principal(v, components)
    trace = float(np.trace(v))
    sound = values > LEAST_SHARE * trace if trace > 0 else np.zeros(len(values), bool)
    white = store(whitened(distinct, dim, n, total, values, vectors, sound), shared_dir(spark, "whitened"))
    error = identity_error(white, np.flatnonzero(sound).tolist())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch["v"]):
                if x.shape[1] == dim:
                    digests = [xxhash.xxh3_128_digest(b) for b in encoded(x)]
                    yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"].take(pa.array(at)), "key": pa.array(digests, pa.binary())})

    joined = rows.mapInArrow(keys, "vec_id long, key binary").join(white.select("key", "deviation", "white"), "key")
    explained = [float(e) / trace if trace > 0 else None for e in values]
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*(F.lit(e).cast("double") for e in explained)), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
