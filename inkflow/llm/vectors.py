"""Embeddings as vectors of integers: what the whitening and the code compression share.

A row is kept if its vector is neither null nor holds a null or non-finite entry; an entry c, as a double, becomes the
integer floor(scale * c), held to the range of a long.  A vector travels as bytes: one for the width of its entries, then
the entries at that width, little-endian, so that equal vectors have equal bytes.  Sums and products are taken in longs
where they fit, else in Python's integers; a result that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
_WIDTHS = tuple(np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8"))
_TOP = 1 << 62


def integers(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of the kept rows of a list column, by length of the vector."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        c = values[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(c).all(1)
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(c[fine] * scale)
            x = np.where(v >= 2.0**63, 2**63 - 1, np.where(v <= -(2.0**63), -(2**63), v.astype(np.int64)))
        yield rows[fine], x.astype(np.int64)


def encoded(x: np.ndarray) -> list[bytes]:
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    width = sum(((low < np.iinfo(t).min) | (high > np.iinfo(t).max)).astype(int) for t in _WIDTHS[:3])
    out: list[bytes] = [b""] * len(x)
    for k, t in enumerate(_WIDTHS):
        rows = np.flatnonzero(width == k)
        data, step = x[rows].astype(t).tobytes(), t.itemsize * x.shape[1]
        for i, r in enumerate(rows.tolist()):
            out[r] = bytes([k]) + data[i * step : (i + 1) * step]
    return out


def decoded(column: list[bytes], dim: int) -> np.ndarray:
    """The vectors of dim entries that these bytes hold, one a row."""
    out = np.empty((len(column), dim), np.int64)
    width = np.array([b[0] for b in column], int)
    for k, t in enumerate(_WIDTHS):
        rows = np.flatnonzero(width == k)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(column[r][1:] for r in rows.tolist()), t).reshape(len(rows), dim)
    return out


def integer_vectors(rows: DataFrame, vector: str, others: str, scale: int = SCALE) -> DataFrame:
    """The columns `others` (a schema) of the kept rows, dim and x, their vector's length and bytes."""
    names = [f.split()[0].strip("`") for f in others.split(", ")] if others else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch[vector], scale):
                kept = batch.take(pa.array(at))
                columns = {n: kept[n] for n in names} | {"dim": pa.array(np.full(len(at), x.shape[1], np.int32)), "x": pa.array(encoded(x), pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select(*names, vector).mapInArrow(run, f"{others}, dim int, x binary" if others else "dim int, x binary")


def common_dim(rows: DataFrame, weight: str | None = None) -> int:
    """The most frequent dim, the larger of equally frequent ones; 0 without rows.  Rows of other lengths have no place
    among the others, and callers drop them."""
    n = F.sum(weight) if weight else F.count("*")
    top = rows.groupBy("dim").agg(n.alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return top.dim if top else 0


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in longs if results of absolute value `most` fit, else in Python's integers."""
    return x if most < _TOP else x.astype(object)


def span(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def longs(values: np.ndarray) -> pa.Array:
    """A long column; null where no long holds the value."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def decimals(values) -> pa.Array:
    """A decimal(38, 0) column of integers."""
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
