"""Media columns of progressive JPEG: texts to stored bytes, stored bytes to RGB tensors and features.

A payload becomes one image, or, beyond STRIP_BYTES, one image for each strip of so many bytes, so that neither the encoder
nor the decoder holds more than a batch of BATCH_BYTES at once; a medium is the array of its images.  store_media writes
media into the shared folder and reads them back, store_tensors the full-resolution RGB tensors, a row for each strip.

Nulls: a null text is empty; every payload is padded with spaces to a positive multiple of 192 bytes.  Equal texts
give equal media, tensors and features.  A null medium gives a row of nulls; a medium that is no progressive JPEG fails the
task with ValueError.  Very long texts are cut into strips.  An empty table gives no rows; repeated rows stay; other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm import jpeg
from inkflow.llm.common import shared_dir, store, text_or_empty

UNIT = 192
BATCH_BYTES = 1 << 20
#: A whole number of the image's units of 384 bytes, in one row of them.
STRIP_BYTES = 384 * 2700
STORED = "doc_id long, n_bytes long, media array<binary>"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSORS = "doc_id long, strip int, height int, width int, rgb binary"


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def strips(payload: bytes, most: int) -> list[bytes]:
    return [payload[i : i + most] for i in range(0, len(payload), most)]


def ranges(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(payloads: list[bytes], strip_bytes: int) -> list[list[bytes]]:
    """The images of each payload."""
    cut = [strips(p, strip_bytes) for p in payloads]
    every = [s for c in cut for s in c]
    files = iter([f for a, b in ranges([len(s) for s in every]) for f in jpeg.encode(every[a:b])])
    return [[next(files) for _ in c] for c in cut]


def encode_media(docs: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """STORED: each text's payload as progressive JPEG images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [padded(t) for t in pdf["text"]]
            for a, b in ranges([len(p) for _, p in got]):
                out = pdf[["doc_id"]].iloc[a:b].astype({"doc_id": "Int64"})
                yield out.assign(n_bytes=[n for n, _ in got[a:b]], media=pd.Series(encoded([p for _, p in got[a:b]], strip_bytes), dtype=object, index=out.index))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, STORED)


def store_media(docs: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """STORED, read back from the shared folder."""
    return store(encode_media(docs, strip_bytes), shared_dir(docs.sparkSession, "media"), compression="zstd")


class Feature:
    """Rows and columns of the tensors so far, and per channel the mean and the mean step between neighbours in a row, in
    thousandths."""

    def __init__(self):
        self.high = self.wide = self.pixels = self.steps = 0
        self.sums, self.changes = np.zeros(3, np.int64), np.zeros(3, np.int64)

    def add(self, tensor: np.ndarray) -> None:
        h, w, _ = tensor.shape
        self.high, self.wide, self.pixels, self.steps = self.high + h, max(self.wide, w), self.pixels + h * w, self.steps + h * (w - 1)
        self.sums += tensor.reshape(-1, 3).sum(0, dtype=np.int64)
        self.changes += np.abs(np.diff(tensor.astype(np.int16), axis=1)).sum((0, 1), dtype=np.int64)

    def __str__(self) -> str:
        means, steps = self.sums * 1000 // max(1, self.pixels), self.changes * 1000 // max(1, self.steps)
        return f"{self.high}x{self.wide}:" + ":".join(map(str, [*means.tolist(), *steps.tolist()]))


class Reader:
    """One medium, image by image."""

    def __init__(self):
        self.payload, self.medium, self.feature = hashlib.sha256(), hashlib.sha256(), Feature()
        self.n, self.n_medium, self.tail = 0, 0, b""

    def add(self, file: bytes, raw: bytes, tensor: np.ndarray) -> None:
        self.payload.update(raw)
        self.medium.update(file)
        self.feature.add(tensor)
        self.n, self.n_medium, self.tail = self.n + len(raw), self.n_medium + len(file), (self.tail + raw[-16:])[-16:]

    def row(self) -> list:
        return [self.n, self.payload.hexdigest(), zlib.crc32(self.tail), self.n_medium, self.medium.hexdigest(), str(self.feature)]


def images(media: pd.Series) -> Iterator[tuple[int, int, bytes, bytes, np.ndarray]]:
    """(place of the medium, strip, file, payload, tensor) of every image, about a megabyte of them decoded at once."""
    every = [(k, i, f) for k, m in enumerate(media) if m is not None for i, f in enumerate(m)]
    for a, b in ranges([len(f) for *_, f in every]):
        for (k, i, f), (image, coefs) in zip(every[a:b], jpeg.decode([f for *_, f in every[a:b]]), strict=True):
            yield k, i, f, jpeg.payload(image, coefs), jpeg.rgb(image, coefs)


def decode_media(stored: DataFrame) -> DataFrame:
    """FEATURES of the stored bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            readers = [None if m is None else Reader() for m in pdf["media"]]
            for k, _, *image in images(pdf["media"]):
                readers[k].add(*image)
            out = pd.DataFrame([[None] * 6 if r is None else r.row() for r in readers], columns=[x.split()[0] for x in FEATURES.split(", ")][2:], index=pdf.index)
            whole = {"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"}
            yield pd.concat([pdf[["doc_id", "n_bytes"]].astype({"doc_id": "Int64", "n_bytes": "Int64"}), out.astype(whole)], axis=1)

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, FEATURES)


def decode_tensors(stored: DataFrame) -> DataFrame:
    """TENSORS of the stored bytes, a row for each strip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            for k, i, _, _, tensor in images(pdf["media"]):
                h, w, _ = tensor.shape
                yield pd.DataFrame({"doc_id": ids.iloc[[k]].to_numpy(), "strip": [i], "height": [h], "width": [w], "rgb": [tensor.tobytes()]}).astype({"doc_id": "Int64"})

    return stored.select("doc_id", "media").mapInPandas(run, TENSORS)


def store_tensors(stored: DataFrame) -> DataFrame:
    """TENSORS, read back from the shared folder: two bytes for each of the payload."""
    return store(decode_tensors(stored), shared_dir(stored.sparkSession, "tensors"), compression="zstd")
