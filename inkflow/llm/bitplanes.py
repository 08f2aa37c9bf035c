"""Token-ID output by bit-plane shuffling.

Documents in ascending doc_id order become streams of fixed-size ids.  A file is a run of blocks of BLOCK_IDS ids;
each block is transposed into 32 bit planes or 4 byte planes, each plane is compressed with zstandard, and a
chunk index at the file's end says where the planes of every block lie.

File layout: MAGIC, planes of block 0, planes of block 1, ..., footer (zstandard: JSON header, doc ids, doc-id
validity, id counts), 8 bytes footer length, MAGIC.  A plane that is all zero takes no bytes.

A file ends after ROLL_IDS ids, and ranges are cut by doc_id and a hash of the text, so neither the files nor the rows of
one id grow into one task.

Nulls: a null text is empty and still gets the end id; a null doc_id sorts first and comes back null.  Repeated
doc_ids stay separate rows, ordered by a hash of their text, then by text.  Very long texts are encoded alone, and their
ids flow through the blocks.  An empty table gives no files and no rows.  Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkflow.llm.common import chunks, shared_dir, store, text_or_empty

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
ROLL_IDS = 1 << 26
READ_ROWS = 50_000
FILES = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"
DOCS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Transpose uint32 ids: bit planes 0..31 (8 ids a byte) or byte planes 0..3."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    """One file.  Memory: one block, and 17 bytes a document for the footer."""

    def __init__(self, uri: str, kind: str, level: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.kind = fs.open_output_stream(path, compression=None), kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting, self.n_ids = len(MAGIC), [], 0, 0
        self.index: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            block = ids[i : min(i + BLOCK_IDS, whole)]
            planes = [self.zip.compress(p) if any(p) else b"" for p in to_planes(block, self.kind)]
            self.index.append([self.at, len(block), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.n_ids += whole
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        head = json.dumps({"kind": self.kind, "index": self.index, "n_docs": len(self.counts)}).encode()
        valid = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        body = len(head).to_bytes(8, "little") + head + valid.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes()
        foot = self.zip.compress(body)
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.at + len(foot) + 8 + len(MAGIC)


def read_documents(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document, block by block."""
    fs, path = pafs.FileSystem.from_uri(uri)
    unzip = zstandard.ZstdDecompressor()
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no id-plane file, or is cut off")
        n = int.from_bytes(tail[:8], "little")
        f.seek(size - 16 - n)
        body = unzip.decompress(f.read(n))
        k = 8 + int.from_bytes(body[:8], "little")
        head = json.loads(body[8:k])
        n_docs = head["n_docs"]
        valid = np.frombuffer(body, np.uint8, n_docs, k)
        doc_ids = np.frombuffer(body, "<i8", n_docs, k + n_docs)
        counts = np.frombuffer(body, "<i8", n_docs, k + 9 * n_docs)
        held, have, blocks, start = [], 0, iter(head["index"]), 0
        for v, doc_id, count in zip(valid.tolist(), doc_ids.tolist(), counts.tolist(), strict=True):
            while have < count:
                at, m, *sizes = next(blocks)
                f.seek(at)
                raw = f.read(sum(sizes))
                planes, k = [], 0
                for s in sizes:
                    planes.append(unzip.decompress(raw[k : k + s]) if s else b"")
                    k += s
                held.append(from_planes(planes, m, head["kind"]))
                have += m
            ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, "<u4")
            yield (doc_id if v else None), start, ids[:count]
            held, have, start = [ids[count:]], have - count, start + count


def write_token_ids(docs: DataFrame, vocabulary: str, end_id: int, out_dir: str, kind: str = "bit", level: int = 3, roll_ids: int = ROLL_IDS) -> DataFrame:
    """Write id files in ascending doc_id order; returns FILES, the manifest, with (part, seq) in that order.

    Each task writes under names of its own, so a repeated task never shares a file with a lost one; only files
    that the manifest names belong to the result.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from inkflow.llm.tokens import encoder

        enc, end, out, uri, seq = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), None, "", 0
        part = TaskContext.get().partitionId()

        def closed() -> pd.DataFrame:
            n_bytes = out.close()
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [uri], "n_docs": [len(out.counts)], "n_ids": [out.n_ids], "n_bytes": [n_bytes]})

        for pdf in batches:
            texts, doc_ids, null = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["doc_id"].isna().tolist()
            for a, b in chunks(texts):
                for i, ids in enumerate(enc.encode(texts[a:b]), a):
                    if out is not None and out.n_ids + out.n_waiting >= roll_ids:
                        yield closed()
                        out, seq = None, seq + 1
                    if out is None:
                        uri = f"{out_dir}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.idp"
                        out = PlaneWriter(uri, kind, level)
                    out.add(None if null[i] else int(doc_ids[i]), ids + end)
        if out is not None:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return store(rows.drop("h").mapInPandas(write, FILES), f"{out_dir}/_manifest")


def read_token_ids(files: DataFrame) -> DataFrame:
    """Read id files back: per document its place, count and crc32.  One task reads whole files, block by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DOCS.split(", ")]
        for pdf in batches:
            for part, seq, path in zip(pdf["part"].tolist(), pdf["seq"].tolist(), pdf["path"].tolist(), strict=True):
                rows = []
                for doc_id, start, ids in read_documents(path):
                    rows.append((part, seq, doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == READ_ROWS:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("part", "seq", "path").repartition(n, "part", "seq").mapInPandas(read, DOCS)


def document_ids(files: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens, ids_crc32: what the files hold."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file of ROLL_IDS ids
    base = files.select(F.col("part").alias("p"), F.col("seq").alias("q"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    docs = read_token_ids(files)
    return docs.join(base, (docs["part"] == base["p"]) & (docs["seq"] == base["q"])).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    return document_ids(write_token_ids(docs, vocabulary, end_id, shared_dir(docs.sparkSession, "token-ids")))
