"""Packing by power-of-two decomposition.

A document's ids are cut, front to back, into pieces of 2048 ids and then of the binary digits of what is left, so
every piece has a power-of-two length and is a sequence of its own: nothing is padded and no sequence crosses
documents.  Sequences of equal length share a bucket; sequence ids of a bucket lie together, in the order
(bucket, input partition, place in it), so a trainer reads batches of one length.

Nulls: a null text is empty and gives one piece, its end id.  Null and repeated doc_ids stay separate rows with
sequences of their own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import chunks, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
#: A sequence id has the bucket above bit 58, the partition above bit 34, and the row below.
BUCKET_BIT, PARTITION_BIT = 58, 34
#: Characters that are encoded at a time: their arrays stay in a core's cache.
AT_ONCE = 1 << 18


def piece_lengths(n: int, most: int) -> list[int]:
    """Power-of-two lengths, falling, that add up to n."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, most: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece; ids ARRAY<INT> holds the sequence if with_ids.  No shuffle: pieces need no partner."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from inkflow.llm.tokens import encoder

        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << PARTITION_BIT
        used = [0] * most.bit_length()
        for pdf in batches:
            texts, doc_ids, null = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["doc_id"].isna().tolist()
            for a, b in chunks(texts, AT_ONCE):
                rows, arrays = [], []
                for i, raw in enumerate(enc.encode(texts[a:b]), a):
                    raw += end
                    n, start = len(raw) // 4, 0
                    doc_id = None if null[i] else int(doc_ids[i])
                    for length in piece_lengths(n, most):
                        ids, k = raw[4 * start : 4 * (start + length)], length.bit_length() - 1
                        rows.append((doc_id, start, length, zlib.crc32(ids), n, k << BUCKET_BIT | first | used[k], 0, k))
                        if with_ids:
                            arrays.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        used[k] += 1
                        start += length
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})
                if with_ids:
                    out["ids"] = arrays
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(pack, PIECES + (", ids array<int>" if with_ids else ""))
