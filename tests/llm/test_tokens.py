"""Token ids against the tokenizers library: numpy's split and table of words, full tables, and op2's rows by brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkflow.llm import packing, tokens
from inkflow.llm.queries import BYTE_BPE, WORD_BPE, vocabulary


def plain_texts(n: int, most: int = 40) -> list[str]:
    """Quotes before contractions, white space in all places, both kinds of letters, words around the table's length."""
    rng = random.Random(7)
    parts = [*"ab'stmdrevl' \n\n  019.,!-éßÉÿ’—“ST", "'s", "'re", "'LL", "a" * 8, "b" * 15, "c" * 16, "d" * 17, "-" * 30, " " * 20]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


def library(name: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


def ids(raw: list[bytes]) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x in raw]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("bits", [2, 8, 16])
def test_ids_with_a_full_table(name, bits):
    """A table that is full from the start, soon, or never gives the library's ids; plain and other texts may mix."""
    texts = plain_texts(1500) + ["日本語 x", "", "<|endoftext|> a", "a\tb"]
    random.Random(1).shuffle(texts)
    enc, want = tokens.WordEncoder(vocabulary(name), bits), library(name, texts)
    for _ in range(2):
        got = [x for a in range(0, len(texts), 100) for x in ids(enc.encode(texts[a : a + 100]))]
        assert got == want
    assert enc.table.used <= 1 << bits - 1 and len(enc.ids) < 1 << 18


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_new_plain_words_skip_the_steps_before_the_model(name):
    """Words that a worker has not seen were most of the time; they go to the model, not through the whole tokenizer."""
    texts = [" ".join(f"w{i:x}é" for i in range(k, k + 50)) for k in range(0, 5000, 50)]
    want, enc = library(name, texts), tokens.WordEncoder(vocabulary(name))
    enc.tokenizer = None
    assert ids(enc.encode(texts)) == want and enc.table.used > 300
    assert ids(enc.encode(texts)) == want


def test_table_keeps_words_apart():
    """Words that begin alike, or that are as long as a key; slots that wrap around."""
    table, rng = tokens.WordTable(6), np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 5, (40, 2)).astype(np.uint64), axis=0)
    keys = np.concatenate([keys, np.unique(rng.integers(1, 1 << 60, (32 - len(keys), 2)).astype(np.uint64), axis=0)])
    table.add(keys[:20], np.arange(20), np.arange(1, 21))
    assert table.find(keys)[:, 1].tolist() == [*range(1, 21)] + [0] * 12
    table.add(keys[20:], np.arange(20, 32), np.arange(21, 33))
    assert table.find(keys).tolist() == [[i, i + 1] for i in range(32)]


def test_op2_rows(spark):
    """All columns of all rows: the pieces of the library's ids, in buckets without gaps."""
    texts = [*plain_texts(60), " ".join(plain_texts(300)), "Ω日本 " * 3000, "word " * 5000, None]
    data = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    rows = packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), vocabulary(BYTE_BPE), 1).collect()
    want, used = [], {}
    for (i, _), x in zip(data, library(BYTE_BPE, [t or "" for t in texts]), strict=True):
        x, start = [*x, 1], 0
        while start < len(x):
            length = 2048
            while length > len(x) - start:
                length //= 2
            piece, k = x[start : start + length], length.bit_length() - 1
            want.append((i, start, length, zlib.crc32(np.array(piece, "<u4").tobytes()), len(x), k << 58 | used.get(k, 0), 0, k, piece))
            used[k], start = used.get(k, 0) + 1, start + length
    assert [tuple(r) for r in rows] == want
