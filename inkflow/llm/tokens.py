"""Token ids of whole texts, with a cache of what the tokenizer says for each word.

Both vocabularies split a text into words before they merge bytes, so every distinct word goes to the tokenizers
library once per worker, and later copies come from a bounded table.  Texts of plain Latin characters are split and
looked up by numpy, many texts at once: a word of up to 16 characters is two integers, which the table compares
whole.  Other texts take a dictionary: the byte-level split uses regex's Unicode classes, and the lower-casing
vocabulary gets what lies between blanks, which it normalizes itself.  The ids equal those of the whole text (tests
compare them).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

#: Words of this length or less are kept; the others are encoded each time.
KEPT_CHARS = 40
#: Entries of a worker's dictionary; beyond them, new words are encoded but not kept.
KEPT_WORDS = 500_000
#: A table's slots are a power of two, half of which are filled: so many words are kept, at 32 bytes a slot.
SLOT_BITS = 21
#: A table's words have this many characters at most.
SHORT_CHARS = 16

#: How the byte-level vocabulary splits a text (public_tokenizers.PATTERN), and the texts that numpy
#: splits, of ASCII, Latin-1 letters and general punctuation.
_BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ\u2010-\u2027]*")
_BETWEEN_BLANKS = re.compile(r"[^ \n]+")
#: Such strings may be special tokens, which a tokenizer looks for before it splits.
_SPECIAL = "<|"

#: A plain character's byte: its code point, but general punctuation lies from 0x80.  0 stands between texts.
_CODE = np.zeros(1 << 16, np.uint8)
_CODE[:256] = np.arange(256)
_CODE[0x2010:0x2028] = np.arange(0x80, 0x98)
_END, _WHITE, _LETTER, _DIGIT, _OTHER = range(5)
#: A byte's kind.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0] = _END
_KIND[[10, 32]] = _WHITE
_KIND[48:58] = _DIGIT
_KIND[[i for i in range(256) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", chr(i))]] = _LETTER
#: The character by which the vocabularies' models write each byte (tokenizers' ByteLevel).
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256)}
#: The bytes of an integer that belong to a word of 0 to 8 characters.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def cut_plain(codes: np.ndarray, n: int, lowers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in the first n codes, and for each text the number of words up to its end.

    Both vocabularies take runs of letters, digits (one by one if lowers) and others, and 's, 't, 're, 've, 'm, 'll,
    'd where a word may start.  The byte-level one joins a blank to the run after it and keeps other white space; a
    last line end before a run stands alone.
    """
    kind = _KIND[codes[:n]]
    first = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    ends = np.flatnonzero(kind == _END)
    first[ends] = True
    at = np.flatnonzero(codes[:n] == ord("'"))
    at = at[kind[at - 1] != _OTHER]
    if lowers:
        first |= kind == _DIGIT
    else:
        at = at[codes[at - 1] != ord(" ")]
        after = np.flatnonzero((kind[1:] >= _LETTER) & (kind[:-1] == _WHITE)) + 1
        first[after - 1] = True
        first[after[codes[after - 1] == ord(" ")]] = False
    if len(at):
        a, b = codes[at + 1], codes[at + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        first[at[one | two] + 1] = False
        first[at[one] + 2] = True
        first[at[two] + 3] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=n)
    kept = kind[starts] > _WHITE if lowers else kind[starts] != _END
    starts, lengths = starts[kept], lengths[kept]
    return starts, lengths, np.searchsorted(starts, ends)


class WordTable:
    """Words of up to 16 codes -> where their ids lie.  Slots are probed one after another; a key is compared whole."""

    def __init__(self, bits: int = SLOT_BITS):
        self.bits, self.used, self.room = bits, 0, 1 << bits - 1
        self.slots = np.zeros((1 << bits, 4), np.uint64)  # both halves of the key, where the ids start, how many

    def probe(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of start and number; a number of 0 says that the word is not there."""
        out = np.zeros((len(keys), 2), np.int64)
        rows, at = np.arange(len(keys)), self.probe(keys)
        while len(rows):
            slots = self.slots[at]
            found = (slots[:, 0] == keys[:, 0]) & (slots[:, 1] == keys[:, 1])
            out[rows[found]] = slots[found, 2:]
            on = np.flatnonzero(~found & (slots[:, 3] > 0))
            rows, keys, at = rows[on], keys[on], at[on] + 1 & (1 << self.bits) - 1
        return out

    def add(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Different keys that are not there, as many as there is room for at most."""
        self.used += len(keys)
        rows, at = np.arange(len(keys)), self.probe(keys)
        while len(rows):
            free = self.slots[at, 3] == 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slots[at[put], :2] = keys[rows[put]]
            self.slots[at[put], 2] = starts[rows[put]]
            self.slots[at[put], 3] = counts[rows[put]]
            on = np.ones(len(rows), bool)
            on[put] = False
            rows, at = rows[on], at[on] + 1 & (1 << self.bits) - 1


class WordEncoder:
    """texts -> little-endian uint32 ids as bytes, without special tokens."""

    def __init__(self, path: str, bits: int = SLOT_BITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.lowers = json.load(f)["normalizer"] is not None
        self.model = self.tokenizer.model
        self.kept: dict[str, bytes] = {}
        self.table, self.ids, self.held = WordTable(bits), np.zeros(1 << 16, "<u4"), 0

    def words(self, text: str) -> list[str]:
        if _SPECIAL in text:
            return [text]
        return (_BETWEEN_BLANKS if self.lowers else _BYTE_WORDS).findall(text)

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, by the tokenizer's model alone: plain words are normalized and split already, what is
        left of the steps before it is its alphabet of bytes."""
        ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(_ALPHABET))] for w in words]
        return np.array([x for found in ids for x in found], "<u4"), np.array(list(map(len, ids)), np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  Memory: the words and ids of the texts given; give about a million characters."""
        plain = [_SPECIAL not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        easy = iter(self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p]))
        hard = iter(self.encode_words([self.words(t) for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(easy if p else hard) for p in plain]

    def encode_words(self, cut: list[list[str]]) -> list[bytes]:
        ids = [list(map(self.kept.get, ws)) for ws in cut]
        lacking = [i for i, found in enumerate(ids) if None in found]
        if lacking:
            new = list({w for i in lacking for w, x in zip(cut[i], ids[i], strict=True) if x is None})
            fresh: dict[str, bytes] = {}
            for k in range(0, len(new), 2048):
                part = new[k : k + 2048]
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    fresh[w] = np.array(e.ids, "<u4").tobytes()
            for i in lacking:
                ids[i] = [fresh[w] if x is None else x for w, x in zip(cut[i], ids[i], strict=True)]
            room = KEPT_WORDS - len(self.kept)
            if room > 0:
                self.kept.update([(w, x) for w, x in fresh.items() if len(w) <= KEPT_CHARS][:room])
        return [b"".join(found) for found in ids]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        text = "".join([t + "\0" for t in texts])
        text, n = text.lower() if self.lowers else text, len(text)
        codes = np.zeros(n + SHORT_CHARS, np.uint8)
        codes[:n] = _CODE[np.frombuffer(text.encode("utf-16-le"), "<u2")]
        starts, lengths, ends = cut_plain(codes, n, self.lowers)
        keys = np.empty((len(starts), 2), np.uint64)
        eights = np.ndarray(n + 9, "<u8", codes, strides=(1,))
        keys[:, 0] = eights[starts] & _MASK[np.minimum(lengths, 8)]
        keys[:, 1] = eights[starts + 8] & _MASK[np.clip(lengths - 8, 0, 8)]
        found = self.table.find(keys)
        held = self.held
        long = lengths > SHORT_CHARS
        found[long, 1] = 0
        if (new := np.flatnonzero((found[:, 1] == 0) & ~long)).size:
            order = new[np.lexsort((keys[new, 0], keys[new, 1]))]
            other = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
            one = order[other]
            where = self.hold(*self.fresh(self.slices(text, starts[one], lengths[one])))
            found[order] = where[np.cumsum(other) - 1]
            if room := min(self.table.room - self.table.used, len(one)):
                self.table.add(keys[one[:room]], *where[:room].T)
                held = int(where[room - 1].sum())
        if (rest := np.flatnonzero(long)).size:
            ids = self.encode_words([[w] for w in self.slices(text, starts[rest], lengths[rest])])
            found[rest] = self.hold(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64))
        counts = found[:, 1]
        until = np.append(0, np.cumsum(counts))
        raw = self.ids[np.repeat(found[:, 0] - until[:-1], counts) + np.arange(until[-1])].tobytes()
        self.held = held
        to = (4 * until[ends]).tolist()
        return [raw[a:b] for a, b in zip([0, *to], to)]

    @staticmethod
    def slices(text: str, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
        return [text[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]

    def hold(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Puts ids behind those that are held; rows of start and number."""
        start, self.held = self.held, self.held + len(ids)
        if self.held > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), self.held - len(self.ids)), "<u4"))
        self.ids[start : self.held] = ids
        return np.stack([start + np.cumsum(counts) - counts, counts], axis=1)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary."""
    return WordEncoder(path)
