"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of `size` consecutive words are its shingles (an item of fewer words is one window).  Every window must
lie in a document whole, so its necessary prefix is one word: the rarest by document frequency, which is counted over all
documents; windows with a word that no document has are dropped.  Document words are joined with the windows whose prefix
word they are, each with the words around it; the positional bound gives the one place where the window could start, the
length bound drops places that do not fit, and the window's words are then compared there.

Windows, frequencies and prefixes are Spark tables.  The tasks that read documents get a bitmap of SLOTS bits of the words
that can matter, whatever the size of the benchmark, and one of the pairs of a prefix word and its neighbour in the window: a
place whose neighbour is in no pair can hold no window, and gives no row.  Words that only share a bit are dropped by the
joins.  A word that stands in many documents gives a row for each place that is left, and Spark splits such a word in the join.

Nulls: a null text has no words, and an item without words has no windows.  Windows of an item with a null id are hits
without an item.  Repeated doc_ids and item_ids: document rows stay separate, items of one id count once.  Very long texts
give rows by prefix word; the words that are hit are counted, and only hit_positions gathers a text's places in a row.  Other columns, of whatever name, are ignored, or pass through
drop_contaminated.  Empty tables: without items every document is clean; without documents there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store, text_or_empty

WINDOW = 10
#: Bits of the bitmaps, words that a task counts or remembers at once, rows that it holds, and the bit above a row's number.
SLOTS, KEPT_WORDS, MOST_PLACES, ROW_BITS = 1 << 22, 400_000, 20_000, 40
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and characters beyond ASCII, in UTF-8."""
    return _WORDS.findall((text or "").encode().lower())


def windows_of(ws: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    return [ws[i : i + size] for i in range(max(1, len(ws) - size + 1) if ws else 0)]


def window_table(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window, words) of every window of every item; window is its words with blanks between."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item_id, text in zip(pdf["item_id"].astype("Int64"), pdf["text"], strict=True):
                found = windows_of(words(text), size)
                yield pd.DataFrame({"item_id": pd.array([item_id] * len(found), "Int64"), "window": pd.Series([b" ".join(w) for w in found], dtype=object), "words": pd.Series(found, dtype=object)})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "item_id long, window binary, words array<binary>")


def bitmap(rows: DataFrame) -> np.ndarray:
    """SLOTS bits, those of the column `word` set: at most SLOTS integers come to the driver."""
    slots = rows.select((F.crc32("word") % SLOTS).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(SLOTS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits)


class Filter:
    """Which words' bits are set, remembered for the words seen so far."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.seen = bits, {}

    def _look(self, word: bytes) -> bool:
        k = zlib.crc32(word) % SLOTS
        got = bool(self.bits[k >> 3] >> (7 - (k & 7)) & 1)
        if len(self.seen) < KEPT_WORDS:
            self.seen[word] = got
        return got

    def beside(self, ws: list[bytes], p: int) -> bool:
        """Whether the bits are set of a pair with the next word, with the one before, or of the word alone."""
        w, bits = ws[p], self.bits
        for key in (w + b" " + ws[p + 1] if p + 1 < len(ws) else None, ws[p - 1] + b" < " + w if p else None, w + b" ."):
            if key is not None:
                k = zlib.crc32(key) % SLOTS
                if bits[k >> 3] >> (7 - (k & 7)) & 1:
                    return True
        return False

    def places(self, ws: list[bytes]) -> list[int]:
        flags = list(map(self.seen.get, ws))
        if None in flags:
            flags = [self._look(w) if f is None else f for w, f in zip(ws, flags, strict=True)]
        return [p for p, f in enumerate(flags) if f] if True in flags else []


def word_frequencies(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(word, n): in how many texts each word whose bit is set occurs; counted in the tasks, then summed."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matters, total = Filter(sent.value), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                ws = words(text)
                total.update({ws[p] for p in matters.places(ws)})
            if len(total) > KEPT_WORDS:
                yield pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object), "n": list(total.values())})
                total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object), "n": list(total.values())})

    return texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_table(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(word, at, window, words) of the windows (window, words) that can occur: the rarest word, the first in byte order
    of equally rare ones, and its place in the window."""
    each = windows.select("window", F.posexplode("words").alias("at", "word")).join(frequencies, "word", "left")
    rarest = each.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p")).where("p.n > 0")
    return rarest.join(windows, "window").select("p.word", "p.at", "window", "words")


def pair_keys(prefixes: DataFrame) -> DataFrame:
    """A key (word) of each prefix word with its neighbour in the window: the next word, else the one before, else none."""
    text = lambda s: F.lit(s).cast("binary")
    other = lambda k: F.get("words", F.col("at") + k)
    after, before = F.concat("word", text(" "), other(1)), F.concat(other(-1), text(" < "), "word")
    return prefixes.select(F.when(F.col("at") + 1 < F.size("words"), after).when(F.col("at") > 0, before).otherwise(F.concat("word", text(" ."))).alias("word"))


def marked(texts: DataFrame, bits: np.ndarray, pairs: np.ndarray, size: int) -> DataFrame:
    """A row for each text (row, n_words, and the columns of texts but text), and one for each of its words whose bit is
    set, as is one of a pair with it: row, word, its place p, and the words from place c on around it.  Write the table before it is used twice, as
    rows are numbered by the task that reads them."""
    sent = texts.sparkSession.sparkContext.broadcast((bits, pairs))
    others = [f for f in texts.schema if f.name != "text"]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matters, near, row = Filter(sent.value[0]), Filter(sent.value[1]), TaskContext.get().partitionId() << ROW_BITS
        types = {"row": pa.int64(), "n_words": pa.int64(), "word": pa.binary(), "p": pa.int32(), "c": pa.int32(), "around": pa.list_(pa.binary())}

        def out(batch: pa.RecordBatch, n: int, **given) -> pa.RecordBatch:
            """n rows: the columns of texts, if all are given, and of the given values; nulls for the others."""
            own = {f.name: batch[f.name] if len(batch) == n else pa.nulls(n, batch[f.name].type) for f in others}
            return pa.RecordBatch.from_pydict(own | {k: pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in types.items()})

        def flush(batch: pa.RecordBatch, places: list[tuple]) -> pa.RecordBatch:
            return out(batch[:0], len(places), **dict(zip(("row", "word", "p", "c", "around"), map(list, zip(*places, strict=True)), strict=True)))

        for batch in batches:
            counts, places = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                ws = words(text)
                counts.append(len(ws))
                for p in matters.places(ws):
                    if not near.beside(ws, p):
                        continue
                    c = max(0, p - size + 1)
                    places.append((row + k, ws[p], p, c, ws[c : p + size]))
                    if len(places) >= MOST_PLACES:
                        yield flush(batch, places)
                        places = []
            if places:
                yield flush(batch, places)
            yield out(batch, len(counts), row=np.arange(row, row + len(counts)), n_words=counts)
            row += len(counts)

    return texts.mapInArrow(run, kept + "row long, n_words long, word binary, p int, c int, around array<binary>")


def occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, start, n, window) of every window at its place in a document."""
    places = found.where("word is not null").select("row", "word", "p", "c", "around")
    start = F.col("p") - F.col("at") - F.col("c")
    fits = (start >= 0) & (start + F.size("words") <= F.size("around"))
    same = F.when(fits, F.slice("around", start + 1, F.size("words")) == F.col("words")).otherwise(False)
    return places.join(prefixes, "word").where(same).select("row", (F.col("p") - F.col("at")).alias("start"), F.size("words").alias("n"), "window")


def search(texts: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts with row and n_words, the occurrences of windows in them, and the windows' items."""
    spark = texts.sparkSession
    owners = store(window_table(benchmark, size), shared_dir(spark, "windows"))
    windows = owners.groupBy("window").agg(F.first("words").alias("words"))
    frequencies = word_frequencies(texts, bitmap(owners.select(F.explode("words").alias("word"))))
    prefixes = store(prefix_table(windows, frequencies), shared_dir(spark, "prefixes"))
    found = store(marked(texts, bitmap(prefixes), bitmap(pair_keys(prefixes)), size), shared_dir(spark, "marked"))
    return found.where("word is null").drop("word", "p", "c", "around"), store(occurrences(found, prefixes), shared_dir(spark, "occurrences")), owners.select("window", "item_id").distinct()


def hit_places(hits: DataFrame) -> DataFrame:
    """(row, p): the different words that an occurrence covers."""
    return hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct()


def find_overlap(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row (HITS) per document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found, hits, owners = search(texts, benchmark, size)
    hit = hit_places(hits).groupBy("row").agg(F.count("*").alias("n_hit"))
    items = hits.join(owners, "window").where("item_id is not null").select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    every = found.join(hit, "row", "left").join(items, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items")
    )
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return every.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items"
    )


def hit_positions(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id and hit_words, the places of the words that are hit, in order, of each document that has some; a row is as long
    as its document has such words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found, hits, _ = search(texts, benchmark, size)
    return found.join(hit_places(hits).groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("hit_words")), "row").select("doc_id", "hit_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents none of whose words lie in a benchmark window, with all their columns.  Texts are told apart by
    digest, and Spark splits the copies of a frequent text in the join."""
    digest = F.unhex(F.md5(text_or_empty().cast("binary")))
    texts = docs.select(digest.alias("digest"), text_or_empty().alias("text"))
    found, hits, _ = search(texts, benchmark, size)
    bad = found.join(hits.select("row").distinct(), "row", "left_semi").select("digest").distinct()
    bad = store(bad, shared_dir(docs.sparkSession, "contaminated"))  # so that Spark knows its size
    inside = docs.select(F.struct("*").alias("row"), digest.alias("digest"))  # no name of docs can clash
    return inside.join(bad, "digest", "left_anti").select("row.*")
