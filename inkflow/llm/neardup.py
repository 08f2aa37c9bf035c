"""Near-duplicates by order MinHash and banded alignment.

A link: the word edit distance of two texts is at most (1 - similarity) of the longer one's words.  A text's k-mers are
its shingles of five words, each labelled with its occurrence number.  A sketch takes the ELL labelled k-mers of least
hash and keeps them in text order, so two texts share it with a probability that falls with their edit distance, moves
included.  SKETCHES sketches are drawn; texts that share one make up its run.

1. Equal texts are one node, named by a digest.
2. Sketches are range-sorted by (value, length, node), so that a value that a third of the corpus shares is spread over
   many tasks.  In one run of EARLY each node is compared with the node before it and with the run's first, which joins
   most copies at little cost; what it leaves, and all other runs, come under 4.  Texts whose lengths differ by more than a fifth of the longer one are no candidates.
3. Candidates are verified by banded alignment, and links become classes by alternating star contraction; each round is
   written to the shared folder.
4. What the second step left out is found exactly.  Runs of one class need no more.  In a run of several classes every two nodes
   of different classes and of about one length are candidates, while it has at most RUN nodes.  The nodes of longer runs,
   and all texts too short for sketches to be sure (SHORT words), go through a prefix filter: an edit changes GRAM shingles of
   GRAM words, so linked texts share at least so many of them (fewer words where texts are too short for that), and in one fixed
   order of all shingles the first few of one text hold one of the first few of the other.  The order puts frequent ones last.
   Shingles of one class give no candidates, nor do those whose texts all have one and the same earlier shingle, as all but
   the first of a common passage: a pair's first common shingle is never among them.  Most of these go
   before they make rows.  Only nodes outside of a shingle's largest class look for others.  Shingles of many nodes are split
   into blocks, and every two blocks are a group of their own.  Bits of the texts' words, of which no more than the edits can be
   set on one side only, drop most pairs before their texts are read.
5. These candidates are verified as well, and the classes are made again with their links.

So a link between classes is lost only if its texts are longer than SHORT words and share none of the sketches; the
README gives the measured recall.  Texts already in one class are not compared again, so links within a class are not
counted.  Texts of fewer than five words have one k-mer, the whole text.

Nulls: a null text is empty; all empty texts are equal.  A null doc_id joins its text's class; a class of null ids
only has the class null.  Repeated rows stay, in one class.  Very long texts are sketched in strips of k-mers, and their
alignment holds a band only.  Other columns, of whatever name, pass through keep_one and are ignored elsewhere.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, reduce
from operator import ne

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import Scratch, shared_dir, store, text_or_empty

SHINGLE, SKETCHES, ELL, SIMILARITY = 5, 80, 2, 0.8
KEPT_NODES = 200_000
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 16
#: Texts, or pairs of them, that go to Python at once.
TEXTS, ROWS_AT_ONCE = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Nodes of a run that are compared with one another, and words of a text up to which the prefix filter looks as well.
RUN, SHORT = 40, 100
#: One sketch value in EARLY (a power of two) gives candidates before the classes are first made; all go through the rest.
EARLY = 4
#: Words of a shingle in the prefix filter, slots of their counts for its order, and nodes in a block.
GRAM, SLOTS, BLOCK = 3, 1 << 23, 1000
#: Bits of a bitmap for each value in it, bits of one row of it, and rows at most: 32 MB.
SPARSE, PART, PARTS = 16, 1 << 15, 1 << 13
#: Numbers of 64 bits that say which words a text has, the same in the prefix filter, and slots of the word counts that bound
#: a distance from below.
BITS, SHARP, BAG = 16, 128, 1024
LENGTHS = 100
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"sketch%d" % i) | 1 for i in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A number for each byte, which bytes part words in an ASCII text, and an odd number whose powers tell a word's places.
_BYTES, _BLANK, _BASE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD), np.isin(np.arange(256), [*range(9, 14), *range(28, 33)]), 0xD6E8FEB86659FD93


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse, modulo 2 ** 64, from 0 to n - 1."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


_POWERS = powers(PIECE)


def piece_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of these bytes: the sum of its bytes' numbers times the power of their place in it."""
    up, down = _POWERS if len(raw) <= PIECE else powers(len(raw))
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(_BLANK.take(raw), out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES.take(raw) * up[: len(raw)], out=total[1:])
    return mix((total[edges[1::2]] - total[edges[::2]]) * down[edges[::2]])


def text_hashes(text: str) -> np.ndarray:
    """A hash of each word of text.split() for bounds and for the prefix filter, made from all bytes at once; long texts go by pieces that end between words.  Two
    words of one hash only bring texts nearer, so they give more candidates and lose none."""
    if not text.isascii():
        text = " ".join(text.split())
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) <= PIECE:
        return piece_hashes(raw)
    blank, found, a = np.append(np.flatnonzero(_BLANK[raw]), len(raw)), [], 0
    while a < len(raw):
        i = int(np.searchsorted(blank, a + PIECE, "right"))
        b = int(blank[i - 1]) if i and blank[i - 1] > a else int(blank[i])
        found.append(piece_hashes(raw[a:b]))
        a = b
    return np.concatenate(found)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes for sketches, whose values decide what these find.  A dictionary of words seen before takes longer."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a text of these word hashes."""
    n = min(k, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + m]) * _M1
        out ^= out >> np.uint64(32)
    return out


def numbered(s: np.ndarray) -> np.ndarray:
    """Sorted hashes mixed with their occurrence numbers."""
    first = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    places = np.arange(len(s))
    return s + (places - np.maximum.accumulate(np.where(first, places, 0))).astype(np.uint64) * _GOLD


def labelled(h: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with their occurrence numbers."""
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    out = np.empty(len(h), np.uint64)
    out[order] = numbered(s)
    return out


def least_places(x: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    """The places of the ell least values of x under each seed's order, one row a seed; at most a million values at once."""
    if len(x) <= ell:
        return np.broadcast_to(np.arange(len(x)), (len(seeds), len(x)))
    best: np.ndarray | None = None
    for a in range(0, len(x), 1 << 14):
        v = x[None, a : a + (1 << 14)] * seeds[:, None]
        rows, found = np.arange(len(seeds)), []
        for _ in range(min(ell, v.shape[1])):
            at = v.argmin(1)
            found.append(at + a)
            v[rows, at] = ~np.uint64(0)
        found = np.stack(found, 1)
        if best is not None:
            found = np.concatenate([best, found], 1)
            keep = np.argsort(x[found] * seeds[:, None], axis=1, kind="stable")[:, :ell]
            found = np.take_along_axis(found, keep, 1)
        best = found
    return best


def sketches(words: np.ndarray, m: int = SKETCHES, ell: int = ELL, k: int = SHINGLE) -> np.ndarray:
    """m order MinHash values of a text of these word hashes; none for a text without words."""
    if not len(words):
        return np.empty(0, np.int64)
    h = shingle_hashes(words, k)
    seeds = _SEEDS[:m]
    at = np.sort(least_places(mix(labelled(h)), seeds, ell), axis=1)  # text order
    value = seeds.copy()
    for j in range(at.shape[1]):
        value = mix(value * _GOLD + h[at[:, j]])
    return value.view(np.int64)


def edit_distance(a: list, b: list, most: int) -> int:
    """Banded word edit distance with bit vectors: a distance of at most `most`, or most + 1 if it is greater.

    Row i of the matrix is a bit; at column j only rows within `most` of j can lie on a path that cheap, so a window of
    the bit vectors moves along, BLOCK columns at a time."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    m, block = len(a), 64
    bottom = top = 0  # rows bottom..top-1 are in the window
    pv = mv = 0
    score = 0  # of row `top`
    for j, w in enumerate(b):
        if j % block == 0:
            new_top, new_bottom = min(m, j + block + most), max(0, j - most)
            if new_top > top:
                pv |= ((1 << (new_top - top)) - 1) << (top - bottom)
                score += new_top - top
                top = new_top
            if new_bottom > bottom:
                pv >>= new_bottom - bottom
                mv >>= new_bottom - bottom
                bottom = new_bottom
            mask = (1 << (top - bottom)) - 1
            high = 1 << (top - bottom - 1)
        eq = (places.get(w, 0) >> bottom) & mask
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
    return score if score <= most else most + 1


def bag_distance(x: list[str], y: list[str]) -> int:
    """At most the edit distance: how many words, counted by slot, one text has more than the other."""
    d = np.subtract(*(np.bincount(text_hashes(" ".join(w)) % np.uint64(BAG), minlength=BAG) for w in (x, y)))
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def length_class(n: int) -> int:
    """A logarithm of a number of words; those of linked texts are at most far_classes apart."""
    return int(LENGTHS * np.log1p(n))


def far_classes(least: float) -> int:
    return int(-LENGTHS * np.log(least)) + 1


def word_bits(words: np.ndarray, numbers: int = BITS) -> np.ndarray:
    """Bits of the words, each with its occurrence number, that a text of these word hashes has, in so many numbers."""
    bits = np.zeros(numbers * 64, np.uint8)
    bits[mix(numbered(np.sort(words))) % np.uint64(numbers * 64)] = 1
    return np.packbits(bits).view(np.int64)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether the word edit distance is at most (1 - least) of the longer text's words."""
    x, y = a.split(), b.split()
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    if len(x) == len(y) and sum(map(ne, x, y)) <= most:  # words in the places of others
        return True
    return bag_distance(x, y) <= most and edit_distance(x, y, most) <= most


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """What is written in this context goes to Python by TEXTS rows: whole texts in Spark's usual 10,000 take hundreds of
    megabytes a task on both sides."""
    before = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(ROWS_AT_ONCE, before)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), id (a long of it), text."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    return rows.select("doc_id", "key", node("key"), "text")


def node(key: str) -> Column:
    """Nodes travel as longs; two digests of one long only give more candidates."""
    return F.xxhash64(key).alias("id")


def sketch_rows(texts: DataFrame) -> DataFrame:
    """(s, q, id) for every sketch of every text, q the class of its length; and, for every text, (n, bits, id), its words as a
    number and as bits.  A task takes equal texts once, so their copies add few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            ids, lengths, values, bits = [], [], [], []
            for i, t in zip(pdf["id"].tolist(), pdf["text"], strict=True):
                if i not in seen:
                    if len(seen) < KEPT_NODES:
                        seen.add(i)
                    words = word_hashes(t.split())
                    ids.append(i)
                    lengths.append(len(words))
                    values.append(sketches(words))
                    bits.append(word_bits(words))
            sizes = [len(v) for v in values]
            every = np.concatenate(values or [np.empty(0, np.int64)])
            classes_ = np.array([length_class(n) for n in lengths], np.int32)
            yield pd.DataFrame({"s": every, "q": np.repeat(classes_, sizes), "id": np.repeat(np.array(ids, np.int64), sizes), "n": 0, "bits": None})
            yield pd.DataFrame({"s": 0, "q": classes_, "id": np.array(ids, np.int64), "n": lengths, "bits": pd.Series(bits, dtype=object)})

    return texts.select("id", "text").mapInPandas(run, "s long, q int, id long, n int, bits array<long>")


def runs(rows: DataFrame, far: int) -> DataFrame:
    """From (s, q, id): kind 0, the candidates (a, b) of each run; kind 1, (s, q, a) of every row whose run has other nodes or
    may go on in a neighbouring partition; kinds 2 and 3, a partition's first and last row."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, "s", "q", "id").sortWithinPartitions("s", "q", "id")
    names = ["kind", "part", "s", "q", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, head, any_row = TaskContext.get().partitionId(), None, None, False
        alone = False  # the last row is the only one of its run so far, and not written
        for pdf in batches:
            if not len(pdf):
                continue
            s, q, ids = (pdf[c].to_numpy() for c in ("s", "q", "id"))
            if last is not None:
                s, q, ids = (np.concatenate([[x], y]) for x, y in zip(last, (s, q, ids), strict=True))
            new = np.concatenate([[True], s[1:] != s[:-1]])
            again = np.concatenate([[False], ~new[1:] & (ids[1:] == ids[:-1])])  # one node twice
            first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            heads, head_q = ids[first], q[first]
            if last is not None:
                heads[first == 0], head_q[first == 0] = head[1], head[0]
            shared = np.concatenate([~new[1:], [False]]) | ~new  # a row before or after it in this batch
            live = np.flatnonzero(shared & ~again)
            live = live[live >= (0 if last is None or alone else 1)]
            pairs = np.flatnonzero(~new & ~again)
            first_looked = (s[pairs] & (EARLY - 1)) == 0
            near = pairs[first_looked & (q[pairs] - q[pairs - 1] <= far)]
            back = pairs[first_looked & (heads[pairs] != ids[pairs - 1]) & (heads[pairs] != ids[pairs]) & (q[pairs] - head_q[pairs] <= far)]
            a, b = np.concatenate([ids[near - 1], heads[back]]), np.concatenate([ids[near], ids[back]])
            out = [pd.DataFrame({"kind": 0, "part": part, "s": 0, "q": 0, "a": np.minimum(a, b), "b": np.maximum(a, b)})]
            out.append(pd.DataFrame({"kind": 1, "part": part, "s": s[live], "q": q[live], "a": ids[live], "b": 0}))
            if not any_row:
                out.append(pd.DataFrame([(2, part, int(s[0]), int(q[0]), int(ids[0]), 0)], columns=names))
                any_row = True
            alone = not shared[-1]
            last = (int(s[-1]), int(q[-1]), int(ids[-1]))
            head = (int(head_q[-1]), int(heads[-1]))
            yield pd.concat(out, ignore_index=True)
        if last is not None:
            yield pd.DataFrame([(3, part, *last, 0)], columns=names)

    return sorted_rows.mapInPandas(run, "kind int, part int, s long, q int, a long, b long")


def neighbours(rows: DataFrame, far: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From (s, q, id): candidate pairs (a, b), and (s, q, id) of the runs of several nodes; both come from one new table."""
    found = scratch.store(runs(rows, far), "runs")
    # Two rows a partition: the first, and the last of the one before that has rows.
    w = Window.orderBy("part", "kind")
    ends = found.where("kind > 1").select("kind", "s", "q", "a", *(F.lag(c).over(w).alias(c + "2") for c in ("s", "q", "a")))
    across = ends.where("kind = 2 and s = s2")
    near = across.where(F.col("q") - F.col("q2") <= far).select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b"))
    pairs = found.where("kind = 0").select("a", "b").unionByName(near).where("a <> b")
    cut = across.select("s", "q", F.col("a").alias("id")).unionByName(across.select("s", F.col("q2").alias("q"), F.col("a2").alias("id")))
    live = found.where("kind = 1").select("s", "q", F.col("a").alias("id")).unionByName(cut)
    return pairs.distinct(), live


def only(x: str, y: str) -> Column:
    """How many of the bits of column x are not in column y."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(BITS)])


def one_side(x: str, y: str) -> Column:
    """As `only`, for arrays of any length."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, n: s + n)


def alike(least: float) -> Column:
    """Whether texts of n and n2 words and the bits of these can be linked."""
    longer = F.greatest("n", "n2")
    edits = F.floor((1 - least) * longer + 1e-9)
    return (longer - F.least("n", "n2") <= edits) & (only("bits", "bits2") <= edits) & (only("bits2", "bits") <= edits)


def ends(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes (id) of pairs (a, b), written."""
    return scratch.store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "needed")


def not_told(pairs: DataFrame, words: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose words' bits (words: id, n, bits) do not say that they are not linked."""
    bits = scratch.store(maybe_in(words, "id", ends(pairs, scratch)), "bits")
    told = pairs.join(bits.withColumnRenamed("id", "a").hint("merge"), "a").join(bits.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2")).hint("merge"), "b")
    return told.where(alike(least)).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b), keys in order, of the candidate pairs (a, b) of nodes whose texts are similar.  Only texts that occur in a
    pair are shuffled, and the few others that maybe_in lets pass, once, one copy of each, and used for both ends."""
    pairs = scratch.store(pairs.distinct(), "likely")
    # By id alone, so that the joins need no other exchange; a set has two rows if two digests have one id.
    texts = maybe_in(keyed(docs).select("id", "key", "text"), "id", ends(pairs, scratch)).groupBy("id").agg(F.collect_set(F.struct("key", "text")).alias("all"))
    texts = texts.select("id", F.inline("all"))

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(a, b, least) for a, b in zip(x, y, strict=True)], dtype=bool)

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("key").alias("k"), F.col("text").alias("x")).hint("merge"), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("key").alias("l"), F.col("text").alias("y")).hint("merge"), "b")
    return both.where(close("x", "y")).select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every end of an edge: alternating large-star and small-star steps until only stars are left.  A
    node's least neighbour is aggregated before the shuffle, so hubs are no single task.  Only the last round's tables stay."""
    spark = edges.sparkSession
    now = store(edges.select("a", "b"), shared_dir(spark, "edges"))
    last = Scratch(spark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: (u, v) for every u and the neighbours v it looks at."""
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = this.store(least, "least")
        joined = e.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))

    def stars(e: DataFrame) -> bool:
        """Whether every greater end has one less one, which is no greater end itself: then nothing moves any more."""
        ends = e.select(F.col("b").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("a").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ups = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ups.where("up > 1 or up = 1 and down = 1").isEmpty()

    while True:
        this = Scratch(spark)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now = this.store(star(both, True).where("a <> b").distinct(), "large")
        down = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = this.store(star(down, False).where("a <> b").distinct(), "small")
        last.clear()
        last = this
        if stars(now):
            break
    return now.select(F.col("b").alias("key"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("key"), F.col("a").alias("root")).distinct())


def mixed_runs(live: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, q, id, root, n): the rows (s, q, id) of the runs with nodes of several classes, and the run's number of rows."""
    nodes = live.groupBy("id").agg(F.collect_list(F.struct("s", "q")).alias("places"))  # at most SKETCHES of a node
    rows = nodes.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.inline("places"))
    rows = scratch.store(rows.select("s", "q", "id", "root"), "rooted")
    mixed = rows.groupBy("s").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).where("r1 <> r2").select("s", "n")
    return scratch.store(rows.join(mixed.hint("merge"), "s"), "mixed")


def left_out(mixed: DataFrame, far: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of nodes of different classes and about one length in runs of at most RUN nodes, and the ids of longer ones."""
    few = mixed.where(F.col("n") <= RUN)
    other = few.select("s", F.col("q").alias("q2"), F.col("id").alias("id2"), F.col("root").alias("root2"))
    close = (F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")) & (F.abs(F.col("q") - F.col("q2")) <= far)
    pairs = few.join(other.hint("merge"), "s").where(close).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    return pairs, mixed.where(F.col("n") > RUN).select("id").distinct()


def edits(n: int, least: float) -> int:
    return int((1 - least) * n + 1e-9)


def shared_grams(longer: int, q: int, least: float) -> int:
    """How many q-grams, each with its occurrence number, two linked texts have in common, if the longer one has so many words:
    an edit changes q of them at most."""
    return longer - q + 1 - q * edits(longer, least)


@cache
def prefix_lengths(n: int, least: float) -> dict[int, int]:
    """By q, how many of the first q-grams of a text of n words must be looked at, whatever the length of its partner.  A pair
    goes by the greatest q up to GRAM of which linked texts share one; which that is depends on the longer text alone."""
    out: dict[int, int] = {}
    for longer in range(n, int(n / least) + 2):
        if longer - n <= edits(longer, least):
            q = next((q for q in range(GRAM, 1, -1) if shared_grams(longer, q, least) > 0), 1)
            out[q] = max(out.get(q, 0), n - q + 1 - shared_grams(longer, q, least) + 1)
    return out


def maybe_in(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose column, a long, is in the written table `values` of one column, and a few others (one in SPARSE, as long as the
    bitmap grows with the values), by a bitmap of at most PARTS rows of PART bits.  It is what keeps texts out of an exchange, alike
    at every size; an inner join or an aggregate's join must follow where others do harm."""
    n_parts = 1
    while n_parts < PARTS and n_parts * PART < SPARSE * values.count():
        n_parts *= 2

    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit("slot")), F.lit(n_parts * PART))

    part, at = (slot(values.columns[0]) / PART).cast("int"), F.pmod(slot(values.columns[0]), F.lit(PART))
    maps = values.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.pmod(slot(column), F.lit(PART)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.pmod(slot(column), F.lit(8))).cast("int"))
    kept = rows.join(F.broadcast(maps), (slot(column) / PART).cast("int") == F.col("_part"))  # at most PARTS rows of 4 kB
    return kept.where(bit != 0).select(*rows.columns)


def grams(words: np.ndarray, least: float) -> dict[int, np.ndarray]:
    """By q, the q-grams of a text of these word hashes that may count, labelled with their occurrence numbers, in text order."""
    return {q: labelled(shingle_hashes(words, q)) for q in prefix_lengths(len(words), least) if len(words) >= q}


def prefixes(words: np.ndarray, least: float, counts: np.ndarray) -> dict[int, np.ndarray]:
    """By q, the first q-grams in the common order: by count, then by value."""
    lengths = prefix_lengths(len(words), least)
    return {q: x[np.lexsort((x, counts[x & np.uint64(SLOTS - 1)]))[: lengths[q]]] for q, x in grams(words, least).items()}


def befores(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of a text's first q-grams x, in the common order, the one before it if that is as frequent by `counts`, else
    itself.  If all texts that have a q-gram have the same other one before it, two of these texts share that as well, and
    earlier: so the first q-gram that two texts share is never such a one."""
    code = counts[x & np.uint64(SLOTS - 1)]
    out = x.copy()
    out[1:] = np.where(code[1:] == code[:-1], x[:-1], x[1:])
    return out


def common_counts(texts: DataFrame, least: float) -> np.ndarray:
    """How frequent the q-grams of all texts are, by slot: their number, of more than 20,000 a logarithm.  Any order is
    right; this one has few texts meet, and q-grams of one passage follow one another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [x for w in map(text_hashes, pdf["text"]) if len(w) for x in grams(w, least).values()]
            slot, many = np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]) & np.uint64(SLOTS - 1), return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int32), "many": many})

    rows = texts.select("text").mapInPandas(run, "slot int, many long").groupBy("slot").agg(F.sum("many").alias("many")).where("many > 1")
    got = rows.select("slot", F.when(F.col("many") <= 20_000, F.col("many")).otherwise(F.least(20_000 + F.floor(500 * F.log2(F.col("many") / 20_000)), F.lit(32_767))).cast("short").alias("code")).toArrow()  # at most SLOTS rows of 6 bytes
    out = np.zeros(SLOTS, np.int16)
    out[got["slot"].to_numpy()] = got["code"].to_numpy()
    return out


def last_as_many(many: np.ndarray) -> list[int]:
    """For each place the last one before it whose number is as large or larger, or -1."""
    out, held = [], []
    for i, n in enumerate(many.tolist()):
        while held and many[held[-1]] < n:
            held.pop()
        out.append(held[-1] if held else -1)
        held.append(i)
    return out


def uncovered(places: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (id, root, n, q, at, gram, many), the rows of the shingles that are needed: a shingle is not, if all texts that have it
    have the same `before`, the last shingle in the common order that is had by as many texts or more.  These texts have that
    one too, and as it comes first in all of them, the first shingle that two texts share is never left out."""

    @F.pandas_udf("array<int>")
    def last(many: pd.Series) -> pd.Series:
        return pd.Series([last_as_many(np.asarray(m)) for m in many], dtype=object)

    # As long as a text's own prefix.
    lists = places.groupBy("id", "root", "n", "q").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "many"))).alias("row"))
    lists = lists.withColumn("last", last(F.col("row.many")))
    one = F.transform("row", lambda x, i: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), x["many"].alias("many"), F.get("row", F.get("last", i))["gram"].alias("before")))
    rows = scratch.store(lists.select("id", "root", "n", "q", F.inline(one)), "before")
    needed = rows.groupBy("gram").agg(F.count("before").alias("some"), F.count("*").alias("every"), F.min("before").alias("b1"), F.max("before").alias("b2"))
    return rows.join(needed.where("some < every or b1 <> b2").select("gram").hint("merge"), "gram", "left_semi").drop("before")


def with_major(live: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (gram, root, ...) with minor, whether the row is outside of its gram's largest class, and others, how many are."""
    live = scratch.store(live, "bare")
    sizes = live.groupBy("gram", "root").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("every"))
    sizes = sizes.select("gram", F.col("major.root").alias("major"), (F.col("every") - F.col("major.n")).alias("others"))
    return live.join(sizes.hint("merge"), "gram").withColumn("minor", F.col("root") != F.col("major")).drop("major")


def filtered(texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """From texts (id, root, text): pairs (a, b) of nodes of different classes that may be linked, and whether their words' bits
    are compared already (told); none that is linked is left out."""
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(common_counts(texts, least))  # SLOTS numbers of 2 bytes

    def first_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, roots, lengths, qs, found, earlier = [], [], [], [], [], []
            for i, root, t in zip(pdf["id"].tolist(), pdf["root"].tolist(), pdf["text"], strict=True):
                words = text_hashes(t)
                for q, x in prefixes(words, least, counts.value).items() if len(words) else ():
                    earlier.append(befores(x, counts.value).view(np.int64))
                    ids.append(i)
                    roots.append(root)
                    lengths.append(len(words))
                    qs.append(q)
                    found.append(x.view(np.int64))
            yield pd.DataFrame({"id": np.array(ids, np.int64), "root": np.array(roots, np.int64), "n": np.array(lengths, np.int32), "q": np.array(qs, np.int32), "grams": pd.Series(found, dtype=object), "befores": pd.Series(earlier, dtype=object)})

    def sharp_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = [word_bits(text_hashes(t), SHARP) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "bits": pd.Series(bits, dtype=object)})

    rows = scratch.store(texts.mapInPandas(first_grams, "id long, root long, n int, q int, grams array<long>, befores array<long>"), "grams")
    places = rows.select("id", "root", "n", "q", F.posexplode("grams").alias("at", "gram"))
    # Counted with its classes before any row moves; what `befores` covers goes before it makes rows of a join.
    each = rows.select("root", F.inline(F.arrays_zip("grams", "befores"))).groupBy("grams")
    ends = (F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("many"), F.min("befores").alias("b1"), F.max("befores").alias("b2"))
    several = scratch.store(each.agg(*ends).where("r1 <> r2 and (b1 <> b2 or b1 = grams)").select(F.col("grams").alias("gram"), "many"), "common")
    left = scratch.store(maybe_in(places, "gram", several.select("gram")).join(several, "gram"), "common-places")
    # Shingles of few texts give few pairs, whose bits are compared before they are verified; those of many texts carry them,
    # and only of these it matters which class is the largest.
    often = scratch.store(uncovered(left.where(F.col("many") > RUN), scratch), "left")
    bits = maybe_in(texts.select("id", "text"), "id", scratch.store(often.select("id").distinct(), "left-nodes")).mapInPandas(sharp_bits, "id long, bits array<long>")
    bare = left.where(F.col("many") <= RUN).select("*", F.lit(None).cast("array<long>").alias("bits"), F.lit(True).alias("minor"), F.col("many").alias("others"))
    live = scratch.store(with_major(often.join(bits.hint("merge"), "id"), scratch).unionByName(bare), "major")
    kept = ("id", "root", "n", "at", "bits", "minor")
    # Every text of a shingle, by blocks, and those outside of its largest class, by blocks of their own: only these look for others.
    blocks, own = F.ceil(F.col("many") / BLOCK).cast("int"), F.ceil(F.col("others") / BLOCK).cast("int")
    one = (blocks == 1) & (own == 1)
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = live.where(one).select("gram", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "q", *kept)
    many = live.where(~one)
    every = scratch.store(few.unionByName(many.select("gram", over(own).alias("lo"), of(blocks).alias("hi"), "q", *kept)), "live")
    minor = few.where("minor").unionByName(many.where("minor").select("gram", of(own).alias("lo"), over(blocks).alias("hi"), "q", *kept))
    right = every.select("gram", "lo", "hi", *(F.col(c).alias(c + "2") for c in kept))
    # Of the first gram that two texts share, both sides have enough left.
    longer = F.greatest("n", "n2")
    most = F.floor((1 - least) * longer + 1e-9)
    enough = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= longer - F.col("q") * most
    close = (F.col("root") != F.col("root2")) & (~F.col("minor2") | (F.col("id") < F.col("id2"))) & (longer - F.least("n", "n2") <= most) & enough
    near = F.col("bits").isNull() | (one_side("bits", "bits2") <= most) & (one_side("bits2", "bits") <= most)
    pairs = minor.join(right.hint("merge"), ["gram", "lo", "hi"]).where(close & near)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.col("bits").isNotNull().alias("told")).distinct()


def by_id(roots: DataFrame) -> DataFrame:
    """(id, root) in longs of (key, root) in digests."""
    return roots.select(node("key"), F.xxhash64("root").alias("root")).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key, class_id (the least doc_id of its class) of every different text."""
    spark = docs.sparkSession
    # What a step is made from goes when the step is written.
    sketched, run_tables, step = Scratch(spark), Scratch(spark), Scratch(spark)
    with few_at_once(spark):
        rows = sketched.store(sketch_rows(keyed(docs)), "sketches")
    far = far_classes(least)
    words = run_tables.store(rows.where("bits is not null").select("id", "n", "bits").distinct(), "word-bits")
    pairs, live = neighbours(rows.where("bits is null").select("s", "q", "id"), far, run_tables)
    sketched.clear()
    with few_at_once(spark):
        edges = store(verified(docs, pairs, step, least), shared_dir(spark, "links"))
    step.clear()
    roots = store(components(edges), shared_dir(spark, "roots"))
    mixed = mixed_runs(live, by_id(roots), run_tables)
    pairs, hot = left_out(mixed, far)
    text = keyed(docs)
    most = int(SHORT / least) + 1  # words of the longest partner
    looked = step.store(hot.unionByName(words.where(F.col("n") <= most).select("id")).distinct(), "looked-ids")
    once = maybe_in(text, "id", looked).groupBy("id", "key").agg(F.first("text").alias("text")).join(looked, "id", "left_semi")
    looked = step.store(once.join(by_id(roots), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "text"), "looked-at")
    with few_at_once(spark):
        found = pairs.withColumn("told", F.lit(False)).unionByName(filtered(looked, least, step))
        found = step.store(found.groupBy("a", "b").agg(F.max("told").alias("told")), "candidates")
        likely = not_told(found.where("not told").select("a", "b"), words, step, least).unionByName(found.where("told").select("a", "b"))
        more = store(verified(docs, likely, step, least), shared_dir(spark, "more"))
    step.clear()
    run_tables.clear()
    if not more.isEmpty():
        known = roots.where("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b"))
        roots = store(components(known.unionByName(more)), shared_dir(spark, "roots"))
    nodes = text.groupBy("key").agg(F.min("doc_id").alias("least"))
    linked = store(nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), shared_dir(spark, "linked"))
    # Written, so that Spark can split a large class in the join below.
    heads = store(linked.groupBy("root").agg(F.min("least").alias("class_id")), shared_dir(spark, "least-of-class"))
    return store(linked.join(heads, "root").select("key", "class_id"), shared_dir(spark, "classes"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, keeps (it is the document of class_id; of repeated rows of one doc_id, all)."""
    return keyed(docs).select("doc_id", "key").join(classes(docs, least), "key").select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("keeps")
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one of the least doc_id.  Rows with a null doc_id stay if their class is null,
    and repeated rows of a kept doc_id stay if their text is of the same class."""
    named = keyed(docs).select("doc_id", "key").join(classes(docs, least), "key")
    keep = named.where("doc_id = class_id or class_id is null").select(F.col("doc_id").alias("i"), F.col("key").alias("k")).distinct()
    own = F.unhex(F.md5(text_or_empty().cast("binary")))
    inside = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), own.alias("key"))  # no name of docs can clash
    return inside.join(keep, inside["id"].eqNullSafe(keep["i"]) & (inside["key"] == keep["k"]), "left_semi").select("row.*")
