"""Caps on drafts, in one ordered run: a source's chunks go to silos until the whole or their silo is full.

Sources come in order, each with its chunks.  Before a chunk is added, the words of all drafts are held against max_total
and then those of its silo against max_silo; the chunk that crosses a cap is still added.  The first chunk that meets a
full cap ends its source, with all later chunks of it, so what a silo takes depends on what other silos refused.  Sources
marked as calls are left out, undecided, once max_calls of them have been taken whole.

A sequential rule, but with few changes: a silo that is full stays full, as do the calls.  While the set of full silos stays
the same, what a source adds depends on that set alone: its chunks before the first one of a full silo.  So the run is done by ranges of
sources, in rounds: a round adds up what every range takes under the present set, finds by running sums the first range in
which a silo or the whole fills up, and runs only that range in order, from sums that are known.  The ranges before it are
decided, and the next round starts behind it.  There are at most as many rounds as silos and two; each reads slim rows (silos
and word counts), and no task sees more than a range.

Nulls: null chunks count as none; a null place comes first, and rows of one place go by `tie`, which should tell
different rows apart.  A source without chunks is extracted.  Chunks without words are added while nothing is full.
Silos are any integers, and a null silo is one of its own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 20_000
TOTAL, SILO, LEFT = "draft_total_cap", "draft_silo_cap", "left"
DECIDED = "taken int, taken_words long, reason string"
_NONE, _CALLS = -(1 << 31), 1 - (1 << 31)  # inside: a null silo, and the number of calls


class State:
    """Words by silo, and the number of calls; the words of all silos count against the total."""

    def __init__(self, words: dict[int, int], max_total: int, max_silo: int, max_calls: int):
        self.words, self.max_total, self.max_silo, self.max_calls = dict(words), max_total, max_silo, max_calls
        self.total = sum(n for s, n in self.words.items() if s != _CALLS)

    def most(self, silo: int) -> int:
        return self.max_calls if silo == _CALLS else self.max_silo

    def full(self) -> set[int]:
        return {s for s, n in ({_CALLS: 0} | self.words).items() if n >= self.most(s)}

    def plus(self, more: dict[int, int]) -> State:
        return State({s: self.words.get(s, 0) + more.get(s, 0) for s in {*self.words, *more}}, self.max_total, self.max_silo, self.max_calls)

    def add(self, chunks: list[tuple[int, int]], call: bool) -> tuple[int, int, str | None]:
        """Chunks taken of one source, their words, and why the next one was not."""
        if call and self.words.get(_CALLS, 0) >= self.max_calls:
            return 0, 0, LEFT
        taken = words = 0
        for silo, n in chunks:
            if self.total >= self.max_total:
                return taken, words, TOTAL
            if self.words.get(silo, 0) >= self.max_silo:
                return taken, words, SILO
            self.words[silo] = self.words.get(silo, 0) + n
            self.total += n
            taken, words = taken + 1, words + n
        if call:
            self.words[_CALLS] = self.words.get(_CALLS, 0) + 1
        return taken, words, None


def in_ranges(rows: DataFrame, place: str, tie: str, path: str, range_rows: int) -> tuple[DataFrame, int]:
    """The rows in ranges of about range_rows of their order, written with the number of each row's range, and how many ranges
    there are."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    n = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(n, F.col(place).asc_nulls_first(), F.col(tie).asc_nulls_first())
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(f"{path}/ranges")
    return spark.read.schema(dealt.schema).parquet(f"{path}/ranges"), n


def _free(full: Column) -> Column:
    """How many chunks come before the first one of a full silo."""
    held = F.transform("_chunks", lambda c: F.array_contains(full, c["silo"]))
    at = F.array_position(held, True)
    return F.when(at > 0, at - 1).otherwise(F.size("_chunks")).cast("int")


def _ints(values: set[int]) -> Column:
    return F.array(*map(F.lit, sorted(values))).cast("array<int>")


def _added(free: Column, calls_full: bool) -> Column:
    """(silo, n) of what a row adds: its free chunks, and a call if it is one and all its chunks are free."""
    one = F.array(F.struct(F.lit(_CALLS).alias("silo"), F.lit(1).cast("long").alias("n")))
    chunks = F.slice("_chunks", F.lit(1), free)
    if calls_full:
        return F.when(~F.col("_call"), chunks)
    return F.when(F.col("_call") & (free == F.size("_chunks")), F.concat(chunks, one)).otherwise(chunks)


def _sums(rows: DataFrame, full: set[int], whole_full: bool) -> DataFrame:
    """(_range, silo, n): what each range adds to each silo, and to the calls, while nothing else gets full."""
    free = F.lit(0) if whole_full else _free(_ints(full))
    return rows.withColumn("_free", free).select("_range", F.inline(_added(F.col("_free"), _CALLS in full))).groupBy("_range", "silo").agg(F.sum("n").alias("n"))


def _first_crossing(sums: DataFrame, state: State) -> int | None:
    """The first range in which a silo, or the whole, gets full."""
    spark = sums.sparkSession
    held = [(s, n) for s, n in state.words.items()]
    start = spark.createDataFrame(held, "_s int, _n long")  # a row a silo
    most = F.when(F.col("silo") == _CALLS, state.max_calls).otherwise(state.max_silo)
    upto = Window.partitionBy("silo").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    silo = sums.join(F.broadcast(start), F.col("silo") == F.col("_s"), "left").withColumn("now", F.coalesce("_n", F.lit(0)) + F.sum("n").over(upto))
    # A row a range, whose number is the rows' over RANGE_ROWS.
    whole = sums.where(F.col("silo") != _CALLS).groupBy("_range").agg(F.sum("n").alias("n")).withColumn("now", state.total + F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    found = [silo.where(F.col("now") >= most).agg(F.min("_range")).first()[0]]
    if state.total < state.max_total:
        found.append(whole.where(F.col("now") >= state.max_total).agg(F.min("_range")).first()[0])
    return min((r for r in found if r is not None), default=None)


def _run_range(rows: DataFrame, state: State, place: str, tie: str) -> DataFrame:
    """The rows of one range, decided in order from `state`."""
    words, limits = dict(state.words), (state.max_total, state.max_silo, state.max_calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = State(words, *limits)
        for pdf in batches:
            got = [now.add([(c["silo"], c["n"]) for c in chunks], call) for chunks, call in zip(pdf["_chunks"], pdf["_call"], strict=True)]
            done = pd.DataFrame(got, columns=["taken", "taken_words", "reason"], index=pdf.index)
            yield pd.concat([pdf, done.astype({"reason": object})], axis=1)

    order = (F.col(place).asc_nulls_first(), F.col(tie).asc_nulls_first())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.coalesce(1).sortWithinPartitions(*order).mapInPandas(run, f"{fields}, {DECIDED}")


def admit(
    rows: DataFrame, path: str, max_total: int, max_silo: int, start: dict[int, int] | None = None, place: str = "place", tie: str = "tie", range_rows: int = RANGE_ROWS,
    call: Column | None = None, max_calls: int = 0,
) -> DataFrame:
    """rows (place, tie, chunks array<struct<silo int, n long>>, and others) with taken, taken_words and reason: how many of a
    source's chunks are taken, and the cap that ended it or null.  path: a new folder in the shared storage.  start: words by
    silo before the run.  call: which rows are calls; those after max_calls of them have the reason `left`."""
    spark = rows.sparkSession
    names = rows.columns
    chunks = F.transform(F.coalesce("chunks", F.array()), lambda c: F.struct(F.coalesce(c["silo"], F.lit(_NONE)).cast("int").alias("silo"), F.coalesce(c["n"], F.lit(0)).cast("long").alias("n")))
    rows = rows.withColumn("_call", F.lit(False) if call is None else F.coalesce(call, F.lit(False)))
    ranged, n = in_ranges(rows.withColumn("_chunks", chunks.cast("array<struct<silo:int,n:bigint>>")), place, tie, path, range_rows)
    state = State({} if start is None else {_NONE if s is None else s: w for s, w in start.items()}, max_total, max_silo, max_calls)
    phases: list[tuple[int, int, set[int], bool]] = []  # ranges from, to (exclusive), the full silos, whether the whole is full
    every: list[DataFrame] = []
    first = 0
    while first < n:
        full, whole_full = state.full(), state.total >= max_total
        sums = _sums(ranged.where(F.col("_range") >= first), full, whole_full)
        sums.write.parquet(f"{path}/sums-{first}")
        sums = spark.read.schema(sums.schema).parquet(f"{path}/sums-{first}")
        crossing = _first_crossing(sums, state)
        end = n if crossing is None else crossing
        if first < end:
            phases.append((first, end, full, whole_full))
        if crossing is None:
            break
        before = {r.silo: r.n for r in sums.where(F.col("_range") < end).groupBy("silo").agg(F.sum("n").alias("n")).collect()}
        state = state.plus(before)
        done = _run_range(ranged.where(F.col("_range") == end), state, place, tie)
        done.write.parquet(f"{path}/range-{end}")
        done = spark.read.schema(done.schema).parquet(f"{path}/range-{end}")
        every.append(done)
        took = done.where(F.coalesce("reason", F.lit("")) != LEFT).select(F.inline(_added(F.col("taken"), False))).groupBy("silo").agg(F.sum("n").alias("n")).collect()
        state = state.plus({r.silo: r.n for r in took})
        first = end + 1
    if phases:
        phase = F.coalesce(*(F.when((F.col("_range") >= a) & (F.col("_range") < b), F.struct(_ints(full).alias("full"), F.lit(whole).alias("whole"), F.lit(_CALLS in full).alias("calls"))) for a, b, full, whole in phases))
        same = ranged.withColumn("_phase", phase).where("_phase is not null")
        left = F.col("_call") & F.col("_phase.calls")
        same = same.withColumn("taken", F.when(left | F.col("_phase.whole"), 0).otherwise(_free(F.col("_phase.full"))).cast("int"))
        words = F.aggregate(F.slice("_chunks", F.lit(1), F.col("taken")), F.lit(0).cast("long"), lambda a, c: a + c["n"])
        ended = F.when(F.col("taken") < F.size("_chunks"), F.when(F.col("_phase.whole"), TOTAL).otherwise(SILO))
        every.append(same.withColumns({"taken_words": words, "reason": F.when(left, LEFT).otherwise(ended)}).drop("_phase"))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.select(*names, "taken", "taken_words", "reason")
