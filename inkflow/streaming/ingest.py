"""Ingest as cycles over a state table: queue what is new, ingest what is pending, record, and stop when there is reason to.

A micro-batch of candidates is a cycle.  URLs that the state table does not know are queued; all pending sources are cleaned
and go through the gates in their order; the chunks of those that pass go to drafts under the caps (operators/caps.py).  The
rows of a cycle and its record are one step of a versioned table: the status column and the record are the checkpoint.  A
cycle is committed against the version it was computed from, so a second runner is seen and fails; a micro-batch that comes
again after a restart finds its step committed and changes nothing.

A run stops after max_cycles cycles, when drafts have stop_words words, when a cycle queues and processes nothing, or when
the caller asks for it.  The micro-batch that finds the run stopped ends the query before it is committed there, so the next
run starts with it.  Calls (URLs of posts) beyond max_calls of a cycle stay pending; when candidates are used up, more
cycles take what is pending.

Nulls: candidates without a URL drop; a null page is empty, and too short; sources are told apart by their URL, the
least source_id of a repeated one.  A chunk without a silo goes to silo null, which is one of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.functions import text as T
from inkflow.operators import caps
from inkflow.sources.versions import VersionedTable
from inkflow.streaming.streams import shared

STATE = "source_id long, url string, status string, reason string, n_words long, taken int, taken_words long, cycle long"
CHUNK_CHARS = 3500
WRITER = "ingest"


@dataclass
class Rules:
    min_words: int = 300
    terms: list[str] = field(default_factory=list)
    max_calls: int = 50
    max_total: int = 1 << 62
    max_silo: int = 1 << 62
    start: dict[int, int] = field(default_factory=dict)  # words by silo of empty drafts
    silo: Callable[[Column], Column] = lambda chunk: F.lit(0)
    max_cycles: int | None = None
    stop_words: int | None = None


class Stopped(Exception):
    """A micro-batch came after the run had stopped."""


def chunk_list(text: Column, silo: Callable[[Column], Column], parted_by: str = "\n\n") -> Column:
    """(silo, n) of the chunks of a text: paragraphs packed up to CHUNK_CHARS characters."""
    parts = F.filter(F.split(text, parted_by), lambda p: T.strip(p) != "")
    return F.transform(T.chunk_by(parts, CHUNK_CHARS, "\n\n", 2, True), lambda c: F.struct(silo(c).cast("int").alias("silo"), T.word_count(c).alias("n")))


def gate(clean: Column, n_words: Column, rules: Rules) -> Column:
    """The first gate that a text fails, or null."""
    return F.when(T.looks_blocked(clean), "blocked").when(n_words < rules.min_words, "too_short").when(~T.mentions(clean, rules.terms), "off_topic")


class Ingest:
    """fetch gives (source_id, html) of pending sources that are no part of the micro-batch."""

    def __init__(self, spark: SparkSession, base: str, rules: Rules, fetch: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.base, self.rules, self.fetch = spark, base, rules, fetch
        self.table = VersionedTable(spark, f"{base}/sources", STATE)
        self.stop_reason: str | None = None
        self.cycles = self._folders = 0

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        self._folders += 1
        path = f"{shared(self.spark, 'ingest')}-{name}-{self._folders}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def current(self, version: int | None = None) -> DataFrame:
        """Each source's last row."""
        columns = [c.split()[0] for c in STATE.split(", ")]
        later = F.col("cycle") * 2 + (F.col("status") != "pending").cast("int")
        last = self.table.read(version).groupBy("source_id").agg(F.max_by(F.struct(*columns), later).alias("r"))
        return last.select("r.*")

    def record(self) -> dict:
        return self.table.manifest()["note"]

    def records(self) -> list[dict]:
        """The cycle log, as it was committed."""
        return [m["note"] for m in self.table.manifests()]

    def cycle(self, batch: DataFrame, step: int | None) -> None:
        """One cycle over candidates (source_id, url, html); step: the micro-batch, or None for a cycle of its own."""
        if step is not None and self.table.done(WRITER, step):
            return
        if self.stop_reason:
            raise Stopped(self.stop_reason)
        version, note = self.table.version(), self.record()
        number, rules = note.get("cycle", 0) + 1, self.rules
        candidates = batch.where(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("source_id").alias("source_id"))
        new = self._store(candidates.join(self.table.read(version).select("url").distinct(), "url", "left_anti"), "new")
        pages = batch.select("source_id", "html").join(new, "source_id").dropDuplicates(["source_id"])
        if note.get("pending_after"):
            waiting = self._store(self.current(version).where("status = 'pending'").select("source_id", "url"), "waiting")
            pages = pages.unionByName(self.fetch(waiting).select("source_id", "html").join(waiting, "source_id"))
        clean = T.bound(T.html_clean(F.coalesce("html", F.lit(""))), lambda t: F.struct(t.alias("t"), T.word_count(t).alias("n")))
        pages = pages.select("source_id", "url", clean.alias("c")).withColumn("reason", gate(F.col("c.t"), F.col("c.n"), rules))
        chunks = F.when(F.col("reason").isNull(), chunk_list(F.col("c.t"), rules.silo))
        gated = self._store(pages.select("source_id", "url", "reason", F.col("c.n").alias("n_words"), chunks.alias("chunks")), "gated")
        start = {int(s): n for s, n in note["silos"].items()} if "silos" in note else rules.start
        passed = gated.where("reason is null").drop("reason")
        decided = caps.admit(passed, f"{shared(self.spark, 'ingest')}-caps", rules.max_total, rules.max_silo, start, "source_id", "url", call=T.any_of(F.col("url"), T.POST_DOMAINS), max_calls=rules.max_calls)
        status = F.when(F.col("reason").isNull(), "extracted").when(F.col("reason") == caps.LEFT, "pending").otherwise("failed")
        decided = decided.withColumn("status", status).withColumn("reason", F.when(F.col("reason") != caps.LEFT, F.col("reason")))
        failed = gated.where("reason is not null").withColumns({"taken": F.lit(0), "taken_words": F.lit(0).cast("long"), "status": F.lit("failed")})
        rows = self._store(decided.unionByName(failed).withColumn("cycle", F.lit(number).cast("long")), "rows")
        counts = {r.status: r.n for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        added = rows.select(F.inline(F.slice("chunks", F.lit(1), F.col("taken")))).groupBy("silo").agg(F.sum("n").alias("n")).collect()
        silos = dict(start)
        for r in added:
            silos[r.silo] = silos.get(r.silo, 0) + r.n
        queued, pending = new.count(), counts.get("pending", 0)
        processed = counts.get("extracted", 0) + counts.get("failed", 0)
        made = {
            "cycle": number, "queued": queued, "pending_before": note.get("pending_after", 0), "pending_after": pending, "processed": processed,
            "extracted": counts.get("extracted", 0), "failed": counts.get("failed", 0), "draft_words": sum(silos.values()), "silos": silos,
        }
        self.table.commit(rows, made_from=version, writer=None if step is None else WRITER, step=step, note=made)
        self.cycles += 1
        if rules.stop_words is not None and made["draft_words"] >= rules.stop_words:
            self.stop_reason = "words"
        elif queued == 0 and processed == 0:
            self.stop_reason = "nothing new"
        elif rules.max_cycles is not None and self.cycles >= rules.max_cycles:
            self.stop_reason = "cycles"

    def stop(self) -> None:
        self.stop_reason = "asked"

    def run(self, candidates: DataFrame) -> str:
        """Cycles over a stream of candidates (source_id, url, html) and what stays pending; why it ended."""
        self.stop_reason, self.cycles = None, 0
        writer = candidates.writeStream.option("checkpointLocation", f"{self.base}/offsets").trigger(availableNow=True)
        try:
            writer.foreachBatch(self.cycle).start().awaitTermination()
        except StreamingQueryException:
            if self.stop_reason is None:
                raise
        none = self.spark.createDataFrame([], "source_id long, url string, html string")
        while self.stop_reason is None and self.record().get("pending_after"):
            self.cycle(none, None)
        return self.stop_reason or "done"
