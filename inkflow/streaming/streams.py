"""Micro-batch and event-time forms of the operators: availableNow runs into a table under the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see; only a local session may do without one being named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The time of a closing row: later than any event.
END = "9000-01-01"


def _run(stream: DataFrame, base: str) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    q = writer.format("parquet").outputMode("append").start(f"{base}/out")
    q.awaitTermination()
    return q


def drained(events: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, delay: str = "1 day") -> tuple[DataFrame, StreamingQuery]:
    """What `build` makes of all events in append mode, and the query that ended it.  Append mode keeps what is not past the
    watermark, so a second run reads one closing row, of the time END, from a source of its own: the watermark passes
    everything, and a last batch without rows writes what is left.  The row itself goes before the state."""
    spark = events.sparkSession
    base = shared(spark, name)
    spark.createDataFrame([], events.schema).write.parquet(f"{base}/closing")
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/closing"))
    # The condition names the event time, so it stays behind the watermark, which has then seen the row.
    stream = build(both.withWatermark("ts", delay).where(F.col("ts") < F.lit(END).cast("timestamp")))
    _run(stream, base)
    closing = [F.lit(END).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*closing).write.mode("append").parquet(f"{base}/closing")
    q = _run(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), q


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, so that a single file is a source too.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type; state is kept for a day behind the last event."""

    def build(events: DataFrame) -> DataFrame:
        w = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
        return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")

    return drained(_events(spark, sf_dir), build, "tumbling")[0]


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each user and type: micro-batches are held against what is stored, so no state grows with the keys."""
    return trend_upsert(spark, _events(spark, sf_dir)).select("user_id", "event_type")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps of less than an hour."""

    def build(events: DataFrame) -> DataFrame:
        s = events.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n"))
        return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")

    return drained(_events(spark, sf_dir), build, "session")[0]


def trend_upsert(spark: SparkSession, stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates (user, type) of a stream that are not known, each with the least event of the micro-batch that brought it:
    every micro-batch is de-duplicated, joined against the stored table and what `known` holds, and appended."""
    base = shared(spark, "trends")
    key = ["user_id", "event_type"]
    columns = stream.select(*key, F.col("event_id").alias("first_event"))

    def stored(before: int) -> DataFrame:
        return spark.read.schema(columns.withColumn("batch", F.lit(0).cast("long")).schema).parquet(f"{base}/out").where(F.col("batch") < before)

    def upsert(rows: DataFrame, i: int) -> None:
        new = rows.groupBy(*key).agg(F.min("event_id").alias("first_event"))
        for table in ([known] if known is not None else []) + ([stored(i)] if i > 0 else []):
            t = table.select(F.col("user_id").alias("_u"), F.col("event_type").alias("_t"))
            new = new.join(t, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("event_type").eqNullSafe(F.col("_t")), "left_anti")
        # A folder of its own, so that a repeated micro-batch replaces its rows.
        new.write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    spark.createDataFrame([], columns.schema).write.parquet(f"{base}/out/batch=-1")  # a stream without rows has a table too
    return stored(1 << 62).drop("batch")


def stream_trend_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (user, type) seen for the first time, without the customers' purchases, which are known."""
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit("purchase").alias("event_type"))
    return trend_upsert(spark, _events(spark, sf_dir), known)


CATALOGUE = {
    "stream_tumbling": (stream_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_session": (stream_session, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_trend_upsert": (stream_trend_upsert, "SELECT user_id, event_type, min(event_id) AS first_event FROM events WHERE NOT (event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer)) GROUP BY 1, 2"),
}
