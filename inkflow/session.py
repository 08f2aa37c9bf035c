"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "inkflow", partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow; the cluster's own settings win where they are set."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
