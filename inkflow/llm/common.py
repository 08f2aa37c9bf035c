"""Helpers shared by the training-data operators: tables, shared folders, text defaults."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used for spark.checkpoint.dir only where the session names none, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see; only a local session may do
    without one being named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        root = LOCAL_SHARED
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends here."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of a step in the shared folder, which go when the step's own result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, name))
        return store(df, self.paths[-1])

    def clear(self) -> None:
        """Only when no table that is still to be read comes from these."""
        for path in self.paths:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = []


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(texts: list[str], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a list that hold about most_chars characters each; one long text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
