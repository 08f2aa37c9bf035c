"""A corpus pipeline of five stages: quality, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm import decontaminate, neardup, packing, pii, quality
from inkflow.llm.common import shared_dir, store, table
from inkflow.llm.queries import BYTE_BPE, BYTE_BPE_END, vocabulary


def few_texts(spark: SparkSession) -> None:
    """Each stage returns a table that its caller writes, so the session is told, from the first stage on, to send whole texts
    to Python by few: 10,000 of them take hundreds of megabytes in a task and in its worker."""
    spark.conf.set(neardup.ROWS_AT_ONCE, str(neardup.TEXTS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this stage's own documents, does not reject."""
    few_texts(spark)
    names = docs.columns
    return quality.score_documents(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least doc_id."""
    few_texts(spark)
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    few_texts(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark of its kind in place of each span, and n_chars of the new text."""
    few_texts(spark)
    return docs.withColumn("text", pii.redacted(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, with their ids."""
    few_texts(spark)
    return packing.pack_documents(docs, vocabulary(BYTE_BPE), BYTE_BPE_END)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: A learned classifier, order MinHash, the random field and the tokenizer are not expressible in SQL: tests hold run()
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with neardup.few_at_once(spark):  # all is written in here, so the setting can go back
        for name, stage in STAGES:
            docs = store(stage(spark, docs, sf_dir), shared_dir(spark, f"stage-{name}"))
    return docs
