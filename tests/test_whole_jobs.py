"""Operators of the plans and streams over all rows, where a registered query's SQL takes some."""

from __future__ import annotations

import tempfile

from inkflow.plans.documents import words_before
from inkflow.streaming.streams import trend_upsert


def test_words_before(spark):
    rows = [(i, (None, "en", "de")[i % 3], i % 7) for i in range(500)]
    got = words_before(spark.createDataFrame(rows, "doc_id long, lang string, n long"), ["lang"], size=40).collect()
    assert len(got) == 500
    assert all(r.before == sum(n for i, lang, n in rows if lang == r.lang and i < r.doc_id) for r in got)


def test_trend_upsert(spark):
    """Three micro-batches, of odd and even users, with a pair that is known and pairs of earlier batches."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/events"
    schema = "event_id long, user_id long, event_type string"
    for part in ([(5, 1, "a"), (4, 1, "a"), (6, 2, "a")], [(1, 1, "a"), (7, 3, "b"), (8, None, "c")], [(9, 3, "b"), (10, 4, "k"), (11, None, "c"), (12, 5, "z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    known = spark.createDataFrame([(4, "k")], "user_id long, event_type string")
    got = trend_upsert(spark, stream, known).collect()
    assert sorted((str(r.user_id), r.event_type, r.first_event) for r in got) == [("1", "a", 4), ("2", "a", 6), ("3", "b", 7), ("5", "z", 12), ("None", "c", 8)]
