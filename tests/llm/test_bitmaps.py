"""The bitmap that keeps rows out of an exchange: never drops a row that is needed, passes few others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkflow.llm import neardup


@pytest.mark.parametrize("parts", [neardup.PARTS, 1])
def test_maybe_in(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(neardup, "PARTS", parts)
    values = spark.range(6000).select(F.xxhash64("id").alias("value"))
    values.write.parquet(str(tmp_path / "values"))
    values = spark.read.parquet(str(tmp_path / "values"))
    rows = spark.range(-30_000, 30_000).select("id", F.xxhash64("id").alias("x"), F.lit("t").alias("value"))
    got = neardup.maybe_in(rows.unionByName(rows.where("id < 0 or id > 5999").limit(5)).unionByName(rows.where("id = 7")), "x", values)
    assert got.columns == ["id", "x", "value"]
    ids = [r.id for r in got.collect()]
    assert set(range(6000)) <= set(ids)
    assert ids.count(7) == 2  # repeated rows stay
    others = len([i for i in ids if not 0 <= i < 6000]) / 54_000
    assert others < (0.1 if parts > 1 else 0.3)  # at its bound the bitmap passes more


def test_maybe_in_empty(spark, tmp_path):
    spark.range(0).select(F.col("id").alias("value")).write.parquet(str(tmp_path / "none"))
    values = spark.read.parquet(str(tmp_path / "none"))
    rows = spark.range(10).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    assert neardup.maybe_in(rows, "x", values).count() == 0
    assert neardup.maybe_in(rows.limit(0), "x", values).count() == 0
