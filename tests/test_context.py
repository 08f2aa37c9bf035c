"""Wide contexts against a model in Python, and the plan's limit before its exchange."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkflow.operators.context import Branch, wide_context

SHAPES = {"few": ("\n- ", 3, None), "chars": (", ", None, 20), "both": ("|", 5, 12), "none": ("", 2, 5)}


def test_wide_context(spark):
    rng = random.Random(9)
    rows = {n: [(rng.choice([1, 1, 1, 1, 2, None, 7]), rng.choice([None, 0, 1, 2]), rng.choice([None, "", "é", "ab", "abc" * 9])) for _ in range(0 if n == "none" else 300)] for n in SHAPES}
    keys = [(1, "a"), (2, "b"), (3, "c"), (None, "d")]
    frames = {n: Branch(spark.createDataFrame(r, "key int, ord int, text string").withColumn("rank", F.lit("a clash")).repartition(5), *SHAPES[n]) for n, r in rows.items()}
    got = {r["title"]: r for r in wide_context(spark.createDataFrame(keys, "key int, title string"), frames).collect()}
    for key, title in keys:
        for n, (gap, items, chars) in SHAPES.items():
            order = lambda r: (r[1] is not None, r[1] or 0, r[2])
            own, every = (sorted((r for r in rows[n] if r[0] == k and r[2]), key=order) for k in (key, None))
            texts = [t for _, _, t in (own if key is not None else []) + every]
            assert got[title][n] == gap.join(texts[:items])[:chars], (title, n)


def test_tasks_limit_before_the_exchange(spark):
    b = {n: Branch(spark.range(1000).selectExpr("CAST(id % 3 AS INT) AS key", "id AS ord", "'x' AS text"), items=3) for n in ("few", "more")}
    plan = wide_context(spark.createDataFrame([(0,)], "key int"), b)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_a_branch_needs_a_bound(spark):
    with pytest.raises(ValueError):
        wide_context(spark.createDataFrame([(0,)], "key int"), {"all": Branch(spark.range(1).selectExpr("0 AS key", "id AS ord", "'x' AS text"))})
