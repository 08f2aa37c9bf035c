"""Draft caps against the sequential rule, and the versioned table."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from inkflow.operators import caps
from inkflow.sources.versions import Conflict, VersionedTable

ROWS = "place long, tie string, chunks array<struct<silo:int,n:long>>, total int, taken_by string"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def model(rows, max_total, max_silo, start, max_calls=None):
    """A place that three divides is a call, if there are calls."""
    words, out, calls = dict(start), [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        taken = added = 0
        reason = None
        call = max_calls is not None and r[0] is not None and r[0] % 3 == 0
        if call and calls >= max_calls:
            out.append((r[0], r[1], 0, 0, "left"))
            continue
        for silo, n in r[2] or []:
            if sum(words.values()) >= max_total:
                reason = "draft_total_cap"
                break
            if words.get(silo, 0) >= max_silo:
                reason = "draft_silo_cap"
                break
            words[silo] = words.get(silo, 0) + (n or 0)
            taken, added = taken + 1, added + (n or 0)
        calls += call and reason is None
        out.append((r[0], r[1], taken, added, reason))
    return out


@pytest.mark.parametrize(("max_total", "max_silo", "start", "range_rows"), [(10**9, 300, {}, 7), (2500, 400, {0: 5, 3: 390}, 10), (900, 10**9, {}, 3), (10**9, 10**9, {}, 40), (0, 5, {}, 50), (5000, 50, {None: 49, 2: 60}, 1000)])
def test_caps_are_the_sequential_rule(spark, max_total, max_silo, start, range_rows):
    rng = random.Random(max_silo + range_rows)
    rows = [(rng.choice([None, *range(60)]), f"t{i:03d}", [(rng.choice([None, 0, 1, 2, 3, 3, 3, 12]), rng.choice([0, 1, 5, 40, None])) for _ in range(rng.randrange(6))] or rng.choice([None, []])) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(5)
    got = caps.admit(df, folder() + "/caps", max_total, max_silo, start, range_rows=range_rows)
    assert got.columns == ["place", "tie", "chunks", "total", "taken_by", "taken", "taken_words", "reason"]
    key = lambda t: t[1]
    assert sorted(((r.place, r.tie, r.taken, r.taken_words, r.reason) for r in got.collect()), key=key) == sorted(model(rows, max_total, max_silo, start), key=key)


@pytest.mark.parametrize(("max_total", "max_silo", "max_calls", "range_rows"), [(10**9, 10**9, 5, 9), (10**9, 200, 0, 9), (600, 10**9, 12, 5), (400, 90, 100, 12), (10, 10**9, 9, 6)])
def test_calls_are_left_when_they_are_used_up(spark, max_total, max_silo, max_calls, range_rows):
    rng = random.Random(max_calls)
    rows = [(rng.choice([None, *range(60)]), f"t{i:03d}", [(rng.choice([None, 0, 1, 2, 3]), rng.choice([1, 5, 20])) for _ in range(rng.randrange(4))]) for i in range(90)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    got = caps.admit(df, folder() + "/caps", max_total, max_silo, {}, range_rows=range_rows, call=F.col("place") % 3 == 0, max_calls=max_calls)
    key = lambda t: t[1]
    assert sorted(((r.place, r.tie, r.taken, r.taken_words, r.reason) for r in got.collect()), key=key) == sorted(model(rows, max_total, max_silo, {}, max_calls), key=key)


def test_no_sources(spark):
    assert caps.admit(spark.createDataFrame([], ROWS), folder() + "/caps", 10, 10).collect() == []


def test_versions(spark):
    t = VersionedTable(spark, folder() + "/table", "id long, text string")
    assert t.version() == 0 and t.read().collect() == []
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    ids = lambda v=None: sorted(r.id for r in t.read(v).collect())
    assert t.commit(rows(1, 2)) == 1 and t.commit(rows(3), note={"words": 7}) == 2
    assert t.commit(rows(9), mode="overwrite") == 3
    assert (ids(1), ids(2), ids(3), ids()) == ([1, 2], [1, 2, 3], [9], [9])
    assert t.manifest(2)["note"] == {"words": 7}
    t.stage(rows(100, 101))  # a step that is lost before its manifest
    assert ids() == [9] and t.version() == 3


def test_a_step_counts_once_and_races_are_seen(spark):
    path = folder() + "/table"
    a, b = (VersionedTable(spark, path, "id long") for _ in range(2))
    rows = lambda i: spark.createDataFrame([(i,)], "id long")
    assert a.commit(rows(1), writer="w", step=0) == 1
    assert a.commit(rows(1), writer="w", step=0) == 1 and b.commit(rows(5), writer="w", step=0) == 1  # repeated: nothing changes
    assert b.commit(rows(2), writer="v", step=0) == 2 and a.commit(rows(3), writer="w", step=1) == 3
    with pytest.raises(Conflict):
        a.commit(rows(4), made_from=2)
    with pytest.raises(Conflict):
        b.publish([b.stage(rows(6))], 2, "append", None, None, None)  # the version that another writer has just made
    assert sorted(r.id for r in b.read().collect()) == [1, 2, 3] and len(list(a.manifests())) == 3
