"""Ingest cycles and expiring sessions over several micro-batches."""

from __future__ import annotations

import random
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkflow.sources.versions import Conflict
from inkflow.streaming.expiry import Expiry, expired_sessions, merged
from inkflow.streaming.ingest import Ingest, Rules

PAGE = "source_id long, url string, html string"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def page(i, words, url=None, extra=""):
    return i, f"http://e.org/{i}" if url is None else url, f"<html><body><p>{extra} {' '.join(f'w{i}x{k}' for k in range(words))}</p></body></html>"


def feed(spark, *batches):
    path = folder() + "/pages"
    for rows in batches:
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(path), path


def rules(**more):
    return Rules(min_words=5, silo=lambda c: F.lit(0), **more)


def state(run):
    return {r.source_id: (r.status, r.reason, r.cycle) for r in run.current().collect()}


BATCHES = (
    [page(1, 9), page(2, 3), page(3, 9, extra="403 Forbidden"), (4, None, "x"), (5, "", "x"), (6, "http://e.org/6", None)],
    [page(1, 9), page(7, 9), page(8, 9, url="http://e.org/7"), page(9, 20)],
    [page(10, 9), page(11, 9)],
)


def test_cycles_gates_and_repeated_urls(spark):
    stream, _ = feed(spark, *BATCHES)
    run = Ingest(spark, folder() + "/run", rules())
    assert run.run(stream) == "done"
    done = ("extracted", None)
    assert state(run) == {1: (*done, 1), 2: ("failed", "too_short", 1), 3: ("failed", "blocked", 1), 6: ("failed", "too_short", 1), 7: (*done, 2), 9: (*done, 2), 10: (*done, 3), 11: (*done, 3)}
    assert [(r["cycle"], r["queued"], r["processed"], r["extracted"], r["failed"]) for r in run.records()] == [(1, 4, 4, 1, 3), (2, 2, 2, 2, 0), (3, 2, 2, 2, 0)]
    assert run.record()["draft_words"] == 9 + 9 + 20 + 9 + 9


@pytest.mark.parametrize(("limit", "reason", "cycles"), [({"max_cycles": 2}, "cycles", 2), ({"stop_words": 9}, "words", 1)])
def test_a_stopped_run_goes_on_where_it_stopped(spark, limit, reason, cycles):
    stream, _ = feed(spark, *BATCHES)
    base = folder() + "/run"
    run = Ingest(spark, base, rules(**limit))
    assert run.run(stream) == reason and len(run.records()) == cycles
    again = Ingest(spark, base, rules())
    assert again.run(stream) == "done"
    assert sorted(state(again)) == [1, 2, 3, 6, 7, 9, 10, 11] and len(again.records()) == 3


def test_a_replayed_batch_changes_nothing(spark):
    base = folder() + "/run"
    run = Ingest(spark, base, rules())
    batch = spark.createDataFrame(BATCHES[0], PAGE)
    run.cycle(batch, 0)
    before = (run.table.version(), state(run))
    run.cycle(batch, 0)
    Ingest(spark, base, rules()).cycle(batch, 0)  # after a restart
    assert (run.table.version(), state(run)) == before


def test_two_runners_do_not_both_commit(spark):
    base = folder() + "/run"
    first, second = Ingest(spark, base, rules()), Ingest(spark, base, rules())
    commit = first.table.commit

    def late(*args, **named):
        second.cycle(spark.createDataFrame([page(50, 9)], PAGE), None)
        return commit(*args, **named)

    first.table.commit = late
    with pytest.raises(Conflict):
        first.cycle(spark.createDataFrame([page(51, 9)], PAGE), 0)
    assert sorted(state(first)) == [50]


def test_calls_stay_pending_until_there_are_calls_again(spark):
    posts = [page(i, 9, url=f"https://x.com/a/status/{i}") for i in range(1, 6)]
    stream, path = feed(spark, [*posts, page(9, 9)], [page(12, 9)])
    known = spark.read.schema(PAGE).parquet(path)
    run = Ingest(spark, folder() + "/run", rules(max_calls=2), lambda waiting: known.join(waiting.select("source_id"), "source_id", "left_semi"))
    assert run.run(stream) == "done"
    done = {i: c for i, (s, _, c) in state(run).items() if s == "extracted"}
    assert done == {1: 1, 2: 1, 9: 1, 3: 2, 4: 2, 12: 2, 5: 3}  # the last cycle has no candidates
    assert [r["pending_after"] for r in run.records()] == [3, 1, 0]


def test_caps_hold_over_cycles(spark):
    stream, _ = feed(spark, [page(1, 9), page(2, 9)], [page(3, 9), page(4, 9)], [page(5, 9)])
    run = Ingest(spark, folder() + "/run", rules(max_total=25, max_silo=1000, start={0: 2}))
    run.run(stream)
    assert {i: r for i, (_, r, _) in state(run).items()} == {1: None, 2: None, 3: None, 4: "draft_total_cap", 5: "draft_total_cap"}
    silo = Ingest(spark, folder() + "/run", rules(max_silo=10))
    silo.run(stream)
    assert [r for _, (_, r, _) in sorted(state(silo).items())] == [None, None, "draft_silo_cap", "draft_silo_cap", "draft_silo_cap"]


def sessions(events, life):
    out = []
    for k in {k for k, _ in events}:
        times = sorted(t for x, t in events if x == k)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > life:
                out.append((k, times[start], times[i - 1], i - start))
                start = i
    return sorted(out, key=str)


def test_sessions_do_not_depend_on_batches(spark):
    rng = random.Random(4)
    events = [(rng.choice(["a", "b", "c", None]), rng.randrange(40_000)) for _ in range(150)]
    events.sort(key=lambda e: e[1] + rng.randrange(3000))  # out of order within the delay
    path, schema = folder() + "/events", "who string, ts timestamp"
    for k in range(0, 150, 30):
        rows = spark.createDataFrame(events[k : k + 30], "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, q = expired_sessions(stream, "who", 600, "2 hours")
    got = [(r.session, r.opened // 1_000_000, r.last // 1_000_000, r.n) for r in out.collect()]
    assert sorted(got, key=str) == sessions(events, 600)
    assert all(s["numRowsTotal"] == 0 for s in q.lastProgress["stateOperators"])  # nothing is left


def test_merging():
    assert merged([(50, 60, 1), (0, 5, 2), (15, 20, 1)], 10) == [(0, 20, 3), (50, 60, 1)]
    assert merged([], 10) == [] and Expiry(5).life == 5


class Handle:
    """State and timers of one key, which counts what is done with them."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_key_has_one_timer():
    """500 intervals of a key that the watermark has passed come out at one timer, with a few calls of state."""
    handle, p, none = Handle(), Expiry(1000), SimpleNamespace
    p.init(handle)
    times = none(getCurrentWatermarkInMs=lambda: 0)
    p.handleInputRows(("a",), iter([]), times)
    for part in (range(250, 500), range(250)):
        assert list(p.handleInputRows(("a",), [none(at=i * 10_000, n=1) for i in part], times)) == []
        assert len(handle.timers) == 1
    assert handle.timers == {2} and handle.calls <= 8
    passed = none(getCurrentWatermarkInMs=lambda: 4001)
    due = none(getExpiryTimeInMs=handle.timers.pop)  # a fired timer is gone
    got = list(p.handleExpiredTimer(("a",), passed, due))
    assert [r.opened for r in got] == [i * 10_000 for i in range(400)] and len(handle.rows) == 100
    assert handle.timers == {4002} and handle.calls <= 12
