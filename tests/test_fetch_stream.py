"""Fetch outcomes by keyed state: attempts that land in different micro-batches."""

import tempfile
import time

import pandas as pd

from postflow import schema
from postflow.operators import links
from postflow.streaming.fetch import fetch_stream, outcomes_of


def land(spark, base, rows, **kw):
    """Land attempts (url, attempt, code, exc, body), let the stream go on, and give all it wrote."""
    spark.createDataFrame(rows, schema.FETCH_LOG).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    q = fetch_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", **kw)
    q.awaitTermination()
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())


def test_rounds_in_any_order_give_the_batch_result(spark):
    base = tempfile.mkdtemp(prefix="pf-fetch-")
    rounds = [
        [("late", 2, 200, None, "{}"), ("down", 1, 503, None, None), ("ok", 0, 200, None, "[1]"), ("beyond", 3, 200, None, "{}")],
        [("late", 0, None, "ConnectionError", None), ("down", 0, 500, None, None), ("down", 0, 404, None, None),
         ("ok", 1, 404, None, None), ("loop", 0, None, "TooManyRedirects", None), (None, 0, 200, None, "{}"), ("none", None, 200, None, "{}")],
        [("late", 1, 404, None, None), ("down", 2, None, "Timeout", None), ("ok", 2, 200, None, "oops"), ("html", 0, 200, None, "<p>")],
    ]
    got = [land(spark, base, r) for r in rounds]
    assert [r[0] for r in got[0]] == ["ok"] and [r[0] for r in got[1]] == ["loop", "ok"]
    whole = [r for part in rounds for r in part if r[0] not in (None, "none") and r[:3] != ("down", 0, 404)]
    batch = links.reduce_fetch_log(spark.createDataFrame(whole, schema.FETCH_LOG))
    assert got[2] == sorted(tuple(r) for r in batch.collect()) and len(got[2]) == 5


def test_what_stays_incomplete_is_given_once_and_forgotten(spark):
    base = tempfile.mkdtemp(prefix="pf-fetch-")
    assert land(spark, base, [("half", 1, 503, None, None), ("done", 0, 404, None, None)], wait_ms=1000) == [
        ("done", 1, 404, "client_error", "HTTP 404")]
    time.sleep(1.5)
    given = land(spark, base, [("other", 0, 200, None, "{}")], wait_ms=1000)
    assert given == [("done", 1, 404, "client_error", "HTTP 404"), ("half", 2, 503, "gave_up", "HTTP 503"), ("other", 1, 200, "ok", None)]
    # a forgotten URL starts anew
    assert land(spark, base, [("half", 0, 200, None, "{}")], wait_ms=1000) == sorted([*given, ("half", 1, 200, "ok", None)])


class Kept:
    """What `outcomes_of` uses of a `GroupState`, with a clock set by hand."""

    def __init__(self):
        self.value, self.now, self.wait, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.wait = ms

    def remove(self):
        self.value = None


def test_urls_of_a_bucket_time_out_one_by_one():
    step, state = outcomes_of(2, 100), Kept()

    def call(now, *rows):
        state.now, state.hasTimedOut = now, not rows
        frames = [pd.DataFrame([r], columns=["url", "attempt", "code", "terminal", "outcome", "error"]) for r in rows]
        return sorted((u, n, None if pd.isna(c) else c, o, e) for pdf in step((0,), iter(frames), state) for u, n, c, o, e in
                      pdf.itertuples(index=False))

    late, down = (2, 200, True, "ok", None), (0, 503, False, "gave_up", "HTTP 503")
    assert call(1000, ("aé\"", *late), ("b", *down)) == []
    assert call(1060, ("b", 1, None, False, "gave_up", "Timeout"), ("c", 0, 404, True, "client_error", "HTTP 404")) == [
        ("c", 1, 404, "client_error", "HTTP 404")]
    assert state.wait == 40  # until the first URL is due, not the last
    assert call(1100) == []  # due, but not past it
    assert call(1101) == [("aé\"", 3, 200, "ok", None)] and state.wait == 59
    # a URL that gets an attempt stays; a known one adds nothing more
    assert call(1170, ("b", 0, 404, True, "client_error", "HTTP 404"), ("d", *down)) == []
    assert state.wait == 100 and state.exists
    assert call(1271) == [("b", 2, None, "gave_up", "Timeout"), ("d", 1, 503, "gave_up", "HTTP 503")] and not state.exists


def test_urls_share_state_rows_and_python_calls(spark):
    rows = [(f"u{i}", a, 503 if a < i % 3 else 200, None, "{}") for i in range(300) for a in range(3)]
    base = tempfile.mkdtemp(prefix="pf-fetch-")
    landed = spark.createDataFrame(rows, schema.FETCH_LOG)
    for attempt in (2, 0, 1):
        landed.filter(f"attempt = {attempt}").write.mode("append").parquet(f"{base}/landing")
        q = fetch_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", buckets=8)
        q.awaitTermination()
        assert q.exception() is None
        assert sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) <= 8
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted(tuple(r) for r in links.reduce_fetch_log(landed).collect()) and len(got) == 300
