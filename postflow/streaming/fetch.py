"""Outcomes of retrying fetches whose attempts land in different micro-batches.

The state of a URL is the attempts seen (a bit each) and two small judged attempts: the
first that ends the fetch and the last of all. Bodies are judged before the shuffle and
never reach the state. URLs share a state row by their hash: Python is called once for a
bucket of URLs and batch, as a call for each URL costs far more than its few attempts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postflow import schema
from postflow.operators.links import RETRYABLE, judged_attempts

OUTCOMES = "url string, attempts int, code int, outcome string, error string"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
# The URLs of a bucket as a JSON object: url -> [due, seen, ending, last] while its outcome is
# open, [due] once it is known; an attempt is [attempt, code, outcome, error]
STATE = "urls string"
BUCKETS = 1024


def _rows(known: list[tuple[str, list]]) -> pd.DataFrame:
    return pd.DataFrame({
        "url": pd.Series([u for u, _ in known], dtype=object),
        "attempts": pd.Series([j[0] + 1 for _, j in known], dtype="int32"),
        "code": pd.array([j[1] for _, j in known], dtype="Int32"),
        "outcome": pd.Series([j[2] for _, j in known], dtype=object),
        "error": pd.Series([j[3] for _, j in known], dtype=object)})


def outcomes_of(retries: int, wait_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """The step of one bucket of URLs. The outcome of a URL is known once every attempt before
    the first that ends the fetch was seen, or all of them were; it is given once. What
    never gets there is given as it stands `wait_ms` after the URL's last attempt; that is also
    how long a URL is remembered, so that late attempts add nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        urls = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs()
        met, known = set(), []
        for frame in () if state.hasTimedOut else frames:
            codes = frame["code"].astype(object).where(frame["code"].notna(), None)
            for url, attempt, code, terminal, outcome, error in zip(
                    frame["url"], frame["attempt"].tolist(), codes, frame["terminal"], frame["outcome"], frame["error"],
                    strict=True):
                met.add(url)
                entry = urls.setdefault(url, [0, 0, None, None])
                if len(entry) == 1 or entry[1] >> attempt & 1:
                    continue  # known, or landed twice
                one = [attempt, None if code is None else int(code), outcome, error]
                entry[1] |= 1 << attempt
                if terminal and (entry[2] is None or attempt < entry[2][0]):
                    entry[2] = one
                if entry[3] is None or attempt > entry[3][0]:
                    entry[3] = one
        for url in met:
            entry = urls[url]
            entry[0] = now + wait_ms
            if len(entry) > 1:
                _, seen, ending, last = entry
                needed = (1 << (ending[0] if ending else retries + 1)) - 1
                if seen & needed == needed:
                    known.append((url, ending or last))
                    urls[url] = entry[:1]
        for url in [u for u, entry in urls.items() if entry[0] < now]:
            entry = urls.pop(url)
            if len(entry) > 1:
                known.append((url, entry[2] or entry[3]))
        if urls:
            state.update((json.dumps(urls, ensure_ascii=False),))
            state.setTimeoutDuration(max(1, min(entry[0] for entry in urls.values()) - now))
        elif state.exists:
            state.remove()
        if known:
            yield _rows(known)

    return step


def fetch_stream(spark: SparkSession, landing_path: str, out_path: str, checkpoint_location: str,
                 retries: int = schema.FETCH_RETRIES, retryable: tuple[str, ...] = RETRYABLE,
                 wait_ms: int = 3_600_000, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Stream landed attempts (Parquet) into one outcome a URL, appended to `out_path` by
    Spark's file sink (a replayed batch writes nothing twice). Over attempts that are
    complete it gives what `reduce_fetch_log` gives, in whatever batches and order they
    land. A timeout passes in the next batch (with `available_now`: the next that brings
    attempts); at most 30 retries (a bit each), and rows
    without a URL or an attempt number are left out. `buckets` is how many state rows the
    URLs share, more for more URLs; it is fixed for the life of a checkpoint."""
    if not 0 <= retries <= 30:
        raise ValueError("retries must be 0 to 30")
    log = spark.readStream.schema(schema.FETCH_LOG).parquet(landing_path).filter("url IS NOT NULL")
    attempts = judged_attempts(log, retries, retryable).withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    outcomes = attempts.groupBy("bucket").applyInPandasWithState(
        outcomes_of(retries, wait_ms), OUTCOMES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    w = outcomes.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_location)
    if not available_now:
        return w.trigger(processingTime="1 minute").start()
    # Spark would go on with empty batches for ever to look for timeouts; the query keeps
    # the settings that it starts with
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        return w.trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
