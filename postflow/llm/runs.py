"""Minimum sampling, scans over sorted runs and spans, for repeated-passage operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm import textarrays as ta


def owners(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every `width` consecutive hashes the place of the smallest (by its upper
    32 bits, the first of equals): the same place in equal windows, wherever they
    are, so a window repeats only if the item at its owner repeats."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = ta.sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | place, width)
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of `length` items that lie within one text."""
    return ta.ranges(bounds[:-1], np.diff(bounds) - length + 1)


def combine(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its value, value is repeated) of each item: what a task can tell
    on its own, so that of each value it sends one row on, however common it is."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    run = np.cumsum(new) - 1
    many = np.bincount(run, minlength=1)[run] > 1 if len(s) else new
    first, repeated = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order], repeated[order] = new, many
    return first, repeated


def repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, many, key, tag, at) sorted by h: key, tag and at of those whose h stands
    more than once, or once with `many` set. Rows without h pass as they are.
    One row is kept from batch to batch, whatever the length of a run."""
    kept = None  # the last row, if nothing has shown yet that it is repeated
    last, known = None, False
    for b in batches:
        h_col = b.column("h")
        key, tag, at = (b.column(c).to_numpy() for c in ("key", "tag", "at"))
        null = h_col.is_null().to_numpy(zero_copy_only=False)
        if null.any():
            yield _places(key[null], tag[null], at[null])
        ok = ~null
        if not ok.any():
            continue
        h = h_col.fill_null(0).to_numpy()[ok]
        many = b.column("many").to_numpy(zero_copy_only=False)[ok]
        key, tag, at = key[ok], tag[ok], at[ok]
        if kept is not None:
            h, many, key, tag, at = (np.concatenate([[x], y]) for x, y in zip(kept, (h, many, key, tag, at), strict=True))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        hit = (size > 1) | (np.bincount(run, weights=many) > 0)
        if known and kept is None and h[0] == last:
            hit[0] = True
        sure = hit[run]
        last, known, kept = h[-1], bool(hit[-1]), None
        if not known:
            kept = (h[-1], many[-1], key[-1], tag[-1], at[-1])
        if sure.any():
            yield _places(key[sure], tag[sure], at[sure])


def _places(key: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.astype(np.int64)), pa.array(tag.astype(np.int64)), pa.array(at.astype(np.int32))], ["key", "tag", "at"])


def later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, g, key, tag, lo, n) sorted by all but n: key, tag, lo and hi = lo + n
    of those that follow another place with the same h and g. Rows without h pass."""
    first = None  # (h, g, key, tag, lo) of the current run's first row
    for b in batches:
        h_col = b.column("h")
        cols = [b.column(c).to_numpy() for c in ("g", "key", "tag", "lo", "n")]
        null = h_col.is_null().to_numpy(zero_copy_only=False)
        if null.any():
            yield _spans(*(c[null] for c in cols[1:]))
        ok = ~null
        if not ok.any():
            continue
        h = h_col.fill_null(0).to_numpy()[ok]
        g, *place, n = (c[ok] for c in cols)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        if first is not None and first[0] == h[0] and first[1] == g[0]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        heads = [np.where(at >= 0, c[np.maximum(at, 0)], first[2 + i] if first else 0) for i, c in enumerate(place)]
        later = np.any([c != own for c, own in zip(place, heads, strict=True)], axis=0)
        first = (h[-1], g[-1], *(own[-1] for own in heads))
        if later.any():
            yield _spans(*(c[later] for c in place), n[later])


def _spans(key: np.ndarray, tag: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.astype(np.int64)), pa.array(tag.astype(np.int64)), pa.array(lo.astype(np.int32)),
         pa.array((lo + n).astype(np.int32))], ["key", "tag", "lo", "hi"])


def gathered(spans: DataFrame) -> DataFrame:
    """key, tag and the spans (lo, hi) there, a number each, as many as a text has room for."""
    one = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    return spans.groupBy("key", "tag").agg(F.collect_list(one).alias("spans"))


def ends(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi of gathered spans."""
    return spans >> 32, spans & 0xFFFFFFFF


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each of n items lies in a span [lo, hi)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(lo, 0, n), 1)
    np.add.at(step, np.clip(hi, 0, n), -1)
    return np.cumsum(step[:n]) > 0
