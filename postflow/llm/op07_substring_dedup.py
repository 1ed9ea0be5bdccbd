"""Substring dedup by level-wise doubling of word windows.

Level 1 looks at windows of a quarter of the length (5 words of 20). Of these only
the sampled ones are compared: each full-length window has an owner among the short
windows in it (the one of smallest hash), the same in equal windows, so all
repeated full windows have repeated owners. Only short windows that occur again
survive. Each further level doubles the length around the survivors alone: the full
windows that they own have owners of twice the length, which are compared in turn,
and at the last level the full windows themselves, of which every place but the
first is covered. Levels end early where nothing survives: the next have no rows.

A level is one exchange by hash: a task sends each of its distinct windows once
(it can tell for itself that the others repeat), so a passage that a third of
all texts share costs a row for each task; the receiving side scans sorted rows
and keeps one of them in memory. Full windows are compared by 96 bits of hash.

Defined results. Null, empty or blank text, or fewer words than a window: nothing
removed. Rows that share a doc_id are documents of their own, in the order of 64 bits
of their text's hash, and rows of equal text too get one result each; a null doc_id
is the smallest. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm import runs
from postflow.llm import textarrays as ta
from postflow.llm.common import NO_ID, told_apart

_VALUES = ta.byte_values(7)
_BYTES = ta.SpanHash(0x9FB21C651E98DF25)
_WORDS = ta.SpanHash(0xA24BAED4963EE407)
_CHECK = ta.SpanHash(0x9E6C63D0676A9A99)


def _owned(buf: np.ndarray, offs: np.ndarray, window: int, part: int):
    """For a block: each text's word bounds, word hashes, hashes of the short
    windows, starts of the full windows and their owners."""
    s, e, doc = ta.words(buf, offs)
    bounds = ta.doc_bounds(doc, len(offs) - 1)
    word = _BYTES.spans(_BYTES.prefix(_VALUES[buf]), s, e)
    run = _WORDS.prefix(word)
    at = np.arange(max(0, len(word) - part + 1))
    short = _WORDS.spans(run, at, at + part)
    start = runs.window_starts(bounds, window)
    owner = runs.owners(short, window - part + 1)
    return bounds, word, run, short, start, owner[start] if len(start) else start


def _alive(words: int, bounds: np.ndarray, batch: pa.RecordBatch, row: int, end: int) -> np.ndarray:
    """Which words of a block begin a surviving short window (column `at`)."""
    lists = batch.column("at")
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    alive = np.zeros(words + 1, bool)
    for d in range(end - row):
        at = bounds[d] + flat[cut[row + d]: cut[row + d + 1]]
        alive[at[at < bounds[d + 1]]] = True
    return alive


def _sampled(window: int, part: int, before: int | None):
    """Owners of `part` words of the full windows; of those alone whose owner of `before`
    words has survived, past the first level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tags = b.column("key").to_numpy(), b.column("tag").to_numpy()
            parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32))]
            for row, end, buf, offs in ta.blocks(b.column("text")):
                bounds, word, _, short, _, owner = _owned(buf, offs, window, part)
                if before:
                    owner = owner[_alive(len(word), bounds, b, row, end)[_owned(buf, offs, window, before)[-1]]]
                owner = owner[np.diff(owner, prepend=-1) != 0]
                doc = np.searchsorted(bounds, owner, side="right") - 1
                parts.append((short[owner], keys[row + doc], tags[row + doc], (owner - bounds[doc]).astype(np.int32)))
            h, key, tag, place = map(np.concatenate, zip(*parts, strict=True))
            first, many = runs.combine(h)
            # of a value this task has seen before, only the first is sent to be compared
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64), mask=~first), pa.array(many), pa.array(key), pa.array(tag), pa.array(place)],
                ["h", "many", "key", "tag", "at"])

    return run


def _doubled(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tags = b.column("key").to_numpy(), b.column("tag").to_numpy()
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3)]
            for row, end, buf, offs in ta.blocks(b.column("text")):
                bounds, word, prefix, _, start, owner = _owned(buf, offs, window, part)
                start = start[_alive(len(word), bounds, b, row, end)[owner]]
                doc = np.searchsorted(bounds, start, side="right") - 1
                check = _CHECK.spans(_CHECK.prefix(word), start, start + window) >> np.uint64(32)
                parts.append((_WORDS.spans(prefix, start, start + window), check.astype(np.uint32).view(np.int32),
                              keys[row + doc], tags[row + doc], start - bounds[doc]))
            h, g, key, tag, place = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((place, tag, key, g, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else order
            later = np.zeros(len(h), bool)
            later[order] = (key[order] != key[first]) | (tag[order] != tag[first]) | (place[order] != place[first])
            # one row for each distinct window, in the order of the texts (ids and places pack well)
            new = np.sort(order[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(g[new]), pa.array(key[new]), pa.array(tag[new]),
                 pa.array(place[new].astype(np.int32)), pa.array(np.ones(len(new), np.int32))],
                ["h", "g", "key", "tag", "lo", "n"])
            # the others are covered, whatever other tasks hold: sent on as ranges of starts
            key, tag, place = key[later], tag[later], place[later]
            order = np.lexsort((place, tag, key))
            key, tag, place = key[order], tag[order], place[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)
            lo = place[head]
            hi = place[np.append(np.flatnonzero(head)[1:], len(key)) - 1] + 1 if len(key) else place
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(lo), pa.int64()), pa.array(np.zeros(len(lo), np.int32)), pa.array(key[head]),
                 pa.array(tag[head]), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                ["h", "g", "key", "tag", "lo", "n"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            cut = spans.offsets.to_numpy()
            null = spans.is_null().to_numpy(zero_copy_only=False)
            lo, hi = runs.ends(spans.values.to_numpy())
            words, removed, digests = [], [], []
            for row, end, buf, offs in ta.blocks(b.column("text")):
                s, e, doc = ta.words(buf, offs)
                bounds = ta.doc_bounds(doc, end - row)
                gone = np.zeros(len(s), bool)
                for d in range(end - row):
                    i, j = cut[row + d], cut[row + d + 1]
                    if not null[row + d] and j > i:
                        n = bounds[d + 1] - bounds[d]
                        gone[bounds[d]: bounds[d + 1]] = runs.covered(n, lo[i:j], hi[i:j] + (window - 1))
                keep = np.flatnonzero(~gone)
                size = e[keep] - s[keep] + 1  # the word and one space
                at = ta.ranges(s[keep], size)
                ends = np.cumsum(size)
                out = np.append(buf, np.uint8(32))[at]
                out[ends - 1] = 32
                ends = np.concatenate([[0], ends])
                left = np.searchsorted(keep, bounds)
                raw = out.tobytes()
                for d in range(end - row):
                    i, j = ends[left[d]], ends[left[d + 1]]
                    digests.append(hashlib.sha256(raw[i: max(i, j - 1)]).hexdigest())
                    words.append(int(bounds[d + 1] - bounds[d]))
                    removed.append(int(gone[bounds[d]: bounds[d + 1]].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["key", "n_words", "n_removed", "kept_sha256"])

    return run


def levels(window: int) -> list[int]:
    """Lengths of the levels before the last: a quarter and a half of the window."""
    return sorted({max(1, window // 4), max(1, window // 2)})


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """key, tag, lo, hi of rows (key, tag, text): ranges of starts of the windows of `window`
    words whose words also start earlier."""
    by_hash = F.coalesce("h", F.xxhash64("key", "tag"))
    rows, before = docs, None
    for part in levels(window):
        survivors = (rows.mapInArrow(_sampled(window, part, before), "h long, many boolean, key long, tag long, at int")
                     .repartition(by_hash).sortWithinPartitions("h")
                     .mapInArrow(runs.repeated_rows, "key long, tag long, at int")
                     .groupBy("key", "tag").agg(F.collect_list("at").alias("at")))
        rows = docs.join(survivors.hint("shuffle_hash"), ["key", "tag"]).select("key", "tag", "text", "at")
        before = part
    return (rows.mapInArrow(_doubled(window, before), "h long, g int, key long, tag long, lo int, n int")
            .repartition(by_hash).sortWithinPartitions("h", "g", "key", "tag", "lo")
            .mapInArrow(runs.later_rows, "key long, tag long, lo int, hi int"))


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = told_apart(documents)
    spans = runs.gathered(repeated_windows(docs, window))
    return (docs.join(spans.hint("shuffle_hash"), ["key", "tag"], "left").select("key", "text", "spans")
            .mapInArrow(_kept(window), "key long, n_words long, n_removed long, kept_sha256 string")
            .select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept_sha256"))
