"""Suffix-array dedup with a logarithmic index family.

Each byte covered by a `window`-byte string that also starts in a document with
a smaller doc_id is removed.

1. Sampling. Every window has an owner among the GRAM-byte strings in it (the
   one of smallest hash), the same in equal windows; so a window can repeat only
   if its owner does. Hashes of the owners go, packed, to the bucket of their
   value; a task sends each distinct value once, so a passage that a third of
   all texts share costs an entry a task. What comes back to a document are the
   owners that stand more than once anywhere (about 1 text byte in 14 has one).
2. Index. The stretch of windows around each of those owners goes, packed and
   compressed, to the bucket of its owner's hash and is taken there in the order
   of doc_id. New batches get suffix arrays (their windows sorted byte by byte, each with its smallest
   doc_id); these are merge-scanned against the levels there are, which marks
   the windows an earlier document holds; new windows become a level, and levels
   of equal size merge, so a bucket holds few levels and each window is merged
   a logarithmic number of times. There are as many more buckets as there are
   shuffle partitions, so one stays small. A stretch that is in the index as a whole adds
   nothing to it.
3. The marked windows of a document are united and cut out.

Windows are compared byte by byte; whole stretches by 128 bits of hash.

Defined results. Null text counts as empty. Texts shorter than a window: nothing
removed. Rows that share a doc_id cut nothing from each other, and each is cut by
its own text alone (64 bits of its hash tell them apart); a null doc_id is the
smallest. Empty table: no rows. Other columns are not read.
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

GRAM = 24
BUCKETS_PER_PARTITION = 4
INDEX_BYTES = 1 << 20  # stretches of a bucket that make a batch of the index
ENTRIES = 1 << 20  # owners a task gathers before it sends them on
STRETCH_BYTES = 8 << 20  # and bytes of stretches

_VALUES = ta.byte_values(3)
_BYTES = ta.SpanHash(0xD1342543DE82EF95)
_CHECK = ta.SpanHash(0xAF251AF3B0F025B5)


def _owned(buf: np.ndarray, offs: np.ndarray, window: int):
    """For a block: the owners' places and hashes, each owner's first window start
    and the number of windows it owns, and its text."""
    run = _BYTES.prefix(_VALUES[buf])
    at = np.arange(max(0, len(buf) - GRAM + 1))
    h = _BYTES.spans(run, at, at + GRAM)
    start = runs.window_starts(offs, window)
    if not len(start):
        z = np.zeros(0, np.int64)
        return run, z, h[:0], z, z, z
    owner = runs.owners(h, window - GRAM + 1)[start]
    doc = np.searchsorted(offs, start, side="right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    return run, owner[head], h[owner[head]], start[head], count, doc[head]


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in 4 bytes each where they fit, else in 8."""
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64).tobytes()


def _packed_tags(tag: np.ndarray) -> bytes:
    """Nothing where all are 0, as they are unless rows share ids."""
    return tag.tobytes() if tag.any() else b""


def _unpacked_tags(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64) if raw else np.zeros(n, np.int64)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.uint64)


_ENTRIES = "bucket int, sure boolean, n int, hashes binary, base long, keys binary, tags binary, many binary"


def _sampled(window: int, buckets: int):
    def pack(bucket, sure, h, key, tag, many):
        """One row for each bucket; hashes sorted within it, as differences."""
        if not len(h):
            return []
        order = np.lexsort((h, bucket))
        bucket, h, key, tag, many = (x[order] for x in (bucket, h, key, tag, many))
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for i, j in zip(head, np.append(head[1:], len(bucket)), strict=True):
            base = key[i:j].min()
            rows.append({"bucket": int(bucket[i]), "sure": sure, "n": int(j - i),
                         "hashes": _packed(np.diff(h[i:j], prepend=np.uint64(0))),
                         "base": int(base), "keys": _packed(key[i:j].view(np.uint64) - base.view(np.uint64)),
                         "tags": _packed_tags(tag[i:j]), "many": np.packbits(many[i:j]).tobytes()})
        return rows

    schema = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("n", pa.int32()), ("hashes", pa.binary()),
                        ("base", pa.int64()), ("keys", pa.binary()), ("tags", pa.binary()), ("many", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            keys, tags = b.column("key").to_numpy(), b.column("tag").to_numpy()
            for row, _, buf, offs in ta.blocks(b.column("text")):
                _, _, h, _, _, doc = _owned(buf, offs, window)
                parts.append((h, keys[row + doc], tags[row + doc]))
                n += len(h)
                if n >= ENTRIES:
                    yield sent(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, n = [], 0
        if n:
            yield sent(*map(np.concatenate, zip(*parts, strict=True)))

    def sent(h, key, tag):
        first, many = runs.combine(h)
        by_hash = (h % np.uint64(buckets)).astype(np.int64)
        by_key = (ta.mix((key ^ tag).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        short = h >> np.uint64(24)  # 40 bits: an owner that only seems to repeat costs work, no result
        rows = pack(by_hash[first], False, short[first], key[first], tag[first], many[first])
        rows += pack(by_key[~first], True, short[~first], key[~first], tag[~first], many[~first])
        return pa.RecordBatch.from_pylist(rows, schema)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """key, tag and (32 bits of) hash of a bucket's entries that stand more than once."""
    seen, out = [], []
    for r in table.to_pylist():
        h = np.cumsum(_unpacked(r["hashes"], r["n"]), dtype=np.uint64)
        k = (_unpacked(r["keys"], r["n"]) + np.int64(r["base"]).view(np.uint64)).view(np.int64)
        t = _unpacked_tags(r["tags"], r["n"])
        if r["sure"]:
            out.append((h, k, t))
        else:
            seen.append((h, k, t, np.unpackbits(np.frombuffer(r["many"], np.uint8), count=r["n"]).astype(bool)))
    if seen:
        columns = [np.concatenate(x) for x in zip(*seen, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        h, k, t, many = (x[order] for x in columns)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.cumsum(new) - 1
        hit = ((np.bincount(run) > 1) | (np.bincount(run, weights=many) > 0))[run]
        out.append((h[hit], k[hit], t[hit]))
    h, k, t = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    return pa.table({"key": pa.array(k, pa.int64()), "tag": pa.array(t, pa.int64()),
                     "h": pa.array(h.astype(np.uint32).view(np.int32), pa.int32())})


_STRETCH = "bucket int, sure boolean, n int, base long, keys binary, tags binary, lo binary, size binary, raw int, bytes binary"
_STRETCH_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("sure", pa.bool_()), ("n", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()),
    ("tags", pa.binary()), ("lo", pa.binary()), ("size", pa.binary()), ("raw", pa.int32()), ("bytes", pa.binary())])


def _stretches(window: int, buckets: int):
    def pack(sure, bucket, key, tag, lo, start, size, data):
        """One row for each bucket, its stretches in the order of doc_id."""
        if not len(key):
            return []
        order = np.lexsort((lo, tag, key, bucket))
        bucket, key, tag, lo, start, size = (x[order] for x in (bucket, key, tag, lo, start, size))
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for i, j in zip(head, np.append(head[1:], len(bucket)), strict=True):
            ids = key[i:j].view(np.uint64)
            raw = b"" if sure else data[ta.ranges(start[i:j], size[i:j])].tobytes()
            rows.append({"bucket": int(bucket[i]), "sure": sure, "n": int(j - i), "base": int(key[i]),
                         "keys": _packed(np.diff(ids, prepend=ids[:1])), "tags": _packed_tags(tag[i:j]), "lo": _packed(lo[i:j].astype(np.uint64)),
                         "size": _packed(size[i:j].astype(np.uint64)), "raw": len(raw),
                         "bytes": pa.compress(raw, codec="zstd", asbytes=True) if raw else b""})
        return rows

    def sent(parts):
        shift = np.cumsum([0] + [len(x[-1]) for x in parts])
        h, c, g, key, tag, lo, start, size = (
            np.concatenate([x[i] + (shift[j] if i == 6 else 0) for j, x in enumerate(parts)]) for i in range(8))
        data = np.concatenate([x[-1] for x in parts])
        order = np.lexsort((key, g, c))
        new = np.ones(len(c), bool)
        new[1:] = (c[order][1:] != c[order][:-1]) | (g[order][1:] != g[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))]
        later = np.zeros(len(c), bool)
        later[order] = key[order] > key[head]  # of equal stretches the index needs the first alone
        by_hash = (h % np.uint64(buckets)).astype(np.int64)
        by_key = (ta.mix((key ^ tag).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        rows = pack(False, *(x[~later] for x in (by_hash, key, tag, lo, start, size)), data)
        rows += pack(True, *(x[later] for x in (by_key, key, tag, lo, start, size)), data)
        return pa.RecordBatch.from_pylist(rows, _STRETCH_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for b in batches:
            keys, tags, lists = b.column("key").to_numpy(), b.column("tag").to_numpy(), b.column("hashes")
            cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for row, end, buf, offs in ta.blocks(b.column("text")):
                run_, _, h, start, count, doc = _owned(buf, offs, window)
                short = (h >> np.uint64(24)).astype(np.uint32).view(np.int32)
                bounds = ta.doc_bounds(doc, end - row)
                alive = np.zeros(len(h), bool)
                for d in range(end - row):
                    i, j = bounds[d], bounds[d + 1]
                    alive[i:j] = np.isin(short[i:j], flat[cut[row + d]: cut[row + d + 1]])
                h, start, count, doc = h[alive], start[alive], count[alive], doc[alive]
                if not len(h):
                    continue
                stop = start + count + window - 1
                c = _BYTES.spans(run_, start, stop) ^ h
                check = _CHECK.prefix(_VALUES[buf])
                g = (_CHECK.spans(check, start, stop) >> np.uint64(32)).astype(np.uint32)
                size = stop - start
                data = buf[ta.ranges(start, size)]
                parts.append((h, c, g, keys[row + doc], tags[row + doc], start - offs[doc], np.cumsum(size) - size, size, data))
                total += len(data)
                if total >= STRETCH_BYTES:
                    yield sent(parts)
                    parts, total = [], 0
        if parts:
            yield sent(parts)

    return run


class Levels:
    """A logarithmic family of sorted arrays: each value with its smallest key."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def least_key(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, smallest key) of sorted values: one scan of each level."""
        found = np.zeros(len(values), bool)
        key = np.zeros(len(values), np.int64)
        for have, have_key in self.levels:
            at = np.minimum(np.searchsorted(have, values), len(have) - 1)
            hit = (have[at] == values) & ~found
            key[hit] = have_key[at[hit]]
            found |= hit
        return found, key

    def add(self, values: np.ndarray, keys: np.ndarray) -> None:
        """Values that no level holds, sorted; levels of about one size merge."""
        if not len(values):
            return
        self.levels.append((values, keys))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels[-2:]
            at = np.searchsorted(a, b) + np.arange(len(b))
            old = np.ones(len(a) + len(b), bool)
            old[at] = False
            both, key = np.empty(len(old), a.dtype), np.empty(len(old), np.int64)
            both[at], key[at] = b, y
            both[old], key[old] = a, x
            self.levels[-2:] = [(both, key)]


def _first_of_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order, heads of equal runs, and the run of each sorted item."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _indexed(window: int):
    wide = np.dtype(f"S{window}")

    def batch(key, tag, lo, size, raw, whole: Levels, family: Levels) -> list[tuple]:
        cut = np.concatenate([[0], np.cumsum(size)])
        hashes = [x.spans(x.prefix(_VALUES[raw]), cut[:-1], cut[1:]) for x in (_BYTES, _CHECK)]
        c = np.stack([hashes[0], hashes[1]], axis=1).astype(">u8").view("S16").ravel()
        # stretches the index holds as a whole
        order, head, run = _first_of_runs(c)
        found, old = whole.least_key(c[order][head])
        first = np.where(found, old, key[order][head])
        covered = np.empty(len(c), bool)
        covered[order] = first[run] < key[order]
        whole.add(c[order][head[~found]], key[order][head[~found]])
        spans = [(key[covered], tag[covered], lo[covered], lo[covered] + size[covered])]
        # the others, window by window
        some = np.flatnonzero(~covered)
        if len(some):
            n = size[some] - window + 1
            at = ta.ranges(cut[:-1][some], n)
            text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, window)[at]).view(wide).ravel()
            row = np.repeat(some, n)
            of = key[row]
            place = ta.ranges(lo[some], n)
            order, head, run = _first_of_runs(text)  # the suffix array of the batch
            text = text[order][head]
            found, old = family.least_key(text)
            first = np.where(found, old, of[order][head])
            gone = np.empty(len(of), bool)
            gone[order] = first[run] < of[order]
            family.add(text[~found], of[order][head[~found]])
            r, p = row[gone], place[gone]
            if len(r):
                edge = np.ones(len(r), bool)
                edge[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
                a = np.flatnonzero(edge)
                z = np.append(a[1:], len(r)) - 1
                spans.append((key[r[a]], tag[r[a]], p[a], p[z] + window))
        return spans

    def run(table: pa.Table) -> pa.Table:
        parts, spans = [], []
        for r in table.to_pylist():
            n = r["n"]
            key = (np.cumsum(_unpacked(r["keys"], n), dtype=np.uint64) + np.int64(r["base"]).view(np.uint64)).view(np.int64)
            tag = _unpacked_tags(r["tags"], n)
            lo, size = (_unpacked(r[x], n).astype(np.int64) for x in ("lo", "size"))
            if r["sure"]:
                spans.append((key, tag, lo, lo + size))
            else:
                raw = pa.decompress(r["bytes"], r["raw"], codec="zstd", asbytes=True)
                parts.append((key, tag, lo, size, np.frombuffer(raw, np.uint8)))
        if parts:
            key, tag, lo, size, raw = map(np.concatenate, zip(*parts, strict=True))
            start = np.cumsum(size) - size
            order = np.lexsort((lo, tag, key))
            key, tag, lo, size, start = (x[order] for x in (key, tag, lo, size, start))
            whole, family = Levels(), Levels()
            cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), INDEX_BYTES))
            for i, j in zip(cut, np.append(cut[1:], len(key)), strict=True):
                if i < j:
                    spans += batch(*(x[i:j] for x in (key, tag, lo, size)), raw[ta.ranges(start[i:j], size[i:j])], whole, family)
        k, t, a, z = map(np.concatenate, zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 4
        return pa.table({"key": pa.array(k, pa.int64()), "tag": pa.array(t, pa.int64()), "lo": pa.array(a.astype(np.int32)), "hi": pa.array(z.astype(np.int32))})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column("spans")
        cut = spans.offsets.to_numpy()
        null = spans.is_null().to_numpy(zero_copy_only=False)
        lo, hi = runs.ends(spans.values.to_numpy())
        size, removed, runs_, digests = [], [], [], []
        for row, end, buf, offs in ta.blocks(b.column("text")):
            for d in range(end - row):
                text = buf[offs[d]: offs[d + 1]]
                i, j = cut[row + d], cut[row + d + 1]
                n = gone_n = 0
                if not null[row + d] and j > i:
                    gone = runs.covered(len(text), lo[i:j], hi[i:j])
                    gone_n = int(gone.sum())
                    n = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    digests.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
                else:
                    digests.append(hashlib.sha256(text.tobytes()).hexdigest())
                size.append(len(text))
                removed.append(gone_n)
                runs_.append(n)
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()),
             pa.array(digests, pa.string())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def earlier_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """key, tag, lo, hi of rows (key, tag, text): byte ranges whose windows also start in
    an earlier document."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = (docs.mapInArrow(_sampled(window, buckets), _ENTRIES)
                .groupBy("bucket").applyInArrow(_repeated, "key long, tag long, h int")
                .groupBy("key", "tag").agg(F.collect_list("h").alias("hashes")))
    return (docs.join(repeated.hint("shuffle_hash"), ["key", "tag"]).select("key", "tag", "text", "hashes")
            .mapInArrow(_stretches(window, buckets), _STRETCH)
            .groupBy("bucket").applyInArrow(_indexed(window), "key long, tag long, lo int, hi int"))


def remove_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = told_apart(documents)
    spans = runs.gathered(earlier_spans(docs, window))
    return (docs.join(spans.hint("shuffle_hash"), ["key", "tag"], "left").select("key", "text", "spans")
            .mapInArrow(_kept, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            .select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                    "kept_sha256"))
