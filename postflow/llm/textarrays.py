"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes.

Every function works on one block of whole texts laid end to end, so the cost
per byte is a few vector operations and memory is bounded by the block (or by
one text, where that is longer than a block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_WORD = ~_SPACE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random odd-looking 64-bit value for each byte, fixed by the seed."""
    base = np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mix(mix(base))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit`
    bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if n == 0:
        return
    _, off_buf, data = texts.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[texts.offset: texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[offs[row]: offs[end]], offs[row: end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word; a text boundary ends a word."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    doc = np.searchsorted(offs, start, side="right") - 1
    return start, end, doc


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inv = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inv):
        p = np.ones(max(n, 1), np.uint64)
        size = 1
        while size < n:
            step = U64(pow(b, size, 1 << 64))
            k = min(size, n - size)
            p[size: size + k] = p[:k] * step
            size += k
        out.append(p)
    return out[0], out[1]


class SpanHash:
    """64-bit hashes of spans of a sequence of 64-bit values, from one running
    sum of value * base**i (so a span costs one subtraction and one product)."""

    def __init__(self, base: int):
        self.base = base | 1
        self._up, self._down = _powers(1024, self.base)

    def _reach(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = _powers(max(n, 2 * len(self._up)), self.base)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        self._reach(n)
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self._up[: n - 1], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._reach(len(prefix))
        h = (prefix[end] - prefix[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def doc_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of the (sorted) items of every text: item i belongs to doc[i]."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ..., start[i]+count[i]-1 for all i, one after another."""
    count = np.maximum(count, 0)
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - (ends - count), count)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (len(x) - w + 1 of them)."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
