"""Toxicity by noisy-channel deobfuscation.

1. A character language model (3-grams of a-z, `other letter` and `no letter`)
   is counted over all texts, added up by Spark.
   With it, each mark (a byte that is no letter) is counted after the one before it.
2. A token that may be disguised (digits or symbols that stand for letters,
   separators inside a word, a letter twice in a row, three or more tokens of one
   character in a row) is a lattice of characters: each written character
   stands for one of a few letters, for a repetition, or for nothing, at a cost.
   Viterbi finds the letters of least cost under the language model; the token
   is replaced by them. Where a token has no letter, a word ends in symbols, or a
   run has marks among its letters, that reading must also cost less than the
   marks as they are written (numbers, punctuation). All other tokens, and a mark
   alone, have one reading only and stay.
3. The restored text is scored: indicators of its words and of word beginnings
   (3 to 6 letters), scaled by log-count ratios, under a linear hinge-loss model
   fitted on at most `per_class` labelled rows of each class, chosen by a seeded
   hash of doc_id.

Defined results. Null or empty text: the score of a text without words. Labels
other than 0 and 1, null ids, and ids with both labels: not learned from. Only
one class (or none) to learn from: every score is 1.0, 0.0 or 0.5. Repeated rows
are each scored alike. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm import common, linear
from postflow.llm import textarrays as ta

# What a written character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
SEPARATORS = ".-_*~'`,/"

DIM = 1 << 18
KNOWN_BYTES = 64  # longer tokens are decoded each time they are met
LONG = 256  # characters from which on it pays to drop states that cannot win
SYMBOLS = 28  # 0: no letter, 1..26: a-z, 27: another letter
PREFIXES = (3, 4, 5, 6)
# Costs (nats) of the channel: a mark stands for a letter; a mark with such a reading
# or a doubled letter means nothing; a letter of a run of three or more repeats.
STAND_IN, DROP_MARK, DROP_DOUBLE, DROP_REPEAT = 0.5, 8.0, 8.0, 0.5
DISGUISE = 3.0  # marks that might as well be meant as written stand for letters

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"): ord("z") + 1] = np.arange(1, 27)
_CLASS[0x80:] = 27
_LETTER = _CLASS > 0
_ASCII_LETTER = (_CLASS > 0) & (_CLASS < 27)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in [*LEET, *SEPARATORS]]] = True
_STAND_IN = np.zeros(256, bool)
_STAND_IN[[ord(c) for c in LEET]] = True
_WRITTEN = np.arange(256, dtype=np.int64)  # letters count as one, and so do blanks
_WRITTEN[_LETTER] = ord("a")
_WRITTEN[0x09: 0x0E] = 0x20
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"): ord("9") + 1] = True
_VALUES = ta.byte_values(9)
_HASH = ta.SpanHash(0xBF58476D1CE4E5B9)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, pairs = np.zeros(SYMBOLS ** 3, np.int64), np.zeros(1 << 16, np.int64)
    for b in batches:
        for _, _, buf, offs in ta.blocks(b.column("text")):
            # a text boundary reads as `no letter`, a space
            buf = np.insert(ta.LOWER[buf], offs[:-1], 0x20) if len(buf) else buf
            cls, mark = _CLASS[buf].astype(np.int64), _WRITTEN[buf]
            if len(cls) > 2:
                grams += np.bincount((cls[:-2] * SYMBOLS + cls[1:-1]) * SYMBOLS + cls[2:], minlength=len(grams))
                pairs += np.bincount((mark[:-1] << 8 | mark[1:])[cls[1:] == 0], minlength=len(pairs))
    n = np.concatenate([grams, pairs])
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["gram", "n"])


def language_models(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cost (-log p) of a character after the two before it, and of each mark (a byte
    that is no letter), given that it is one, after the byte before it; the counts
    cover all texts, and at most SYMBOLS**3 + 256**2 sums come back."""
    rows = (documents.select("text").mapInArrow(_gram_counts, "gram int, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(SYMBOLS ** 3 + (1 << 16))
    for r in rows:
        n[r["gram"]] = r["n"]
    pairs = n[SYMBOLS ** 3:].reshape(256, 256)
    n = n[: SYMBOLS ** 3].reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SYMBOLS)
    p2 = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5)
    p1 = (pairs.sum(axis=0) + 1) / (pairs.sum() + 256)
    marks = (pairs + 5 * p1) / (pairs.sum(axis=1, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32), -np.log(marks).astype(np.float32)


def language_model(documents: DataFrame) -> np.ndarray:
    """Cost (-log p) of a character after the two before it."""
    return language_models(documents)[0]


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ord(ch) >= 0x80 else 0


class _Leads:
    """How much more than the best state another may cost and still be on the best reading:
    whatever is read next, the two are in one state after two letters (or the end)."""

    def __init__(self, cost: list):
        self.cost, self.known = np.array(cost), {}

    def of(self, best: tuple[int, int], other: tuple[int, int]) -> float:
        lead = self.known.get((best, other))
        if lead is None:
            first = self.cost[best] - self.cost[other]
            second = self.cost[best[1]] - self.cost[other[1]]
            lead = max(first[0], (first[1:, None] + second[1:]).max()) + 1e-6
            self.known[best, other] = lead
        return lead


def _lattice(token: str, cost: list, ends: list[int]) -> list[tuple[float, tuple | None]]:
    """Cost and letters (see `_letters`) of the likeliest reading of the first n characters
    of a (lower-case) token, as a word, for each n of `ends`. A state is the last two
    characters read; its value the least cost and the letters so far, the last one first."""
    found = []
    at = set(ends)
    leads = _Leads(cost) if len(token) >= LONG else None
    states = {(0, 0): (0.0, None)}
    for i, ch in enumerate(token):
        letter = _class(ch) > 0
        reads = [(ch, 0.0)] if letter else [(x, STAND_IN) for x in LEET.get(ch, "")]
        again = i > 0 and token[i - 1] == ch
        if not reads:
            skip = 0.0
        elif again and ch * 3 in (token[max(0, i - 2): i + 1], token[i - 1: i + 2]):
            skip = DROP_REPEAT
        elif letter:
            skip = DROP_DOUBLE if again else None
        else:
            skip = DROP_MARK
        new: dict = {}
        for (a, b), (v, path) in states.items():
            if skip is not None:
                best = new.get((a, b))
                if best is None or v + skip < best[0]:
                    new[a, b] = (v + skip, path)
            for x, extra in reads:
                k = _class(x)
                w = v + extra + cost[a][b][k]
                best = new.get((b, k))
                if best is None or w < best[0]:
                    new[b, k] = (w, (path, x))
        if leads and len(new) > 4:
            first = min(new, key=lambda s: new[s][0])
            least = new[first][0]
            new = {s: e for s, e in new.items() if e[0] <= least + leads.of(first, s)}
        states = new
        if i + 1 in at:
            found.append(min(((v + cost[a][b][0], path) for (a, b), (v, path) in states.items()), key=lambda s: s[0]))
    return found


def _letters(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def decode(token: str, cost: list) -> str:
    """The likeliest letters behind a (lower-case) token."""
    return _letters(_lattice(token, cost, [len(token)])[0][1]) if token else token


def _as_written(text: str, cost: list, written: list, state: tuple[int, int] = (0, 0), before: str = " ") -> float:
    """Cost of a text, and the space after it, if every mark is meant as such."""
    (a, b), v = state, 0.0
    for ch in text + " ":
        k = _class(ch)
        v += cost[a][b][k]
        if not k:
            v += written[ord(before)][ord(ch)]
        a, b, before = b, k, "a" if k else ch
    return v


def _read_run(run: str, cost: list, written: list) -> str:
    """A run of one-character tokens with marks among them: one word, or as written
    but for three or more letters in a row."""
    parts = re.split("([\x20\x09-\x0D]+)", run)
    tokens = parts[::2]
    out, value, at = "", 0.0, 0
    while at < len(tokens):
        to = at
        while to < len(tokens) and _class(tokens[to][0]):
            to += 1
        if to - at >= 3:
            plain = "".join(tokens[at: to - 1]) + tokens[to - 1][0]
            [(v, path)] = _lattice(plain, cost, [len(plain)])
            letters = _letters(path)
            rest = tokens[to - 1][1:]
            value += v + written[ord("a")][ord((rest + " ")[0])]
            out += letters + rest
        else:
            to = max(to, at + 1)
            value += _as_written(" ".join(tokens[at:to]), cost, written)
            out += "".join(parts[2 * at: 2 * to - 1])
        out += "".join(parts[2 * to - 1: 2 * to])
        at = to
    plain = "".join(tokens)
    [(v, path)] = _lattice(plain, cost, [len(plain)])
    return _letters(path) if v + written[ord("a")][ord(" ")] + DISGUISE < value else out


def read(token: str, sure: int, cost: list, written: list) -> str:
    """A token with its disguise off. The first `sure` characters are read as letters
    in any case; of what follows (or the whole token) the language model says how far
    it is part of the word, and the rest stays as written."""
    if sure == len(token):
        return decode("".join(token.split()), cost)
    ends = [n for n in range(1, len(token) + 1) if n == sure or n > sure and token[n - 1] in LEET]
    # what stays as written, from each place on: its marks (but for the first) and the characters
    rest_cost, tail = [0.0] * (len(token) + 1), token + " "
    for n in range(len(token) - 1, sure - 1, -1):
        rest_cost[n] = rest_cost[n + 1] + written[ord(tail[n])][ord(tail[n + 1])] + cost[0][0][0]
    best = None if sure else (_as_written(token, cost, written), 0, None)
    for n, (v, path) in zip(ends, _lattice(token, cost, ends), strict=True):
        v += written[ord("a")][ord(tail[n])] + rest_cost[n] + (DISGUISE if n > sure else 0.0)
        if best is None or v < best[0]:
            best = (v, n, path)
    _, n, path = best
    return _letters(path) + token[n:]


def _suspects(buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(start, end of what is read as letters in any case, end, text, run of tokens
    with marks) of the spans of a lower-cased block to be decoded."""
    start, end, doc = ta.words(buf, offs)
    if not len(start):
        return []
    letter = _LETTER[buf]
    # what counts of a token: without symbols at its end and quotes before it
    keep = letter | _DIGIT[buf]
    last = np.maximum.accumulate(np.where(keep, np.arange(len(buf)), -1))[end - 1] + 1
    stop = np.maximum(last, start)
    money = np.zeros(len(start), bool)  # one or two $ at the end may be letters
    for k in (1, 2):
        at = np.minimum(stop + k - 1, len(buf) - 1)
        money |= (stop > start) & (stop + k == end) & (buf[at] == ord("$"))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, marks, stand_ins = total(letter), total(_MARK[buf]), total(_STAND_IN[buf])
    n_letters = letters[end] - letters[start]
    stop = np.where(n_letters == 0, start, np.where(money, end, stop))
    double = np.zeros(len(buf), bool)
    double[1:] = _ASCII_LETTER[buf[1:]] & (buf[1:] == buf[:-1])
    twos = total(double)
    odd = (n_letters > 0) & (marks[stop] - marks[start] > 0)
    odd |= twos[np.maximum(stop, np.minimum(start + 1, stop))] - twos[np.minimum(start + 1, stop)] > 0
    open_end = stand_ins[end] - stand_ins[stop] > np.where(n_letters > 0, 0, 1)  # one mark alone is no word
    odd |= open_end
    # tokens of one character, perhaps with a symbol behind it
    head, tail = buf[start], buf[end - 1]
    single = (stop - start == 1) & _ASCII_LETTER[head] & (end - start <= 2)
    mark = (end - start == 1) & _MARK[head]
    mark |= (end - start == 2) & _STAND_IN[head] & ~_LETTER[tail] & ~_STAND_IN[tail]
    short = single | mark
    at = np.flatnonzero(odd & ~short)
    upto = np.where(open_end, end, stop)
    spans = [(*x, False) for x in zip(*(a[at].tolist() for a in (start, stop, upto, doc)), strict=True)]
    # runs of three or more of them that may be letters
    readable = single | mark & _STAND_IN[head]
    edge = np.diff(np.concatenate([[0], short.astype(np.int8), [0]]))
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if j - i < 3:
            continue
        cut = [i, *(np.flatnonzero(np.diff(doc[i:j])) + i + 1), j]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = np.flatnonzero(readable[a:b]) + a
            if len(own) < 3:
                continue
            a, b = own[0], own[-1] + 1
            e = int(start[b - 1]) + 1
            mixed = bool(mark[a:b].any())
            spans.append((int(start[a]), int(start[a]) if mixed else e, e, int(doc[a]), mixed))
    return sorted(spans)


def restored(texts: pa.Array, cost: np.ndarray, written: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (rows, bytes, offsets) of the lower-cased texts with every disguised
    token replaced by its reading. Without `written`, marks cost nothing as such."""
    table = cost.tolist()
    marks = (np.zeros((256, 256)) if written is None else written).tolist()
    known: dict[tuple, bytes] = {}
    for row, end, buf, offs in ta.blocks(texts):
        buf = ta.LOWER[buf]
        spans = _suspects(buf, offs)
        if spans:
            raw, parts, at = buf.tobytes(), [], 0
            grown = np.zeros(end - row, np.int64)
            for s, sure, e, d, run in spans:
                token = raw[s:e]
                out = known.get((token, sure - s, run))
                if out is None:
                    if len(known) > 50_000:  # memory only: a token met again is decoded again
                        known.clear()
                    plain = token.decode("utf-8", "replace")
                    n = len(raw[s:sure].decode("utf-8", "replace"))
                    out = _read_run(plain, table, marks) if run else read(plain, n, table, marks)
                    out = out.encode()
                    if len(token) <= KNOWN_BYTES:
                        known[token, sure - s, run] = out
                parts += [raw[at:s], out]
                at = e
                grown[d] += len(out) - len(token)
            parts.append(raw[at:])
            buf = np.frombuffer(b"".join(parts), np.uint8)
            offs = offs + np.concatenate([[0], np.cumsum(grown)])
        yield end - row, buf, offs


def indicators(texts: pa.Array, cost: np.ndarray, written: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct feature slots of every restored text, in row order."""
    place = np.zeros(DIM, np.int32)
    for n, buf, offs in restored(texts, cost, written):
        s, e, doc = ta.words(buf, offs, _LETTER)
        run = _HASH.prefix(_VALUES[buf])
        kinds = [_HASH.spans(run, s, e) ^ np.uint64(1)]
        owner = [doc]
        for k in PREFIXES:
            long = e - s >= k
            kinds.append(_HASH.spans(run, s[long], s[long] + k) ^ np.uint64(k << 8))
            owner.append(doc[long])
        bounds = [ta.doc_bounds(o, n) for o in owner]
        slots = [(ta.mix(h) % np.uint64(DIM)).astype(np.int64) for h in kinds]
        for d in range(n):
            f = np.concatenate([x[b[d]: b[d + 1]] for x, b in zip(slots, bounds, strict=True)])
            at = np.arange(len(f), dtype=np.int32)
            place[f] = at
            yield f[place[f] == at]


def _fit(cost: np.ndarray, written: np.ndarray, seed: int, c: float, epochs: int, least_ratio: float):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, rows = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            ys += b.column("label").to_pylist()
            rows += list(indicators(b.column("text"), cost, written))
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        y = np.array([1 if ys[i] == 1 else -1 for i in order])
        rows = [rows[i] for i in order]
        if not len(y) or len(set(y.tolist())) < 2:
            v, bias = np.zeros(DIM), 0.0 if not len(y) else 40.0 * y[0]
        else:
            r = linear.log_count_ratio(rows, y, DIM, min_rows=5)
            r[np.abs(r) < least_ratio] = 0.0  # words of either class: noise in long texts
            rows = [f[r[f] != 0] for f in rows]
            w, bias = linear.fit_hinge(rows, [r[f] / 4 for f in rows], y, DIM, c=c, epochs=epochs, seed=seed)
            v = w * r / 4
        yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float32).tobytes()], pa.binary()), pa.array([float(bias)])],
                                         ["v", "bias"])

    return fit


def fit_toxicity(documents: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 3000,
                 seed: int = 9, c: float = 0.5, epochs: int = 12, least_ratio: float = 1.0) -> dict:
    cost, written = language_models(documents)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if train is not None:
        rows = rows.filter(train)
    rows = (rows.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("_most"))
            .filter("label = _most").select("doc_id", "label"))
    sample = common.sample_per_class(rows, "label", per_class, seed, [0, 1])
    texts = (documents.select("doc_id", "text")
             .join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    got = texts.repartition(1).mapInArrow(_fit(cost, written, seed, c, epochs, least_ratio), "v binary, bias double").collect()
    v = np.frombuffer(got[0]["v"], np.float32) if got else np.zeros(DIM, np.float32)
    return {"cost": cost, "written": written, "v": v, "bias": got[0]["bias"] if got else 0.0}


def toxicity_scores(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Rows with
    crc32(doc_id) mod 5 = 0 are held out of the fit."""
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    documents = documents.select("doc_id", "text")
    model = fit_toxicity(documents, labels, train=~held_out, **fit)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            s = np.array([float(m["v"][f].sum()) for f in indicators(b.column("text"), m["cost"], m["written"])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(linear.sigmoid(2 * (s + m["bias"])))],
                                             ["doc_id", "score"])

    return documents.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
