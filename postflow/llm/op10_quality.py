"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (byte 3-grams, and 1- and 2-grams of word shapes, hashed
to DIM slots) are scaled by the log-count ratio of the two classes; a linear
hinge-loss model over the scaled, length-normalised rows is fitted by dual
coordinate descent. The fit uses a bounded sample: at most `per_class` labelled
rows of each class, chosen by a seeded hash of doc_id. Every whole text is
scored where it lies (one pass, no shuffle); the model (two arrays of DIM
floats) is all that is broadcast.

Defined results. Null or empty text: the score of a text without any n-gram.
Labels other than 0 and 1, null ids, and ids with both labels: not learned from.
Only one class (or none) to learn from: every score is 1.0, 0.0 or 0.5.
Repeated rows: each is scored. Empty table: no rows. Columns other than
doc_id and text are ignored by `quality_scores` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow.llm import common, linear
from postflow.llm import textarrays as ta

DIM = 1 << 17
_GRAMS = 1 << 16  # slots of byte 3-grams; the rest is for word shapes

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 4 digit, 8 other
_KIND[:] = 8
_KIND[ord("A"): ord("Z") + 1] = 1
_KIND[ord("a"): ord("z") + 1] = 2
_KIND[0x80:] = 2
_KIND[ord("0"): ord("9") + 1] = 4
_VALUES = ta.byte_values(11)
_HASH = ta.SpanHash(0xD6E8FEB86659FD93)


def _shapes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the shape 1-grams and 2-grams of a block, with each text's bounds."""
    start, end, doc = ta.words(buf, offs)
    bounds = ta.doc_bounds(doc, len(offs) - 1)
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return z, z, bounds
    kinds = np.bitwise_or.reduceat(_KIND[buf], start)
    # reduceat runs on to the next word's start: the blanks between are of kind 8
    gap = np.empty(len(start), bool)
    gap[:-1] = end[:-1] < start[1:]
    gap[-1] = end[-1] < len(buf)
    inner = np.bitwise_or.reduceat(np.where(ta.IS_WORD[buf], _KIND[buf], 0).astype(np.uint8), start)
    kinds = np.where(gap, inner, kinds)
    last = buf[end - 1]
    mark = np.where(_KIND[last] == 8, last, 0).astype(np.int64)
    twice = (end - start > 1) & (buf[np.maximum(end - 2, 0)] == last) & (mark > 0)
    h = _HASH.spans(_HASH.prefix(_VALUES[buf]), start, end)
    first = np.zeros(len(start), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    same = np.zeros(len(start), bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    size = np.minimum(end - start, 16) // 4
    shape = (((kinds.astype(np.int64) * 256 + mark) * 2 + twice) * 2 + same) * 8 + size
    prev = np.empty_like(shape)
    prev[0] = 0
    prev[1:] = shape[:-1]
    prev[first] = -1
    slots = np.uint64(DIM - _GRAMS)
    one = _GRAMS + (ta.mix(shape.astype(np.uint64) + np.uint64(1 << 40)) % slots).astype(np.int64)
    two = _GRAMS + (ta.mix(ta.mix(prev.astype(np.uint64)) + shape.astype(np.uint64)) % slots).astype(np.int64)
    return one, two, bounds


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct slots of every text, in row order."""
    place = np.zeros(DIM, np.int32)
    for row, end, buf, offs in ta.blocks(texts):
        b = buf.astype(np.uint32)
        grams = ((b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(16) if len(b) > 2 else b[:0]
        one, two, bounds = _shapes(buf, offs)
        for d in range(end - row):
            lo, hi = offs[d], max(offs[d], offs[d + 1] - 2)
            s, e = bounds[d], bounds[d + 1]
            f = np.concatenate([grams[lo:hi].astype(np.int64), one[s:e], two[s:e]])
            at = np.arange(len(f), dtype=np.int32)
            place[f] = at
            yield f[place[f] == at]


def _fit(seed: int, c: float, epochs: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, rows = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            ys += b.column("label").to_pylist()
            rows += [np.sort(f) for f in indicators(b.column("text"))]
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        y = np.array([1 if ys[i] == 1 else -1 for i in order])
        rows = [rows[i] for i in order]
        if not len(y) or len(set(y.tolist())) < 2:
            flat = 0.0 if not len(y) else 40.0 * y[0]
            v, r2, bias = np.zeros(DIM), np.zeros(DIM), flat
        else:
            r = linear.log_count_ratio(rows, y, DIM, min_rows=3)
            values = []
            for f in rows:
                x = r[f]
                values.append(x / (np.sqrt(x @ x) or 1.0))
            w, bias = linear.fit_hinge(rows, values, y, DIM, c=c, epochs=epochs, seed=seed)
            v, r2 = w * r, r * r
        yield pa.RecordBatch.from_pydict({
            "v": pa.array([v.astype(np.float32).tobytes()], pa.binary()),
            "r2": pa.array([r2.astype(np.float32).tobytes()], pa.binary()),
            "bias": pa.array([float(bias)]),
        })

    return fit


def fit_quality(documents: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 3000,
                seed: int = 10, c: float = 1.0, epochs: int = 12) -> dict:
    """The model, learned from at most `per_class` rows of each class of `labels`
    (doc_id, quality) for which `train` holds."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if train is not None:
        rows = rows.filter(train)
    rows = (rows.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
            .filter("label = _most").select("doc_id", "label"))
    sample = common.sample_per_class(rows, "label", per_class, seed, [0, 1])
    texts = (documents.select("doc_id", "text")
             .join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    got = texts.repartition(1).mapInArrow(_fit(seed, c, epochs), "v binary, r2 binary, bias double").collect()
    if not got:  # no partition, so no row
        return {"v": np.zeros(DIM, np.float32), "r2": np.zeros(DIM, np.float32), "bias": 0.0}
    return {"v": np.frombuffer(got[0]["v"], np.float32), "r2": np.frombuffer(got[0]["r2"], np.float32),
            "bias": got[0]["bias"]}


def _scores(texts: pa.Array, model: dict) -> np.ndarray:
    v, r2, bias = model["v"], model["r2"], model["bias"]
    out = np.empty(len(texts))
    for i, f in enumerate(indicators(texts)):
        norm = float(r2[f].sum()) ** 0.5
        out[i] = (float(v[f].sum()) / norm if norm > 0 else 0.0) + bias
    return linear.sigmoid(2.0 * out)


def with_score(df: DataFrame, model: dict, column: str) -> DataFrame:
    """All columns of df and the score of its `text`."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(b.column(b.schema.get_field_index("text")), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, column])

    schema = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])
    return df.mapInArrow(score, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Rows with
    crc32(doc_id) mod 3 = 1 are held out of the fit."""
    held_out = common.crc_mod(F.col("doc_id"), 3) == 1
    model = fit_quality(documents, labels, train=~held_out, **fit)
    scored = with_score(documents.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns."""
    column = "_quality"
    while column in documents.columns:
        column = "_" + column
    model = fit_quality(documents, labels, train=common.crc_mod(F.col("doc_id"), 3) != 1, **fit)
    return with_score(documents, model, column).filter(F.col(column) >= 0.5).drop(column)
