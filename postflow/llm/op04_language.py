"""Language identification by hierarchical discrimination.

First the language family is predicted (one linear support vector machine for
each family against the rest), then, within the family, one-versus-one linear
support vector machines vote on the language. Features are the shares of hashed
byte 1- to 3-grams of the whole text (A-Z lower-cased), so a text of any length
is one row of small numbers; texts are scored where they lie, without a shuffle.

The fit uses a bounded sample: at most `per_language` texts of each language,
chosen by a seeded hash of doc_id. Every language of the training rows is learned;
the machines are dealt over `max_tasks` tasks at most, each with the profiles of
the sample (bounded a language). FAMILIES is a parameter; a language it does not
list is a family of its own.

Defined results. Null text, or a text without a letter: `und`, score 0. Null
lang: not learned from. Nothing to learn from: every text is `und`. Votes that
tie go to the larger sum of margins. Repeated rows are each predicted alike.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm import common, linear
from postflow.llm import textarrays as ta

# Language codes of the larger European families.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

DIM = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 20.0
SLICE = 1 << 20  # places times machines that are summed at once


def _grams(buf: np.ndarray, order: int) -> np.ndarray:
    """Slot of the byte n-gram at each position of a block."""
    b = ta.LOWER[buf].astype(np.uint32)
    n = len(b) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.full(n, order, np.uint32)
    for i in range(order):
        key = (key << np.uint32(8)) | b[i: n + i]
    key = key * np.uint32(0x9E3779B1)
    return ((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.int64)


def _profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and scaled shares of a text's n-grams."""
    slots = np.concatenate([_grams(np.frombuffer(text, np.uint8), k) for k in ORDERS])
    f, n = np.unique(slots, return_counts=True)
    return f, SCALE * n / max(1, len(slots))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_profile(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array([f.astype(np.uint16).tobytes() for f, _ in got], pa.binary()),
             pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], ["doc_id", "label", "slots", "shares"])


def _machines(langs: list[str], family_of: dict) -> list[tuple[str, str, str]]:
    """(kind, a, b) of all machines: family a against the rest, or language a against b."""
    inside: dict[str, list[str]] = {}
    for x in sorted(langs):
        inside.setdefault(family_of.get(x, "=" + x), []).append(x)
    names = sorted(inside)
    return ([("family", g, "") for g in names if len(names) > 1]
            + [("pair", x, z) for g in names for i, x in enumerate(inside[g]) for z in inside[g][i + 1:]])


def _fit(machines: list, family_of: dict, tasks: int, seed: int, c: float, epochs: int):
    """Fits the machines of one task; a profile is held once for all of them."""
    def fit(t: pa.Table) -> pa.Table:
        got = sorted(zip(t["doc_id"].to_pylist(), t["label"].to_pylist(), t["slots"].to_pylist(), t["shares"].to_pylist(),
                         strict=True), key=lambda r: (r[0], r[1]))
        langs = np.array([r[1] for r in got], object)
        groups = np.array([family_of.get(x, "=" + x) for x in langs], object)
        slots = [np.frombuffer(r[2], np.uint16) for r in got]
        shares = [np.frombuffer(r[3], np.float32) for r in got]
        out = []
        for k in range(t["task"][0].as_py(), len(machines), tasks):
            kind, a, b = machines[k]
            at = np.arange(len(got)) if kind == "family" else np.flatnonzero((langs == a) | (langs == b))
            y = np.where((groups if kind == "family" else langs)[at] == a, 1, -1)
            w, bias = linear.fit_hinge([slots[i] for i in at], [shares[i] for i in at], y, DIM, c=c, epochs=epochs, seed=seed)
            out.append({"machine": k, "bias": float(bias), "w": (SCALE * w).astype(np.float32).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("machine", pa.int32()), ("bias", pa.float64()), ("w", pa.binary())]))

    return fit


def fit_languages(documents: DataFrame, train: Column | None = None, per_language: int = 400, families: dict | None = None,
                  seed: int = 4, c: float = 10.0, epochs: int = 15, max_tasks: int = 16) -> dict:
    families = FAMILIES if families is None else families
    family_of = {lang: name for name, langs in families.items() for lang in langs}
    rows = documents.filter("doc_id is not null and lang is not null and text is not null")
    if train is not None:
        rows = rows.filter(train)
    pick = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    sample = (rows.select("doc_id", "lang").distinct()
              .withColumn("_nth", F.row_number().over(pick)).filter(F.col("_nth") <= per_language)
              .select("doc_id", F.col("lang").alias("label")))
    texts = (documents.select("doc_id", F.col("lang").alias("label"), "text")
             .join(sample, ["doc_id", "label"])
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    profiles = common.materialize(
        texts.mapInArrow(_profiles, "doc_id long, label string, slots binary, shares binary"), "profiles")
    langs = [r["label"] for r in profiles.select("label").distinct().collect()]
    machines = _machines(langs, family_of)
    tasks = min(max_tasks, len(machines))
    got = []
    if machines:
        # the rows a task needs: all for a family, else those of its pairs
        needs = {(k % tasks, x) for k, (kind, a, b) in enumerate(machines) for x in (langs if kind == "family" else (a, b))}
        dealt = documents.sparkSession.createDataFrame(sorted(needs), "task int, label string")
        got = (profiles.join(F.broadcast(dealt), "label").groupBy("task")  # max_tasks rows a language at most
               .applyInArrow(_fit(machines, family_of, tasks, seed, c, epochs), "machine int, bias double, w binary").collect())
        got.sort(key=lambda r: r["machine"])
    names = sorted({family_of.get(x, "=" + x) for x in langs})
    n_family = sum(kind == "family" for kind, _, _ in machines)
    alone = {g: [x for x in langs if family_of.get(x, "=" + x) == g] for g in names}
    return {
        "w": np.stack([np.frombuffer(r["w"], np.float32) for r in got], axis=1) if got else np.zeros((DIM, 0), np.float32),
        "bias": np.array([r["bias"] for r in got]),
        "families": names,
        "n_family": n_family,
        "pairs": [(k, family_of.get(a, "=" + a), a, b) for k, (kind, a, b) in enumerate(machines) if kind == "pair"],
        "only": {g: own[0] for g, own in alone.items() if len(own) == 1},
    }


def _margins(texts: pa.Array, model: dict) -> np.ndarray:
    """A margin of each text for each machine: the mean weight of its n-grams."""
    w = model["w"]
    step = max(256, SLICE // max(1, w.shape[1]))
    out = np.zeros((len(texts), w.shape[1]))
    for row, end, buf, offs in ta.blocks(texts, 1 << 18):
        total = np.zeros((end - row, w.shape[1]))
        count = np.zeros(end - row)
        for order in ORDERS:
            n = max(0, len(buf) - order + 1)
            first = np.minimum(offs[:-1], n)
            last = np.maximum(first, np.minimum(offs[1:] - order + 1, n))
            count += last - first
            for at in range(0, n, step):
                to = min(at + step, n)
                run = np.zeros((to - at + 1, w.shape[1]))
                np.cumsum(w[_grams(buf[at: to + order - 1], order)], axis=0, dtype=np.float64, out=run[1:])
                # the texts with a place in this slice
                rows = slice(int(np.searchsorted(offs, at, side="right")) - 1, int(np.searchsorted(offs, to, side="left")))
                total[rows] += run[np.clip(last[rows], at, to) - at] - run[np.clip(first[rows], at, to) - at]
        out[row:end] = total / np.maximum(count, 1)[:, None]
    return out + model["bias"]


def _predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    if not model["families"]:
        return ["und"] * n, np.zeros(n)
    m = _margins(texts, model)
    best, sure = np.zeros(n, int), np.ones(n)
    if model["n_family"]:
        f = m[:, : model["n_family"]]
        best = f.argmax(axis=1)
        top2 = np.sort(f, axis=1)[:, -2:]
        sure = linear.sigmoid(top2[:, 1] - top2[:, 0])
    names, score = np.empty(n, object), np.zeros(n)
    for i, family in enumerate(model["families"]):
        rows = np.flatnonzero(best == i)
        if family in model["only"]:
            names[rows], score[rows] = model["only"][family], sure[rows]
            continue
        pairs = [p for p in model["pairs"] if p[1] == family]
        langs = sorted({x for p in pairs for x in p[2:]})
        votes = np.zeros((len(rows), len(langs)))
        sums = np.zeros((len(rows), len(langs)))
        for at, _, a, b in pairs:
            x = m[rows, at]
            for lang, side in ((a, x), (b, -x)):
                votes[:, langs.index(lang)] += side > 0
                sums[:, langs.index(lang)] += side
        win = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
        names[rows] = np.array(langs, object)[win]
        per = max(1, len(langs) - 1)
        score[rows] = sure[rows] * linear.sigmoid(2 * sums[np.arange(len(rows)), win] / per)
    return names.tolist(), score


def languages(documents: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Rows with
    crc32(doc_id) mod 5 = 0 are held out of the fit."""
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    model = fit_languages(documents.select("doc_id", "lang", "text"), train=~held_out, **fit)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = _predict(b.column("text"), held.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("letters"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "letters", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    scored = documents.select("doc_id", letters.alias("letters"), "text").mapInArrow(
        predict, "doc_id long, letters boolean, lang_pred string, score double")
    return scored.select(
        "doc_id", held_out.alias("held_out"),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))
