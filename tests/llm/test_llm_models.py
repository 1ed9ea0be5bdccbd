"""Classifiers on held-out rows, deobfuscation, and their edge cases."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, with_clashes, word_list
from pyspark.sql import functions as F

from postflow.llm import linear, op04_language, op09_toxicity, op10_quality
from postflow.llm import textarrays as ta

LABELS = "doc_id long, quality int, toxic int"


def sentences(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n)) + "."


def quality_table(spark):
    rng, vocab = random.Random(4), word_list(4)
    data, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        t = sentences(rng, vocab, rng.randint(5, 80))
        if not good:
            t = [t.upper().replace(" ", "!! "), " | ".join(t.split()), " ".join([t.split()[0]] * 40)][i % 9 // 3]
        data.append((i, t, None, None, 0))
        labels.append((i, int(good), 0))
    return frame(spark, data), spark.createDataFrame(labels, LABELS)


def test_quality_held_out(spark):
    docs, labels = quality_table(spark)
    got = op10_quality.quality_scores(with_clashes(docs), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = quality_table(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, op10_quality.quality_scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_keep_good_keeps_columns(spark):
    docs, labels = quality_table(spark)
    docs = docs.withColumn("_quality", F.lit(1))
    out = op10_quality.keep_good(docs, labels)
    assert out.columns == docs.columns
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len({r.doc_id for r in out.collect()} ^ good) <= 10


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "!!! 123"), (5, "x" * 200_000), (6, "a b " * 50_000), (7, "é"), (7, "é"), (None, "text")]


@pytest.mark.parametrize("labelled", [[], [(2, 1, 1)], [(2, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (7, 2, 5)]])
def test_scores_of_edge_cases(spark, labelled):
    docs = frame(spark, [(i, t, None, None, 0) for i, t in EDGES])
    labels = spark.createDataFrame(labelled, LABELS)
    for run in (op10_quality.quality_scores, op09_toxicity.toxicity_scores):
        rows = run(docs, labels).collect()
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _ in EDGES)
        assert all(0 <= r.score <= 1 for r in rows)
        empty = {r.score for r in rows if r.doc_id in (1, 2)}
        assert len(empty) == 1  # null counts as empty


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], LABELS)
    assert op10_quality.quality_scores(docs, labels).isEmpty()
    assert op09_toxicity.toxicity_scores(docs, labels).isEmpty()
    assert op04_language.languages(docs).isEmpty()
    assert op10_quality.keep_good(docs, labels).isEmpty()


# -- toxicity --------------------------------------------------------------------

BAD = ["moron", "idiot", "worthless"]


def toxic_table(spark):
    rng, vocab = random.Random(6), word_list(6)
    data, labels = [], []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        data.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, int(i % 3 == 0)))
    return data, frame(spark, data), spark.createDataFrame(labels, LABELS)


def test_toxicity_held_out_and_disguised(spark):
    data, docs, labels = toxic_table(spark)
    rows = op09_toxicity.toxicity_scores(with_clashes(docs), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 30 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    # the same words written otherwise, in new texts
    clean = data[1][1]
    disguised = ["m0r0n", "1d10t", "w0rthl3ss", "m o r o n", "mooooron", "id.i.ot", "worth-less", "!diot"]
    more = [(1000 + i, f"{clean} {w} {w} {w}", None, None, 0) for i, w in enumerate(disguised)] + [(2000, clean, None, None, 0)]
    both = docs.unionByName(frame(spark, more))
    got = {r.doc_id: r.predicted for r in op09_toxicity.toxicity_scores(both, labels).collect()}
    assert sum(got[1000 + i] for i in range(len(disguised))) >= len(disguised) - 1, got
    assert got[2000] == 0


def test_decoding_leaves_plain_words_alone():
    cost = np.full((28, 28, 28), 3.0, np.float32)
    t = pa.array(["plain words, as they are. Même là", "", None])
    out = [buf.tobytes() for _, buf, _ in op09_toxicity.restored(t, cost)]
    assert b"".join(out).decode() == "plain words, as they are. Même là".lower().replace("Ê", "ê")


def test_restored_offsets_follow_the_texts(spark):
    cost = op09_toxicity.language_model(frame(spark, [(i, "moron something else book here", None, None, 0) for i in range(20)]))
    t = pa.array(["m0r0n here", None, "s o m e t h i n g else", "b00000k"])
    for n, buf, offs in op09_toxicity.restored(t, cost):
        parts = [buf[offs[i]: offs[i + 1]].tobytes().decode() for i in range(n)]
    assert parts[:3] == ["moron here", "", "something else"] and parts[3] in ("book", "bok")


def test_disguises_against_tokens_as_written(spark):
    """Words of marks alone, ending in marks, spaced with marks, or with a doubled
    letter are read; numbers and punctuation stay."""
    line = "the ass of an idiot is a stupid shit, and 1990 or 455 or 2,000 is a number! go on (at 10%) to 3 4 5 6 *"
    models = op09_toxicity.language_models(frame(spark, [(i, line, None, None, 0) for i in range(40)]))
    cases = {"@$$": "ass", "@$$.": "ass.", "shi+": "shit", "shi+,": "shit,", "i d 1 0 t": "idiot", "stuupid": "stupid", "1 d 1 0 t": "idiot",
             "s h i t 4 5": "shit 4 5"}
    cases |= dict.fromkeys(["455", "1990", "2,000", "number!", "3 4 5 6", "*", "- - - -", "is a 3 4 5", "go on"])
    out = [x for x in op09_toxicity.restored(pa.array([f"the {x}" for x in cases]), *models)]
    got = [buf[a:b].tobytes().decode() for _, buf, offs in out for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == [f"the {y or x}" for x, y in cases.items()]


def test_language_model_counts_all_texts(spark):
    docs = frame(spark, [(i, "abab", None, None, 0) for i in range(50)] + [(99, None, None, None, 0)])
    cost = op09_toxicity.language_model(docs)
    assert cost.shape == (28, 28, 28) and cost[1, 2, 1] < 0.8 < cost[1, 2, 3]


# -- language --------------------------------------------------------------------

WORDS = {"en": "the and of that with from this are was", "de": "der die und das nicht mit für sich über",
         "fr": "les des une dans qui pour avec être où", "es": "los que una con para por más como año", "xx": "zuk zak zok zik"}


def test_languages_held_out(spark):
    rng = random.Random(8)
    data = [(i, sentences(rng, WORDS[lang].split(), rng.randint(8, 60)), lang, "s", 0)
            for i, lang in enumerate(list(WORDS) * 40)]
    data += [(900, None, "en", None, 0), (901, "", "en", None, 0), (902, "12 !!", "de", None, 0), (903, "le là les", None, None, 0)]
    got = {r.doc_id: r for r in op04_language.languages(with_clashes(frame(spark, data))).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in data[:200] if got[i].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred in WORDS and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "de"], ["en", "fr"]])
def test_few_languages(spark, langs):
    rng = random.Random(9)
    data = [(i, sentences(rng, WORDS[x].split(), 20), x, None, 0) for i, x in enumerate(langs * 20)] + [(500, "some text", None, None, 0)]
    rows = op04_language.languages(frame(spark, data)).collect()
    assert {r.lang_pred for r in rows} <= (set(langs) or {"und"})
    assert all(r.lang_pred == x for r, x in zip(sorted(rows, key=lambda r: r.doc_id), langs * 20))


def test_margins_of_a_long_text_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(3)
    model = {"w": rng.normal(size=(op04_language.DIM, 30)).astype(np.float32), "bias": np.zeros(30)}
    texts = pa.array(["", "ab", None, "a text", "x" * 700 + " y" * 300, "c", "words and more words " * 40])
    got = op04_language._margins(texts, model)
    for t, m in zip(texts.to_pylist(), got, strict=True):
        b = np.frombuffer((t or "").encode(), np.uint8)
        slots = np.concatenate([op04_language._grams(b, k) for k in op04_language.ORDERS])
        assert np.allclose(m, model["w"][slots].astype(float).mean(axis=0) if len(slots) else 0.0)
    monkeypatch.setattr(op04_language, "SLICE", 1)
    assert np.allclose(op04_language._margins(texts, model), got)
    monkeypatch.undo()
    tracemalloc.start()
    op04_language._margins(pa.array(["some words " * 100_000]), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_more_languages_than_64(spark):
    rng = random.Random(10)
    langs = [f"l{i:02}" for i in range(68)] + ["en", "de"]
    own = {x: ["".join(rng.choice(chr(97 + i % 26) + chr(97 + i // 26) + "xyz") for _ in range(5)) for _ in range(9)] for i, x in enumerate(langs)}
    data = [(i, sentences(rng, own[x], 30), x, None, 0) for i, x in enumerate(langs * 6)]
    got = {r.doc_id: r.lang_pred for r in op04_language.languages(frame(spark, data)).collect()}
    assert set(got.values()) == set(langs)
    assert np.mean([got[i] == x for i, x in enumerate(langs * 6)]) > 0.97


# -- the common parts --------------------------------------------------------------

def test_hinge_fit_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    w, b = linear.fit_hinge([np.arange(5)] * 200, list(x), y, 5, c=10, epochs=50)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97


def test_blocks_and_words():
    t = ["one two", None, "", " three\x0bfour ", "fünf"]
    for limit in (1, 5, 1000):
        got = []
        for row, end, buf, offs in ta.blocks(pa.array(t), limit):
            s, e, doc = ta.words(buf, offs)
            got += [(row + d, buf[a:b].tobytes().decode()) for a, b, d in zip(s, e, doc, strict=True)]
        assert got == [(0, "one"), (0, "two"), (3, "three"), (3, "four"), (4, "fünf")]


def test_span_hashes_do_not_depend_on_the_place():
    h = ta.SpanHash(12345)
    v = ta.byte_values(1)[np.frombuffer(b"xxabcabcyyabc" * 400, np.uint8)]
    p = h.prefix(v)
    at = np.array([2, 5, 10, 13 * 399 + 10])
    assert len(set(h.spans(p, at, at + 3).tolist())) == 1
    assert len(set(h.spans(p, np.array([2, 2, 3]), np.array([5, 4, 6])).tolist())) == 3


def test_long_tokens_take_linear_time_and_no_other_reading(spark, monkeypatch):
    lines = ["moron something else book here 12 x3 4 5!", "o 1 l0st 77 way", "s3v3n of 9", "2 2 2 2"]
    models = op09_toxicity.language_models(frame(spark, [(i, lines[i % 4], None, None, 0) for i in range(40)]))
    rng = random.Random(3)
    tokens = ["".join(rng.choice(kind) for _ in range(rng.randint(250, 500))) for kind in ("0123456789", "ab01$!", "m0r*n.") * 6]
    read = lambda: [buf.tobytes() for _, buf, _ in op09_toxicity.restored(pa.array(tokens), *models)]
    fast = read()
    monkeypatch.setattr(op09_toxicity, "LONG", 1 << 40)  # every state is carried along
    assert read() == fast
    monkeypatch.undo()
    steps = 0

    class Counted(op09_toxicity._Leads):
        def of(self, *states):
            nonlocal steps
            steps += 1
            return super().of(*states)

    monkeypatch.setattr(op09_toxicity, "_Leads", Counted)
    sizes = []
    for n in (5_000, 20_000):
        steps = 0
        list(op09_toxicity.restored(pa.array(["1234567890" * (n // 10)]), *models))
        sizes.append(steps)
    assert 3 < sizes[1] / sizes[0] < 5
