"""A small table of documents with every case the operators must take."""

import random
import re

from pyspark.sql import types as T

SPACE = "[^\x20\x09-\x0D]+"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ("n", "node", "key", "size", "score", "h", "at", "words", "label", "component", "kept", "_quality", "_taken")


def word_list(seed=1, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def texts(seed=2):
    """Unrelated, equal, nearly equal, null, empty, blank, periodic, short and long texts."""
    rng = random.Random(seed)
    vocab = word_list()
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 19, 20, 21, 60, 200]))] for _ in range(60)]
    out = [" ".join(w) for w in base]
    for i in range(0, 60, 4):  # copies with a few words changed, inserted or cut
        for _ in range(3):
            w = list(base[i])
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocab))
            out.append(" ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out += [f"{rng.choice(vocab)} {passage} {rng.choice(vocab)}\n{rng.choice(vocab)}" for _ in range(8)]
    out += [passage, passage, passage.upper(), out[0], out[4], out[4]]
    out += [None, "", " \t\n", None, "", "a", "a", "ab " * 90, "ab " * 91, "x" * 300, "x" * 301, "\x0b\x0ctab\tend",
            "Ünï çödé " * 30, "日本語 テキスト " * 20, "Ünï çödé " * 30 + "more", "1 2 3 !!! ???", "é", "nul \x00 byte"]
    out.append(" ".join(rng.choice(vocab) for _ in range(30_000)))  # one very long text
    return out


def rows(seed=3):
    t = texts()
    random.Random(seed).shuffle(t)
    return [(i * 3 + 1, x, ["en", "de", "fr", None][i % 4], [None, "s0", "s0", "s0", "é", "z"][i % 6], len(x or ""))
            for i, x in enumerate(t)]


def frame(spark, data, parts=5):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def with_clashes(df):
    """More columns, with names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})


def split(text, pattern=SPACE):
    return re.findall(pattern, text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})
