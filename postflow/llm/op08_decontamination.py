"""Benchmark decontamination: prefix-filtered join of item windows.

An item's windows are its runs of `width` consecutive words (an item of fewer
words is one window). A text holds a window only if it holds all its words, so
one word of the window, the rarest in the whole corpus, is a prefix that any
text with the window must hold too. The words of all texts are joined with these
prefix words; a hit at position p stands for a window that starts at p less the
word's offset, must lie within the text (length and position bounds), and is
then compared word by word with the text over the whole window.

The item side is broadcast only where it has at most `broadcast_rows` windows. Of
more windows, words are counted before they meet the vocabulary, and the join is a
shuffle on the word, where a text's word takes the width - 1 words on either side of
it along; only words that a bitmap of all prefix words (of fixed size) may hold are sent.

Defined results. Null or empty text: no words, no hits, the checksum of an empty
list. Items without words have no window. Repeated rows are each judged alike.
Repeated items: an item_id counts once. Null item_id: written as nothing, so it
is not listed, but its windows hit. Empty tables: no rows, or no hits. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import ascii_lower, bits_of, one_of

# What stands between words; a word is a run of anything else, once A-Z are lower.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BETWEEN_RAW = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _inner(pieces: Column) -> tuple[Column, Column]:
    """Place of the first word in the pieces of a split, and the number of words: a
    text that begins or ends between words has an empty first or last piece."""
    first, last = (F.coalesce(F.element_at(pieces, at) == "", F.lit(False)).cast("int") for at in (1, -1))
    return first + 1, F.greatest(F.size(pieces) - first - last, F.lit(0))


def with_word_count(df: DataFrame) -> DataFrame:
    """df with its `text` as `n_words`; capitals are told from what stands between words
    by another pattern, so no text is lower-cased for it."""
    pieces = F.split(F.coalesce("text", F.lit("")), BETWEEN_RAW)
    return (df.withColumn("text", pieces).withColumn("n_words", _inner(F.col("text"))[1].cast("long")).drop("text"))


def with_words(df: DataFrame) -> DataFrame:
    """df with its `text` as `words`, lower-cased; null has none."""
    pieces = F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN)
    start, n = _inner(F.col("words"))
    return df.withColumn("words", pieces).withColumn("words", F.slice("words", start, n))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and window (array of words) for each window of each item."""
    n = F.least(F.size("words"), F.lit(width))
    return (with_words(benchmark.select("item_id", "text")).filter("size(words) > 0")
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)))
            .select("item_id", F.slice("words", F.col("at"), n).alias("window")).distinct())


def row_key(documents: DataFrame) -> list[Column]:
    """k and t: what tells rows of different id or text apart."""
    return [F.coalesce(documents["doc_id"], F.lit(-(1 << 63))).alias("k"), F.xxhash64(documents["text"]).alias("t")]


def hit_texts(documents: DataFrame, benchmark: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """k, t, n_hit and items (sorted) of every text that holds a window."""
    docs = with_words(documents.select(*row_key(documents), "text")).drop("text")
    windows = (item_windows(benchmark, width).groupBy("window")
               .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    small = windows.count() <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)  # both joins give the same rows

    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    # outer: no test of the words is put before the scan, where it would split the text again
    written = docs.select(F.explode_outer("words").alias("word"))
    if small:
        written = written.join(side(vocabulary), "word")
    rarity = written.groupBy("word").agg(F.count("*").alias("n"))
    if not small:
        rarity = rarity.join(vocabulary, "word", "left_semi")
    # a window with a word that no text holds cannot occur: the inner join drops it
    prefix = (windows.select("window", F.posexplode("window").alias("offset", "word"))
              .join(rarity, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy("window").agg(F.min(F.struct("n", "word", "offset")).alias("p"))
              .filter("p.n > 0").select("window", "p.word", "p.offset")
              .join(side(windows), "window"))

    start = F.col("at") - F.col("offset")
    length = F.size("window")
    places = docs.select("k", "t", "words", F.size("words").alias("n"), F.lit(0).alias("from"),
                         F.posexplode_outer("words").alias("at", "word"))
    if not small:  # a row that is shuffled takes the words around it along, not the whole text
        bits = bits_of(prefix, F.col("word"))
        where, found = one_of(bits, F.col("word"))
        places = places.join(F.broadcast(bits), where).filter(found).drop("slot", "bits")
        first = F.greatest(F.col("at") - (width - 1), F.lit(0))
        places = places.withColumns({"from": first, "words": F.slice("words", first + 1, F.col("at") - first + width)})
    hits = (places.join(side(prefix), "word")
            .filter((start >= 0) & (start + length <= F.col("n")))
            .filter(F.slice("words", start - F.col("from") + 1, length) == F.col("window"))
            .select("k", "t", start.alias("lo"), (start + length).alias("hi"), "items"))
    per_text = hits.groupBy("k", "t").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"),
                                          F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["hi"]).alias("end"),
        (a["n"] + F.greatest(s["hi"] - F.greatest(a["end"], s["lo"]), F.lit(0))).alias("n")))["n"]
    return per_text.select("k", "t", covered.cast("long").alias("n_hit"),
                           F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10,
                  broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = hit_texts(documents, benchmark, width, broadcast_rows)
    out = (with_word_count(documents.select("doc_id", *row_key(documents), "text"))
           .join(found, ["k", "t"], "left"))
    hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 10,
                      broadcast_rows: int = 200_000) -> DataFrame:
    """The documents without a benchmark window, with all their columns; each row is
    judged by its own text, whatever rows share its doc_id."""
    found = hit_texts(documents, benchmark, width, broadcast_rows).filter("n_hit > 0").select("k", "t")
    k, t = row_key(documents)
    return documents.join(found.hint("shuffle_hash"), (k == found["k"]) & (t == found["t"]), "left_anti")
