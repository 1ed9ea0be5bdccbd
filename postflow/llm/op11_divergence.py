"""Source divergence audit over the frequent terms of each language.

Iceberg prefix refinement finds the terms that stand in at least `least_docs`
documents of their language: prefixes of 4 bytes are counted first, then of 8, 16
and so on. A level counts, for each prefix whose shorter prefix was kept, the
distinct documents that hold a term with it; prefixes below the threshold go, as
no term that begins with them can reach it. A term not longer than the level is
complete and kept if its own documents suffice. Refinement ends at the level where
no prefix longer than itself is left, so there are about as many passes over the
texts as the longest frequent term has doublings. Kept prefixes reach the tasks as
one bitmap of `bits` bits, whatever their number: a prefix that meets a foreign bit
is counted once more in vain, and falls by its own exact count.

A last pass counts the kept terms by language and source, and two parts compare
the smoothed shares p = 1 + floor(10^9 (count + 1) / (N + V)) of a group with
those of each other source of its language (`pair`) and, term by term, with those
of the language (`term`); f = floor((p - q)^2 / q). Pairs are summed over blocks
of terms by sources of at most CELLS cells, so neither the terms of a language nor
all pairs of a term's sources meet in one place.

Defined results. Null text, lang and source count as ''; each row is a document of
its own, whatever its doc_id (so repeated rows count twice). A group without terms
or a language without kept terms: pairs of value 0, no terms. A language with one
source: no pairs. Equal values rank by the item's UTF-8 bytes. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm import textarrays as ta
from postflow.llm.common import materialize

FIRST = 4  # bytes of the first level's prefixes
BITS = 1 << 26
BLOCK = 4 << 20
CELLS = 1 << 20
UNIT = 1_000_000_000

# A term is a run of ASCII letters and of bytes beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_MASKS = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


def _chunks(buf: np.ndarray, start: np.ndarray, size: np.ndarray, upto: int) -> list[np.ndarray]:
    """The first `upto` bytes of spans as 64-bit numbers of eight bytes each, filled
    up with zeros (no term has a zero byte, so different bytes give different numbers)."""
    eights = np.lib.stride_tricks.sliding_window_view(buf, 8)
    out = []
    for at in range(0, upto, 8):
        left = np.clip(np.minimum(size, upto) - at, 0, 8)
        place = np.minimum(start + at, len(buf) - 8)
        out.append(np.ascontiguousarray(eights[place]).view(">u8")[:, 0].astype(np.uint64) & _MASKS[left])
    return out


def _slots(chunks: list[np.ndarray], seed: np.ndarray, bits: int) -> np.ndarray:
    """Place of each span in a bitmap."""
    h = ta.mix(seed)
    for c in chunks:
        h = np.where(c == 0, h, ta.mix(h ^ c))
    return (h % np.uint64(bits)).astype(np.int64)


def _held(bitmap: np.ndarray, chunks: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    slots = _slots(chunks, seed, 8 * len(bitmap))
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _blocks(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple]:
    """For blocks of whole texts: padded lower-case bytes, start and size of the terms,
    the text of each, each text's group and seed; texts come ordered by their keys,
    and `names` holds the keys of each group."""
    table = pa.table(batch.columns, batch.schema.names)
    names = table.select(keys).group_by(keys).aggregate([]).sort_by([(k, "ascending") for k in keys])
    place = {k: i for i, k in enumerate(zip(*(names[k].to_pylist() for k in keys), strict=True))}
    group = np.array([place[k] for k in zip(*(table[k].to_pylist() for k in keys), strict=True)], np.int64)
    seeds = np.array([zlib.crc32(x.encode()) for x in names["lang"].to_pylist()], np.uint64)
    order = np.argsort(group, kind="stable")
    texts, group = pc.take(table["text"].cast(pa.large_string()), pa.array(order)), group[order]
    for row, end, buf, offs in ta.blocks(texts, BLOCK):
        buf = ta.LOWER[buf]
        start, stop, doc = ta.words(buf, offs, _TERM)
        if len(start):
            yield np.concatenate([buf, np.zeros(8, np.uint8)]), start, stop - start, doc, group[row:end], seeds, names


def _runs(chunks: list[np.ndarray], doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal spans of one group together: (one of them, its group, documents, occurrences)."""
    order = np.lexsort(chunks[::-1])  # stable: texts, and so groups, stay in order
    doc = doc[order]
    other = np.ones(len(order), bool)
    other[1:] = group[doc[1:]] != group[doc[:-1]]
    for c in chunks:
        c = c[order]
        other[1:] |= c[1:] != c[:-1]
    fresh = other.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(other)
    return order[at], group[doc[at]], np.add.reduceat(fresh.astype(np.int64), at), np.diff(np.append(at, len(order)))


def _bytes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = buf[ta.ranges(start, size)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _level(length: int, prefixes, bits: int) -> Callable:
    """Documents of each term of at most `length` bytes (and over half of them, past the
    first level), and of each prefix of that length of longer ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buf, start, size, doc, group, seeds, names in _blocks(b, ["lang"]):
                if prefixes is not None:
                    on = np.flatnonzero(size > length // 2)
                    short = _chunks(buf, start[on], size[on], length // 2)
                    on = on[_held(prefixes.value, short, seeds[group[doc[on]]])]
                    start, size, doc = start[on], size[on], doc[on]
                for longer in (False, True):
                    on = np.flatnonzero((size > length) == longer)
                    if not len(on):
                        continue
                    chunks = _chunks(buf, start[on], size[on], length)
                    one, of, docs, _ = _runs(chunks, doc[on], group)
                    slot = _slots([c[one] for c in chunks], seeds[of], bits)
                    yield pa.RecordBatch.from_arrays(
                        [names["lang"].combine_chunks().take(pa.array(of)),
                         _bytes(buf, start[on][one], np.minimum(size[on][one], length)),
                         pa.array(np.full(len(one), longer)), pa.array(slot.astype(np.int32)), pa.array(docs)],
                        ["lang", "prefix", "longer", "slot", "docs"])

    return run


def _counts(kept) -> Callable:
    """Occurrences of kept terms by language and source (and of few others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buf, start, size, doc, group, seeds, names in _blocks(b, ["lang", "source"]):
                least, most = 0, 8
                while least < size.max():  # terms of about one length at a time
                    on = np.flatnonzero((size > least) & (size <= most))
                    chunks = _chunks(buf, start[on], size[on], most)
                    held = _held(kept.value, chunks, seeds[group[doc[on]]])
                    on, chunks = on[held], [c[held] for c in chunks]
                    if len(on):
                        one, of, _, n = _runs(chunks, doc[on], group)
                        of = pa.array(of)
                        yield pa.RecordBatch.from_arrays(
                            [names["lang"].combine_chunks().take(of), names["source"].combine_chunks().take(of),
                             _bytes(buf, start[on][one], size[on][one]), pa.array(n.astype(np.int64))],
                            ["lang", "source", "term", "n"])
                    least, most = most, 2 * most

    return run


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits of the rows' slots: bits / 8 bytes, however many rows there are."""
    got = (rows.select((F.col("slot").cast("long") + 1).alias("x"))
           .groupBy(F.bitmap_bucket_number("x").alias("bucket"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        at = (r["bucket"] - 1) * 4096
        out[at: at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(documents: DataFrame, least_docs: int = 3, bits: int = BITS) -> DataFrame:
    """lang, prefix (the whole term, binary), slot of the terms that at least
    `least_docs` documents of their language hold."""
    sc = documents.sparkSession.sparkContext
    texts = _plain(documents).select("lang", "text")
    length, prefixes, kept = FIRST, None, None
    while True:
        level = materialize(
            texts.mapInArrow(_level(length, prefixes, bits), "lang string, prefix binary, longer boolean, slot int, docs long")
            .groupBy("lang", "prefix", "longer").agg(F.max("slot").alias("slot"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= least_docs), f"terms-{length}")
        complete = level.filter(~F.col("longer")).select("lang", "prefix", "slot")
        kept = complete if kept is None else kept.unionByName(complete)
        longer = _bitmap(level.filter("longer"), bits)
        if not longer.any():
            return kept
        prefixes, length = sc.broadcast(longer), 2 * length


def _share(count: Column, mass: Column) -> Column:
    """1 + floor(10^9 (count + 1) / mass), exact for any long."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", whole, mass.cast("decimal(20,0)")) + 1


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of f over a block of terms, for each two sources of a language."""
    sources = sorted(groups["source"].to_pylist(), key=lambda s: s.encode())
    zero = dict(zip(groups["source"].to_pylist(), groups["p0"].to_pylist(), strict=True))
    place = {s: i for i, s in enumerate(sources)}
    n = len(sources)
    sums = np.zeros((n, n), np.int64)
    if terms.num_rows:
        at = pc.dictionary_encode(terms["term"].combine_chunks())
        p = np.tile(np.array([zero[s] for s in sources], np.int64)[:, None], (1, len(at.dictionary)))
        p[[place[s] for s in terms["source"].to_pylist()], at.indices.to_numpy()] = terms["p"].to_numpy()
        for i in range(n):
            d = p[i] - p
            sums[i] = (d * d // p).sum(axis=1)
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    names = pa.array(sources, pa.string())
    lang = groups["lang"].combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
    return pa.table([lang, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sums[i, j])],
                    ["lang", "source", "item", "value"])


def divergence(documents: DataFrame, least_docs: int = 3, top: int = 200, bits: int = BITS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its
    language, and its `top` terms above the language's share."""
    sc = documents.sparkSession.sparkContext
    kept = kept_terms(documents, least_docs, bits)
    held = sc.broadcast(_bitmap(kept, bits))
    same = Window.partitionBy("lang", "term")
    counts = materialize(
        _plain(documents).mapInArrow(_counts(held), "lang string, source string, term binary, n long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        .join(kept.select("lang", F.col("prefix").alias("term")), ["lang", "term"], "left_semi")
        .withColumn("all_n", F.sum("n").over(same)), "term-counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_lang = Window.partitionBy("lang")
    groups = materialize(
        _plain(documents).groupBy("lang", "source").agg(F.lit(0).alias("none"))
        .join(totals, ["lang", "source"], "left").join(terms_of, "lang", "left")
        .fillna(0, ["n", "v"])
        .withColumn("all_mass", F.sum("n").over(of_lang) + F.col("v"))
        .withColumn("mass", F.col("n") + F.col("v"))
        .withColumn("blocks", F.ceil(F.col("v") * F.count("*").over(of_lang) / F.lit(CELLS)).cast("int"))
        .withColumn("p0", F.when(F.col("mass") > 0, _share(F.lit(0), F.col("mass"))).otherwise(F.lit(1)))
        .select("lang", "source", "mass", "all_mass", "p0", F.greatest("blocks", F.lit(1)).alias("blocks")), "term-groups")

    rows = (counts.join(groups, ["lang", "source"])
            .withColumn("p", _share(F.col("n"), F.col("mass")))
            .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")))
    sides = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sums = (rows.select("lang", "block", "source", "term", "p").groupBy("lang", "block")
            .cogroup(sides.groupBy("lang", "block"))
            .applyInArrow(_pair_sums, "lang string, source string, item string, value long"))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    q = F.col("q")
    over = (rows.withColumn("q", _share(F.col("all_n"), F.col("all_mass")))
            .filter(F.col("p") > q)
            .select("lang", "source", F.col("term").cast("string").alias("item"), _excess(F.col("p"), q).alias("value"),
                    F.lit("term").alias("part")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(ranked)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("rank", rank).select(columns)
            .unionByName(over.withColumn("rank", rank).filter(F.col("rank") <= top).select(columns)))
