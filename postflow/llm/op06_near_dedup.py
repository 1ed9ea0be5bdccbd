"""MinHash near-dedup: HyperMinHash sketches, banding, exact verification.

1. Sketch. Each distinct k-word shingle is hashed to 64 bits. The first 8 bits
   name one of 256 buckets; of the smallest remainder in a bucket the register
   stores the count of leading zeros and 10 mantissa bits (0: empty). Sets too
   small to fill the buckets (up to SMALL shingles) get a bucket for each of 255
   multipliers instead, each over the whole set, in the same code; sets of up to
   SMALL / 0.8 shingles carry both, so any two similar sets share a kind.
2. Classes. Documents with one shingle set (equal 128-bit set fingerprint) form
   a class, which is a node of all that follows; one row's text stands for it.
   Copies are never expanded.
3. Bands. 51 bands of 5 registers; two classes with one band in common are
   candidates. At a similarity of 0.8 a pair shares no band with probability
   (1 - 0.8**5)**51, about 2e-9 (less for small sets).
4. One member of each bucket is compared with all others; that settles most.
   Buckets that still hold several components are put together to areas that
   share none, and the rest is joined by differences: against one reference set R
   of an area, D(u) is the symmetric difference of u and R. Two sets differ as their
   D do, so similar pairs are pairs whose D overlap enough, found by an exact
   prefix-filtered join (rarest differences first, with length and position
   bounds). Pairs that are similar whatever their overlap need no join: all of
   them are similar to the one set of least difference. So a large group of near
   copies, or of texts that share one common passage, costs a few rows a member,
   and no link that could join two components is lost.
5. Each pair is estimated from the registers (corrected for chance collisions);
   only pairs more than six standard deviations below the threshold are dropped.
   The rest is confirmed on the full sets: 100 * both >= percent * either.
6. Components of the confirmed links; their smallest doc_id stays.

Shingles are compared by 64-bit hash: two of one pair's sets collide with a
probability of about 1e-13.

Defined results. Null, empty or blank text: no shingles, linked with nothing,
kept. Fewer than k words: the whole sequence is the one shingle. Repeated rows
are one class; texts that share a doc_id are each judged by their own shingles.
Rows with a null doc_id take part in classes and links as any other; a component
of nothing else has a null component_id and its rows are kept. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm import textarrays as ta
from postflow.llm.common import WORD_PATTERN, materialize
from postflow.llm.components import components

REGISTERS = 256
BANDS, ROWS = 51, 5
MANTISSA = 10
SMALL = 512

_VALUES = ta.byte_values(6)
_BYTES = ta.SpanHash(0x9E3779B97F4A7C15)
_WORDS = ta.SpanHash(0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = (ta.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1))[:, None]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in row order."""
    for row, end, buf, offs in ta.blocks(texts):
        buf = ta.LOWER[buf]
        s, e, doc = ta.words(buf, offs)
        bounds = ta.doc_bounds(doc, end - row)
        run = _WORDS.prefix(_BYTES.spans(_BYTES.prefix(_VALUES[buf]), s, e))
        count = np.diff(bounds)
        n = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
        at = ta.ranges(bounds[:-1], n)
        last = np.repeat(bounds[1:], n)
        h = _WORDS.spans(run, at, np.minimum(at + k, last))
        cut = np.concatenate([[0], np.cumsum(n)])
        for d in range(end - row):
            yield np.unique(h[cut[d]: cut[d + 1]])


def _code(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each smallest hash, as one number over 0."""
    least = least | np.uint64(0xFF)
    zeros = 63 - np.minimum(np.log2(least.astype(np.float64)).astype(np.int64), 63)
    # log2 of a value just below a power of two rounds up to it
    zeros += (least << zeros.astype(np.uint64)) < np.uint64(1 << 63)
    body = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (1 + (np.minimum(zeros, 55) << MANTISSA) + body.astype(np.int64)).astype(np.uint16)


def registers(u: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct 64-bit hashes, one bucket each."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(u):
        bucket = (u >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        out[bucket[first]] = _code(u[first] << np.uint64(8))
    return out


def small_registers(u: np.ndarray) -> np.ndarray:
    """The same for a small set: all its hashes take part in every bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(u):
        out[: BANDS * ROWS] = _code((u[None, :] * _MULTIPLIERS).min(axis=1))
    return out


def _fingerprint(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set, the same in any order."""
    c1 = ta.mix(u + np.uint64(1)).sum(dtype=np.uint64)
    c2 = ta.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(c1.astype(np.int64)), int(c2.astype(np.int64))


def row_key(documents: DataFrame) -> list[Column]:
    """k and t: what tells rows of different id or text apart (128 bits of the text
    where the id is null)."""
    return [F.coalesce(documents["doc_id"], F.xxhash64(F.lit(6), documents["text"])).alias("k"),
            F.xxhash64(documents["text"]).alias("t")]


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c1, c2, regs, small = [], [], [], [], []
            for u in shingle_sets(b.column("text"), k):
                n.append(len(u))
                a, c = _fingerprint(u)
                c1.append(a)
                c2.append(c)
                regs.append(registers(u).tobytes() if len(u) > SMALL else None)
                small.append(small_registers(u).tobytes() if 0 < len(u) <= SMALL * 5 // 4 else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), b.column("t"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(regs, pa.binary()), pa.array(small, pa.binary())],
                ["doc_id", "k", "t", "n", "c1", "c2", "regs", "small"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, at, done = [], [], set()
            rows = zip(*(b.column(x).to_pylist() for x in ("node", "c1", "c2")), strict=True)
            for i, ((node, *of), u) in enumerate(zip(rows, shingle_sets(b.column("text"), k), strict=True)):
                # copies without an id meet the same node; so might a text of equal hash
                if node not in done and _fingerprint(u) == tuple(of):
                    done.add(node)
                    at.append(i)
                    sets.append(u)
            cut = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(at, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.view(np.int64)))],
                ["node", "shingles"])
    return run


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, less the share of equal
    registers expected from different minima, and the registers compared.
    n_a and n_b: hashes in a bucket on average."""
    used = (regs_a > 0) | (regs_b > 0)
    m = np.maximum(used.sum(axis=1), 1)
    equal = ((regs_a == regs_b) & used).sum(axis=1)
    edges = 2.0 ** -np.arange(57)
    chance = np.zeros(len(n_a))
    for hi, lo in zip(edges[:-1], edges[1:], strict=True):  # by count of leading zeros
        pa_, pb_ = (np.exp(-n * lo) - np.exp(-n * hi) for n in (n_a, n_b))
        chance += pa_ * pb_ / (1 << MANTISSA)
    chance = np.minimum(chance, 0.5)
    return np.clip((equal / m - chance) / (1 - chance), 0, 1), m


def _likely(percent: int):
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                    for x in ("regs_a", "regs_b"))
            over = np.where(b.column("dense").to_numpy(zero_copy_only=False), 1.0, REGISTERS)
            est, m = estimate(a, c, b.column("n_a").to_numpy() / over, b.column("n_b").to_numpy() / over)
            ok = est >= t - 6 * np.sqrt(t * (1 - t) / m) - 1 / m
            yield b.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok))
    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: reps.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in reps.columns])
    dense = F.col("small_a").isNotNull() & F.col("small_b").isNotNull()
    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent)
            .select("a", "b", "n_a", "n_b", dense.alias("dense"), *[
                F.when(dense, F.col(f"small_{x}")).otherwise(F.col(f"regs_{x}")).alias(f"regs_{x}") for x in "ab"])
            .mapInArrow(_likely(percent), "a long, b long, n_a long, n_b long"))
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (near.join(full("a"), "a").join(full("b"), "b").withColumn("both", both)
            .filter(F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
            .select("a", "b"))


def _connected(reps: DataFrame, classes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all classes with links."""
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("of", 2 * ROWS * i + 1, 2 * ROWS).alias("r"))
                      for i in range(BANDS)])
    empty = F.lit(bytes(2 * ROWS))
    kinds = (reps.filter("regs is not null").select("node", F.lit(0).alias("kind"), F.col("regs").alias("of"))
             .unionByName(reps.filter("small is not null")
                          .select("node", F.lit(1).alias("kind"), F.col("small").alias("of"))))
    in_band = (kinds.select("node", "kind", F.explode(bands).alias("x")).filter(F.col("x.r") != empty)
               .select("node", F.xxhash64("kind", "x.i", "x.r").alias("bucket")))
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    members = materialize(in_band.join(shared, "bucket"), "buckets")

    nodes = members.select("node").distinct().join(classes, "node").select("node", "c1", "c2", "first.k", "first.t")
    texts = (documents.select(*row_key(documents), "text").join(nodes.hint("shuffle_hash"), ["k", "t"])
             .select("node", "c1", "c2", "text"))
    sets = materialize(texts.mapInArrow(_sets(k), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    pairs = members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = materialize(pairs, "pairs")
    links = materialize(_confirmed(tried, reps, sets, percent), "confirmed")

    labels = materialize(components(links), "labels")
    more = _by_difference(members, labels, tried, reps, sets, percent)
    if more is None:
        return labels
    more = materialize(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = materialize(_confirmed(more, reps, sets, percent), "confirmed")
    return labels if found.isEmpty() else components(links.unionByName(found))


def _by_difference(members: DataFrame, labels: DataFrame, tried: DataFrame, reps: DataFrame, sets: DataFrame,
                   percent: int) -> DataFrame | None:
    """Pairs (a, b) of different components to be compared still; None: no bucket holds two.

    With S the sum of two sizes and D the size of their symmetric difference, a pair
    is similar if (100 + percent) D <= (100 - percent) S. Let w = (100 + percent) *
    |difference to the reference| - (100 - percent) * size for each set: the pair is
    similar if its differences have (w + w') / (2 (100 + percent)) in common.
    """
    plus, minus = 100 + percent, 100 - percent
    named = (members.filter("size > 2").select("bucket", "node").join(labels, "node", "left")
             .select("bucket", "node", F.coalesce("component", "node").alias("component")))
    mixed = (named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo != hi").select("bucket", "lo"))
    left = materialize(named.join(mixed, "bucket").select("node", "component", "lo").distinct(), "open")
    if left.isEmpty():
        return None
    areas = components(left.filter("component != lo").select(F.col("lo").alias("a"), F.col("component").alias("b")).distinct())
    areas = areas.select(F.col("node").alias("component"), F.col("component").alias("area"))
    nodes = materialize(left.select("node", "component").distinct().join(areas, "component")
                        .join(reps.select("node", "n"), "node"), "areas")
    # the reference of an area: the set compared with most others so far
    degree = tried.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    reference = (nodes.join(degree, "node").groupBy("area")
                 .agg(F.max(F.struct("degree", "node"))["node"].alias("ref")))
    refs = reference.join(sets, reference.ref == sets.node).select("area", F.col("shingles").alias("of_ref"))
    # a shingle the reference lacks stands for itself, one it has too many for its complement
    delta = F.concat(F.array_except("shingles", "of_ref"),
                     F.transform(F.array_except("of_ref", "shingles"), lambda x: F.bitwise_not(x)))
    rows = (nodes.join(sets, "node").join(refs, "area")
            .select("area", "node", "component", "n", delta.alias("delta"))
            .withColumn("size", F.size("delta").cast("long"))
            .withColumn("w", plus * F.col("size") - minus * F.col("n")))
    rows = materialize(rows, "differences")
    least = rows.groupBy("area").agg(F.min(F.struct("w", "node")).alias("m")).select(
        "area", F.col("m.w").alias("w0"), F.col("m.node").alias("node0"))
    star = (rows.select("area", "node", "w").join(least, "area").filter("w + w0 <= 0 and node != node0")
            .select(F.least("node", "node0").alias("a"), F.greatest("node", "node0").alias("b")))

    tokens = rows.select("area", "node", "component", "size", "w", F.explode("delta").alias("token"))
    shared = tokens.groupBy("area", "token").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = Window.partitionBy("area", "node")
    # a difference of one set alone meets none; such come first in every order
    at = F.col("size") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("df", "token"))
    placed = tokens.join(shared, ["area", "token"]).withColumn("at", at).join(least.drop("node0"), "area")
    # read twice: written once, the join of both ends is a small plan
    placed = materialize(placed.drop("df"), "placed")
    needs = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(2 * plus)))
    index = placed.filter(F.col("at") <= F.col("size") - needs(2 * F.col("w")) + 1)
    probe = placed.filter(F.col("at") <= F.col("size") - needs(F.col("w") + F.col("w0")) + 1)
    side = lambda df, x: df.select("area", "token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "size", "w", "at")])
    met = side(index, "i").join(side(probe, "p"), ["area", "token"]).filter(
        (F.struct("w_i", "node_i") < F.struct("w_p", "node_p")) & (F.col("component_i") != F.col("component_p"))
        & (F.ceil((F.col("w_i") + F.col("w_p")) / F.lit(2 * plus))
           <= 1 + F.least(F.col("size_i") - F.col("at_i"), F.col("size_p") - F.col("at_p"))))
    pairs = met.select(F.least("node_i", "node_p").alias("a"), F.greatest("node_i", "node_p").alias("b"))
    return pairs.unionByName(star).distinct()


def _judged(documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and c1, c2, first and component of every class; `first`
    is its row of smallest doc_id (null last), `component` a node of the classes."""
    sketches = materialize(
        documents.select("doc_id", *row_key(documents), "text").mapInArrow(
            _sketch(words), "doc_id long, k long, t long, n long, c1 long, c2 long, regs binary, small binary"),
        "sketches")
    some = sketches.filter("n > 0")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "k", "t"))
    # written once, so the numbers hold; no two classes share one
    classes = materialize(some.groupBy("c1", "c2").agg(first.alias("first"), F.max("n").alias("n"))
                          .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = materialize(
        some.select("k", "t", "c1", "c2", "regs", "small")
        .join(classes.select("node", "c1", "c2", "n", "first.k", "first.t"), ["k", "t", "c1", "c2"])
        .dropDuplicates(["node"]).select("node", "n", "regs", "small"), "reps")
    labels = _connected(reps, classes, documents, words, percent)
    return sketches, classes.join(labels, "node", "left").select(
        "c1", "c2", "first", F.coalesce("component", "node").alias("component"))


def _firsts(classes: DataFrame) -> DataFrame:
    """The row of smallest doc_id (null last) of every component."""
    return classes.groupBy("component").agg(F.min("first").alias("first"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document: links are
    pairs whose sets of `words`-word shingles have a Jaccard similarity of at
    least `percent` hundredths."""
    sketches, classes = _judged(documents.select("doc_id", "text"), words, percent)
    ids = _firsts(classes).select("component", F.when(~F.col("first.no_id"), F.col("first.k")).alias("component_id"))
    named = classes.select("c1", "c2", "component").join(ids, "component").select("c1", "c2", "component_id")
    out = sketches.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays, with all its columns: one of its smallest
    doc_id, or of no id where none has one. Texts without words stay as they are."""
    _, classes = _judged(documents.select("doc_id", "text"), words, percent)
    kept = _firsts(classes).select("first.k", "first.t")
    has_words = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    k, t = "_k", "_t"
    while k in documents.columns or t in documents.columns:
        k, t = "_" + k, "_" + t
    # a task sends one of the rows equal in id and text; the join needs no other shuffle
    rows = (documents.filter(has_words).withColumns(dict(zip((k, t), row_key(documents), strict=True)))
            .dropDuplicates([k, t]))
    rows = rows.join(kept.hint("shuffle_hash"), (rows[k] == kept["k"]) & (rows[t] == kept["t"]), "left_semi")
    return rows.select(*documents.columns).unionByName(documents.filter(~has_words))
