"""Mixing sources to target weights: capped water-filling.

Every source has a weight; together the targets are a share of all words. A
source is clamped at `epochs` times its size and the excess goes to the others
by weight until no target is above its cap. The fixpoint of that redistribution
is one level L with target = min(cap, weight * L); ordering the sources by
cap / weight, the sources up to some rank are clamped, and L follows from the
running sums, so one pass over the (small) table of sources finds it.

A source then takes each document floor(target / size) whole times, and of one
further repetition a seeded sample: documents in the order of a seeded hash,
until the rest of the target is reached; the last one is taken in part. So the
words taken are the target rounded down. `mix`, which writes the documents out,
takes that last one whole or not at all, whichever is nearer. The running sum over a source is
taken over BUCKETS hash buckets first and then within a bucket, so a source with
a third of all rows is dealt over all tasks.

Defined results. Null source: a source of its own, last in order. Null or empty
text: size 0, taken 0. A source without words: target 0. Repeated rows, and rows that
share a doc_id: each is a document; equal ones are interchangeable. Null doc_id: the
text stands for it in the order. Empty table: no rows. Other columns
are kept by `mix` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm.common import NO_ID, WORD_PATTERN, materialize

BUCKET_DIGITS = 3  # hex digits of the hash: 4096 buckets
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, share: float = 1.0, epochs: int = 3) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row
    for each source: weights 1, 2, 3 repeating in the order of the names."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), place + 1).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    # ascending cap / weight: the order in which a rising level clamps the sources
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumns({
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(onward),
        "words": (total.cast("double") * F.lit(share)),
    })
    # the level if this source and all after it are open; it holds from the first
    # source on whose cap is not below it
    level = (F.col("words") - F.col("clamped")) / F.col("open")
    rows = rows.withColumn("level", level).withColumn("fits", F.col("weight") * F.col("level") <= F.col("cap"))
    found = F.min(F.when(F.col("fits"), F.struct("clamped", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(found, F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def order_hash(seed: int) -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own))


def allot(documents: DataFrame, share: float = 1.0, epochs: int = 3, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (and `source` and the
    hash of its text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = materialize(
        documents.select("doc_id", "source", size.alias("size"), order_hash(seed).alias("turn"),
                         F.xxhash64("text").alias("text_hash"))
        .withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS)), "sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, epochs)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (buckets.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
              .withColumnRenamed("source", "of").withColumnRenamed("bucket", "in_bucket")
              .join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("source"))
    inside = (Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, (F.col("bucket") == F.col("in_bucket")) & F.col("source").eqNullSafe(F.col("of")))
    goal = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole).withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    part = F.least(F.greatest(F.col("rest") - F.col("start") - F.col("inner"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target",
                       (F.col("whole") * F.col("size") + part).alias("taken"))


def mix(documents: DataFrame, share: float = 1.0, epochs: int = 3, seed: int = 5) -> DataFrame:
    """The mix itself: every document as often as it is taken, whole, with all its columns."""
    mark = "_mix"
    while any(c.startswith(mark) for c in documents.columns):
        mark = "_" + mark
    key = [mark + c for c in "ist"]  # never null, so that rank and join share one shuffle

    def keyed(df: DataFrame, text_hash: Column) -> DataFrame:
        return df.withColumns(dict(zip(key, (
            F.coalesce("doc_id", F.lit(NO_ID)), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), text_hash), strict=True)))

    # of m equal rows some are taken `least` times, and `more` of them once more
    plan = (keyed(allot(documents, share, epochs, seed).filter("size > 0"), F.col("text_hash"))
            .withColumn("times", F.expr("(2 * taken + size) div (2 * size)"))
            .groupBy(key).agg(F.min("times").alias(mark + "least"), F.sum("times").alias("times"), F.count("*").alias("m"))
            .filter("times > 0")
            .select(*key, mark + "least", (F.col("times") - F.col("m") * F.col(mark + "least")).alias(mark + "more")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(key[0]))
    rows = keyed(documents, F.xxhash64("text")).withColumn(mark + "rank", rank).join(plan.hint("shuffle_hash"), key)
    times = F.col(mark + "least") + (F.col(mark + "rank") <= F.col(mark + "more")).cast("int")
    return (rows.withColumn(mark + "times", times.cast("int")).filter(F.col(mark + "times") > 0)
            .withColumn(mark + "nth", F.explode(F.sequence(F.lit(1), F.col(mark + "times")))).select(*documents.columns))
