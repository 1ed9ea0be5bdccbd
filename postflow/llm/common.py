"""Helpers shared by the operators: shared folder, row keys, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words in the sense of the contracts: maximal runs without space, \t, \n, \x0B, \f, \r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session, or,
    where that is unset (local tests), a folder below the SQL warehouse."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later passes read the same rows.
    The table stays until the folder is cleared, as the result may still read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, all other characters as they are. (On text without any
    other character `lower` does just that, at a fraction of the cost.)"""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


NO_ID = -(1 << 63)  # stands for a null doc_id: the smallest
BITS = 1 << 26


def one_of(bits: DataFrame, value: Column) -> tuple[Column, Column]:
    """Join condition and test of a value against `bits_of` some values: false only
    where it is none of them."""
    bit = F.pmod(F.xxhash64(value), F.lit(BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return bits["slot"] == F.floor(bit / 64), F.coalesce(bits["bits"].bitwiseAND(one) != 0, F.lit(False))


def bits_of(values: DataFrame, value: Column) -> DataFrame:
    """A bitmap of a column of values, 64 bits a row: at most BITS / 64 rows (so it can be
    broadcast), however many values there are."""
    bit = F.pmod(F.xxhash64(value), F.lit(BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return (values.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("slot"))
            .agg(F.bit_or(one).alias("bits")))


def told_apart(documents: DataFrame) -> DataFrame:
    """key, tag, text of every document: key is its doc_id (NO_ID for null), tag tells rows
    of one doc_id apart: 64 bits of the text's hash where the id is null or may stand in
    several rows, else 0."""
    ids = documents.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    shared = bits_of(ids, F.col("doc_id"))
    where, found = one_of(shared, F.col("doc_id"))
    tag = F.when(F.col("doc_id").isNull() | found, F.xxhash64("text")).otherwise(F.lit(0))
    return documents.select("doc_id", "text").join(F.broadcast(shared), where, "left").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), tag.cast("long").alias("tag"), "text")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id written as decimal text, modulo n (null doc_id: of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample_per_class(labelled: DataFrame, label: str, per_class: int, seed: int,
                     classes: list) -> DataFrame:
    """At most `per_class` rows of every class of (doc_id, label), chosen by a
    seeded hash of doc_id: a bounded sample whatever the size of the table."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    picked = [
        labelled.filter(F.col(label) == F.lit(c)).select("doc_id", label)
        .orderBy(order, "doc_id").limit(per_class)
        for c in classes
    ]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out
