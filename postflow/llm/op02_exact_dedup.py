"""Exact dedup: group by 128-bit content hash, then compare the bytes.

1. Group by the hash (counted on the map side) and find the hashes that repeat.
2. Only texts with a repeated hash are grouped again, by hash and text, which
   compares their bytes; so each class of equal texts has its own largest
   doc_id and count, even where two texts share a hash. The rows are dealt by
   hash and salt and combined before the last shuffle, so a text that a third of
   all rows repeat fills no task.
3. Rows find their class by hash; only those of colliding hashes by the text too.

Defined results. Null text counts as empty (no bytes). Of equal texts the row
with the largest doc_id stays; rows that repeat both doc_id and text cannot be
told apart and carry one decision. A null doc_id is kept only where its text has
no other id. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import materialize

SALTS = 8


def content_hash(text: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(text))


def exact_duplicates(documents: DataFrame, hashed=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    text = F.coalesce("text", F.lit(""))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = documents.select("doc_id", text.alias("text")).withColumns({"key": hashed(F.col("text")), "salt": salt})
    narrow = rows.select("doc_id", "key", "salt", F.sha2("text", 256).alias("text_sha256"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")

    repeated = (narrow.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", salts))
    # the only shuffle of texts; what is left of them is written once
    again = materialize(rows.join(repeated.hint("shuffle_hash"), ["key", "salt"], "left_semi"), "repeated")
    classes = (again.groupBy("key", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
               .groupBy("key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")))
    # a hash with one text is settled by the hash; one with several by the text
    keyed = (classes.groupBy("key").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"),
                                        F.sum("n").alias("n")))
    by_hash = keyed.select("key", salts, F.col("texts"), "keep_id", "n")
    found = (narrow.join(by_hash, ["key", "salt"], "left")
             .withColumn("texts", F.coalesce("texts", F.lit(1))))
    settled = found.filter("texts = 1").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), "text_sha256")
    shared = keyed.filter("texts > 1").select("key")
    collided = (again.join(shared.hint("shuffle_hash"), "key", "left_semi")
                .join(classes.select("key", "text", "keep_id", F.col("n").alias("group_size")), ["key", "text"])
                .select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return (settled.unionByName(collided)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))
