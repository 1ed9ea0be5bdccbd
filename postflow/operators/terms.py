"""Filter terms kept in a table: thousands of terms in one pass over the texts.

A term is found through its rarest piece of one to six characters: a text that holds
the term holds all its pieces, so only texts with that one piece are looked at, and each
is then searched for the term itself. The result is that of one `contains` a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.text import col
from postflow.session import checkpoint_dir, shuffle_partitions

# Lengths of pieces; a term is cut into the longest that it has (longer ones are rarer).
PIECES = (6, 3, 2, 1, 0)
REMOTE = "remote"


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of `size` characters (none of a shorter text), in time linear in
    the text: a `substr` at every place would count from the start each time."""
    chars = F.split(text, "")
    pieces = chars
    for n in range(2, size + 1):
        pieces = F.zip_with(pieces, F.slice(chars, F.lit(n), F.length(text)), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= size, F.array_distinct(F.array_compact(pieces)))


def held_terms(texts: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(text, term) for each distinct lower-cased text of `column` and each distinct
    lower-cased `term` it holds as a substring. Null texts and terms hold nothing; an
    empty term is held by every text.

    Pieces of the texts are shuffled with a hash of the text in place of the text; texts
    whose hashes are equal are all searched, so a collision costs time only. A text is
    cut in memory by the task that reads it (about a hundred bytes a distinct piece)."""
    text = texts.select(F.lower(col(column)).alias("text")).filter("text IS NOT NULL").distinct()
    spark = texts.sparkSession
    checkpoint_dir(spark)
    # read three times below; a fixed width, as few bytes of text make many pieces
    text = text.withColumn("_text_key", F.xxhash64("text")).repartition(shuffle_partitions(spark), "_text_key").checkpoint(eager=True)
    term = terms.select(F.lower("term").alias("term")).filter("term IS NOT NULL").distinct()
    size = F.coalesce(*[F.when(F.length("term") >= n, F.lit(n)) for n in PIECES])
    sizes = sorted(r[0] for r in term.select(size).distinct().collect())  # at most five numbers
    every = text.filter(F.lit(0 in sizes)).select("text", F.lit("").alias("term"))
    cuts = [n for n in sizes if n]
    if not cuts:
        return every
    term = term.filter("term != ''")
    of_term = F.coalesce(*[F.when(size == n, _pieces(F.col("term"), n)) for n in cuts])
    term_pieces = term.select("term", F.explode(of_term).alias("piece"))
    of_text = F.concat(*[F.coalesce(_pieces(F.col("text"), n), F.array().cast("array<string>")) for n in cuts])
    # explode_outer: an explode would have Spark cut each text once more for a filter
    text_pieces = text.select("_text_key", F.explode_outer(of_text).alias("piece"))
    common = text_pieces.join(term_pieces.select("piece").distinct(), "piece", "left_semi").groupBy("piece").count()
    # a piece that no text holds is the rarest: nothing then meets its term
    rarest = (term_pieces.join(common, "piece", "left").groupBy("term")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "piece")).alias("_r"))
              .filter("_r.n > 0").select("term", F.col("_r.piece").alias("piece")))
    found = text_pieces.join(rarest, "piece").select("_text_key", "term")
    return text.join(found, "_text_key").filter(F.contains("text", "term")).select("text", "term").unionByName(every)


def matching(rows: DataFrame, filters: DataFrame, title: str = "title", location: str = "location") -> DataFrame:
    """Rows whose title holds one of the title terms and whose location holds one of the
    location terms; a remote location always passes. `filters` has a `field` (title or
    location) and a `term`; a field without terms passes all rows. A null title (or
    location) passes only where its field has no terms. Rows come back unchanged,
    repeated ones too."""
    out = rows
    for name, column, more in (("title", title, ()), ("location", location, (REMOTE,))):
        terms = filters.filter((F.col("field") == name) & F.col("term").isNotNull()).select("term")
        if terms.isEmpty():
            continue
        for term in more:
            terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit(term).alias("term")))
        # found over the given rows, so that one field's work is not done again within the other's
        passing = held_terms(rows.select(column), column, terms).select(F.col("text").alias("_text")).distinct()
        out = out.join(passing, F.lower(out[column]) == F.col("_text"), "left_semi")
    return out
