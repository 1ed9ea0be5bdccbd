"""What a posting's key stands for, and the key an incoming posting has in a store.

A key is a short hash of the posting's URL or of its provider's id. Two rows with one
key are the same posting if what their keys were made from is the same; a source
that was moved to id keys leaves an alias for each old key behind (chains resolved),
so that the next scrape, which still hashes URLs, meets the rows it stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.text import first_non_empty, posting_key
from postflow.operators.extras import id_from_url, url_without_query


def with_provider_id(rows: DataFrame) -> DataFrame:
    """rows with a `provider_id` (null where their adapter gives none)."""
    return rows if "provider_id" in rows.columns else rows.withColumn("provider_id", F.lit(None).cast("string"))


def known_id(provider_id: Column | str = "provider_id", url: Column | str = "url") -> Column:
    """The provider's id, or the one printed in the URL; '' if there is none."""
    return first_non_empty(provider_id, id_from_url(url))


def identity() -> Column:
    """What the key of a row (source, job_board_id, url, provider_id) was made from: a
    URL, the provider's id, or the URL without its query. The URL stands for a key of
    another make."""
    key, source, url, pid = (F.col(c) for c in ("job_board_id", "source", "url", "provider_id"))
    made_from = lambda x: key == posting_key(source, x)
    return (F.when(made_from(url), F.concat(F.lit("url "), url))
            .when(made_from(first_non_empty(pid)) & (first_non_empty(pid) != ""), F.concat(F.lit("id "), pid))
            .when((id_from_url(url) != "") & made_from(id_from_url(url)), F.concat(F.lit("id "), id_from_url(url)))
            .when(made_from(url_without_query(url)), F.concat(F.lit("page "), url_without_query(url)))
            .otherwise(F.concat(F.lit("url "), url)))


def canonical(rows: DataFrame, aliases: DataFrame, id_sources: Sequence[str]) -> DataFrame:
    """Narrow incoming rows (source, job_board_id, url, provider_id, ...) under the key
    they have in the store, and their `identity`. An alias decides; without one, a row
    of a source on id keys takes its id's key. A row that comes by an alias is what
    the alias says: its identity is null, and never differs from another."""
    old = aliases.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
    pid = known_id()
    by_id = F.col("source").isin(*id_sources) & (pid != "") if id_sources else F.lit(False)
    return (rows.join(old, F.col("job_board_id") == F.col("_old"), "left")
            .withColumn("job_board_id", F.when(F.col("_new").isNotNull(), F.col("_new"))
                        .when(by_id, posting_key("source", pid)).otherwise(F.col("job_board_id")))
            .withColumn("identity", F.when(F.col("_new").isNull(), identity()))
            .drop("_old", "_new"))


def moved_keys(postings: DataFrame, source: str) -> DataFrame:
    """(old_key, new_key) of all postings of a source that moves to id keys; a posting
    without a known id keeps its key, and that is an alias too (its next scrape may
    bring an id along)."""
    pid = known_id()
    mine = with_provider_id(postings).filter(F.col("source") == F.lit(source))
    return mine.select(F.col("job_board_id").alias("old_key"), F.when(pid != "", posting_key(F.lit(source), pid))
                       .otherwise(F.col("job_board_id")).alias("new_key")).distinct()


def chained(aliases: DataFrame, moved: DataFrame) -> DataFrame:
    """The aliases after one more move: what led to a moved key leads to its new one."""
    on = F.col("a.new_key") == F.col("m.old_key")
    led = aliases.alias("a").join(moved.alias("m"), on, "left").select(
        "a.old_key", F.coalesce("m.new_key", "a.new_key").alias("new_key"))
    return led.unionByName(moved.join(aliases.select("old_key"), "old_key", "left_anti"))
