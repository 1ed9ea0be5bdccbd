"""Ingest: adapters over landed payloads, first-write-wins upsert, run summary.

Run order is (source_ord, payload_ord, entry_ord): the earlier source, then the
earlier response, then the earlier entry wins a duplicate key, and a key that
is already stored is never written again.
"""

from __future__ import annotations

import datetime as dt

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import source_of_key
from postflow.operators import keys
from postflow.sources import adapters
from postflow.sources.adapters import AdapterResult

RUN_ORDER = ["source_ord", "payload_ord", "entry_ord"]


def prepare(payloads: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Attach source parameters (title filter, search location) to each payload.

    The sources table has one row per configured board; AQE turns this into a
    broadcast join once it has measured that side.
    """
    if sources is None:
        return payloads.withColumn("title_contains", F.lit(None).cast("string")).withColumn(
            "search_location", F.lit(None).cast("string"))
    params = sources.select(
        "source_ord", "title_contains",
        F.coalesce(F.col("location"), F.lit(schema.DEFAULT_LOCATION)).alias("search_location"))
    return payloads.join(params, "source_ord", "left")


def scan(payloads: DataFrame, sources: DataFrame | None = None,
         types: list[str] | None = None) -> AdapterResult:
    """Run the adapter of every source type over its payloads and union the rows.

    Payloads of a type without an adapter are rejected, like a source whose
    type the configuration does not know. Landed payloads should be stored
    partitioned by `type` so each adapter's filter prunes to its own folder.
    """
    prepared = prepare(payloads, sources)
    wanted = types if types is not None else adapters.registered_types()
    parts = [adapters.adapter_for(t)(prepared.filter(F.col("type") == t)).both() for t in wanted]
    if types is None:
        parts.append(prepared.filter(~F.col("type").isin(*wanted) | F.col("type").isNull()).select(
            "source_ord", "payload_ord", "type",
            F.concat(F.lit("Unknown source type: "), F.coalesce(F.col("type"), F.lit("None"))).alias("reason"),
            F.col("body").alias("raw")))
    tagged = parts[0]
    for other in parts[1:]:
        tagged = tagged.unionByName(other, allowMissingColumns=True)
    return AdapterResult.of(tagged)


def split_required(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field set, and the others as rejects."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in schema.REQUIRED])
    ok = F.col("title").isNotNull()
    for c in schema.REQUIRED[1:]:
        ok = ok & F.col(c).isNotNull()
    valid = inc.filter(ok)
    bad = inc.filter(~ok).select(
        "source_ord", "payload_ord", F.col("source").alias("type"), "entry_ord",
        F.concat(F.lit("null required field: "), missing).alias("reason"),
        F.to_json(F.struct(*schema.INCOMING_COLUMNS)).alias("raw"))
    return valid, bad


def first_wins(inc: DataFrame) -> DataFrame:
    """The first row of each key in run order.

    `row_number() = 1` lets the planner add a partial WindowGroupLimit before
    the shuffle, so a hot key (all URL-less postings of a source share one)
    shrinks to one row per map task before it moves.
    """
    w = Window.partitionBy("job_board_id").orderBy(*RUN_ORDER)
    return inc.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def existing_keys(current: DataFrame | None, by_source: bool = False) -> DataFrame | None:
    if current is None:
        return None
    return current.select("source", "job_board_id") if by_source else current.select("job_board_id")


def _key_cols(by_source: bool) -> list[str]:
    return ["source", "job_board_id"] if by_source else ["job_board_id"]


def new_postings(inc: DataFrame, current: DataFrame | None, by_source: bool = False) -> DataFrame:
    """Incoming rows whose key is neither stored nor beaten by an earlier row.

    `by_source=True` joins on (source, key): equivalent, since the source is
    the key's prefix, and it lets a store partitioned by `source` be pruned to
    the sources of the batch (dynamic partition pruning) instead of reading
    every stored key.
    """
    valid, _ = split_required(inc)
    winners = first_wins(valid)
    keys = existing_keys(current, by_source)
    if keys is None:
        return winners
    cols = _key_cols(by_source)
    if by_source:
        # stored keys that the batch also has (the stored side is the one pruned),
        # then the batch without them
        hits = keys.join(winners.select(*cols), cols, "left_semi")
        return winners.join(hits, cols, "left_anti").select(*winners.columns)
    return winners.join(keys, cols, "left_anti").select(*winners.columns)


def with_defaults(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Posting defaults: scrape time, status, empty texts and contact fields."""
    null_s = F.lit(None).cast("string")
    return rows.withColumns({
        "date_scraped": F.lit(as_of).cast("timestamp_ntz"),
        "status": F.lit(schema.DEFAULT_STATUS),
        "generated_cover_letter": null_s,
        "generated_cold_email": null_s,
        "contact_name": null_s,
        "contact_email": null_s,
        "contact_confidence": null_s,
        "dead_at": F.lit(None).cast("timestamp_ntz"),
    })


KEY_COLLISION = "key collision"


def _held(known: DataFrame, n: int) -> DataFrame:
    """Stored keys and what they were made from, as `_held<n>`, `_stored<n>`."""
    held = F.when(F.col("url").isNotNull(), keys.identity())
    return known.select("job_board_id", held.alias(f"_held{n}"), F.lit(True).alias(f"_stored{n}")).dropDuplicates(["job_board_id"])


def tag(inc: DataFrame, current: DataFrame | None, by_source: bool = False, aliases: DataFrame | None = None,
        id_sources: Sequence[str] = (), keyed: DataFrame | None = None) -> DataFrame:
    """What becomes of each incoming row, without its texts: run order, source, key,
    url, `ok` (all required fields set), `is_new`, `collision`.

    The first valid row of a key in run order wins, unless the key is stored. The
    key is a short hash, so what it was made from goes along (a URL or the
    provider's id): a row whose key another of these holds (in the store, or first
    in the run) is a collision, not a repetition. With `aliases`, rows come under
    the key they have in the store (see `keys.canonical`). Each
    key's winner is a minimum, combined before the shuffle; the narrow rows then
    meet it on the key, where a hot key (all blank URLs of a source share one) is
    split by the skew join. `keyed` holds stored postings that lie by key already (a
    bucketed table, its keys in `current` no more): the lookup leaves them where they are.
    """
    ok = F.col("title").isNotNull()
    for c in schema.REQUIRED[1:]:
        ok = ok & F.col(c).isNotNull()
    rows = keys.with_provider_id(inc).select(*RUN_ORDER, "source", "job_board_id", "url", "provider_id", ok.alias("ok"))
    if aliases is None:
        rows = rows.withColumn("identity", keys.identity())
    else:
        rows = keys.canonical(rows, aliases, id_sources)
    rows = rows.drop("provider_id")
    first = (rows.filter("ok").groupBy("job_board_id")
             .agg(F.min(F.struct(*RUN_ORDER, "identity")).alias("_w")))
    stored = []
    if current is not None:
        url = F.col("url") if "url" in current.columns else F.lit(None).cast("string").alias("url")
        source = F.col("source") if "source" in current.columns else source_of_key("job_board_id").alias("source")
        known = keys.with_provider_id(current).select(source, "job_board_id", url, "provider_id")
        if by_source:
            # only the stored keys the batch also has (lets a source-partitioned store be pruned)
            known = known.join(rows.select(*_key_cols(True)).distinct(), _key_cols(True), "left_semi")
        stored.append(_held(known, 0))
    if keyed is not None:
        stored.append(_held(keys.with_provider_id(keyed).select("source", "job_board_id", "url", "provider_id"), len(stored)))
    for held in stored:
        first = first.join(held, "job_board_id", "left")
    first = first.select("job_board_id", "_w",
                         F.coalesce(*[F.col(f"_held{i}") for i in range(len(stored))], F.lit(None).cast("string")).alias("_held"),
                         F.coalesce(*[F.col(f"_stored{i}") for i in range(len(stored))], F.lit(False)).alias("_stored"))
    place = F.struct(*RUN_ORDER)
    won = F.struct(*[F.col("_w")[c].alias(c) for c in RUN_ORDER])
    stored_key = F.coalesce("_stored", F.lit(False))
    owner = F.when(stored_key, F.col("_held")).otherwise(F.col("_w")["identity"])
    return rows.join(first, "job_board_id", "left").select(
        *RUN_ORDER, "source", "job_board_id", "url", "ok",
        F.coalesce(F.col("ok") & ~stored_key & (place == won), F.lit(False)).alias("is_new"),
        F.coalesce(F.col("ok") & (F.col("identity") != owner), F.lit(False)).alias("collision"))


def summary_of(tags: DataFrame) -> DataFrame:
    """Per-source counts of tagged rows plus a grand-total row (source_ord NULL)."""
    return tags.groupingSets([["source_ord", "source"], []], "source_ord", "source").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("is_new").alias("new"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.count_if(F.coalesce(F.col("url"), F.lit("")) == "").alias("blank_urls"),
        F.count_if("collision").alias("key_collisions"),
    ).select("source_ord", "source", "seen", "new", "rejected", "blank_urls", "key_collisions")


def summary(inc: DataFrame, current: DataFrame | None, by_source: bool = False) -> DataFrame:
    """Per-source seen / new / rejected / URL-less / key-collision counts plus a
    grand-total row. URL-less postings of a source all share one key (the hot
    key), so their number is reported next to the counts."""
    return summary_of(tag(inc, current, by_source))


def collisions(inc: DataFrame, tags: DataFrame) -> DataFrame:
    """The incoming rows that lost their key to another posting, as rejects."""
    lost = tags.filter("collision").select(*RUN_ORDER)
    return inc.join(lost, RUN_ORDER, "left_semi").select(
        "source_ord", "payload_ord", F.col("source").alias("type"), "entry_ord",
        F.lit(KEY_COLLISION).alias("reason"), F.to_json(F.struct(*schema.INCOMING_COLUMNS)).alias("raw"))


def assign_ids(new_rows: DataFrame, base_id: int | DataFrame, partitions: int | None = None) -> DataFrame:
    """Dense surrogate ids base+1, base+2, ... in run order, without one global window.

    Only the run order and the key are numbered: they are range-partitioned and
    sorted within each range, cut from their lineage with `checkpoint()` (to the
    shared folder) so the split and the in-range positions are fixed, and the
    per-range counts (one small row per range) give each range its offset. The
    ids then meet the rows on the run order. `base_id` is the largest stored id,
    or the stored table to take it from.
    """
    from postflow.session import checkpoint_dir, shuffle_partitions

    spark = new_rows.sparkSession
    checkpoint_dir(spark)
    n = partitions or shuffle_partitions(spark)
    ranged = (new_rows.select(*RUN_ORDER).repartitionByRange(n, *RUN_ORDER).sortWithinPartitions(*RUN_ORDER)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    # position inside the range: monotonically_increasing_id is (pid << 33) + row index
    ranged = ranged.withColumn("_pos", F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if isinstance(base_id, DataFrame):
        # one scalar (the largest stored id) comes back to the driver
        base_id = base_id.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    offsets = offsets.withColumn("_base", F.lit(int(base_id)))
    ids = ranged.join(F.broadcast(offsets), "_pid").select(
        *RUN_ORDER, (F.col("_base") + F.col("_off") + F.col("_pos") + 1).cast("long").alias("id"))
    return new_rows.join(ids, RUN_ORDER).select(*new_rows.columns, "id")
