"""Board: status changes, the current view of postings, listing and lookups.

Stored postings are never updated in place. Status edits, dead marks and
generated texts are appended to their own tables and folded in at read time:
the latest status by (changed_at, seq), the earliest dead mark, the latest
successful materials row. Each fold is a keyed aggregate (partial before the
shuffle, so a key with many changes moves as one row per map task) and the
joins are on the unique posting key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import has_text, listing_header, normalise_status


def fold_status(changes: DataFrame) -> DataFrame:
    """Latest status per key: job_board_id, status, changed_at, changes."""
    order = F.struct("changed_at", "seq")
    return changes.groupBy("job_board_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("changed_at", order).alias("changed_at"),
        F.count(F.lit(1)).alias("changes"),
    )


def fold_dead(marks: DataFrame) -> DataFrame:
    """First dead mark per key (dead is sticky; nothing clears it)."""
    return marks.groupBy("job_board_id").agg(F.min("dead_at").alias("dead_at"))


def fold_materials(materials: DataFrame) -> DataFrame:
    """Latest successful texts per key; failed runs leave the posting pending.

    The newest time of each key is found on fixed-width values; only the rows of
    that time carry their texts on (several at one time: the largest generator).
    """
    ok = materials.filter(F.col("error").isNull() & F.col("cover_letter").isNotNull())
    newest = ok.groupBy("job_board_id").agg(F.max("generated_at").alias("_newest"))
    last = ok.join(newest, "job_board_id").filter(F.col("generated_at").eqNullSafe(F.col("_newest")))
    order = F.struct("generator", "cover_letter", "cold_email")
    return last.groupBy("job_board_id").agg(F.max(order).alias("_m")).select(
        "job_board_id", "_m.cover_letter", "_m.cold_email")


def folded(name: str, rows: DataFrame) -> DataFrame:
    """The rows of a change table that still count, one a key, with the table's columns:
    folding them with later rows gives what folding all rows gives."""
    if name == "status_changes":
        last = F.max_by(F.struct(*rows.columns), F.struct("changed_at", "seq"))
    elif name == "materials":
        rows = rows.filter(F.col("error").isNull() & F.col("cover_letter").isNotNull())
        last = F.max(F.struct("generated_at", "generator", "cover_letter", "cold_email", "error"))
    elif name == "dead_marks":
        last = F.struct(F.min("dead_at").alias("dead_at"))
    else:
        raise ValueError(f"not a change table: {name}")
    out = rows.groupBy(F.col("job_board_id").alias("_key")).agg(last.alias("_last"))
    return out.select(*[F.col("_key").alias(c) if c == "job_board_id" else F.col("_last")[c].alias(c) for c in rows.columns])


def current_view(postings: DataFrame, status_changes: DataFrame | None = None,
                 materials: DataFrame | None = None, dead_marks: DataFrame | None = None) -> DataFrame:
    """Postings with the folded status, texts and dead time (the posting schema)."""
    view = postings
    if status_changes is not None:
        st = fold_status(status_changes).select("job_board_id", F.col("status").alias("_st"))
        view = view.join(st, "job_board_id", "left").withColumn(
            "status", F.coalesce(F.col("_st"), F.col("status"))).drop("_st")
    if materials is not None:
        m = fold_materials(materials).select(
            "job_board_id", F.col("cover_letter").alias("_cl"), F.col("cold_email").alias("_ce"))
        view = view.join(m, "job_board_id", "left").withColumns({
            "generated_cover_letter": F.coalesce(F.col("_cl"), F.col("generated_cover_letter")),
            "generated_cold_email": F.coalesce(F.col("_ce"), F.col("generated_cold_email")),
        }).drop("_cl", "_ce")
    if dead_marks is not None:
        d = fold_dead(dead_marks).select("job_board_id", F.col("dead_at").alias("_dead"))
        view = view.join(d, "job_board_id", "left").withColumn(
            "dead_at", F.coalesce(F.col("dead_at"), F.col("_dead"))).drop("_dead")
    return view.select(*schema.POSTING_COLUMNS)


def _last_of(parts: list[DataFrame], value: Column, pick: Callable[..., Column], fold: Callable[[Column], Column],
             name: str) -> tuple[list[DataFrame], Column]:
    """Each part folded by key, and the pick among what the parts say of a key."""
    sides = [p.groupBy("job_board_id").agg(fold(value).alias(f"{name}{i}")) for i, p in enumerate(parts)]
    said = [F.col(f"{name}{i}") for i in range(len(parts))]
    return sides, pick(*said) if len(said) > 1 else said[0]


def view_of_parts(postings: DataFrame, status_changes: list[DataFrame], materials: list[DataFrame],
                  dead_marks: list[DataFrame]) -> DataFrame:
    """The current view of postings whose change tables come in parts, each folded and
    joined on its own: a part that lies by key (a bucketed snapshot) is not moved for
    the rows that came after it."""
    done = F.col("error").isNull() & F.col("cover_letter").isNotNull()
    st, last = _last_of(status_changes, F.struct("changed_at", "seq", "status"), F.greatest, F.max, "_st")
    ma, text = _last_of([m.filter(done) for m in materials], F.struct("generated_at", "generator", "cover_letter", "cold_email"),
                        F.greatest, F.max, "_ma")
    de, dead = _last_of(dead_marks, F.col("dead_at"), F.least, F.min, "_de")
    view = postings
    for side in st + ma + de:
        view = view.join(side, "job_board_id", "left")
    return view.withColumns({
        "status": F.coalesce(last["status"], "status"),
        "generated_cover_letter": F.coalesce(text["cover_letter"], "generated_cover_letter"),
        "generated_cold_email": F.coalesce(text["cold_email"], "generated_cold_email"),
        "dead_at": F.coalesce("dead_at", dead),
    }).select(*schema.POSTING_COLUMNS)


def listing(view: DataFrame, limit: int = 0, ordered: bool = True) -> DataFrame:
    """Dashboard rows, newest scraped first (id breaks ties): header, status shown,
    and whether each text is there. `limit` N > 0 returns one page of N rows, picked
    on (date, id) alone; `ordered=False` leaves the order to the caller."""
    if limit:
        page = view.select("id", "date_scraped").orderBy(F.desc("date_scraped"), F.desc("id")).limit(limit)
        view = view.join(page.select("id"), "id", "left_semi")
    shown = normalise_status("status")
    rows = view.select(
        "id", "job_board_id", "date_scraped",
        listing_header("title", "company", shown).alias("header"),
        shown.alias("status_shown"),
        has_text("generated_cover_letter").alias("has_cover_letter"),
        has_text("generated_cold_email").alias("has_cold_email"),
        "location", "url",
    )
    return rows.orderBy(F.desc("date_scraped"), F.desc("id")) if ordered else rows


def status_change(view: DataFrame, job_board_id: str, new_status: str, as_of: dt.datetime,
                  seq: int = 0) -> DataFrame:
    """Change row for one posting when the new status differs from the stored one."""
    row = view.filter(F.col("job_board_id") == F.lit(job_board_id))
    return row.filter(~F.col("status").eqNullSafe(F.lit(new_status))).select(
        "job_board_id", F.lit(new_status).alias("status"),
        F.lit(as_of).cast("timestamp_ntz").alias("changed_at"), F.lit(seq).cast("long").alias("seq"))


def status_change_by_id(view: DataFrame, id: int, new_status: str, as_of: dt.datetime, seq: int = 0) -> DataFrame:
    """Change row for the posting with this id when the new status differs."""
    row = view.filter(F.col("id") == F.lit(id))
    return row.filter(~F.col("status").eqNullSafe(F.lit(new_status))).select(
        "job_board_id", F.lit(new_status).alias("status"),
        F.lit(as_of).cast("timestamp_ntz").alias("changed_at"), F.lit(seq).cast("long").alias("seq"))


def numbered_changes(edits: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Change rows of edits (job_board_id, status, ord) that know their posting's status
    `_now` and its last number `_seq` (null: none): each that differs from the one before."""
    in_order = Window.partitionBy("job_board_id").orderBy("ord")
    before = F.coalesce(F.lag("status").over(in_order), F.col("_now"))
    rows = edits.withColumn("_before", before).filter(~F.col("status").eqNullSafe(F.col("_before")))
    seq = F.coalesce(F.col("_seq"), F.lit(-1)) + F.row_number().over(in_order)
    return rows.select("job_board_id", "status", F.lit(as_of).cast("timestamp_ntz").alias("changed_at"),
                       seq.cast("long").alias("seq"))


def normalisation_changes(view: DataFrame, as_of: dt.datetime, seq: int = 0) -> DataFrame:
    """Change rows that save the default status over every unknown stored one."""
    return view.filter(normalise_status("status") != F.col("status")).select(
        "job_board_id", normalise_status("status").alias("status"),
        F.lit(as_of).cast("timestamp_ntz").alias("changed_at"), F.lit(seq).cast("long").alias("seq"))


def lookup(view: DataFrame, job_board_id: str | None = None, id: int | None = None) -> DataFrame:
    """One posting by key or by id (partition pruning on `source` when read from the store)."""
    if job_board_id is not None:
        src = job_board_id.split("-", 1)[0]
        return view.filter((F.col("source") == src) & (F.col("job_board_id") == job_board_id))
    return view.filter(F.col("id") == F.lit(id))


def status_history(changes: DataFrame) -> DataFrame:
    """Every status change with the status it replaced (NULL for the first).

    A key's changes are dealt by day, so a key with very many of them takes
    several tasks; within a day the previous row is a lag, and the first row of a
    day takes the last status of the key's day before (one small row for each key
    and day, which meets the changes on the partitioning they already have).
    """
    rows = changes.select("job_board_id", "status", "changed_at", "seq", F.to_date("changed_at").alias("_day"))
    in_day = Window.partitionBy("job_board_id", "_day").orderBy("changed_at", "seq")
    local = rows.withColumns({"_n": F.row_number().over(in_day), "_prev": F.lag("status").over(in_day)})
    last = rows.groupBy("job_board_id", "_day").agg(
        F.max(F.struct("changed_at", "seq", "status"))["status"].alias("_last"))
    by_day = Window.partitionBy("job_board_id").orderBy("_day")
    before = last.select("job_board_id", "_day", F.lag("_last").over(by_day).alias("_before"))
    on = [F.col("l.job_board_id").eqNullSafe(F.col("b.job_board_id")), F.col("l._day").eqNullSafe(F.col("b._day"))]
    return local.alias("l").join(before.alias("b"), on, "left").select(
        "l.job_board_id", "l.status", "l.changed_at", "l.seq",
        F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev")).alias("previous_status"))
