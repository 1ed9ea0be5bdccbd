"""Board adapters: landed payload rows -> incoming postings (+ rejected payloads).

Each adapter is a DataFrame -> DataFrame function. The input is the payload
table joined with its source parameters (`title_contains`, `search_location`);
the output is the incoming-posting schema plus a reject table. One payload row
is one board response (bounded size); entries come out of it with their array
position as `entry_ord`, so the run order is kept without any sort.

JSON boards are parsed into VARIANT so that a missing key and a JSON null stay
different (`entry.get(k, default)` applies the default only when the key is
missing). A payload whose shape would have made the original adapter raise
(body not JSON, `jobs` null or not a list, an entry that is not an object, a
null URL, ...) is rejected whole: a failing source contributes no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import first_non_empty, fold_remote, posting_key, title_matches


REJECT_COLUMNS = [f.name for f in schema.REJECTS.fields]


@dataclass
class AdapterResult:
    """What an adapter makes of its payloads: incoming postings and rejected payloads.

    `tagged` holds both in one frame (a reject has a `reason`), so a consumer of
    both writes it once and the payloads are parsed once.
    """

    incoming: DataFrame
    rejects: DataFrame
    tagged: DataFrame | None = None

    @staticmethod
    def of(tagged: DataFrame) -> AdapterResult:
        return AdapterResult(tagged.filter(F.col("reason").isNull()).select(*schema.INCOMING_COLUMNS),
                             tagged.filter(F.col("reason").isNotNull()).select(*REJECT_COLUMNS), tagged)

    def both(self) -> DataFrame:
        if self.tagged is not None:
            return self.tagged
        null_s = F.lit(None).cast("string")
        own = self.incoming.columns
        pid = F.col("provider_id") if "provider_id" in own else null_s.alias("provider_id")
        rows = self.incoming.select(*schema.INCOMING_COLUMNS, pid, F.col("source").alias("type"),
                                    null_s.alias("reason"), null_s.alias("raw"))
        return rows.unionByName(self.rejects, allowMissingColumns=True)


# what an adapter yields for the store: the provider's id goes along (null if it has none)
TAGGED_COLUMNS = [*schema.INCOMING_COLUMNS, "provider_id", "type", "reason", "raw"]


Adapter = Callable[[DataFrame], AdapterResult]

_REGISTRY: dict[str, Adapter] = {}


def register_adapter(source_type: str, fn: Adapter) -> None:
    """Add (or replace) the adapter of a source type."""
    _REGISTRY[source_type] = fn


def adapter_for(source_type: str) -> Adapter:
    if source_type not in _REGISTRY:
        raise ValueError(f"Unknown source type: {source_type!r}")
    return _REGISTRY[source_type]


def registered_types() -> list[str]:
    return list(_REGISTRY)


# ---------------------------------------------------------------------------
# variant helpers
# ---------------------------------------------------------------------------

def vget(v: Column, path: str) -> Column:
    """Variant at path; SQL NULL when the key is missing, variant null when JSON null."""
    return F.variant_get(v, path, "variant")


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def vstr(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def present(v: Column, path: str) -> Column:
    return vget(v, path).isNotNull()


def get_or_default(v: Column, path: str, default: str) -> Column:
    """`entry.get(key, default)` for string values: default only when missing."""
    return F.when(~present(v, path), F.lit(default)).otherwise(vstr(v, path))


def truthy(x: Column) -> Column:
    """Python truthiness of a variant value (SQL NULL = missing = falsy)."""
    t = vtype(x)
    return (
        F.when(x.isNull() | (t == "VOID"), F.lit(False))
        .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(t == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
        .when(F.startswith(t, F.lit("ARRAY")), F.array_size(F.try_variant_get(x, "$", "array<variant>")) > 0)
        .when(F.startswith(t, F.lit("OBJECT")), F.to_json(x) != "{}")
        .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(False)))
    )


def _jobs(v: Column) -> Column:
    return F.try_variant_get(v, "$.jobs", "array<variant>")


def _payload_reason(v: Column, fatal_entry: Callable[[Column], Column]) -> Column:
    """Why a JSON board payload fails as a whole, or NULL when it parses."""
    jobs_v = vget(v, "$.jobs")
    return (
        F.when(v.isNull(), F.lit("body is not JSON"))
        .when(~F.startswith(vtype(v), F.lit("OBJECT")), F.lit("body is not an object"))
        .when(jobs_v.isNull(), F.lit(None).cast("string"))  # no `jobs`: zero postings
        .when(~F.startswith(vtype(jobs_v), F.lit("ARRAY")), F.lit("jobs is not a list"))
        .when(F.exists(_jobs(v), fatal_entry), F.lit("entry the adapter cannot read"))
    )


def _split(prepared: DataFrame, reason_fn: Callable[[Column], Column], source_type: str,
           entry_fn: Callable[[DataFrame], DataFrame]) -> AdapterResult:
    """Reject failing payloads whole; explode the rest into incoming rows.

    The body is parsed once per payload: one generator yields a row for each
    entry, or one row with the reason. The reason comes out of the generator, so
    a filter on it stays above (below, it would parse the body again).
    """
    parsed = prepared.withColumn("_v", F.try_parse_json("body"))
    parsed = parsed.withColumn("_reason", reason_fn(F.col("_v")))
    one = lambda reason, raw, pos, e: F.struct(
        reason.alias("reason"), raw.alias("raw"), pos.cast("int").alias("entry_ord"), e.alias("e"))
    null_s, null_v = F.lit(None).cast("string"), F.lit(None).cast("variant")
    rows = F.when(F.col("_reason").isNotNull(), F.array(one(F.col("_reason"), F.col("body"), F.lit(None), null_v))).otherwise(
        F.transform(_jobs(F.col("_v")), lambda e, i: one(null_s, null_s, i, e)))
    entries = parsed.select(
        "source_ord", "payload_ord", "type", "token", "title_contains", "search_location",
        F.explode(rows).alias("_r")).select("*", "_r.*").drop("_r")
    return AdapterResult.of(_keyed(entry_fn(entries), source_type))


def _keyed(rows: DataFrame, source_type: str) -> DataFrame:
    """Source and key of the entries; a reject carries neither."""
    ok = F.col("reason").isNull()
    rows = rows.withColumn("source", F.when(ok, F.lit(source_type)))
    rows = rows.withColumn("job_board_id", F.when(ok, posting_key(F.lit(source_type), F.col("url"))))
    if "provider_id" not in rows.columns:
        rows = rows.withColumn("provider_id", F.lit(None).cast("string"))
    return rows.select(*TAGGED_COLUMNS)


# ---------------------------------------------------------------------------
# greenhouse
# ---------------------------------------------------------------------------

def _greenhouse_fatal(e: Column, needle: Column) -> Column:
    """The entry stops its whole board. URL and location are looked at only where
    the title passes the filter: an entry that is skipped cannot fail the board."""
    title = vget(e, "$.title")
    url = vget(e, "$.absolute_url")
    loc = vget(e, "$.location")
    wanted = title_matches(get_or_default(e, "$.title", schema.UNTITLED), needle)
    return (
        ~F.startswith(vtype(e), F.lit("OBJECT"))
        # a title that cannot be lower-cased fails the filter when a needle is set
        | (F.coalesce(needle != "", F.lit(False)) & title.isNotNull() & (vtype(title) != "STRING"))
        | (wanted & (
            # the URL is hashed: null or non-text raises
            (url.isNotNull() & (vtype(url) != "STRING"))
            # (location or {}).get(...) raises on a truthy non-object
            | (truthy(loc) & ~F.startswith(vtype(loc), F.lit("OBJECT")))))
    )


def _greenhouse_entries(entries: DataFrame) -> DataFrame:
    e = F.col("e")
    loc = vget(e, "$.location")
    location = F.when(~truthy(loc), F.lit("")).otherwise(get_or_default(e, "$.location.name", ""))
    title = get_or_default(e, "$.title", schema.UNTITLED)
    out = entries.select(
        "source_ord", "payload_ord", "entry_ord", "type", "reason", "raw",
        title.alias("title"),
        F.col("token").alias("company"),
        location.alias("location"),
        get_or_default(e, "$.content", "").alias("description"),
        get_or_default(e, "$.absolute_url", "").alias("url"),
        vstr(e, "$.id").alias("provider_id"),
        "title_contains",
    )
    return out.filter(F.col("reason").isNotNull() | title_matches("title", "title_contains")).drop("title_contains")


def greenhouse(prepared: DataFrame) -> AdapterResult:
    """Greenhouse board JSON `{"jobs": [{title, absolute_url, location: {name}, content}]}`."""
    def fatal(x: Column) -> Column:
        return F.coalesce(_greenhouse_fatal(x, F.col("title_contains")), F.lit(False))

    return _split(prepared, lambda v: _payload_reason(v, fatal), "greenhouse", _greenhouse_entries)


# ---------------------------------------------------------------------------
# ashby
# ---------------------------------------------------------------------------

def _ashby_fatal(e: Column) -> Column:
    listed = F.coalesce(F.to_json(vget(e, "$.isListed")) == "false", F.lit(False))
    return (
        ~F.startswith(vtype(e), F.lit("OBJECT"))
        | (~listed & (
            # the chosen URL is hashed: a truthy non-text value raises
            (truthy(vget(e, "$.jobUrl")) & (vtype(vget(e, "$.jobUrl")) != "STRING"))
            | (~truthy(vget(e, "$.jobUrl")) & truthy(vget(e, "$.applyUrl"))
               & (vtype(vget(e, "$.applyUrl")) != "STRING"))
            # a remote posting's location is lower-cased: a truthy non-text value raises
            | (truthy(vget(e, "$.isRemote")) & truthy(vget(e, "$.location"))
               & (vtype(vget(e, "$.location")) != "STRING"))))
    )


def or_text(v: Column, path: str) -> Column:
    """The value at path when Python would take it in `a or b` (truthy), as text; else NULL.

    Truthy values that are not text make the payload fail (see `_ashby_fatal`),
    so what is left here is text.
    """
    x = vget(v, path)
    return F.when(truthy(x), vstr(v, path))


def _ashby_entries(entries: DataFrame) -> DataFrame:
    e = F.col("e")
    listed = vget(e, "$.isListed")
    unlisted = F.coalesce(F.to_json(listed) == "false", F.lit(False))
    location = first_non_empty(or_text(e, "$.location"))
    return entries.filter(F.col("reason").isNotNull() | ~unlisted).select(
        "source_ord", "payload_ord", "entry_ord", "type", "reason", "raw",
        get_or_default(e, "$.title", schema.UNTITLED).alias("title"),
        F.col("token").alias("company"),
        fold_remote(location, truthy(vget(e, "$.isRemote"))).alias("location"),
        first_non_empty(or_text(e, "$.descriptionPlain"), or_text(e, "$.descriptionHtml")).alias("description"),
        first_non_empty(or_text(e, "$.jobUrl"), or_text(e, "$.applyUrl")).alias("url"),
        vstr(e, "$.id").alias("provider_id"),
    )


def ashby(prepared: DataFrame) -> AdapterResult:
    """Ashby board JSON; drops explicit `isListed: false`, folds `isRemote` into location."""
    return _split(prepared, lambda v: _payload_reason(v, _ashby_fatal), "ashby", _ashby_entries)


# ---------------------------------------------------------------------------
# seek (RSS)
# ---------------------------------------------------------------------------

NOT_A_FEED = "body is not a feed"
FEED_CUT_SHORT = "feed does not parse; its complete items are kept"

RSS_ITEMS = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, author: STRING>>>"


def _feed(body: Column) -> Column:
    return F.from_xml(body, RSS_ITEMS, {"mode": "PERMISSIVE"})["channel"]


def seek(prepared: DataFrame) -> AdapterResult:
    """RSS feed: one posting per `<item>`; company = author, location = search location.

    A body without a channel (plain text, an error page, another format, nothing)
    is rejected. A feed that does not parse (cut short) is rejected too, and its
    complete items are taken all the same.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    whole_items = F.array_join(F.regexp_extract_all(body, F.lit("(?s)<item[ >].*?</item>"), F.lit(0)), "")
    salvaged = F.when(F.contains(body, F.lit("<channel")), _feed(
        F.concat(F.lit("<rss><channel>"), whole_items, F.lit("</channel></rss>"))))
    # parsed once a payload: one generator for items and reasons (see _split)
    parsed = prepared.withColumn("_c", _feed(body))
    parsed = parsed.withColumn("_x", F.coalesce("_c", salvaged)).withColumn(
        "_reason", F.when(F.col("_x").isNull(), F.lit(NOT_A_FEED)).when(F.col("_c").isNull(), F.lit(FEED_CUT_SHORT)))
    item = "struct<title: string, link: string, description: string, author: string>"
    rows_type = f"array<struct<reason: string, raw: string, entry_ord: int, it: {item}>>"
    one = lambda reason, raw, pos, it: F.struct(
        reason.alias("reason"), raw.alias("raw"), pos.cast("int").alias("entry_ord"), it.cast(item).alias("it"))
    null_s = F.lit(None).cast("string")
    bad = F.when(F.col("_reason").isNotNull(), F.array(one(F.col("_reason"), F.col("body"), F.lit(None), F.lit(None))))
    good = F.transform(F.col("_x.item"), lambda it, i: one(null_s, null_s, i, it))
    items = parsed.select("source_ord", "payload_ord", "type", "search_location", F.explode(F.concat(
        F.coalesce(bad, F.array().cast(rows_type)), F.coalesce(good, F.array().cast(rows_type)))).alias("_r")).select("*", "_r.*").drop("_r")
    rows = items.select(
        "source_ord", "payload_ord", "entry_ord", "type", "reason", "raw",
        F.coalesce(F.col("it.title"), F.lit(schema.UNTITLED)).alias("title"),
        F.coalesce(F.col("it.author"), F.lit(schema.UNKNOWN_COMPANY)).alias("company"),
        F.coalesce(F.col("search_location"), F.lit(schema.DEFAULT_LOCATION)).alias("location"),
        F.coalesce(F.col("it.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("it.link"), F.lit("")).alias("url"),
    )
    return AdapterResult.of(_keyed(rows, "seek"))


register_adapter("greenhouse", greenhouse)
register_adapter("ashby", ashby)
register_adapter("seek", seek)
