"""Source configuration as DataFrames: resolution, validation, request URLs,
source-list lines and careers-URL detection. All of these tables are
configuration-sized (one row per configured board)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import slug, strip


def legacy_source(spark: SparkSession, title: str, location: str | None = None) -> DataFrame:
    """The one feed source an old single-search block stands for."""
    return spark.createDataFrame(
        [(0, "seek", None, title, location or schema.DEFAULT_LOCATION, None)], schema.SOURCES)


def resolve_sources(listed: DataFrame | None, legacy: DataFrame | None) -> DataFrame:
    """The explicit list when it has rows, else the legacy single search."""
    if listed is not None and not listed.isEmpty():
        return listed
    if legacy is None:
        raise ValueError("config must define either a 'search' block or a 'sources' list")
    return legacy


def resolve_all(listed: DataFrame, blocks: DataFrame) -> DataFrame:
    """`resolve_sources` for many configurations at once (column `config`): the listed
    sources of each, or its old search block (config, title, location) if it lists none."""
    alone = blocks.join(listed.select("config").distinct(), "config", "left_anti")
    null_s = F.lit(None).cast("string")
    return listed.unionByName(alone.select(
        "config", F.lit(0).alias("source_ord"), F.lit("seek").alias("type"), null_s.alias("token"), "title",
        F.coalesce("location", F.lit(schema.DEFAULT_LOCATION)).alias("location"), null_s.alias("title_contains")))


def invalid_sources(sources: DataFrame) -> DataFrame:
    """Rows a configuration check rejects: unknown type or a missing parameter."""
    t = F.col("type")
    reason = (
        F.when(~t.isin(*schema.SOURCE_TYPES) | t.isNull(),
               F.concat(F.lit("Unknown source type: "), F.coalesce(t, F.lit("None"))))
        .when((t == "seek") & F.col("title").isNull(), F.lit("seek source needs a title"))
        .when((t != "seek") & F.col("token").isNull(), F.concat(t, F.lit(" source needs a board token")))
    )
    return sources.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def with_defaults(sources: DataFrame) -> DataFrame:
    """Feed sources without a location search `All Australia`; country tokens are trimmed and lower-cased."""
    return sources.withColumns({
        "location": F.when(F.col("type") == "seek", F.coalesce(F.col("location"), F.lit(schema.DEFAULT_LOCATION)))
                     .otherwise(F.col("location")),
        "token": F.when(F.col("type") == "adzuna", F.lower(strip(F.col("token")))).otherwise(F.col("token")),
    })


def request_url(type_: Column | str = "type", token: Column | str = "token", title: Column | str = "title",
                location: Column | str = "location") -> Column:
    """URL a fetcher calls for a source; NULL for types without an adapter."""
    t = F.col(type_) if isinstance(type_, str) else type_
    tok = strip(F.col(token) if isinstance(token, str) else token)

    def fill(template: str, **holes: Column) -> Column:
        parts: list[Column] = []
        rest = template
        while "{" in rest:
            pre, after = rest.split("{", 1)
            name, rest = after.split("}", 1)
            parts += [F.lit(pre), holes[name]]
        parts.append(F.lit(rest))
        return F.concat(*parts)

    tpl = schema.REQUEST_TEMPLATES
    return (
        F.when(t == "seek", fill(tpl["seek"], query=slug(title),
                                 loc=slug(F.coalesce(F.col(location) if isinstance(location, str) else location,
                                                     F.lit(schema.DEFAULT_LOCATION)))))
        .when(t == "greenhouse", fill(tpl["greenhouse"], token=tok))
        .when(t == "ashby", fill(tpl["ashby"], token=tok))
    )


def plan_requests(sources: DataFrame) -> DataFrame:
    """source_ord, type, request_url for every source with an adapter."""
    return with_defaults(sources).select(
        "source_ord", "type", request_url().alias("request_url")).filter(F.col("request_url").isNotNull())


def parse_source_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Source-list lines `<type> <token>`; blank lines and `#` comments are skipped.

    Output: type, token, reason (NULL when the line is a usable source).
    """
    s = strip(F.col(column))
    kept = lines.select(s.alias("_l")).filter((F.col("_l") != "") & ~F.startswith(F.col("_l"), F.lit("#")))
    parts = F.split(F.col("_l"), r"\s+", 3)
    typ = F.lower(parts.getItem(0))
    token = F.when(F.size(parts) > 1, parts.getItem(1))
    reason = (F.when(~typ.isin(*schema.SOURCE_TYPES), F.concat(F.lit("Unknown source type: "), typ))
              .when(token.isNull(), F.lit("missing board token"))
              .when(F.size(parts) > 2, F.lit("extra text after the token")))
    return kept.select(typ.alias("type"), token.alias("token"), reason.alias("reason"))


_URL_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]+)(?:/([^/?#]*))?"


def board_from_url(url: Column | str) -> Column:
    """struct(type, token, error) of a pasted careers URL (scheme optional, deep links allowed)."""
    u = strip(F.col(url) if isinstance(url, str) else url)
    host = F.lower(F.regexp_extract(u, _URL_PARTS, 1))
    token = F.regexp_extract(u, _URL_PARTS, 2)
    typ = F.lit(None).cast("string")
    for h, t in schema.CAREERS_HOSTS.items():
        typ = F.when(host == h, F.lit(t)).otherwise(typ)
    error = (F.when(typ.isNull(), F.concat(F.lit("not a known careers host: "), host))
             .when(token == "", F.lit("no board token in URL")))
    ok = error.isNull()
    return F.struct(F.when(ok, typ).alias("type"), F.when(ok, token).alias("token"), error.alias("error"))
