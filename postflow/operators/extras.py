"""Second-wave operators described in the original project's notes.

These were planned there but their code is not part of the snapshot; each is
built only as far as the notes specify it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import col, first_non_empty, posting_key, source_of_key

_SCHEME_HOST_PATH = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)"


# X1 ------------------------------------------------------------------------

def url_without_query(url: Column | str) -> Column:
    """scheme://host/path of a URL (query and fragment dropped); '' when it has no scheme."""
    u = col(url)
    return F.concat(F.regexp_extract(u, _SCHEME_HOST_PATH, 1), F.regexp_extract(u, _SCHEME_HOST_PATH, 2))


def provider_key(source: str, provider_id: Column | str | None, url: Column | str) -> Column:
    """Key from the provider's own id when it has one, else from the URL without its query."""
    pid = F.lit(None).cast("string") if provider_id is None else col(provider_id).cast("string")
    return posting_key(F.lit(source), first_non_empty(pid, url_without_query(url)))


# X2 ------------------------------------------------------------------------

def id_from_url(url: Column | str) -> Column:
    """Provider id printed as the last numeric path segment of the URL ('' if none)."""
    return F.regexp_extract(col(url), r"/([0-9]+)/?(?:[?#]|$)", 1)


def _known_id(postings: DataFrame) -> Column:
    """The stored provider id, or the one printed in the URL ('' if none)."""
    return first_non_empty("provider_id", id_from_url("url")) if "provider_id" in postings.columns else id_from_url("url")


def new_keys(postings: DataFrame, source: str) -> DataFrame:
    """(old_key, new_key) of the URL-keyed rows of `source` whose id can be derived."""
    pid = _known_id(postings)
    mine = postings.filter((F.col("source") == F.lit(source)) & (pid != ""))
    pairs = mine.select(F.col("job_board_id").alias("old_key"), posting_key(F.lit(source), pid).alias("new_key"))
    return pairs.filter("old_key != new_key").distinct()


def rekey(postings: DataFrame, source: str) -> DataFrame:
    """Move URL-keyed rows of `source` onto id-derived keys, in place and idempotently.

    Rows whose id cannot be derived keep their key. When an old row and an
    id-keyed row end up with the same key, the id-keyed row is kept (then the
    lowest id). Other sources pass through untouched.
    """
    mine = F.col("source").eqNullSafe(F.lit(source))
    pid = _known_id(postings)
    new_key = F.when(pid != "", posting_key(F.lit(source), pid)).otherwise(F.col("job_board_id"))
    keyed = postings.filter(mine).withColumn("_old_key", F.col("job_board_id")).withColumn("job_board_id", new_key)
    w = Window.partitionBy("job_board_id").orderBy(F.desc(F.col("_old_key") == F.col("job_board_id")), "id")
    kept = keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    kept = kept.withColumn("rekeyed", F.col("_old_key") != F.col("job_board_id")).drop("_rn", "_old_key")
    return kept.unionByName(postings.filter(~mine).withColumn("rekeyed", F.lit(False)))


def rekey_tables(postings: DataFrame, source: str, **sides: DataFrame) -> dict[str, DataFrame]:
    """The postings and their side tables (status edits, texts, dead marks) after the
    move: each side row of a moved key follows it, so nothing a user did is lost."""
    keys = new_keys(postings, source)
    out = {"postings": rekey(postings, source).drop("rekeyed")}
    for name, df in sides.items():
        moved = df.join(keys, df.job_board_id == keys.old_key, "left")
        out[name] = moved.withColumn("job_board_id", F.coalesce("new_key", "job_board_id")).select(*df.columns)
    return out


# X5, X6 --------------------------------------------------------------------

def _any_of(terms: Sequence[str]) -> str:
    """Java regex matching any of the (lower-cased) terms literally."""
    return "|".join(f"\\Q{t.lower()}\\E" if "\\E" not in t else re.escape(t.lower()) for t in terms)


def matches_filters(title: Column | str, location: Column | str, title_terms: Sequence[str],
                    location_terms: Sequence[str]) -> Column:
    """Title holds one of the title terms and the location holds one of the
    location terms, where a remote location always passes. Empty lists pass.

    Each side is one regex over the lower-cased column, so the column is
    referenced once however many terms there are (a filter pushed below the
    adapter's projection repeats the column's whole expression per reference).
    """
    t_ok = F.lit(True) if not title_terms else F.lower(col(title)).rlike(_any_of(title_terms))
    l_ok = F.lit(True) if not location_terms else F.lower(col(location)).rlike(_any_of(["remote", *location_terms]))
    return F.coalesce(t_ok & l_ok, F.lit(False))


def board_states(payloads: DataFrame, incoming: DataFrame, rejects: DataFrame, title_terms: Sequence[str],
                 location_terms: Sequence[str], keep_matching_only: bool = False) -> DataFrame:
    """Every board with a landed response: token, match / live / dead, posting counts.

    dead = every response of the board was rejected; match = at least one
    posting passes the filters; live = it answered but nothing matches (an empty
    board too).
    """
    zero, one = F.lit(0), F.lit(1)
    null_s = F.lit(None).cast("string")
    match = matches_filters("title", "location", title_terms, location_terms).cast("int")

    def counted(df: DataFrame, token: Column, answers: Column, postings: Column, matching: Column, bad: Column) -> DataFrame:
        return df.select("source_ord", token.alias("_token"), answers.alias("_answers"), postings.alias("_n"),
                         matching.alias("_m"), bad.alias("_bad"))

    rows = (counted(payloads, F.col("token"), one, zero, zero, zero)
            .unionByName(counted(incoming, null_s, zero, one, match, zero))
            .unionByName(counted(rejects, null_s, zero, zero, zero, one)))
    per = rows.groupBy("source_ord").agg(
        F.max("_token").alias("token"), F.sum("_answers").cast("long").alias("responses"),
        F.sum("_n").cast("long").alias("postings"), F.sum("_m").cast("long").alias("matching"),
        F.sum("_bad").cast("long").alias("failed_responses"))
    state = (F.when((F.col("failed_responses") >= F.col("responses")) & (F.col("postings") == 0), F.lit("dead"))
             .when(F.col("matching") > 0, F.lit("match")).otherwise(F.lit("live")))
    out = per.withColumn("state", state)
    return out.filter(F.col("state") == "match") if keep_matching_only else out


# X7 ------------------------------------------------------------------------

def company_slug(company: Column | str) -> Column:
    """Board token guess from a company name: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col(company)), r"[^a-z0-9]", "")


def board_candidates(companies: DataFrame, known: DataFrame,
                     types: Sequence[str] = ("greenhouse", "lever", "ashby")) -> DataFrame:
    """(type, token) guesses for every stored company not already a known source."""
    slugs = companies.select(company_slug("company").alias("token")).filter(F.col("token") != "").distinct()
    guesses = slugs.select(F.explode(F.array(*[F.lit(t) for t in types])).alias("type"), "token")
    return guesses.join(known.select("type", "token"), ["type", "token"], "left_anti")


# X8 ------------------------------------------------------------------------

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def find_contacts(postings: DataFrame) -> DataFrame:
    """Contact of each posting not looked up yet (contact_confidence IS NULL).

    A printed email address -> `published`; otherwise `none` (set even on a
    miss so the row leaves the queue). The whole description is searched.
    """
    todo = postings.filter(F.col("contact_confidence").isNull())
    email = F.regexp_extract(F.coalesce(F.col("description"), F.lit("")), EMAIL_PATTERN, 0)
    return todo.select(
        "job_board_id",
        F.lit(None).cast("string").alias("contact_name"),
        F.when(email != "", email).alias("contact_email"),
        F.when(email != "", F.lit(schema.CONTACT_PUBLISHED)).otherwise(F.lit(schema.CONTACT_NONE))
         .alias("contact_confidence"),
    )


# X9 ------------------------------------------------------------------------

def bounded_run_counts(view: DataFrame, limit: int) -> DataFrame:
    """processed / remaining of a generation run limited to `limit` postings (0 = all)."""
    pending = view.filter(F.col("generated_cover_letter").isNull()).agg(F.count(F.lit(1)).alias("_p"))
    return pending.select(
        (F.col("_p") if not limit else F.least(F.col("_p"), F.lit(limit).cast("long"))).alias("processed"),
        (F.lit(0).cast("long") if not limit else F.greatest(F.col("_p") - F.lit(limit), F.lit(0)).cast("long"))
        .alias("remaining"))


# X11, X12 -----------------------------------------------------------------

def still_listed(view: DataFrame) -> DataFrame:
    """Postings not found dead: the table as it is after pruning removed ones."""
    return view.filter(F.col("dead_at").isNull())


def manual_postings(rows: DataFrame) -> DataFrame:
    """Hand-entered postings (title, company, location, description, url) as incoming rows of source `manual`."""
    p_ord = F.col("payload_ord") if "payload_ord" in rows.columns else F.lit(0)
    e_ord = F.col("entry_ord") if "entry_ord" in rows.columns else F.lit(0)
    return rows.select(
        F.lit(0).alias("source_ord"), p_ord.cast("int").alias("payload_ord"), e_ord.cast("int").alias("entry_ord"),
        F.lit("manual").alias("source"),
        posting_key(F.lit("manual"), F.col("url")).alias("job_board_id"),
        "title", "company", "location", "description", "url")


# X13, X14 ------------------------------------------------------------------

def search_plan(titles: Sequence[str], locations: DataFrame, country_of: DataFrame) -> DataFrame:
    """(title, location, country) for every search title and location, each
    location paired with its country through the (small) country map."""
    paired = locations.select("location").distinct().join(country_of.select("location", "country"), "location", "left")
    return paired.select(F.explode(F.array(*[F.lit(t) for t in titles])).alias("title"), "location", "country")


def canonical_locations(raw: DataFrame, aliases: DataFrame, column: str = "location") -> DataFrame:
    """Distinct canonical locations: an alias maps to its canonical name, others stay as they are."""
    a = aliases.select(F.col("alias").alias(column), F.col("canonical"))
    # distinct first (partial aggregate): a location shared by many rows reaches the join once
    return raw.select(column).distinct().join(a, column, "left").select(
        F.coalesce(F.col("canonical"), F.col(column)).alias(column)).distinct()


# X15 -----------------------------------------------------------------------

def with_source(df: DataFrame) -> DataFrame:
    """Add the source name taken from the key prefix (also the store's partition column)."""
    return df.withColumn("source", source_of_key("job_board_id"))


# X16 -----------------------------------------------------------------------

def text_history(materials: DataFrame, job_board_id: str | None = None) -> DataFrame:
    """Every text ever generated, numbered per posting from the first (`version`), with
    `current` on the one the board shows; optionally for one posting. The materials
    table is append-only, so nothing is missing."""
    if job_board_id is not None:
        materials = materials.filter(F.col("job_board_id") == F.lit(job_board_id))
    ok = F.col("error").isNull() & F.col("cover_letter").isNotNull()
    by_time = Window.partitionBy("job_board_id").orderBy("generated_at", "generator", "cover_letter", "cold_email", "error")
    latest = Window.partitionBy("job_board_id").orderBy(
        F.desc(ok), F.desc("generated_at"), F.desc("generator"), F.desc("cover_letter"), F.desc("cold_email"))
    return materials.withColumns({
        "version": F.row_number().over(by_time).cast("long"),
        "current": ok & (F.row_number().over(latest) == 1)})


__all__ = [
    "url_without_query", "provider_key", "id_from_url", "new_keys", "rekey", "rekey_tables", "matches_filters", "board_states",
    "company_slug", "board_candidates", "find_contacts", "bounded_run_counts", "still_listed",
    "manual_postings", "search_plan", "canonical_locations", "with_source", "text_history",
]
