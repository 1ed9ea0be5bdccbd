"""Landed inputs derived from the given tables.

The given tables hold no job postings, so each driver query first derives the
landed data the engine reads (board responses, link responses, fetch logs,
status changes) from them, with rules DuckDB can repeat in SQL.

Every document becomes one board entry; its `source` (`src<N>`) is the board
token and `N` the source position. Entries are paged into responses of at most
PAGE_SIZE documents (`doc_id div PAGE_SIZE`), so one payload row stays bounded
however large a source grows. Which fields are missing, JSON null or empty is
chosen by `doc_id % 10` (a CASE on every row, never a filter).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postflow import schema

PAGE_SIZE = 200

# Fixed time stamp of derived runs ("now" of a run is an argument, not a clock).
AS_OF = dt.datetime(2026, 1, 1, 0, 0, 0)

# Search parameters used by derived feed sources.
SEARCH_TITLE = "data analyst"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is (more splits: `spark.sql.files.maxPartitionBytes`)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.col("doc_id") % 10


def first_sentence(text: Column | str = "text") -> Column:
    return F.split_part(F.col(text) if isinstance(text, str) else text, F.lit("."), F.lit(1))


def derived_url(prefix: str = "https://jobs.example.com/") -> Column:
    """Posting URL of a document; documents with the same text share it."""
    return F.concat(F.lit(prefix), F.col("lang"), F.lit("/"), F.md5(F.col("text")))


def source_ord_of(source: Column | str = "source") -> Column:
    c = F.col(source) if isinstance(source, str) else source
    return F.substring(c, 4, 1 << 20).try_cast("int")


def page_of() -> Column:
    return F.expr(f"doc_id div {PAGE_SIZE}").cast("int")


def _v(c: Column) -> Column:
    return c.cast("variant")


def _null_v() -> Column:
    return F.parse_json(F.lit("null"))


def _absent() -> Column:
    return F.lit(None).cast("variant")


# ---------------------------------------------------------------------------
# board entries as JSON text, one per document
# ---------------------------------------------------------------------------

def greenhouse_entry(needle: str | None = None) -> Column:
    """With a needle, entries k = 2 that the title filter skips have a null URL (which
    must not fail their board)."""
    k = _k()
    title = F.when(k == 3, _absent()).when(k == 7, _null_v()).otherwise(_v(first_sentence()))
    url = F.when(k == 5, _v(F.lit(""))).when(k == 9, _absent()).otherwise(_v(derived_url()))
    if needle:
        skipped = ~F.contains(F.lower(first_sentence()), F.lit(needle.lower()))
        url = F.when((k == 2) & skipped, _null_v()).otherwise(url)
    loc_obj = (
        F.when(k.isin(0, 4), F.to_variant_object(F.struct(F.concat(F.lit("City of "), F.col("lang")).alias("name"))))
        .when(k == 1, _null_v())
        .when(k == 2, _absent())
        .when(k == 6, F.parse_json(F.lit("{}")))
        .when(k == 8, F.parse_json(F.lit('{"name": null}')))
        .otherwise(F.to_variant_object(F.struct(F.col("source").alias("name"))))
    )
    # fields that are never JSON null stay plain strings (a SQL NULL is left out)
    content = F.when(k != 1, F.col("text"))
    return F.to_json(F.struct(
        F.col("doc_id").alias("id"), title.alias("title"), url.alias("absolute_url"),
        loc_obj.alias("location"), content.alias("content")))


def ashby_entry() -> Column:
    k = _k()
    title = F.when(k == 3, _absent()).when(k == 7, _null_v()).otherwise(_v(first_sentence()))
    job_url = (
        F.when(k.isin(0, 1, 2, 3), _v(derived_url()))
        .when(k == 4, _v(F.lit("")))
        .when(k == 6, _null_v())
        .when(k == 8, _v(F.lit("")))
        .otherwise(_absent())
    )
    apply_url = (
        F.when(k.isin(4, 5), _v(derived_url("https://apply.example.com/")))
        .when(k == 6, _null_v())
        .when(k == 7, _v(F.lit("")))
        .otherwise(_absent())
    )
    j = F.expr("(doc_id div 10) % 4")
    location = (
        F.when(j == 0, _v(F.concat(F.lit("City of "), F.col("lang"))))
        .when(j == 1, _v(F.lit("")))
        .when(j == 2, _absent())
        .otherwise(_v(F.concat(F.lit("Remote - "), F.col("lang"))))
    )
    r = F.col("doc_id") % 3
    is_remote = F.when(r == 0, _v(F.lit(True))).when(r == 1, _v(F.lit(False))).otherwise(_absent())
    s = F.col("doc_id") % 7
    is_listed = F.when(s == 0, _v(F.lit(False))).when(s == 1, _null_v()).when(s == 3, _absent()).otherwise(_v(F.lit(True)))
    plain = F.when(k % 2 == 0, F.col("text")).otherwise(F.lit(""))
    html = F.when(k % 4 == 1, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    return F.to_json(F.struct(
        F.col("doc_id").alias("id"), title.alias("title"), job_url.alias("jobUrl"),
        apply_url.alias("applyUrl"), location.alias("location"), is_remote.alias("isRemote"),
        is_listed.alias("isListed"), plain.alias("descriptionPlain"), html.alias("descriptionHtml")))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def rss_item() -> Column:
    k = _k()

    def el(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), xml_escape(value), F.lit(f"</{tag}>"))

    return F.concat(
        F.lit("<item>"),
        F.when(k == 3, F.lit("")).otherwise(el("title", first_sentence())),
        F.when(k == 5, F.lit("")).otherwise(el("link", derived_url())),
        el("description", F.col("text")),
        F.when(k.isin(2, 7), F.lit("")).otherwise(el("author", F.concat(F.lit("Company "), F.col("source")))),
        F.lit("</item>"),
    )


def _wrap(source_type: str, parts: Column) -> Column:
    if source_type == "seek":
        return F.concat(F.lit("<rss version=\"2.0\"><channel><title>feed</title>"), F.array_join(parts, ""),
                        F.lit("</channel></rss>"))
    return F.concat(F.lit('{"jobs":['), F.array_join(parts, ","), F.lit("]}"))


def type_by_source() -> Column:
    """Source type of a document's source when all three adapters run together."""
    o = source_ord_of() % 3
    return F.when(o == 0, F.lit("greenhouse")).when(o == 1, F.lit("ashby")).otherwise(F.lit("seek"))


def payloads(documents: DataFrame, source_type: str | Column, needle: str | None = None) -> DataFrame:
    """Board responses built from documents: one row per (source, page).

    `source_type` is one type for all sources, or a column choosing it per
    document (all documents of one source must get the same type).
    """
    builders = {"greenhouse": lambda: greenhouse_entry(needle), "ashby": ashby_entry, "seek": rss_item}
    if isinstance(source_type, str):
        typ, entry = F.lit(source_type), builders[source_type]()
    else:
        typ = source_type
        entry = F.when(typ == "greenhouse", greenhouse_entry()).when(typ == "ashby", ashby_entry()).otherwise(rss_item())
    docs = documents.select(
        source_ord_of().alias("source_ord"), page_of().alias("payload_ord"), typ.alias("type"),
        F.col("source").alias("token"), F.struct(F.col("doc_id"), entry.alias("j")).alias("p"))
    grouped = docs.groupBy("source_ord", "payload_ord", "type", "token").agg(
        F.array_sort(F.collect_list("p")).alias("ps"))
    parts = F.transform(F.col("ps"), lambda x: x["j"])
    if isinstance(source_type, str):
        body = _wrap(source_type, parts)
    else:
        body = F.when(F.col("type") == "seek", _wrap("seek", parts)).otherwise(_wrap("greenhouse", parts))
    return grouped.select(
        "source_ord", "payload_ord", "type", "token",
        F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"), body.alias("body"))


def broken_payloads(documents: DataFrame) -> DataFrame:
    """The mixed board responses, broken by `payload_ord % 5`; every seventh source
    (from position 6) has a type no adapter knows."""
    rows = payloads(documents, type_by_source())
    c = F.col("payload_ord") % 5
    feed = F.col("type") == "seek"
    tail = F.lit(len("</channel></rss>"))
    cut = F.substring(F.col("body"), F.lit(1), F.length("body") - F.when(feed, tail).otherwise(F.lit(1)))
    body = (F.when(c == 1, cut)
            .when(c == 2, F.when(feed, F.lit("<html><body>error</body></html>")).otherwise(F.lit('{"jobs": null}')))
            .when(c == 3, F.lit(""))
            .when(c == 4, F.when(feed, F.lit("<feed><entry>x</entry></feed>")).otherwise(F.lit('{"jobs": [1]}')))
            .otherwise(F.col("body")))
    known = F.when(F.col("source_ord") % 7 == 6, F.lit("workday")).otherwise(F.col("type"))
    return rows.withColumns({"body": body, "type": known})


def sources(documents: DataFrame, source_type: str | Column, title_contains: str | None = None,
            location: str | None = None) -> DataFrame:
    """One configured source per document source (`src<N>` -> position N)."""
    typ = F.lit(source_type) if isinstance(source_type, str) else source_type
    is_seek = F.lit(source_type == "seek") if isinstance(source_type, str) else typ == "seek"
    return documents.select("source").distinct().select(
        source_ord_of().alias("source_ord"), typ.alias("type"), F.col("source").alias("token"),
        F.when(is_seek, F.lit(SEARCH_TITLE)).alias("title"),
        F.when(is_seek, F.lit(location)).cast("string").alias("location"),
        F.lit(title_contains).cast("string").alias("title_contains"))


def greenhouse_url() -> Column:
    """URL the greenhouse adapter reads for a document (empty for k in 5, 9)."""
    return F.when(_k().isin(5, 9), F.lit("")).otherwise(derived_url())


def stored_postings(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings already in the table: the greenhouse posting of each labelled document.

    Keys are unique (the first document of a key by doc_id wins) and ids are
    doc_id + 1, so later runs see a realistic stored table.
    """
    from postflow.functions.text import posting_key
    from postflow.operators.ingest import with_defaults

    docs = documents.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = docs.select(
        (F.col("doc_id") + 1).alias("id"),
        posting_key(F.lit("greenhouse"), greenhouse_url()).alias("job_board_id"),
        F.coalesce(first_sentence(), F.lit(schema.UNTITLED)).alias("title"),
        F.col("source").alias("company"),
        F.concat(F.lit("City of "), F.col("lang")).alias("location"),
        F.col("text").alias("description"),
        greenhouse_url().alias("url"),
        F.lit("greenhouse").alias("source"),
    )
    w = Window.partitionBy("job_board_id").orderBy("id")
    first = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return with_defaults(first, AS_OF).select(*schema.POSTING_COLUMNS)


# ---------------------------------------------------------------------------
# link checking inputs from `pages`
# ---------------------------------------------------------------------------

# Text appended to page bodies per case (test pages carry none of the phrases).
_GONE_TEXT = " no longer accepting applications"
_CLOSED_TEXT = " This job is no longer available"
_APPLY_TEXT = " Apply for this job"
_TWO_PHRASES = " Posting has closed. Job not found"
BLANK_URL = " \t\u00a0"


def page_case() -> Column:
    return F.col("page_id") % 8


def page_url() -> Column:
    """Stored URL of a page posting; every 16th is blank (spaces, tab, no-break space)."""
    return F.when(F.col("page_id") % 16 == 15, F.lit(BLANK_URL)).otherwise(F.col("url"))


def page_postings(pages: DataFrame) -> DataFrame:
    """One stored posting per page: id = page_id, title from <title>, company = host."""
    null_s = F.lit(None).cast("string")
    return pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("job_board_id"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("company"),
        F.lit("").alias("location"),
        F.lit("").alias("description"),
        page_url().alias("url"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("date_scraped"),
        F.lit(schema.DEFAULT_STATUS).alias("status"),
        null_s.alias("generated_cover_letter"), null_s.alias("generated_cold_email"),
        null_s.alias("contact_name"), null_s.alias("contact_email"), null_s.alias("contact_confidence"),
        # every 11th page was already found dead earlier and is not checked again
        F.when(F.col("page_id") % 11 == 10, F.lit(AS_OF - dt.timedelta(days=1)).cast("timestamp_ntz"))
         .otherwise(F.lit(None).cast("timestamp_ntz")).alias("dead_at"),
        F.lit("page").alias("source"),
    )


def page_responses(pages: DataFrame) -> DataFrame:
    """Landed HEAD/GET answers per page URL, case by page_id % 8."""
    c = page_case()
    head = (F.when(c.isin(0, 1), 200).when(c == 2, 404).when(c == 3, 410).when(c == 4, 503)
            .when(c == 5, None).when(c == 6, 405).otherwise(429))
    get = F.when(c.isin(0, 1, 6), 200).when(c == 2, 404).when(c == 3, 410)
    extra = (F.when(c == 1, F.lit(_CLOSED_TEXT)).when(c == 2, F.lit(_GONE_TEXT)).when(c == 3, F.lit(_APPLY_TEXT))
             .when(c == 6, F.lit(_TWO_PHRASES)).otherwise(F.lit("")))
    return pages.select(
        F.col("url"),
        head.cast("int").alias("head_code"),
        get.cast("int").alias("get_code"),
        F.when(get.isNotNull(), F.concat(F.col("html"), extra)).alias("body"),
        F.when(c == 5, F.lit("ConnectTimeout")).alias("exc"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"),
    )


def page_results(spark: SparkSession, sf_dir: str, limit: int = 0) -> DataFrame:
    from postflow.operators import links

    pages = table(spark, sf_dir, "pages")
    return links.check_postings(page_postings(pages), page_responses(pages), limit=limit)


# ---------------------------------------------------------------------------
# fetch attempt log from `events`
# ---------------------------------------------------------------------------

def fetch_log(events: DataFrame) -> DataFrame:
    """Attempt log: every 4 consecutive events are the attempts 0..3 of one URL
    (attempt 3 lies beyond the default cap of 2 retries and must be ignored). Errors
    of every second URL are redirect loops, which no retry mends."""
    e = F.col("event_type")
    code = F.when(e == "view", 200).when(e == "purchase", 404).when(e == "click", 503).when(e == "signup", 500)
    return events.select(
        F.concat(F.lit("https://boards.example.com/e/"), F.expr("event_id div 4").cast("string")).alias("url"),
        (F.col("event_id") % 4).cast("int").alias("attempt"),
        code.cast("int").alias("code"),
        F.when(e == "error", F.when(F.expr("event_id div 4") % 2 == 0, F.lit("ConnectionError"))
               .otherwise(F.lit("TooManyRedirects"))).alias("exc"),
        F.when(F.col("value") < 5, F.lit("<html>oops</html>")).otherwise(F.col("props")).alias("body"),
    )


# ---------------------------------------------------------------------------
# stored postings, texts, status changes and dead marks from documents/labels/events
# ---------------------------------------------------------------------------

RESUME_SUMMARY = "Data analyst with five years of SQL, Python and dashboard work in retail and health."

# Status names events stand for (the last one is not a known status).
EVENT_STATUS = {"view": "To Apply", "click": "Applied", "purchase": "Interviewing",
                "signup": "Rejected", "error": "On Hold"}


def doc_key() -> Column:
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))


def doc_postings(documents: DataFrame) -> DataFrame:
    """One stored posting per document, keyed `doc-<doc_id>`, id doc_id + 1."""
    null_s = F.lit(None).cast("string")
    st = F.col("doc_id") % 13
    return documents.select(
        (F.col("doc_id") + 1).alias("id"),
        doc_key().alias("job_board_id"),
        first_sentence().alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        derived_url().alias("url"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("date_scraped"),
        F.when(st == 0, F.lit("Ghosted")).when(st == 1, F.lit("Applied")).otherwise(F.lit(schema.DEFAULT_STATUS))
         .alias("status"),
        null_s.alias("generated_cover_letter"), null_s.alias("generated_cold_email"),
        null_s.alias("contact_name"), null_s.alias("contact_email"), null_s.alias("contact_confidence"),
        F.lit(None).cast("timestamp_ntz").alias("dead_at"),
        F.lit("doc").alias("source"),
    )


def contact_postings(documents: DataFrame) -> DataFrame:
    """Postings whose description ends, by `doc_id % 5`, with a contact's name and address
    (0, 1), a name and the company's web address (2, 3) or nothing more. The names are
    made of the text's hash; an address follows one of three patterns, mostly that of
    its source."""
    k = F.col("doc_id") % 5
    h = F.translate(F.md5("text"), "0123456789", "ghijklmnop")
    first, last = F.initcap(F.substr(h, F.lit(1), F.lit(4))), F.initcap(F.substr(h, F.lit(5), F.lit(6)))
    domain = F.concat(F.col("source"), F.lit(".example.com"))
    style = F.when(F.col("doc_id") % 7 == 0, F.lit(0)).otherwise(F.coalesce(source_ord_of(), F.lit(0)) % 3)
    local = (F.when(style == 0, F.concat(first, F.lit("."), last)).when(style == 1, F.concat(F.left(first, F.lit(1)), last))
             .otherwise(F.concat(last, F.lit("."), first)))
    name = F.concat(F.lit(" Recruiter: "), first, F.lit(" "), last)
    tail = (F.when(k < 2, F.concat(name, F.lit(", "), F.lower(local), F.lit("@"), domain))
            .when(k < 4, F.concat(name, F.lit(", https://www."), domain, F.lit("/jobs"))))
    return doc_postings(documents.withColumn("text", F.concat("text", F.coalesce(tail, F.lit("")))))


def label_materials(labels: DataFrame) -> DataFrame:
    """Texts generated earlier for labelled documents: quality 0 gives an empty
    letter, toxic 1 an empty email, both together a failed run (still pending)."""
    failed = (F.col("quality") == 0) & (F.col("toxic") == 1)
    return labels.select(
        doc_key().alias("job_board_id"),
        F.when(failed, None).when(F.col("quality") == 1, F.concat(F.lit("Cover letter "), F.col("doc_id").cast("string")))
         .otherwise(F.lit("")).alias("cover_letter"),
        F.when(failed, None).when(F.col("toxic") == 1, F.lit(""))
         .otherwise(F.concat(F.lit("Cold email "), F.col("doc_id").cast("string"))).alias("cold_email"),
        F.lit("seed").alias("generator"),
        F.lit(AS_OF - dt.timedelta(days=1)).cast("timestamp_ntz").alias("generated_at"),
        F.when(failed, F.lit("TimeoutError")).alias("error"),
    )


def event_status_changes(events: DataFrame) -> DataFrame:
    """Status edits: user N edits posting doc-N; several may share one second."""
    e = F.col("event_type")
    status = F.lit(None).cast("string")
    for k, v in EVENT_STATUS.items():
        status = F.when(e == k, F.lit(v)).otherwise(status)
    return events.select(
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("job_board_id"),
        status.alias("status"),
        F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("changed_at"),
        F.col("event_id").alias("seq"),
    )


def doc_dead_marks(labels: DataFrame) -> DataFrame:
    """Dead marks: postings of toxic-labelled documents were found dead at AS_OF;
    those also of low quality were marked a second time a day later (the fold
    keeps the first mark)."""
    toxic = labels.filter(F.col("toxic") == 1)
    first = toxic.select(doc_key().alias("job_board_id"), F.lit(AS_OF).cast("timestamp_ntz").alias("dead_at"))
    again = toxic.filter(F.col("quality") == 0).select(
        doc_key().alias("job_board_id"), F.lit(AS_OF + dt.timedelta(days=1)).cast("timestamp_ntz").alias("dead_at"))
    return first.unionByName(again)


def doc_view(spark: SparkSession, sf_dir: str, with_changes: bool = True, with_dead: bool = True) -> DataFrame:
    from postflow.operators.board import current_view

    docs = table(spark, sf_dir, "documents")
    return current_view(
        doc_postings(docs),
        status_changes=event_status_changes(table(spark, sf_dir, "events")) if with_changes else None,
        materials=label_materials(table(spark, sf_dir, "labels")),
        dead_marks=doc_dead_marks(table(spark, sf_dir, "labels")) if with_dead else None,
    )


# ---------------------------------------------------------------------------
# postings sharing URLs (each distinct URL is checked once)
# ---------------------------------------------------------------------------

def shared_url_postings(documents: DataFrame) -> DataFrame:
    """One posting per document; URLs repeat across documents and every 13th is blank."""
    null_s = F.lit(None).cast("string")
    url = F.when(F.col("doc_id") % 13 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("https://jobs.example.com/"), F.col("lang"), F.lit("/"), (F.col("doc_id") % 50).cast("string")))
    return documents.select(
        (F.col("doc_id") + 1).alias("id"), doc_key().alias("job_board_id"), first_sentence().alias("title"),
        F.col("source").alias("company"), url.alias("url"),
        F.lit(None).cast("timestamp_ntz").alias("dead_at"), null_s.alias("status"))


def url_responses(urls: DataFrame) -> DataFrame:
    """Two landed answers per distinct URL: a day ago all were open; the newer one
    goes by the number at the end of the URL."""
    n = F.regexp_extract("url", "/([0-9]+)$", 1).try_cast("int") % 5
    some = urls.filter(F.col("url") != "  ")
    newer = some.select(
        "url",
        F.when(n.isin(0, 3), 200).when(n == 1, 404).when(n == 2, 503).cast("int").alias("head_code"),
        F.when(n.isin(0, 3), 200).when(n == 1, 404).cast("int").alias("get_code"),
        F.when(n == 3, F.lit("<p>This position has been filled</p>")).when(n.isin(0, 1), F.lit("<p>open</p>"))
         .alias("body"),
        F.when(n == 4, F.lit("ReadTimeout")).alias("exc"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"))
    older = some.select(
        "url", F.lit(200).alias("head_code"), F.lit(200).alias("get_code"), F.lit("<p>open</p>").alias("body"),
        F.lit(None).cast("string").alias("exc"),
        F.lit(AS_OF - dt.timedelta(days=1)).cast("timestamp_ntz").alias("fetched_at"))
    return newer.unionByName(older)


# ---------------------------------------------------------------------------
# URL-keyed postings to be moved onto id-derived keys
# ---------------------------------------------------------------------------

def adzuna_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """Postings of one source keyed by URL (every fourth with an id already by id), and
    status edits, texts and dead marks on the old keys of every 3rd, 5th and 7th page."""
    from postflow.functions.text import posting_key
    from postflow.operators import extras

    pid = extras.id_from_url("url")
    by_id = (F.col("page_id") % 4 == 0) & (pid != "")
    key = F.when(by_id, posting_key(F.lit("adzuna"), pid)).otherwise(
        extras.provider_key("adzuna", F.lit(None).cast("string"), F.col("url")))
    stamp = F.lit(AS_OF).cast("timestamp_ntz")
    postings = page_postings(pages).withColumns({
        "id": F.col("id") + 1, "source": F.lit("adzuna"), "dead_at": F.lit(None).cast("timestamp_ntz")})
    keys = pages.select(F.col("page_id") + 1, key.alias("job_board_id"), "url").toDF("id", "job_board_id", "url")
    postings = postings.drop("job_board_id", "url").join(keys, "id").select(*schema.POSTING_COLUMNS)
    at = lambda n: pages.filter(F.col("page_id") % n == 0)
    return {
        "postings": postings,
        "status_changes": at(3).select(key.alias("job_board_id"), F.lit("Applied").alias("status"),
                                       stamp.alias("changed_at"), F.col("page_id").alias("seq")),
        "materials": at(5).select(key.alias("job_board_id"),
                                  F.concat(F.lit("Letter "), F.col("page_id").cast("string")).alias("cover_letter"),
                                  F.lit("").alias("cold_email"), F.lit("seed").alias("generator"),
                                  stamp.alias("generated_at"), F.lit(None).cast("string").alias("error")),
        "dead_marks": at(7).select(key.alias("job_board_id"), stamp.alias("dead_at")),
    }
