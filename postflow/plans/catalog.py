"""Driver queries: one callable per operator group, each (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or what Spark derives from them), runs the
engine's operators over all their rows, and returns the result un-collected.
The SQL oracle of each query is in `postflow.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import has_text
from postflow.operators import board, contacts, extras, ingest, links, materials, terms
from postflow.plans import derive, stand_in
from postflow.plans.derive import table
from postflow.session import scratch_path, shuffle_partitions
from postflow.sources import config
from postflow.sources.store import PostingStore
from postflow.streaming import fetch as fetching
from postflow.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]

stand_in.install()


# ---------------------------------------------------------------------------
# scans (A1-A3, A6, A7, B1-B7, G1, H1)
# ---------------------------------------------------------------------------

def _scan(spark: SparkSession, sf_dir: str, source_type, title_contains=None, location=None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payloads = derive.payloads(docs, source_type, needle=title_contains)
    sources = derive.sources(docs, source_type, title_contains=title_contains, location=location)
    types = [source_type] if isinstance(source_type, str) else None
    return ingest.scan(payloads, sources, types=types).incoming


def greenhouse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "greenhouse")


def ashby_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "ashby")


def rss_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "seek", location="Adelaide")


def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "greenhouse", title_contains="THE")


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, derive.type_by_source())


def payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (reason NULL) and rejects of broken responses, by source and reason."""
    docs = table(spark, sf_dir, "documents")
    res = ingest.scan(derive.broken_payloads(docs), derive.sources(docs, derive.type_by_source()))
    return res.both().groupBy("source_ord", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# upsert (E1, C1, D1, K1, B8)
# ---------------------------------------------------------------------------

def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.stored_postings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(greenhouse_scan(spark, sf_dir), _stored(spark, sf_dir))


def union_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(source_union(spark, sf_dir), _stored(spark, sf_dir))


def ingest_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ingest.with_defaults(ingest.new_postings(greenhouse_scan(spark, sf_dir), _stored(spark, sf_dir)),
                               derive.AS_OF)
    return new.select(*schema.INCOMING_COLUMNS, "date_scraped", "status", "generated_cover_letter",
                      "generated_cold_email", "contact_name", "contact_email", "contact_confidence", "dead_at")


QUERIES: dict[str, Query] = {
    "greenhouse_scan": greenhouse_scan,
    "ashby_scan": ashby_scan,
    "rss_scan": rss_scan,
    "title_filter": title_filter,
    "source_union": source_union,
    "payload_rejects": payload_rejects,
    "ingest_summary": ingest_summary,
    "union_summary": union_summary,
    "ingest_new_rows": ingest_new_rows,
}


# ---------------------------------------------------------------------------
# links (L1-L5, C2, C3, A10, A11, B10, B11, D2, F1, H4-H6, H11)
# ---------------------------------------------------------------------------


def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.page_results(spark, sf_dir)


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.counts(derive.page_results(spark, sf_dir))


def dead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.dead_lines(derive.page_results(spark, sf_dir))


def dead_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    current = derive.page_postings(pages)
    results = links.check_postings(current, derive.page_responses(pages))
    return links.mark_dead(current, results, derive.AS_OF).select("id", "job_board_id", "dead_at")


def check_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = derive.page_postings(table(spark, sf_dir, "pages"))
    return links.check_queue(current, limit=50).select("id", "job_board_id")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.report_lines(derive.page_results(spark, sf_dir))


def fetch_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.reduce_fetch_log(derive.fetch_log(table(spark, sf_dir, "events")))


QUERIES.update({
    "link_status": link_status,
    "link_counts": link_counts,
    "dead_export": dead_export,
    "dead_mark": dead_mark,
    "check_queue": check_queue,
    "report_lines": report_lines,
    "fetch_reduce": fetch_reduce,
})


# ---------------------------------------------------------------------------
# board, queue, prompts, generation
# ---------------------------------------------------------------------------


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.fold_status(derive.event_status_changes(table(spark, sf_dir, "events")))


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.status_history(derive.event_status_changes(table(spark, sf_dir, "events")))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.doc_view(spark, sf_dir)


def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.pending(_view(spark, sf_dir)).select("id", "job_board_id", "title")


def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir)
    return v.agg(
        F.count(F.lit(1)).alias("tracked"),
        F.count_if(F.col("generated_cover_letter").isNull()).alias("pending"),
        F.count_if(has_text("generated_cover_letter")).alias("generated"),
        F.count_if(F.col("generated_cover_letter") == "").alias("shown_missing"),
        F.count_if(F.col("dead_at").isNotNull()).alias("dead"),
    )


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = materials.prompts(materials.pending(_view(spark, sf_dir)), derive.RESUME_SUMMARY)
    return p.select(
        "job_board_id", F.md5("cover_prompt").alias("cover_md5"), F.md5("email_prompt").alias("email_md5"),
        F.length("cover_prompt").cast("long").alias("cover_chars"),
        F.length("email_prompt").cast("long").alias("email_chars"))


def generate_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.run_generation(_view(spark, sf_dir), derive.RESUME_SUMMARY, "echo", derive.AS_OF)


def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    produced = materials.run_generation(view, derive.RESUME_SUMMARY, "echo", derive.AS_OF)
    return materials.run_summary(view, produced)


def board_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.listing(_view(spark, sf_dir), ordered=False)


def board_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.listing(_view(spark, sf_dir), limit=100)


def status_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.normalisation_changes(_view(spark, sf_dir), derive.AS_OF)


def posting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir)
    return board.lookup(v, "doc-7").drop("source", "contact_name", "contact_email", "contact_confidence")


def posting_lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.lookup(_view(spark, sf_dir), id=12).drop("source", "contact_name", "contact_email", "contact_confidence")


def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    new = ingest.new_postings(greenhouse_scan(spark, sf_dir), stored)
    return ingest.assign_ids(new, stored).select("id", "job_board_id")


QUERIES.update({
    "status_fold": status_fold,
    "status_history": status_history,
    "pending_queue": pending_queue,
    "queue_counts": queue_counts,
    "prompt_build": prompt_build,
    "generate_materials": generate_materials,
    "generation_summary": generation_summary,
    "board_view": board_view,
    "board_listing": board_listing,
    "status_normalise": status_normalise,
    "posting_lookup": posting_lookup,
    "posting_lookup_id": posting_lookup_id,
    "assign_ids": assign_ids,
})


# ---------------------------------------------------------------------------
# store and streaming
# ---------------------------------------------------------------------------


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land greenhouse responses, stream them into a store seeded with the
    stored postings, and return the store's postings."""
    base = scratch_path(spark, "ingest-stream")
    docs = table(spark, sf_dir, "documents")
    streaming.land_payloads(derive.payloads(docs, "greenhouse"), f"{base}/landing")
    store = PostingStore(spark, f"{base}/store")
    store.seed(_stored(spark, sf_dir))
    q = streaming.ingest_stream(spark, f"{base}/landing", store, f"{base}/checkpoint", as_of=derive.AS_OF)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return store.postings()


def generate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream stored postings through generation; return the texts the stream wrote."""
    base = scratch_path(spark, "generate-stream")
    store = PostingStore(spark, f"{base}/store")
    store.seed(derive.doc_postings(table(spark, sf_dir, "documents")))
    store.append_materials(derive.label_materials(table(spark, sf_dir, "labels")), batch_id=0)
    q = streaming.generation_stream(spark, store, f"{base}/checkpoint", derive.RESUME_SUMMARY, "echo",
                                    as_of=derive.AS_OF)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    written = store.read("materials", with_batch=True).filter(F.col("writer").startswith("stream-"))
    return written.drop("writer", "batch_id")


def fetch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of each URL land in rounds, the last ones first, and the stream goes
    on after each: the outcomes it wrote."""
    base = scratch_path(spark, "fetch-stream")
    log = derive.fetch_log(table(spark, sf_dir, "events"))
    for attempt in (2, 0, 1):
        log.filter(F.col("attempt") == attempt).write.mode("append").parquet(f"{base}/landing")
        q = fetching.fetch_stream(spark, f"{base}/landing", f"{base}/outcomes", f"{base}/checkpoint")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return spark.read.schema(fetching.OUTCOMES).parquet(f"{base}/outcomes")


def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed a store, ingest one batch twice, edit, compact twice and ingest the batch once
    more: no row or edit is lost or doubled."""
    store = PostingStore(spark, scratch_path(spark, "store-replay"))
    store.seed(_stored(spark, sf_dir))
    payloads = derive.payloads(table(spark, sf_dir, "documents"), "greenhouse")
    for _ in range(2):
        store.ingest_payloads(payloads, None, derive.AS_OF, batch_id=0)
    applied = store.postings().filter("id % 5 = 0").select(
        "job_board_id", F.lit("Applied").alias("status"), F.lit(0).alias("ord"))
    store.edit_statuses(applied, derive.AS_OF, batch_id=0)
    store = PostingStore(spark, store.compact("postings", 1))
    store = PostingStore(spark, store.compact("postings", 2))
    store.ingest_payloads(payloads, None, derive.AS_OF, batch_id=0)
    return store.view()


def store_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `store_replay`, with the stored postings in a version bucketed by key: the batch
    comes after the move and once more as another batch, the edits partly before a
    snapshot and partly after it."""
    store = PostingStore(spark, scratch_path(spark, "store-bucketed"))
    store.seed(_stored(spark, sf_dir))
    store = PostingStore(spark, store.compact("postings", 1, buckets=shuffle_partitions(spark)))
    payloads = derive.payloads(table(spark, sf_dir, "documents"), "greenhouse")
    for batch_id in range(2):
        store.ingest_payloads(payloads, None, derive.AS_OF, batch_id=batch_id)
    edited = store.postings().filter("id % 5 = 0")
    for batch_id, half in enumerate(("id % 2 = 0", "id % 2 = 1")):
        store.edit_statuses(edited.filter(half).select("job_board_id", F.lit("Applied").alias("status"), F.lit(0).alias("ord")),
                            derive.AS_OF, batch_id=batch_id)
        if batch_id == 0:
            store.snapshot()
    return store.view()


def store_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape all boards, move the source to the providers' ids, scrape them again: the
    summaries of both runs (the second adds nothing)."""
    store = PostingStore(spark, scratch_path(spark, "store-rekey"))
    payloads = derive.payloads(table(spark, sf_dir, "documents"), "greenhouse")
    before = store.ingest_payloads(payloads, None, derive.AS_OF, batch_id=0)
    moved = PostingStore(spark, store.rekey("greenhouse", 1))
    after = moved.ingest_payloads(payloads, None, derive.AS_OF, batch_id=1)
    return before.withColumn("run", F.lit(0)).unionByName(after.withColumn("run", F.lit(1)))


def status_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every labelled document's posting, two each in one second and one batch:
    the postings whose status is then not the stored one."""
    store = PostingStore(spark, scratch_path(spark, "status-edit"))
    store.seed(derive.doc_postings(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels")
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("job_board_id")
    first = labels.select(key, F.when(F.col("toxic") == 1, "Rejected").otherwise("Interviewing").alias("status"), F.lit(0).alias("ord"))
    second = labels.select(key, F.when(F.col("quality") == 1, "Applied").otherwise("Rejected").alias("status"), F.lit(1).alias("ord"))
    for _ in range(2):  # the second time nothing is written
        store.edit_statuses(first.unionByName(second), derive.AS_OF, batch_id=5)
    after = store.view().select("id", "job_board_id", "status")
    before = store.postings().select("id", F.col("status").alias("stored_status"))
    return after.join(before, "id").filter("status != stored_status")


QUERIES.update({
    "ingest_stream": ingest_stream,
    "generate_stream": generate_stream,
    "fetch_stream": fetch_stream,
    "store_replay": store_replay,
    "store_bucketed": store_bucketed,
    "store_rekey": store_rekey,
    "status_edit": status_edit,
})


# ---------------------------------------------------------------------------
# configuration and second wave (A4, A5, H2, X1-X16, C2/D4/B11 with shared URLs)
# ---------------------------------------------------------------------------


def _config_sources(docs: DataFrame) -> DataFrame:
    o = derive.source_ord_of()
    typ = (F.when(o % 4 == 0, F.lit("greenhouse")).when(o % 4 == 1, F.lit("ashby"))
           .when(o % 4 == 2, F.lit("seek")).otherwise(F.lit("lever")))
    return docs.select("source").distinct().select(
        o.alias("source_ord"), typ.alias("type"),
        F.concat(F.lit("  "), F.col("source"), F.lit(" Board  ")).alias("token"),
        F.when(typ == "seek", F.concat(F.lit(" Data  Analyst "), F.upper(F.col("source")))).alias("title"),
        F.when(typ == "seek", F.when(o % 8 == 2, F.lit(None)).otherwise(F.lit(" New South Wales ")))
         .cast("string").alias("location"),
        F.lit(None).cast("string").alias("title_contains"))


def plan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listed = _config_sources(docs)
    sources = config.resolve_sources(listed, config.legacy_source(spark, derive.SEARCH_TITLE))
    return config.plan_requests(sources)


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each (source, language): the boards it lists, or, where it
    lists none that are of a known type, its old search block."""
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    config_of = F.concat_ws("/", "source", "lang").alias("config")
    listed = (docs.filter("lang <> 'en'").select("source", "lang").distinct().select(config_of, "*")
              .join(_config_sources(docs).withColumn("source", F.lower(F.trim(F.substring_index("token", " Board", 1))))
                    .filter("type <> 'lever'"), "source")
              .select("config", *[f.name for f in schema.SOURCES.fields]))
    blocks = docs.select("source", "lang").distinct().select(
        config_of, F.concat(F.lit("Data "), F.col("lang")).alias("title"),
        F.when(F.col("lang") == "fr", " Paris ").alias("location"))
    resolved = config.resolve_all(listed, blocks)
    plan = config.with_defaults(resolved).select("config", "source_ord", "type", config.request_url().alias("request_url"))
    return plan.filter(F.col("request_url").isNotNull())


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    line = (F.when(k == 0, F.concat(F.lit("# "), F.col("source"), F.lit(" boards")))
            .when(k == 1, F.lit("   "))
            .when(k == 2, F.concat(F.lit("greenhouse "), F.col("source")))
            .when(k == 3, F.concat(F.lit("  Ashby   "), F.col("source"), F.lit("  ")))
            .when(k == 4, F.concat(F.lit("workday "), F.col("source")))
            .otherwise(F.when(F.expr("(doc_id div 6) % 2") == 0, F.lit("lever"))
                       .otherwise(F.concat(F.lit("lever "), F.col("source"), F.lit(" extra words")))))
    return config.parse_source_lines(docs.select(line.alias("value")))


def board_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    src = F.col("source")
    url = (F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/"), src, F.lit("/jobs/"),
                                   F.col("doc_id").cast("string")))
           .when(k == 1, F.concat(F.lit("job-boards.greenhouse.io/"), src))
           .when(k == 2, F.concat(F.lit("http://jobs.lever.co/"), src, F.lit("?lever-origin=applied")))
           .when(k == 3, F.concat(F.lit("JOBS.ASHBYHQ.COM/"), src, F.lit("/"), F.md5("text")))
           .when(k == 4, F.concat(F.lit("https://careers."), src, F.lit(".example.com/jobs")))
           .otherwise(F.lit("https://jobs.lever.co/")))
    r = config.board_from_url(url)
    return docs.select(F.col("doc_id"), url.alias("url"), r["type"].alias("type"), r["token"].alias("token"),
                       r["error"].alias("error"))


def x_provider_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    pid = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).otherwise(extras.id_from_url("url"))
    return pages.select("page_id", extras.url_without_query("url").alias("url_norm"),
                        extras.provider_key("adzuna", pid, F.col("url")).alias("job_board_id"))


def x_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded view after the move: status, letter and dead time are kept."""
    old = derive.adzuna_tables(table(spark, sf_dir, "pages"))
    new = extras.rekey_tables(old.pop("postings"), "adzuna", **old)
    return board.current_view(new["postings"], new["status_changes"], new["materials"], new["dead_marks"]).select(
        "id", "job_board_id", "status", "generated_cover_letter", "dead_at")


_TITLE_TERMS = ["the", "la", "und"]
_LOCATION_TERMS = ["city of en", "city of fr"]


def x_location_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ashby_scan(spark, sf_dir)
    return rows.filter(extras.matches_filters("title", "location", _TITLE_TERMS, _LOCATION_TERMS))


def x_term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title terms: every two neighbouring words of a benchmark item; location terms: a
    city for each language but French."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    phrases = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
    titles = table(spark, sf_dir, "benchmark").filter(F.size(words) > 1).select(F.lit("title").alias("field"), F.explode(phrases).alias("term"))
    cities = table(spark, sf_dir, "documents").filter("lang <> 'fr'").select(
        F.lit("location").alias("field"), F.concat(F.lit("CITY OF "), F.col("lang")).alias("term")).distinct()
    return terms.matching(ashby_scan(spark, sf_dir), titles.unionByName(cities))


def x_board_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # every fifth board (from position 4) has no postings at all
    payloads = derive.payloads(docs, "greenhouse", needle="THE").withColumn(
        "body", F.when(F.col("source_ord") % 5 == 4, F.lit('{"jobs": []}')).otherwise(F.col("body")))
    res = ingest.scan(payloads, derive.sources(docs, "greenhouse", title_contains="THE"), types=["greenhouse"])
    return extras.board_states(payloads, res.incoming, res.rejects, ["the"], ["city of en", "remote"])


def x_board_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    companies = cust.select(F.col("c_name").alias("company"))
    known = cust.filter(F.col("c_mktsegment") == "BUILDING").select(
        F.lit("greenhouse").alias("type"), extras.company_slug("c_name").alias("token"))
    return extras.board_candidates(companies, known)


def x_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.find_contacts(derive.doc_postings(table(spark, sf_dir, "documents")))


def x_contact_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.guess_contacts(derive.contact_postings(table(spark, sf_dir, "documents")))


def x_bounded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.run_generation(_view(spark, sf_dir), derive.RESUME_SUMMARY, "echo", derive.AS_OF, limit=50)


def x_bounded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.bounded_run_counts(_view(spark, sf_dir), 50)


def x_live_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.still_listed(_view(spark, sf_dir)).select("id", "job_board_id")


def x_manual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    url = F.concat(F.lit("https://manual.example.com/"), F.col("conv_id").cast("string"),
                   F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.col("turn").cast("string"))))
    rows = conv.select(
        F.col("conv_id").cast("int").alias("payload_ord"), F.col("turn").cast("int").alias("entry_ord"),
        derive.first_sentence().alias("title"), F.col("role").alias("company"), F.lit("Remote").alias("location"),
        F.col("text").alias("description"), url.alias("url"))
    inc = extras.manual_postings(rows)
    stored = derive.doc_postings(table(spark, sf_dir, "documents"))
    return ingest.new_postings(inc.select(*schema.INCOMING_COLUMNS), stored).select(
        "payload_ord", "entry_ord", "job_board_id", "title", "company", "url")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def x_search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    nation = _nations(spark, sf_dir)
    locations = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(F.col("n_name").alias("location"))
    country = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("location"), F.col("r_name").alias("country"))
    return extras.search_plan(["data analyst", "data engineer"], locations, country)


def x_location_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    nation = _nations(spark, sf_dir)
    k = F.col("c_custkey") % 3
    raw = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.when(k == 0, F.lower("n_name")).when(k == 1, F.replace("n_name", F.lit("_"), F.lit(" ")))
         .otherwise(F.col("n_name")).alias("location"))
    aliases = nation.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical")).unionByName(
        nation.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("alias"), F.col("n_name").alias("canonical")))
    return extras.canonical_locations(raw, aliases)


def x_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extras.with_source(source_union(spark, sf_dir).drop("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("postings"))


def x_text_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeded = derive.label_materials(table(spark, sf_dir, "labels"))
    return extras.text_history(seeded.unionByName(generate_materials(spark, sf_dir)))


def link_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    posts = derive.shared_url_postings(docs)
    responses = derive.url_responses(posts.select("url").distinct())
    return links.check_postings(posts, responses).select("job_id", "url", "status_code", "live", "error", "status")


QUERIES.update({
    "plan_requests": plan_requests,
    "source_fallback": source_fallback,
    "source_lines": source_lines,
    "board_from_url": board_from_url,
    "x_provider_key": x_provider_key,
    "x_rekey": x_rekey,
    "x_location_filter": x_location_filter,
    "x_term_table": x_term_table,
    "x_board_state": x_board_state,
    "x_board_candidates": x_board_candidates,
    "x_contacts": x_contacts,
    "x_contact_guess": x_contact_guess,
    "x_bounded_run": x_bounded_run,
    "x_bounded_counts": x_bounded_counts,
    "x_live_postings": x_live_postings,
    "x_manual_add": x_manual_add,
    "x_search_plan": x_search_plan,
    "x_location_alias": x_location_alias,
    "x_source_counts": x_source_counts,
    "x_text_history": x_text_history,
    "link_by_url": link_by_url,
})
