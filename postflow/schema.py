"""Table schemas and fixed values of the posting-table engine.

Every table is declared here; nothing is inferred at read time.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values the original pipeline uses, or the
# results differ (keys, statuses, link verdicts, prompt text). Natural order.
# ---------------------------------------------------------------------------

# Known posting statuses; the first one is the default and the fallback.
STATUSES = ["To Apply", "Applied", "Interviewing", "Rejected"]
DEFAULT_STATUS = STATUSES[0]

# Search location used when a feed source gives none.
DEFAULT_LOCATION = "All Australia"

# Phrases that mark a page as a closed posting although it answers 200,
# tested in this order (the first one found is reported).
CLOSED_PHRASES = [
    "no longer accepting applications",
    "this position has been filled",
    "this job is no longer available",
    "posting has closed",
    "job not found",
]

# A 404/410 page that still carries this text is treated as live.
APPLY_MARKER = "apply for this job"

# HEAD codes after which the checker repeats the request as GET.
GET_AFTER_HEAD = [200, 403, 404, 405, 410]

# HTTP codes that mean "gone".
DEAD_CODES = [404, 410]

# Defaults for fields missing from a board entry.
UNTITLED = "Untitled"
UNKNOWN_COMPANY = "Unknown"
NO_URL_ERROR = "no url on record"
LIVE_DESPITE_404 = "live-content-despite-404"

# Request URL templates per source type ({token}, {query}, {loc} are holes).
REQUEST_TEMPLATES = {
    "seek": "https://www.seek.com.au/{query}-jobs/in-{loc}?rss=true",
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{token}/jobs?content=true",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{token}",
}

# Careers-page hosts and the source type each belongs to.
CAREERS_HOSTS = {
    "boards.greenhouse.io": "greenhouse",
    "job-boards.greenhouse.io": "greenhouse",
    "jobs.lever.co": "lever",
    "jobs.ashbyhq.com": "ashby",
}

# Source types a configuration may name, and the ones with an adapter.
SOURCE_TYPES = ["seek", "greenhouse", "lever", "ashby", "adzuna"]

# Fetch retry policy: attempts = retries + 1, back-off = backoff * 2^attempt s.
FETCH_RETRIES = 2
FETCH_BACKOFF = 1.0

# Prompt templates; holes are {title}, {company}, {description}, {resume_summary}.
COVER_LETTER_TEMPLATE = """You are helping a job seeker write a concise, specific cover letter.

Job title: {title}
Company: {company}
Job description:
{description}

Candidate background:
{resume_summary}

Write a 3-paragraph cover letter. Be specific to the role, avoid generic
filler, and do not invent experience that isn't present in the candidate
background.
"""

COLD_EMAIL_TEMPLATE = """Write a brief, direct cold email (under 150 words) to a
hiring manager at {company} about the {title} role. Reference one specific
detail from the job description below. No generic flattery, no filler
sign-off.

Job description:
{description}

Candidate background:
{resume_summary}
"""

# Contact confidence values.
CONTACT_PUBLISHED = "published"
CONTACT_PATTERN_GUESS = "pattern-guess"
CONTACT_NONE = "none"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

S = T.StringType()
L = T.LongType()
I = T.IntegerType()
TS = T.TimestampNTZType()
B = T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# One configured source. source_ord is its list position and decides who wins a
# duplicate key within a run.
SOURCES = _struct(
    ("source_ord", I),
    ("type", S),
    ("token", S),
    ("title", S),
    ("location", S),
    ("title_contains", S),
)

# One landed board response or feed per row. payload_ord orders the responses of
# one source (pages); 0 when a source answers with one body.
PAYLOADS = _struct(
    ("source_ord", I),
    ("payload_ord", I),
    ("type", S),
    ("token", S),
    ("fetched_at", TS),
    ("body", S),
)

# Adapter output. Run order is (source_ord, payload_ord, entry_ord).
INCOMING = _struct(
    ("source_ord", I),
    ("payload_ord", I),
    ("entry_ord", I),
    ("source", S),
    ("job_board_id", S),
    ("title", S),
    ("company", S),
    ("location", S),
    ("description", S),
    ("url", S),
)

INCOMING_COLUMNS = [f.name for f in INCOMING.fields]

# Stored posting. Texts, status changes and dead marks live in their own
# append-only tables and are folded in by the current view.
POSTINGS = _struct(
    ("id", L),
    ("job_board_id", S),
    ("title", S),
    ("company", S),
    ("location", S),
    ("description", S),
    ("url", S),
    ("date_scraped", TS),
    ("status", S),
    ("generated_cover_letter", S),
    ("generated_cold_email", S),
    ("contact_name", S),
    ("contact_email", S),
    ("contact_confidence", S),
    ("dead_at", TS),
    ("source", S),
)

POSTING_COLUMNS = [f.name for f in POSTINGS.fields]

# As the store keeps it: with the provider's id, where the adapter gave one.
STORED_POSTINGS = T.StructType([*POSTINGS.fields, T.StructField("provider_id", S, True)])

# Keys that postings had before their source moved to id keys.
ALIASES = _struct(
    ("old_key", S),
    ("new_key", S),
)

# Batches that were committed in the version before this one.
MARKS = _struct(
    ("name", S),
    ("writer", S),
    ("batch_id", L),
)

# Required posting fields: a null here sends the row to rejects.
REQUIRED = ["job_board_id", "title", "company", "location", "description", "url"]

# Answers of several runs may lie side by side: the newest of a URL counts.
RESPONSES = _struct(
    ("url", S),
    ("head_code", I),
    ("get_code", I),
    ("body", S),
    ("exc", S),
    ("fetched_at", TS),
)

FETCH_LOG = _struct(
    ("url", S),
    ("attempt", I),
    ("code", I),
    ("exc", S),
    ("body", S),
)

STATUS_CHANGES = _struct(
    ("job_board_id", S),
    ("status", S),
    ("changed_at", TS),
    ("seq", L),
)

DEAD_MARKS = _struct(
    ("job_board_id", S),
    ("dead_at", TS),
)

MATERIALS = _struct(
    ("job_board_id", S),
    ("cover_letter", S),
    ("cold_email", S),
    ("generator", S),
    ("generated_at", TS),
    ("error", S),
)

REJECTS = _struct(
    ("source_ord", I),
    ("payload_ord", I),
    ("type", S),
    ("entry_ord", I),
    ("reason", S),
    ("raw", S),
)

# Run summary of one ingest batch (source_ord NULL = all sources).
SUMMARIES = _struct(
    ("source_ord", I),
    ("source", S),
    ("seen", L),
    ("new", L),
    ("rejected", L),
    ("blank_urls", L),
    ("key_collisions", L),
)

LINK_RESULTS = _struct(
    ("job_id", L),
    ("job_board_id", S),
    ("label", S),
    ("url", S),
    ("status_code", I),
    ("live", B),
    ("error", S),
    ("status", S),
)
