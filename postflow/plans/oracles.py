"""DuckDB SQL oracles of the driver queries.

Each string repeats, in plain SQL over the given tables, what the Spark query
derives and computes; column names and types match the Spark output.
"""

from __future__ import annotations

from postflow import schema as _schema
from postflow.plans.derive import EVENT_STATUS, PAGE_SIZE, RESUME_SUMMARY

# Posting URL of a document (documents with the same text share it).
_U = "'https://jobs.example.com/' || lang || '/' || md5(text)"
_APPLY = "'https://apply.example.com/' || lang || '/' || md5(text)"
_FIRST = "split_part(text, '.', 1)"

# Common columns of a derived board entry.
_DOC = f"""
  SELECT *, doc_id % 10 AS k,
    TRY_CAST(substr(source, 4) AS INTEGER) AS source_ord,
    CAST(doc_id // {PAGE_SIZE} AS INTEGER) AS payload_ord,
    CAST(row_number() OVER (PARTITION BY source, doc_id // {PAGE_SIZE} ORDER BY doc_id) - 1 AS INTEGER) AS pos,
    {_U} AS u
  FROM documents"""

GREENHOUSE_ROWS = f"""
  SELECT source_ord, payload_ord, pos AS entry_ord, 'greenhouse' AS source,
    'greenhouse-' || substr(sha1(CASE WHEN k IN (5, 9) THEN '' ELSE u END), 1, 10) AS job_board_id,
    CASE WHEN k = 3 THEN 'Untitled' WHEN k = 7 THEN NULL ELSE {_FIRST} END AS title,
    source AS company,
    CASE WHEN k IN (0, 4) THEN 'City of ' || lang WHEN k IN (1, 2, 6) THEN '' WHEN k = 8 THEN NULL
         ELSE source END AS location,
    CASE WHEN k = 1 THEN '' ELSE text END AS description,
    CASE WHEN k IN (5, 9) THEN '' ELSE u END AS url,
    doc_id, source AS token
  FROM ({_DOC}) d"""

_ASHBY_LOC = "CASE (doc_id // 10) % 4 WHEN 0 THEN 'City of ' || lang WHEN 3 THEN 'Remote - ' || lang ELSE '' END"

ASHBY_ROWS = f"""
  SELECT source_ord, payload_ord, pos AS entry_ord, 'ashby' AS source,
    'ashby-' || substr(sha1(CASE WHEN k IN (0, 1, 2, 3) THEN u WHEN k IN (4, 5) THEN {_APPLY} ELSE '' END), 1, 10)
      AS job_board_id,
    CASE WHEN k = 3 THEN 'Untitled' WHEN k = 7 THEN NULL ELSE {_FIRST} END AS title,
    source AS company,
    CASE WHEN doc_id % 3 = 0 AND NOT contains(lower({_ASHBY_LOC}), 'remote')
         THEN (CASE WHEN {_ASHBY_LOC} = '' THEN 'Remote' ELSE {_ASHBY_LOC} || ' (Remote)' END)
         ELSE {_ASHBY_LOC} END AS location,
    CASE WHEN k % 2 = 0 THEN text WHEN k % 4 = 1 THEN '<p>' || text || '</p>' ELSE '' END AS description,
    CASE WHEN k IN (0, 1, 2, 3) THEN u WHEN k IN (4, 5) THEN {_APPLY} ELSE '' END AS url,
    doc_id, source AS token
  FROM ({_DOC}) d
  WHERE doc_id % 7 <> 0"""

RSS_ROWS = f"""
  SELECT source_ord, payload_ord, pos AS entry_ord, 'seek' AS source,
    'seek-' || substr(sha1(CASE WHEN k = 5 THEN '' ELSE u END), 1, 10) AS job_board_id,
    CASE WHEN k = 3 THEN 'Untitled' ELSE {_FIRST} END AS title,
    CASE WHEN k IN (2, 7) THEN 'Unknown' ELSE 'Company ' || source END AS company,
    'Adelaide' AS location,
    text AS description,
    CASE WHEN k = 5 THEN '' ELSE u END AS url,
    doc_id, source AS token
  FROM ({_DOC}) d"""

_COLS = "source_ord, payload_ord, entry_ord, source, job_board_id, title, company, location, description, url"

# Keys already stored: the greenhouse key of every labelled document.
STORED_KEYS = f"""
  SELECT DISTINCT 'greenhouse-' || substr(sha1(CASE WHEN doc_id % 10 IN (5, 9) THEN '' ELSE {_U} END), 1, 10)
    AS job_board_id
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""

_OK = "(title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL AND description IS NOT NULL AND url IS NOT NULL)"


# Stored keys with the URL that holds each.
STORED_URLS = f"""
  SELECT 'greenhouse-' || substr(sha1(u), 1, 10) AS job_board_id, min(u) AS held FROM (
    SELECT CASE WHEN doc_id % 10 IN (5, 9) THEN '' ELSE {_U} END AS u
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) s GROUP BY 1"""


def _summary(rows: str) -> str:
    return f"""
WITH inc AS ({rows}),
ranked AS (
  SELECT inc.*, held, {_OK} AS ok,
    row_number() OVER (PARTITION BY inc.job_board_id, {_OK} ORDER BY source_ord, payload_ord, entry_ord) AS rn,
    first_value(url) OVER (PARTITION BY inc.job_board_id, {_OK} ORDER BY source_ord, payload_ord, entry_ord) AS first_url
  FROM inc LEFT JOIN ({STORED_URLS}) h ON inc.job_board_id = h.job_board_id)
SELECT source_ord,
  CASE WHEN grouping(source_ord) = 0 THEN max(source) END AS source,
  CAST(count(*) AS BIGINT) AS seen,
  CAST(sum(CASE WHEN ok AND rn = 1 AND job_board_id NOT IN (SELECT job_board_id FROM ({STORED_KEYS}) s)
                THEN 1 ELSE 0 END) AS BIGINT) AS new,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS rejected,
  CAST(sum(CASE WHEN coalesce(url, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_urls,
  CAST(sum(CASE WHEN ok AND url <> coalesce(held, first_url) THEN 1 ELSE 0 END) AS BIGINT) AS key_collisions
FROM ranked GROUP BY ROLLUP (source_ord)"""


def _new_rows(rows: str) -> str:
    return f"""
WITH inc AS ({rows}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_board_id ORDER BY source_ord, payload_ord, entry_ord) AS rn
  FROM inc WHERE {_OK})
SELECT {_COLS},
  TIMESTAMP '2026-01-01 00:00:00' AS date_scraped, 'To Apply' AS status,
  CAST(NULL AS VARCHAR) AS generated_cover_letter, CAST(NULL AS VARCHAR) AS generated_cold_email,
  CAST(NULL AS VARCHAR) AS contact_name, CAST(NULL AS VARCHAR) AS contact_email,
  CAST(NULL AS VARCHAR) AS contact_confidence, CAST(NULL AS TIMESTAMP) AS dead_at
FROM ranked
WHERE rn = 1 AND job_board_id NOT IN (SELECT job_board_id FROM ({STORED_KEYS}) s)"""


# source type per source position when all adapters run together
_TYPE = "CASE TRY_CAST(substr(token, 4) AS INTEGER) % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' ELSE 'seek' END"

UNION_ROWS = f"""
  SELECT {_COLS} FROM ({GREENHOUSE_ROWS}) g WHERE {_TYPE} = 'greenhouse'
  UNION ALL
  SELECT {_COLS} FROM ({ASHBY_ROWS}) a WHERE {_TYPE} = 'ashby'
  UNION ALL
  SELECT {_COLS} FROM ({RSS_ROWS.replace("'Adelaide'", "'All Australia'")}) r WHERE {_TYPE} = 'seek'"""


# Broken responses by payload_ord % 5 (see derive.broken_payloads).
_ENTRIES = f"""
  SELECT source_ord, payload_ord, doc_id, source_ord % 3 AS t,
    source_ord % 7 = 6 AS unknown, payload_ord % 5 AS c FROM ({_DOC}) d"""
_BROKEN = f"""
  WITH e AS ({_ENTRIES}),
  p AS (SELECT DISTINCT source_ord, payload_ord, t, unknown, c FROM e)
  SELECT source_ord, NULL AS reason, count(*) AS n FROM e
  WHERE NOT unknown AND (c = 0 OR (t = 2 AND c = 1)) AND NOT (t = 1 AND doc_id % 7 = 0) GROUP BY source_ord
  UNION ALL
  SELECT source_ord, reason, count(*) AS n FROM (
    SELECT source_ord, CASE
      WHEN unknown THEN 'Unknown source type: workday'
      WHEN t = 2 AND c = 1 THEN 'feed does not parse; its complete items are kept'
      WHEN t = 2 AND c > 1 THEN 'body is not a feed'
      WHEN c IN (1, 3) THEN 'body is not JSON' WHEN c = 2 THEN 'jobs is not a list'
      WHEN c = 4 THEN 'entry the adapter cannot read' END AS reason
    FROM p) r WHERE reason IS NOT NULL GROUP BY source_ord, reason"""


ORACLES: dict[str, str] = {
    "payload_rejects": _BROKEN,
    "greenhouse_scan": f"SELECT {_COLS} FROM ({GREENHOUSE_ROWS}) g",
    "ashby_scan": f"SELECT {_COLS} FROM ({ASHBY_ROWS}) a",
    "rss_scan": f"SELECT {_COLS} FROM ({RSS_ROWS}) r",
    # with a needle set, a null title fails its whole response (the filter lower-cases it)
    "title_filter": f"""SELECT {_COLS} FROM ({GREENHOUSE_ROWS}) g
      WHERE contains(lower(title), 'the')
        AND NOT EXISTS (SELECT 1 FROM documents d2 WHERE d2.source = g.token
                          AND d2.doc_id // {PAGE_SIZE} = g.doc_id // {PAGE_SIZE} AND d2.doc_id % 10 = 7)""",
    "ingest_summary": _summary(f"SELECT {_COLS} FROM ({GREENHOUSE_ROWS}) g"),
    "ingest_new_rows": _new_rows(f"SELECT {_COLS} FROM ({GREENHOUSE_ROWS}) g"),
    "source_union": f"SELECT {_COLS} FROM ({UNION_ROWS}) u",
    "union_summary": _summary(f"SELECT {_COLS} FROM ({UNION_ROWS}) u"),
}


# ---------------------------------------------------------------------------
# link checking over `pages`
# ---------------------------------------------------------------------------

_PHRASES = _schema.CLOSED_PHRASES
_PHRASE_CASE = "CASE " + " ".join(f"WHEN contains(b, '{p}') THEN '{p}'" for p in _PHRASES) + " END"

LINK_RESULTS = f"""
WITH resp AS (
  SELECT url,
    CASE page_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 503
                     WHEN 5 THEN NULL WHEN 6 THEN 405 ELSE 429 END AS head_code,
    CASE WHEN page_id % 8 IN (0, 1, 6) THEN 200 WHEN page_id % 8 = 2 THEN 404 WHEN page_id % 8 = 3 THEN 410 END
      AS get_code,
    html || CASE page_id % 8 WHEN 1 THEN ' This job is no longer available'
                             WHEN 2 THEN ' no longer accepting applications'
                             WHEN 3 THEN ' Apply for this job'
                             WHEN 6 THEN ' Posting has closed. Job not found' ELSE '' END AS body,
    CASE WHEN page_id % 8 = 5 THEN 'ConnectTimeout' END AS exc
  FROM pages),
eff AS (
  SELECT url, exc,
    CASE WHEN head_code IN (200, 403, 404, 405, 410) THEN get_code ELSE head_code END AS code,
    lower(CASE WHEN head_code IN (200, 403, 404, 405, 410) AND get_code IS NOT NULL THEN body ELSE '' END) AS b
  FROM resp),
ph AS (SELECT *, {_PHRASE_CASE} AS phrase FROM eff),
verdict AS (
  SELECT url,
    CASE WHEN exc IS NOT NULL THEN NULL ELSE code END AS status_code,
    CASE WHEN exc IS NOT NULL THEN false
         WHEN code IN (404, 410) AND contains(b, 'apply for this job') THEN true
         WHEN code IN (404, 410) THEN false
         WHEN code IS NULL OR code <> 200 THEN false
         WHEN phrase IS NOT NULL THEN false ELSE true END AS live,
    CASE WHEN exc IS NOT NULL THEN exc
         WHEN code IN (404, 410) AND contains(b, 'apply for this job') THEN 'live-content-despite-404'
         WHEN code IN (404, 410) THEN NULL
         WHEN code IS NULL OR code <> 200 THEN 'HTTP ' || coalesce(CAST(code AS VARCHAR), 'None')
         WHEN phrase IS NOT NULL THEN 'closed: ''' || phrase || ''''
         ELSE NULL END AS error
  FROM ph),
verdict2 AS (
  SELECT *, CASE WHEN live THEN 'live'
                 WHEN status_code IN (404, 410) OR coalesce(starts_with(error, 'closed:'), false) THEN 'dead'
                 ELSE 'unknown' END AS status
  FROM verdict),
posts AS (
  SELECT page_id AS job_id, 'page-' || CAST(page_id AS VARCHAR) AS job_board_id,
    regexp_extract(url, '://([^/?#]+)', 1) || ' — ' || regexp_extract(html, '<title>(.*?)</title>', 1) AS label,
    CASE WHEN page_id % 16 = 15 THEN '' ELSE url END AS url
  FROM pages WHERE page_id % 11 <> 10)
SELECT p.job_id, p.job_board_id, p.label, p.url,
  CASE WHEN p.url = '' THEN NULL ELSE v.status_code END AS status_code,
  CASE WHEN p.url = '' OR v.url IS NULL THEN false ELSE v.live END AS live,
  CASE WHEN p.url = '' THEN 'no url on record' WHEN v.url IS NULL THEN 'not fetched' ELSE v.error END AS error,
  CASE WHEN p.url = '' OR v.url IS NULL THEN 'unknown' ELSE v.status END AS status
FROM posts p LEFT JOIN verdict2 v ON p.url = v.url"""

FETCH_LOG = """
  SELECT 'https://boards.example.com/e/' || CAST(event_id // 4 AS VARCHAR) AS url,
    CAST(event_id % 4 AS INTEGER) AS attempt,
    CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 404 WHEN 'click' THEN 503 WHEN 'signup' THEN 500 END
      AS code,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN (event_id // 4) % 2 = 0 THEN 'ConnectionError' ELSE 'TooManyRedirects' END END AS exc,
    CASE WHEN value < 5 THEN '<html>oops</html>' ELSE props END AS body
  FROM events"""

ORACLES.update({
    "link_status": f"SELECT * FROM ({LINK_RESULTS}) r",
    "link_counts": f"""SELECT CAST(count_if(status = 'live') AS BIGINT) AS live,
        CAST(count_if(status = 'dead') AS BIGINT) AS dead, CAST(count_if(status = 'unknown') AS BIGINT) AS unknown,
        CAST(count(*) AS BIGINT) AS checked FROM ({LINK_RESULTS}) r""",
    "dead_export": f"""SELECT CAST(job_id AS VARCHAR) || chr(9) || url || chr(9)
        || coalesce(nullif(error, ''), CAST(status_code AS VARCHAR)) AS value
        FROM ({LINK_RESULTS}) r WHERE status = 'dead'""",
    "dead_mark": f"""SELECT page_id AS id, 'page-' || CAST(page_id AS VARCHAR) AS job_board_id,
        CASE WHEN page_id % 11 = 10 THEN TIMESTAMP '2025-12-31 00:00:00'
             WHEN page_id IN (SELECT job_id FROM ({LINK_RESULTS}) r WHERE status = 'dead')
             THEN TIMESTAMP '2026-01-01 00:00:00' END AS dead_at
        FROM pages""",
    "check_queue": """SELECT page_id AS id, 'page-' || CAST(page_id AS VARCHAR) AS job_board_id
        FROM pages WHERE page_id % 11 <> 10 ORDER BY page_id DESC LIMIT 50""",
    "report_lines": f"""SELECT job_id,
        rpad(substr(label, 1, 40), 40, ' ') || ' ' || rpad(status, 7, ' ') || ' '
        || CASE WHEN status_code IS NOT NULL AND status_code <> 0 THEN 'HTTP ' || CAST(status_code AS VARCHAR)
                ELSE '-' END
        || CASE WHEN coalesce(error, '') <> '' THEN '  (' || error || ')' ELSE '' END AS line
        FROM ({LINK_RESULTS}) r""",
    "fetch_reduce": f"""
        WITH capped AS (SELECT *, exc IS NOT DISTINCT FROM 'TooManyRedirects' AS failed,
                          (exc IS NULL AND code < 500) OR exc IS NOT DISTINCT FROM 'TooManyRedirects' AS term
                        FROM ({FETCH_LOG}) l WHERE attempt BETWEEN 0 AND 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY term DESC,
                     CASE WHEN term THEN attempt END ASC, attempt DESC) AS rn FROM capped)
        SELECT url, attempt + 1 AS attempts, code,
          CASE WHEN failed THEN 'failed' WHEN term AND code < 400 AND NOT json_valid(body) THEN 'bad_body'
               WHEN term AND code < 400 THEN 'ok' WHEN term THEN 'client_error' ELSE 'gave_up' END AS outcome,
          CASE WHEN failed THEN exc WHEN term AND code < 400 AND NOT json_valid(body) THEN 'JSONDecodeError'
               WHEN term AND code < 400 THEN NULL WHEN exc IS NOT NULL THEN exc
               ELSE 'HTTP ' || CAST(code AS VARCHAR) END AS error
        FROM r WHERE rn = 1""",
})


# ---------------------------------------------------------------------------
# board, queue, prompts, generation over documents / labels / events
# ---------------------------------------------------------------------------



def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(template: str) -> str:
    """The fixed text with its holes filled; the description, which may hold anything, last."""
    sql = f"replace({_sql_lit(template)}, '{{resume_summary}}', {_sql_lit(RESUME_SUMMARY)})"
    for hole in ("title", "company", "description"):
        sql = f"replace({sql}, '{{{hole}}}', coalesce({hole}, ''))"
    return sql


COVER_SQL = _prompt_sql(_schema.COVER_LETTER_TEMPLATE)
EMAIL_SQL = _prompt_sql(_schema.COLD_EMAIL_TEMPLATE)

_EVENT_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATUS.items()) + " END"

CHANGES = f"""
  SELECT 'doc-' || CAST(user_id AS VARCHAR) AS job_board_id, {_EVENT_STATUS} AS status,
    date_trunc('second', ts) AS changed_at, event_id AS seq
  FROM events"""

LATEST_STATUS = f"""
  SELECT job_board_id, status, changed_at, changes FROM (
    SELECT *, row_number() OVER (PARTITION BY job_board_id ORDER BY changed_at DESC, seq DESC) AS rn,
      count(*) OVER (PARTITION BY job_board_id) AS changes
    FROM ({CHANGES}) c) x
  WHERE rn = 1"""

MATERIALS = """
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS job_board_id,
    CASE WHEN quality = 0 AND toxic = 1 THEN NULL WHEN quality = 1 THEN 'Cover letter ' || CAST(doc_id AS VARCHAR)
         ELSE '' END AS cover_letter,
    CASE WHEN quality = 0 AND toxic = 1 THEN NULL WHEN toxic = 1 THEN ''
         ELSE 'Cold email ' || CAST(doc_id AS VARCHAR) END AS cold_email,
    CASE WHEN quality = 0 AND toxic = 1 THEN 'TimeoutError' END AS error
  FROM labels"""


def _view(with_changes: bool = True, with_dead: bool = True) -> str:
    status = "coalesce(l.status, p.status0)" if with_changes else "p.status0"
    dead = ("CASE WHEN p.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) "
            "THEN TIMESTAMP '2026-01-01 00:00:00' END" if with_dead
            else "CAST(NULL AS TIMESTAMP)")
    return f"""
  SELECT p.id, p.job_board_id, p.title, p.company, p.location, p.description, p.url, p.date_scraped,
    {status} AS status, m.cover_letter AS generated_cover_letter, m.cold_email AS generated_cold_email,
    {dead} AS dead_at
  FROM (SELECT doc_id, doc_id + 1 AS id, 'doc-' || CAST(doc_id AS VARCHAR) AS job_board_id,
          split_part(text, '.', 1) AS title, source AS company, lang AS location, text AS description,
          {_U} AS url,
          TIMESTAMP '2026-01-01 00:00:00' - to_days(CAST(doc_id % 30 AS INTEGER)) AS date_scraped,
          CASE doc_id % 13 WHEN 0 THEN 'Ghosted' WHEN 1 THEN 'Applied' ELSE 'To Apply' END AS status0
        FROM documents) p
  LEFT JOIN ({LATEST_STATUS}) l USING (job_board_id)
  LEFT JOIN (SELECT * FROM ({MATERIALS}) mm WHERE error IS NULL) m USING (job_board_id)"""


_SHOWN = "CASE WHEN status IN ('To Apply', 'Applied', 'Interviewing', 'Rejected') THEN status ELSE 'To Apply' END"
_LISTING = f"""
  SELECT id, job_board_id, date_scraped,
    title || ' — ' || company || '  ·  ' || {_SHOWN} AS header,
    {_SHOWN} AS status_shown,
    length(coalesce(generated_cover_letter, '')) > 0 AS has_cover_letter,
    length(coalesce(generated_cold_email, '')) > 0 AS has_cold_email,
    location, url
  FROM ({_view()}) v"""

_PROMPTS = f"""
  SELECT job_board_id, {COVER_SQL} AS cover_prompt, {EMAIL_SQL} AS email_prompt
  FROM ({_view()}) v WHERE generated_cover_letter IS NULL"""

_GENERATED = f"""
  SELECT job_board_id,
    CASE WHEN md5(cover_prompt) LIKE '00%' OR md5(email_prompt) LIKE '00%' THEN 'GenerationError' END AS error,
    CASE WHEN md5(cover_prompt) LIKE 'f%' THEN ''
         ELSE CAST(length(cover_prompt) AS VARCHAR) || ':' || md5(cover_prompt) END AS c,
    CASE WHEN md5(email_prompt) LIKE 'f%' THEN ''
         ELSE CAST(length(email_prompt) AS VARCHAR) || ':' || md5(email_prompt) END AS e
  FROM ({_PROMPTS}) p"""

_STORED_MAX = f"""
  SELECT max(id) FROM (
    SELECT doc_id + 1 AS id, row_number() OVER (
      PARTITION BY 'greenhouse-' || substr(sha1(CASE WHEN doc_id % 10 IN (5, 9) THEN '' ELSE {_U} END), 1, 10)
      ORDER BY doc_id) AS rn
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) s WHERE rn = 1"""

ORACLES.update({
    "status_fold": f"SELECT * FROM ({LATEST_STATUS}) s",
    "status_history": f"""SELECT job_board_id, status, changed_at, seq,
        lag(status) OVER (PARTITION BY job_board_id ORDER BY changed_at, seq) AS previous_status
        FROM ({CHANGES}) c""",
    "pending_queue": f"SELECT id, job_board_id, title FROM ({_view()}) v WHERE generated_cover_letter IS NULL",
    "queue_counts": f"""SELECT CAST(count(*) AS BIGINT) AS tracked,
        CAST(count_if(generated_cover_letter IS NULL) AS BIGINT) AS pending,
        CAST(count_if(length(coalesce(generated_cover_letter, '')) > 0) AS BIGINT) AS generated,
        CAST(count_if(generated_cover_letter = '') AS BIGINT) AS shown_missing,
        CAST(count_if(dead_at IS NOT NULL) AS BIGINT) AS dead
        FROM ({_view()}) v""",
    "prompt_build": f"""SELECT job_board_id, md5(cover_prompt) AS cover_md5, md5(email_prompt) AS email_md5,
        CAST(length(cover_prompt) AS BIGINT) AS cover_chars, CAST(length(email_prompt) AS BIGINT) AS email_chars
        FROM ({_PROMPTS}) p""",
    "generate_materials": f"""SELECT job_board_id,
        CASE WHEN error IS NULL THEN c END AS cover_letter, CASE WHEN error IS NULL THEN e END AS cold_email,
        'echo' AS generator, TIMESTAMP '2026-01-01 00:00:00' AS generated_at, error
        FROM ({_GENERATED}) g""",
    "generation_summary": f"""SELECT
        CAST(count_if(error IS NULL AND c <> '') AS BIGINT) AS generated,
        CAST(count_if(error IS NULL AND c = '') AS BIGINT) AS empty,
        CAST(count_if(error IS NOT NULL) AS BIGINT) AS failed,
        CAST(count_if(error IS NOT NULL) AS BIGINT) AS remaining
        FROM ({_GENERATED}) g""",
    "board_view": f"SELECT * FROM ({_LISTING}) l",
    "board_listing": f"SELECT * FROM ({_LISTING}) l ORDER BY date_scraped DESC, id DESC LIMIT 100",
    "status_normalise": f"""SELECT job_board_id, 'To Apply' AS status, TIMESTAMP '2026-01-01 00:00:00' AS changed_at,
        CAST(0 AS BIGINT) AS seq FROM ({_view()}) v WHERE {_SHOWN} <> status""",
    "posting_lookup": f"SELECT * FROM ({_view()}) v WHERE job_board_id = 'doc-7'",
    "posting_lookup_id": f"SELECT * FROM ({_view()}) v WHERE id = 12",
    "status_edit": f"""
        WITH p AS (SELECT d.doc_id + 1 AS id, 'doc-' || CAST(d.doc_id AS VARCHAR) AS job_board_id,
                     CASE d.doc_id % 13 WHEN 0 THEN 'Ghosted' WHEN 1 THEN 'Applied' ELSE 'To Apply' END AS stored_status,
                     CASE WHEN quality = 1 THEN 'Applied' ELSE 'Rejected' END AS edited
                   FROM documents d JOIN labels USING (doc_id))
        SELECT id, job_board_id, edited AS status, stored_status FROM p WHERE edited <> stored_status""",
    "assign_ids": f"""
        WITH inc AS ({GREENHOUSE_ROWS}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY job_board_id
                     ORDER BY source_ord, payload_ord, entry_ord) AS rn FROM inc WHERE {_OK}),
        new AS (SELECT * FROM ranked WHERE rn = 1
                  AND job_board_id NOT IN (SELECT job_board_id FROM ({STORED_KEYS}) s))
        SELECT CAST(({_STORED_MAX}) + row_number() OVER (ORDER BY source_ord, payload_ord, entry_ord) AS BIGINT) AS id,
          job_board_id FROM new""",
})


_STORED_ROWS = f"""
  SELECT id, job_board_id, title, company, location, description, url FROM (
    SELECT *, row_number() OVER (PARTITION BY job_board_id ORDER BY id) AS rn FROM (
      SELECT doc_id + 1 AS id, 'greenhouse-' || substr(sha1(gurl), 1, 10) AS job_board_id,
        split_part(text, '.', 1) AS title, source AS company, 'City of ' || lang AS location,
        text AS description, gurl AS url
      FROM (SELECT *, CASE WHEN doc_id % 10 IN (5, 9) THEN '' ELSE {_U} END AS gurl
            FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) a) b) c
  WHERE rn = 1"""

_NEW_WITH_IDS = f"""
  WITH inc AS ({GREENHOUSE_ROWS}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY job_board_id
               ORDER BY source_ord, payload_ord, entry_ord) AS rn FROM inc WHERE {_OK}),
  new AS (SELECT * FROM ranked WHERE rn = 1
            AND job_board_id NOT IN (SELECT job_board_id FROM ({STORED_KEYS}) s))
  SELECT CAST(({_STORED_MAX}) + row_number() OVER (ORDER BY source_ord, payload_ord, entry_ord) AS BIGINT) AS id,
    job_board_id, title, company, location, description, url FROM new"""

_POSTING_TAIL = """TIMESTAMP '2026-01-01 00:00:00' AS date_scraped, 'To Apply' AS status,
    CAST(NULL AS VARCHAR) AS generated_cover_letter, CAST(NULL AS VARCHAR) AS generated_cold_email,
    CAST(NULL AS VARCHAR) AS contact_name, CAST(NULL AS VARCHAR) AS contact_email,
    CAST(NULL AS VARCHAR) AS contact_confidence, CAST(NULL AS TIMESTAMP) AS dead_at, 'greenhouse' AS source"""

ORACLES.update({
    "ingest_stream": f"""
        SELECT *, {_POSTING_TAIL} FROM ({_STORED_ROWS}) s
        UNION ALL
        SELECT *, {_POSTING_TAIL} FROM ({_NEW_WITH_IDS}) n""",
    "generate_stream": ORACLES["generate_materials"],
})
ORACLES["store_replay"] = f"""
    SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'Applied' ELSE status END AS status) FROM ({ORACLES["ingest_stream"]}) p"""
ORACLES["fetch_stream"] = ORACLES["fetch_reduce"]
ORACLES["store_bucketed"] = ORACLES["store_replay"]
ORACLES["store_rekey"] = f"""
    WITH inc AS ({GREENHOUSE_ROWS}),
    r AS (SELECT *, {_OK} AS ok, row_number() OVER (PARTITION BY job_board_id, {_OK}
                 ORDER BY source_ord, payload_ord, entry_ord) = 1 AND {_OK} AS won FROM inc),
    s AS (SELECT source_ord, CASE WHEN source_ord IS NOT NULL THEN 'greenhouse' END AS source, count(*) AS seen,
                 count_if(won) AS new, count_if(NOT ok) AS rejected, count_if(coalesce(url, '') = '') AS blank_urls
          FROM r GROUP BY ROLLUP (source_ord))
    SELECT source_ord, source, seen, CAST(CASE run WHEN 0 THEN new ELSE 0 END AS BIGINT) AS new,
           CAST(rejected AS BIGINT) AS rejected, CAST(blank_urls AS BIGINT) AS blank_urls,
           CAST(0 AS BIGINT) AS key_collisions, run
    FROM s, (VALUES (0), (1)) AS runs(run)"""


# ---------------------------------------------------------------------------
# configuration and second wave
# ---------------------------------------------------------------------------

_SRC_ORD = "TRY_CAST(substr(source, 4) AS INTEGER)"
_CFG = f"""
  SELECT {_SRC_ORD} AS source_ord,
    CASE {_SRC_ORD} % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'seek' ELSE 'lever' END AS type,
    '  ' || source || ' Board  ' AS token,
    ' Data  Analyst ' || upper(source) AS title,
    CASE WHEN {_SRC_ORD} % 8 = 2 THEN NULL ELSE ' New South Wales ' END AS location
  FROM (SELECT DISTINCT source FROM documents) d"""

_URL_NORM = ("regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)', 1) || "
             "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)', 2)")
_PID = "regexp_extract(url, '/([0-9]+)/?(?:[?#]|$)', 1)"

_BFU_URL = """CASE doc_id % 6
      WHEN 0 THEN 'https://boards.greenhouse.io/' || source || '/jobs/' || CAST(doc_id AS VARCHAR)
      WHEN 1 THEN 'job-boards.greenhouse.io/' || source
      WHEN 2 THEN 'http://jobs.lever.co/' || source || '?lever-origin=applied'
      WHEN 3 THEN 'JOBS.ASHBYHQ.COM/' || source || '/' || md5(text)
      WHEN 4 THEN 'https://careers.' || source || '.example.com/jobs'
      ELSE 'https://jobs.lever.co/' END"""
_URL_RE = "'^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]+)(?:/([^/?#]*))?'"

_LINES = """CASE doc_id % 6
      WHEN 0 THEN '# ' || source || ' boards' WHEN 1 THEN '   '
      WHEN 2 THEN 'greenhouse ' || source WHEN 3 THEN '  Ashby   ' || source || '  '
      WHEN 4 THEN 'workday ' || source
      ELSE CASE WHEN (doc_id // 6) % 2 = 0 THEN 'lever' ELSE 'lever ' || source || ' extra words' END END"""

_VIEW_DOCS = _view()

_TITLE_OK = "(contains(lower(title), 'the') OR contains(lower(title), 'la') OR contains(lower(title), 'und'))"
_LOC_OK = ("(contains(lower(location), 'remote') OR contains(lower(location), 'city of en') "
           "OR contains(lower(location), 'city of fr'))")

_SHARED = """
  SELECT doc_id + 1 AS job_id,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'https://jobs.example.com/' || lang || '/' || CAST(doc_id % 50 AS VARCHAR) END
      AS url
  FROM documents"""

ORACLES.update({
    "plan_requests": f"""SELECT source_ord, type,
        CASE type
          WHEN 'seek' THEN 'https://www.seek.com.au/' || lower(replace(trim(title), ' ', '-')) || '-jobs/in-'
                           || lower(replace(trim(coalesce(location, 'All Australia')), ' ', '-')) || '?rss=true'
          WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || trim(token) || '/jobs?content=true'
          WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || trim(token) END AS request_url
        FROM ({_CFG}) c WHERE type <> 'lever'""",
    "source_fallback": f"""
        WITH c AS (SELECT DISTINCT source, lang, source || '/' || lang AS config FROM documents
                   WHERE source IS NOT NULL AND lang IS NOT NULL),
        t AS ({_CFG}),
        l AS (SELECT config, t.* FROM c JOIN t ON trim(t.token) = c.source || ' Board' WHERE lang <> 'en' AND type <> 'lever'),
        u AS (SELECT config, source_ord, type, token, title, location FROM l
              UNION ALL
              SELECT config, 0, 'seek', NULL, 'Data ' || lang, CASE WHEN lang = 'fr' THEN ' Paris ' END FROM c
              WHERE config NOT IN (SELECT config FROM l))
        SELECT config, source_ord, type, CASE type
          WHEN 'seek' THEN 'https://www.seek.com.au/' || lower(replace(trim(title), ' ', '-')) || '-jobs/in-'
            || lower(replace(trim(coalesce(location, 'All Australia')), ' ', '-')) || '?rss=true'
          WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || trim(token) || '/jobs?content=true'
          ELSE 'https://api.ashbyhq.com/posting-api/job-board/' || trim(token) END AS request_url
        FROM u""",
    "source_lines": f"""
        WITH l AS (SELECT trim({_LINES}) AS l FROM documents),
        k AS (SELECT regexp_split_to_array(l, '\\s+') AS p FROM l WHERE l <> '' AND NOT starts_with(l, '#'))
        SELECT lower(p[1]) AS type, CASE WHEN len(p) > 1 THEN p[2] END AS token,
          CASE WHEN lower(p[1]) NOT IN ('seek', 'greenhouse', 'lever', 'ashby', 'adzuna')
                 THEN 'Unknown source type: ' || lower(p[1])
               WHEN len(p) < 2 THEN 'missing board token'
               WHEN len(p) > 2 THEN 'extra text after the token' END AS reason
        FROM k""",
    "board_from_url": f"""
        WITH u AS (SELECT doc_id, {_BFU_URL} AS url FROM documents),
        p AS (SELECT doc_id, url, lower(regexp_extract(url, {_URL_RE}, 1)) AS host,
                     regexp_extract(url, {_URL_RE}, 2) AS tok FROM u),
        t AS (SELECT *, CASE host WHEN 'boards.greenhouse.io' THEN 'greenhouse'
                                  WHEN 'job-boards.greenhouse.io' THEN 'greenhouse'
                                  WHEN 'jobs.lever.co' THEN 'lever' WHEN 'jobs.ashbyhq.com' THEN 'ashby' END AS typ
              FROM p),
        e AS (SELECT *, CASE WHEN typ IS NULL THEN 'not a known careers host: ' || host
                             WHEN tok = '' THEN 'no board token in URL' END AS error FROM t)
        SELECT doc_id, url, CASE WHEN error IS NULL THEN typ END AS type,
          CASE WHEN error IS NULL THEN tok END AS token, error FROM e""",
    "x_provider_key": f"""SELECT page_id, {_URL_NORM} AS url_norm,
        'adzuna-' || substr(sha1(coalesce(nullif(CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {_PID} END, ''),
                                          nullif({_URL_NORM}, ''), '')), 1, 10) AS job_board_id
        FROM pages""",
    "x_rekey": f"""
        WITH s AS (SELECT page_id + 1 AS id, url, {_PID} AS pid,
                     CASE WHEN page_id % 4 = 0 AND {_PID} <> '' THEN 'adzuna-' || substr(sha1({_PID}), 1, 10)
                          ELSE 'adzuna-' || substr(sha1(coalesce(nullif({_URL_NORM}, ''), '')), 1, 10) END AS old_key
                   FROM pages),
        k AS (SELECT *, CASE WHEN pid <> '' THEN 'adzuna-' || substr(sha1(pid), 1, 10) ELSE old_key END AS new_key FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY (old_key = new_key) DESC, id) AS rn FROM k)
        SELECT r.id, r.new_key AS job_board_id, CASE WHEN edited THEN 'Applied' ELSE 'To Apply' END AS status,
          letter AS generated_cover_letter, CASE WHEN dead THEN TIMESTAMP '2026-01-01 00:00:00' END AS dead_at
        FROM r JOIN (SELECT new_key, bool_or((id - 1) % 3 = 0) AS edited, bool_or((id - 1) % 7 = 0) AS dead,
                       max(CASE WHEN (id - 1) % 5 = 0 THEN 'Letter ' || CAST(id - 1 AS VARCHAR) END) AS letter
                     FROM k GROUP BY new_key) f ON r.new_key = f.new_key
        WHERE rn = 1""",
    "x_location_filter": f"""SELECT {_COLS} FROM ({ASHBY_ROWS}) a WHERE coalesce({_TITLE_OK} AND {_LOC_OK}, false)""",
    "x_term_table": f"""
        WITH words AS (SELECT string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM benchmark),
        phrase AS (SELECT DISTINCT lower(w[i] || ' ' || w[i + 1]) AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words) x),
        city AS (SELECT DISTINCT lower('CITY OF ' || lang) AS term FROM documents WHERE lang <> 'fr')
        SELECT {_COLS} FROM ({ASHBY_ROWS}) a
        WHERE EXISTS (SELECT 1 FROM phrase WHERE contains(lower(a.title), term))
          AND (contains(lower(a.location), 'remote') OR EXISTS (SELECT 1 FROM city WHERE contains(lower(a.location), term)))""",
    "x_board_state": f"""
        WITH rows AS (SELECT * FROM ({ORACLES['title_filter']}) f WHERE source_ord % 5 <> 4),
        landed AS (SELECT TRY_CAST(substr(source, 4) AS INTEGER) AS source_ord, max(source) AS token,
                     CAST(count(DISTINCT doc_id // {PAGE_SIZE}) AS BIGINT) AS responses FROM documents GROUP BY 1),
        per AS (SELECT source_ord, CAST(count(*) AS BIGINT) AS postings,
                  CAST(sum(CASE WHEN coalesce(contains(lower(title), 'the') AND (contains(lower(location), 'remote')
                           OR contains(lower(location), 'city of en')),
                           false) THEN 1 ELSE 0 END) AS BIGINT) AS matching
                FROM rows GROUP BY source_ord),
        bad AS (SELECT TRY_CAST(substr(source, 4) AS INTEGER) AS source_ord,
                  CAST(count(DISTINCT doc_id // {PAGE_SIZE}) AS BIGINT) AS failed_responses
                FROM documents WHERE doc_id % 10 = 7 AND TRY_CAST(substr(source, 4) AS INTEGER) % 5 <> 4 GROUP BY 1)
        SELECT l.source_ord, l.token, l.responses, coalesce(p.postings, 0) AS postings,
          coalesce(p.matching, 0) AS matching, coalesce(b.failed_responses, 0) AS failed_responses,
          CASE WHEN coalesce(p.postings, 0) = 0 AND coalesce(b.failed_responses, 0) >= l.responses THEN 'dead'
               WHEN coalesce(p.matching, 0) > 0 THEN 'match' ELSE 'live' END AS state
        FROM landed l LEFT JOIN per p ON l.source_ord = p.source_ord LEFT JOIN bad b ON l.source_ord = b.source_ord""",
    "x_board_candidates": """
        WITH s AS (SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS token FROM customer),
        t AS (SELECT * FROM (VALUES ('greenhouse'), ('lever'), ('ashby')) v(type)),
        known AS (SELECT 'greenhouse' AS type, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS token
                  FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT t.type, s.token FROM s, t WHERE s.token <> ''
          AND NOT EXISTS (SELECT 1 FROM known k WHERE k.type = t.type AND k.token = s.token)""",
    "x_contacts": """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS job_board_id, CAST(NULL AS VARCHAR) AS contact_name,
        nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', 0), '') AS contact_email,
        CASE WHEN regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', 0) <> ''
             THEN 'published' ELSE 'none' END AS contact_confidence
        FROM documents""",
    "x_contact_guess": """
        WITH h AS (SELECT doc_id, text, source, translate(md5(text), '0123456789', 'ghijklmnop') AS h,
                     CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(TRY_CAST(substr(source, 4) AS INTEGER), 0) % 3 END AS style
                   FROM documents),
        n AS (SELECT *, substr(h, 1, 4) AS fst, substr(h, 5, 6) AS lst FROM h),
        c AS (SELECT *, upper(substr(fst, 1, 1)) || substr(fst, 2) AS first0, upper(substr(lst, 1, 1)) || substr(lst, 2) AS last0 FROM n),
        d AS (SELECT doc_id, text || coalesce(CASE
                WHEN doc_id % 5 < 2 THEN ' Recruiter: ' || first0 || ' ' || last0 || ', '
                  || CASE style WHEN 0 THEN fst || '.' || lst WHEN 1 THEN substr(fst, 1, 1) || lst ELSE lst || '.' || fst END
                  || '@' || source || '.example.com'
                WHEN doc_id % 5 < 4 THEN ' Recruiter: ' || first0 || ' ' || last0 || ', https://www.' || source || '.example.com/jobs' END, '')
                AS text FROM c),
        f AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', 0)) AS addr,
                regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', 0) AS email,
                regexp_extract(text, '(?:Contact|Recruiter|Hiring manager): ?([A-Z][A-Za-z''-]+) ([A-Z][A-Za-z''-]+)', 1) AS first,
                regexp_extract(text, '(?:Contact|Recruiter|Hiring manager): ?([A-Z][A-Za-z''-]+) ([A-Z][A-Za-z''-]+)', 2) AS last,
                lower(regexp_extract(text, '(?:https?://(?:www[.])?|www[.])([A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+)', 1)) AS domain
              FROM d),
        p AS (SELECT *, lower(regexp_replace(first, '[''-]', '', 'g')) AS a, lower(regexp_replace(last, '[''-]', '', 'g')) AS b FROM f),
        m AS (SELECT *, [a || '.' || b, a || b, a || '_' || b, a || '-' || b, substr(a, 1, 1) || '.' || b,
                         substr(a, 1, 1) || b, a || substr(b, 1, 1), b || '.' || a, a, b] AS made FROM p),
        v AS (SELECT DISTINCT split_part(addr, '@', 2) AS domain, addr, list_position(made, split_part(addr, '@', 1)) AS i
              FROM m WHERE email <> '' AND first <> '' AND list_contains(made, split_part(addr, '@', 1))),
        w AS (SELECT domain, i, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, i) AS r FROM v GROUP BY domain, i)
        SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS job_board_id, CASE WHEN first <> '' THEN first || ' ' || last END AS contact_name,
          CASE WHEN email <> '' THEN email WHEN first <> '' AND m.domain <> '' THEN made[coalesce(w.i, 1)] || '@' || m.domain END AS contact_email,
          CASE WHEN email <> '' THEN 'published' WHEN first <> '' AND m.domain <> '' THEN 'pattern-guess' ELSE 'none' END AS contact_confidence
        FROM m LEFT JOIN w ON m.domain = w.domain AND w.r = 1""",
    "x_bounded_run": f"""SELECT job_board_id,
        CASE WHEN error IS NULL THEN c END AS cover_letter, CASE WHEN error IS NULL THEN e END AS cold_email,
        'echo' AS generator, TIMESTAMP '2026-01-01 00:00:00' AS generated_at, error
        FROM ({_GENERATED}) g
        WHERE job_board_id IN (SELECT job_board_id FROM ({_VIEW_DOCS}) v WHERE generated_cover_letter IS NULL
                               ORDER BY id LIMIT 50)""",
    "x_bounded_counts": f"""SELECT CAST(least(count(*), 50) AS BIGINT) AS processed,
        CAST(greatest(count(*) - 50, 0) AS BIGINT) AS remaining
        FROM ({_VIEW_DOCS}) v WHERE generated_cover_letter IS NULL""",
    "x_live_postings": f"SELECT id, job_board_id FROM ({_VIEW_DOCS}) v WHERE dead_at IS NULL",
    "x_manual_add": """
        WITH m AS (SELECT CAST(conv_id AS INTEGER) AS payload_ord, CAST(turn AS INTEGER) AS entry_ord,
                     split_part(text, '.', 1) AS title, role AS company,
                     'https://manual.example.com/' || CAST(conv_id AS VARCHAR)
                       || CASE WHEN turn % 2 = 0 THEN '' ELSE '/' || CAST(turn AS VARCHAR) END AS url
                   FROM conversations),
        k AS (SELECT *, 'manual-' || substr(sha1(url), 1, 10) AS job_board_id FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY job_board_id ORDER BY payload_ord, entry_ord) AS rn FROM k
              WHERE title IS NOT NULL AND company IS NOT NULL)
        SELECT payload_ord, entry_ord, job_board_id, title, company, url FROM r WHERE rn = 1""",
    "x_search_plan": """
        WITH loc AS (SELECT DISTINCT n_name AS location FROM customer JOIN nation ON c_nationkey = n_nationkey),
        c AS (SELECT n_name AS location, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT t.title, loc.location, c.country
        FROM loc LEFT JOIN c USING (location), (VALUES ('data analyst'), ('data engineer')) t(title)""",
    "x_location_alias": """
        WITH raw AS (SELECT CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, '_', ' ')
                              ELSE n_name END AS location
                     FROM customer JOIN nation ON c_nationkey = n_nationkey),
        a AS (SELECT lower(n_name) AS alias, n_name AS canonical FROM nation
              UNION ALL SELECT replace(n_name, '_', ' '), n_name FROM nation)
        SELECT DISTINCT coalesce(a.canonical, raw.location) AS location FROM raw LEFT JOIN a ON raw.location = a.alias""",
    "x_source_counts": f"""SELECT split_part(job_board_id, '-', 1) AS source, CAST(count(*) AS BIGINT) AS postings
        FROM ({UNION_ROWS}) u GROUP BY 1""",
    "x_text_history": f"""
        WITH h AS (
          SELECT job_board_id, cover_letter, cold_email, 'seed' AS generator,
            TIMESTAMP '2025-12-31 00:00:00' AS generated_at, error FROM ({MATERIALS}) m
          UNION ALL {ORACLES['generate_materials']})
        SELECT *, row_number() OVER (PARTITION BY job_board_id ORDER BY generated_at) AS version,
          error IS NULL AND row_number() OVER (
            PARTITION BY job_board_id ORDER BY (error IS NULL) DESC, generated_at DESC) = 1 AS current
        FROM h""",
    "link_by_url": f"""
        WITH p AS ({_SHARED}),
        u AS (SELECT DISTINCT url, TRY_CAST(regexp_extract(url, '/([0-9]+)$', 1) AS INTEGER) % 5 AS n FROM p WHERE url <> ''),
        v AS (SELECT url,
                CASE WHEN n = 4 THEN NULL WHEN n IN (0, 3) THEN 200 WHEN n = 1 THEN 404 ELSE 503 END AS status_code,
                n = 0 AS live,
                CASE n WHEN 4 THEN 'ReadTimeout' WHEN 3 THEN 'closed: ''this position has been filled'''
                       WHEN 2 THEN 'HTTP 503' END AS error,
                CASE n WHEN 0 THEN 'live' WHEN 1 THEN 'dead' WHEN 3 THEN 'dead' ELSE 'unknown' END AS status
              FROM u)
        SELECT p.job_id, p.url, CASE WHEN p.url = '' THEN NULL ELSE v.status_code END AS status_code,
          CASE WHEN p.url = '' THEN false ELSE v.live END AS live,
          CASE WHEN p.url = '' THEN 'no url on record' ELSE v.error END AS error,
          CASE WHEN p.url = '' THEN 'unknown' ELSE v.status END AS status
        FROM p LEFT JOIN v ON p.url = v.url""",
})
