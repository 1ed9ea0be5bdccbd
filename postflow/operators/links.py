"""Link liveness over landed HTTP responses, dead marks, export, fetch-retry reduction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions import links as LX
from postflow.functions.text import link_label, reason_or_code, report_line, strip


def classify_responses(responses: DataFrame) -> DataFrame:
    """One verdict per distinct URL: url, status_code, live, error, status.

    Every landed response is classified where it is read (the page body
    shrinks to a small verdict before anything moves). Of a URL landed more than
    once the newest answer counts (one without a time is the oldest; at one time
    the smallest verdict by code, error, live): a minimum over the small verdict
    that is combined before its shuffle.
    """
    age = F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit((1 << 63) - 1)) \
        if "fetched_at" in responses.columns else F.lit(0)
    # the body is lowered and searched once each, in columns of their own
    each = responses.select("url", "exc", age.alias("_age"), LX.effective_code("head_code", "get_code").alias("_code"),
                            LX.effective_body("head_code", "body").alias("_body"))
    each = each.select("url", "exc", "_age", "_code", LX.closed_phrase("_body").alias("_phrase"),
                       F.contains("_body", F.lit(schema.APPLY_MARKER)).alias("_apply"))
    each = each.select("url", "_age", LX.classify("_code", "_phrase", "_apply", "exc").alias("v"))
    one = each.groupBy("url").agg(F.min(F.struct("_age", "v.status_code", "v.error", "v.live")).alias("v"))
    out = one.select("url", "v.status_code", "v.live", "v.error")
    return out.withColumn("status", LX.link_status("status_code", "live", "error"))


def check_queue(current: DataFrame, limit: int = 0, ordered: bool = True) -> DataFrame:
    """Not-dead postings, newest id first; with `limit` N > 0 the N newest, picked
    on the id alone. `ordered=False` leaves the order to the caller (a check of
    all postings needs none)."""
    q = current.filter(F.col("dead_at").isNull())
    if limit:
        q = q.join(q.select("id").orderBy(F.desc("id")).limit(limit), "id", "left_semi")
    return q.orderBy(F.desc("id")) if ordered else q


def check_postings(current: DataFrame, responses: DataFrame, limit: int = 0) -> DataFrame:
    """Verdict for every not-dead posting (optionally the newest `limit`).

    Each distinct URL is classified once and the verdict joined back to every
    posting that carries it. Blank URLs are not looked up and come out as
    unknown / `no url on record`; a URL without a landed response is unknown /
    `not fetched`.
    """
    posts = check_queue(current, limit, ordered=False).select(
        F.col("id").alias("job_id"), "job_board_id",
        link_label("company", F.coalesce(F.col("title"), F.col("job_board_id"))).alias("label"),
        strip(F.coalesce(F.col("url"), F.lit(""))).alias("url"))
    landed = responses.withColumn("url", strip("url")).filter(F.col("url") != "")
    if limit:
        # a bounded check looks only at the URLs of the postings it selected
        landed = landed.join(posts.select("url").distinct(), "url", "left_semi")
    verdicts = classify_responses(landed).withColumnRenamed("url", "_landed")
    # a blank URL looks for a URL that cannot be (one for each posting, so blanks
    # do not all meet in one partition) and finds nothing
    blank = F.col("url") == ""
    wanted = F.when(blank, F.concat(F.lit("\u0000"), F.coalesce(F.col("job_id").cast("string"), F.lit("")))).otherwise(
        F.col("url"))
    joined = posts.withColumn("_wanted", wanted).join(verdicts, F.col("_wanted") == F.col("_landed"), "left")
    missing = F.col("status").isNull()
    return joined.select(
        "job_id", "job_board_id", "label", "url", "status_code",
        F.when(missing, F.lit(False)).otherwise(F.col("live")).alias("live"),
        F.when(blank, F.lit(schema.NO_URL_ERROR)).when(missing, F.lit("not fetched")).otherwise(F.col("error")).alias("error"),
        F.when(missing, F.lit("unknown")).otherwise(F.col("status")).alias("status"),
    )


def counts(results: DataFrame) -> DataFrame:
    """live / dead / unknown / checked counts in one row."""
    return results.agg(
        F.count_if(F.col("status") == "live").alias("live"),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
        F.count(F.lit(1)).alias("checked"),
    )


def dead_lines(results: DataFrame) -> DataFrame:
    """Export lines `id \\t url \\t reason-or-code` of dead postings (one `value` column).

    Written with `write.text`; the column meaning lives in the docs, not in a
    header line, so the files stay splittable.
    """
    dead = results.filter(F.col("status") == "dead")
    return dead.select(
        F.concat_ws("\t", F.col("job_id").cast("string"), F.col("url"),
                    reason_or_code("error", "status_code")).alias("value"))


def export_dead(results: DataFrame, path: str) -> bool:
    """Write the dead-link lines as text files under `path`, only when there are dead links."""
    lines = dead_lines(results)
    if lines.isEmpty():
        return False
    lines.write.mode("overwrite").text(path)
    return True


def dead_marks(results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows to append to the dead-marks table: every dead posting, one shared time."""
    return results.filter(F.col("status") == "dead").select(
        "job_board_id", F.lit(as_of).cast("timestamp_ntz").alias("dead_at"))


def mark_dead(current: DataFrame, results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The current postings with dead_at set on the dead ones (already-dead stay as they were)."""
    dead_ids = results.filter(F.col("status") == "dead").select(F.col("job_id").alias("id")).distinct()
    hit = current.join(dead_ids.withColumn("_dead", F.lit(True)), "id", "left")
    return hit.withColumn(
        "dead_at",
        F.when(F.col("_dead") & F.col("dead_at").isNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("dead_at")),
    ).drop("_dead")


def report_lines(results: DataFrame) -> DataFrame:
    """Readable log line per checked posting."""
    return results.select(
        "job_id", report_line("label", "status", "status_code", "error").alias("line"))


# Exceptions worth another attempt: the connection failed or took too long.
RETRYABLE = ("ConnectionError", "ConnectTimeout", "ReadTimeout", "Timeout", "HTTPError", "SSLError", "ProxyError")


def judged_attempts(fetch_log: DataFrame, retries: int = schema.FETCH_RETRIES,
                    retryable: tuple[str, ...] = RETRYABLE) -> DataFrame:
    """Each attempt up to the cap, without its body: whether it ends the fetch
    (`terminal`), and the outcome and error that stand if it is the last."""
    log = fetch_log.filter(F.col("attempt").between(0, retries))
    failed = F.col("exc").isNotNull() & ~F.col("exc").isin(*retryable)
    answered = F.col("exc").isNull() & (F.col("code") < 500)
    ok = answered & (F.col("code") < 400)
    bad_body = ok & F.try_parse_json("body").isNull()
    outcome = (
        F.when(bad_body, F.lit("bad_body"))
        .when(ok, F.lit("ok"))
        .when(answered, F.lit("client_error"))
        .when(failed, F.lit("failed"))
        .otherwise(F.lit("gave_up"))
    )
    error = (
        F.when(bad_body, F.lit("JSONDecodeError"))
        .when(ok, F.lit(None).cast("string"))
        .when(F.col("exc").isNotNull(), F.col("exc"))
        .otherwise(F.concat(F.lit("HTTP "), F.col("code").cast("string")))
    )
    return log.select("url", "attempt", "code", F.coalesce(failed | answered, F.lit(False)).alias("terminal"),
                      outcome.alias("outcome"), error.alias("error"))


def reduce_fetch_log(fetch_log: DataFrame, retries: int = schema.FETCH_RETRIES,
                     retryable: tuple[str, ...] = RETRYABLE) -> DataFrame:
    """Outcome of the retrying fetch of each URL from its attempt log.

    Attempts run 0..retries. A 2xx/3xx answer ends with the parsed body (or a
    decode error when it is not JSON); a 4xx ends at once, and so does an
    exception that is not `retryable`; 5xx answers and retryable exceptions are
    retried, and after the last attempt the last error stands. Each URL has at
    most retries + 1 rows after the cap, so the window holds a bounded group.
    """
    log = judged_attempts(fetch_log, retries, retryable)
    w = Window.partitionBy("url").orderBy(
        F.desc("terminal"), F.when(F.col("terminal"), F.col("attempt")).asc(), F.col("attempt").desc())
    final = log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return final.select("url", (F.col("attempt") + 1).alias("attempts"), "code", "outcome", "error")



__all__ = [
    "classify_responses", "check_queue", "check_postings", "counts", "dead_lines", "export_dead", "dead_marks",
    "mark_dead", "report_lines", "judged_attempts", "reduce_fetch_log",
]
