import pytest
from helpers import AS_OF, postings

from postflow import schema
from postflow.operators import links


def responses(spark, rows):
    """rows: (url, head, get, body, exc) -> responses fetched at one time."""
    return spark.createDataFrame([(*r, AS_OF) for r in rows], schema.RESPONSES)


CASES = [
    # url, head, get, body, exc -> code, live, error, status
    ("https://x/exc", None, None, None, "ConnectTimeout", None, False, "ConnectTimeout", "unknown"),
    ("https://x/404apply", 404, 404, "<a>Apply for this job</a>", None, 404, True, "live-content-despite-404", "live"),
    ("https://x/404", 404, 404, "gone", None, 404, False, None, "dead"),
    ("https://x/410closed", 410, 410, "Job not found", None, 410, False, None, "dead"),
    ("https://x/500", 500, None, None, None, 500, False, "HTTP 500", "unknown"),
    ("https://x/403", 403, 403, "", None, 403, False, "HTTP 403", "unknown"),
    ("https://x/429", 429, None, None, None, 429, False, "HTTP 429", "unknown"),
    ("https://x/closed", 200, 200, "Sorry, this JOB is No Longer Available. Job not found",
     None, 200, False, "closed: 'this job is no longer available'", "dead"),
    ("https://x/twophrases", 405, 200, "posting has closed / no longer accepting applications",
     None, 200, False, "closed: 'no longer accepting applications'", "dead"),
    ("https://x/live", 200, 200, "<h1>Apply now</h1>", None, 200, True, None, "live"),
]


@pytest.fixture(scope="module")
def results(spark):
    posts = postings(spark, [{"id": i + 1, "url": c[0], "job_board_id": f"k{i}"} for i, c in enumerate(CASES)]
                     + [{"id": 100, "url": " \t ", "job_board_id": "blank"},
                        {"id": 101, "url": "https://x/live", "job_board_id": "dup"},
                        {"id": 102, "url": "https://x/dead-before", "job_board_id": "old", "dead_at": AS_OF},
                        {"id": 103, "url": "https://x/never", "job_board_id": "nf"}])
    resp = responses(spark, [c[:5] for c in CASES])
    return posts, links.check_postings(posts, resp)


def test_rules(results):
    _, res = results
    assert [(f.name, f.dataType) for f in res.schema] == [(f.name, f.dataType) for f in schema.LINK_RESULTS]
    got = {r.job_id: r for r in res.collect()}
    for i, c in enumerate(CASES):
        r = got[i + 1]
        assert (r.status_code, r.live, r.error, r.status) == c[5:], c[0]


def test_blank_dup_dead_and_missing(results):
    _, res = results
    got = {r.job_id: r for r in res.collect()}
    assert (got[100].url, got[100].error, got[100].status) == ("", "no url on record", "unknown")
    assert got[101].status == "live"  # shares the verdict of its URL
    assert 102 not in got  # already dead: not re-checked
    assert (got[103].error, got[103].status) == ("not fetched", "unknown")


def test_counts_and_export(results):
    _, res = results
    c = links.counts(res).collect()[0]
    assert c.live + c.dead + c.unknown == c.checked == res.count()
    lines = sorted(r.value for r in links.dead_lines(res).collect())
    assert "3\thttps://x/404\t404" in lines
    assert "8\thttps://x/closed\tclosed: 'this job is no longer available'" in lines


def test_mark_dead(results, spark):
    posts, res = results
    marked = {r.id: r.dead_at for r in links.mark_dead(posts, res, AS_OF.replace(year=2027)).collect()}
    assert marked[3].year == 2027 and marked[10] is None and marked[102] == AS_OF
    assert links.dead_marks(res, AS_OF).count() == 4  # 404, 410 + closed text, two closed pages


def test_check_queue_limit(spark):
    posts = postings(spark, [{"id": i} for i in range(1, 21)] + [{"id": 50, "dead_at": AS_OF}])
    ids = [r.id for r in links.check_queue(posts, 5).collect()]
    assert ids == [20, 19, 18, 17, 16]
    assert links.check_queue(posts, 0).count() == 20
    resp = responses(spark, [(f"https://x/{i}", 200, 200, "ok", None) for i in range(30)])
    checked = links.check_postings(posts, resp, limit=3).collect()
    assert sorted(r.job_id for r in checked) == [18, 19, 20] and {r.status for r in checked} == {"live"}


def test_report_line(results):
    _, res = results
    line = {r.job_id: r.line for r in links.report_lines(res).collect()}[3]
    assert line.startswith("c — t2") and "dead    HTTP 404" in line and len(line.split(" dead")[0]) == 40


def fetch_log(spark, rows):
    return spark.createDataFrame(rows, schema.FETCH_LOG)


def test_fetch_success_first_try(spark):
    r = links.reduce_fetch_log(fetch_log(spark, [("u", 0, 200, None, '{"jobs": []}')])).collect()[0]
    assert (r.attempts, r.outcome, r.error) == (1, "ok", None)


def test_fetch_5xx_then_success(spark):
    r = links.reduce_fetch_log(fetch_log(spark, [("u", 0, 503, None, None), ("u", 1, 200, None, "{}")])).collect()[0]
    assert (r.attempts, r.outcome) == (2, "ok")


def test_fetch_4xx_not_retried(spark):
    r = links.reduce_fetch_log(fetch_log(spark, [("u", 0, 404, None, None), ("u", 1, 200, None, "{}")])).collect()[0]
    assert (r.attempts, r.outcome, r.error) == (1, "client_error", "HTTP 404")


def test_fetch_gives_up_after_three(spark):
    rows = [("u", a, None, "ConnectionError", None) for a in range(5)]
    r = links.reduce_fetch_log(fetch_log(spark, rows)).collect()[0]
    assert (r.attempts, r.outcome, r.error) == (3, "gave_up", "ConnectionError")


def test_fetch_stops_at_an_exception_no_retry_mends(spark):
    rows = [("u", 0, None, "TooManyRedirects", None), ("u", 1, 200, None, "{}")]
    r = links.reduce_fetch_log(fetch_log(spark, rows)).collect()[0]
    assert (r.attempts, r.outcome, r.error) == (1, "failed", "TooManyRedirects")
    r = links.reduce_fetch_log(fetch_log(spark, rows), retryable=("TooManyRedirects",)).collect()[0]
    assert (r.attempts, r.outcome) == (2, "ok")


def test_fetch_body_not_json(spark):
    r = links.reduce_fetch_log(fetch_log(spark, [("u", 0, 200, None, "<html>")])).collect()[0]
    assert (r.outcome, r.error) == ("bad_body", "JSONDecodeError")


def test_seed_row_dead_and_export(spark, tmp_path):
    posts = postings(spark, [{"id": 1, "job_board_id": "test-404", "url": "https://x/gone"}])
    res = links.check_postings(posts, responses(spark, [("https://x/gone", 404, 404, "not here", None)]))
    assert [(r.job_board_id, r.status) for r in res.collect()] == [("test-404", "dead")]
    out = str(tmp_path / "dead")
    assert links.export_dead(res, out)
    assert [r.value for r in spark.read.text(out).collect()] == ["1\thttps://x/gone\t404"]
    live = links.check_postings(posts, responses(spark, [("https://x/gone", 200, 200, "open", None)]))
    assert not links.export_dead(live, str(tmp_path / "none"))


def test_read_landed_json(spark, tmp_path):
    from postflow.sources.landed import read_landed

    p = tmp_path / "resp.jsonl"
    p.write_text('{"url": "https://x/1", "head_code": 200, "get_code": 200, "body": "ok"}\n')
    r = read_landed(spark, "responses", str(p), fmt="json").collect()[0]
    assert (r.url, r.head_code, r.exc) == ("https://x/1", 200, None)
