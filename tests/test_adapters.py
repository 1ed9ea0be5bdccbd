import hashlib

from helpers import payloads, sources

from postflow.operators import ingest


def key(source, url):
    return f"{source}-" + hashlib.sha1(url.encode()).hexdigest()[:10]


GREENHOUSE = {
    "jobs": [
        {"title": "Data Analyst", "absolute_url": "https://boards.example/acme/1",
         "location": {"name": "Adelaide, AU"}, "content": "Analyse &amp; report"},
        {"title": "Software Engineer", "absolute_url": "https://boards.example/acme/2",
         "location": {"name": "Remote"}, "content": "Build things"},
    ]
}


def scan(spark, rows, srcs=None, types=None):
    res = ingest.scan(payloads(spark, rows), sources(spark, srcs) if srcs else None, types=types)
    return res.incoming, res.rejects


def test_greenhouse_two_entries(spark):
    inc, rej = scan(spark, [(0, "greenhouse", "acme", GREENHOUSE)], types=["greenhouse"])
    rows = sorted(inc.collect(), key=lambda r: r.entry_ord)
    assert [r.title for r in rows] == ["Data Analyst", "Software Engineer"]
    assert [r.location for r in rows] == ["Adelaide, AU", "Remote"]
    assert {r.company for r in rows} == {"acme"}
    assert rows[0].description == "Analyse &amp; report"  # raw, entities kept
    assert rows[0].job_board_id == key("greenhouse", "https://boards.example/acme/1")
    assert rows[0].job_board_id != rows[1].job_board_id
    assert rej.count() == 0


def test_greenhouse_title_filter(spark):
    srcs = [(0, "greenhouse", "acme", None, None, "ANALYST")]
    inc, _ = scan(spark, [(0, "greenhouse", "acme", GREENHOUSE)], srcs, types=["greenhouse"])
    assert [r.title for r in inc.collect()] == ["Data Analyst"]
    for needle in ("", None):
        srcs = [(0, "greenhouse", "acme", None, None, needle)]
        inc, _ = scan(spark, [(0, "greenhouse", "acme", GREENHOUSE)], srcs, types=["greenhouse"])
        assert inc.count() == 2


def test_greenhouse_defaults_and_missing_vs_null(spark):
    body = {"jobs": [{}, {"title": None, "absolute_url": "u", "location": None, "content": None},
                     {"location": {}}, {"location": {"name": None}}]}
    inc, rej = scan(spark, [(0, "greenhouse", "acme", body)], types=["greenhouse"])
    rows = sorted(inc.collect(), key=lambda r: r.entry_ord)
    assert rows[0].title == "Untitled" and rows[0].url == "" and rows[0].location == "" and rows[0].description == ""
    assert rows[0].job_board_id == "greenhouse-da39a3ee5e"  # sha1('')
    assert rows[1].title is None and rows[1].location == "" and rows[1].description is None
    assert rows[2].location == ""
    assert rows[3].location is None
    assert rej.count() == 0


def test_broken_payloads_fail_whole_source(spark):
    rows = [
        (0, "greenhouse", "a", "not json"),
        (1, "greenhouse", "b", {"jobs": None}),
        (2, "greenhouse", "c", {"nojobs": 1}),
        (3, "greenhouse", "d", {"jobs": [{"title": "ok", "absolute_url": None}]}),
        (4, "greenhouse", "e", {"jobs": [{"title": "ok", "location": "Sydney"}, {"title": "fine"}]}),
        (5, "greenhouse", "f", {"jobs": [1]}),
        (6, "greenhouse", "g", {"jobs": [{"title": "kept"}]}),
    ]
    inc, rej = scan(spark, rows, types=["greenhouse"])
    assert [r.title for r in inc.collect()] == ["kept"]
    reasons = {r.source_ord: r.reason for r in rej.collect()}
    assert set(reasons) == {0, 1, 3, 4, 5}  # source 2 has no jobs key: zero postings, no failure
    assert reasons[0] == "body is not JSON"


def test_null_title_with_needle_fails_source(spark):
    body = {"jobs": [{"title": None}, {"title": "Analyst"}]}
    srcs = [(0, "greenhouse", "acme", None, None, "analyst")]
    inc, rej = scan(spark, [(0, "greenhouse", "acme", body)], srcs, types=["greenhouse"])
    assert inc.count() == 0 and rej.count() == 1


def test_ashby_cases(spark):
    jobs = [
        {"title": "A", "jobUrl": "https://j/1", "isListed": False},                         # dropped
        {"title": "B", "jobUrl": "https://j/2", "isListed": True, "location": "Berlin", "isRemote": True},
        {"title": "C", "jobUrl": "", "applyUrl": "https://a/3", "isListed": None, "isRemote": True,
         "location": ""},
        {"jobUrl": "https://j/4", "location": "Remote - EU", "isRemote": True,
         "descriptionPlain": "", "descriptionHtml": "<p>x</p>"},
        {"title": None, "isRemote": False, "location": None, "descriptionPlain": "plain"},
        {"title": "F", "isRemote": "yes", "isListed": "false"},                             # truthy, kept
        {"title": "G", "jobUrl": False, "applyUrl": "https://a/7", "location": 0, "descriptionPlain": False,
         "descriptionHtml": "h"},                                                            # falsy non-text skipped
    ]
    inc, rej = scan(spark, [(0, "ashby", "org", {"jobs": jobs})], types=["ashby"])
    rows = sorted(inc.collect(), key=lambda r: r.entry_ord)
    assert [r.entry_ord for r in rows] == [1, 2, 3, 4, 5, 6]
    b, c, d, e, f, g = rows
    assert (g.url, g.location, g.description) == ("https://a/7", "", "h")
    assert b.location == "Berlin (Remote)" and b.company == "org"
    assert c.url == "https://a/3" and c.location == "Remote"
    assert d.title == "Untitled" and d.location == "Remote - EU" and d.description == "<p>x</p>"
    assert e.title is None and e.url == "" and e.location == "" and e.description == "plain"
    assert e.job_board_id == "ashby-da39a3ee5e"
    assert f.location == "Remote"
    assert rej.count() == 0


def test_rss_feed(spark):
    feed = ("<rss><channel><title>x</title>"
            "<item><title> Data analyst &amp; BI </title><link>https://s/1</link>"
            "<description>&lt;b&gt;hi&lt;/b&gt;</description><author>Acme</author></item>"
            "<item><link>https://s/2</link></item></channel></rss>")
    srcs = [(0, "seek", None, "data analyst", "Adelaide", None)]
    inc, _ = scan(spark, [(0, "seek", None, feed)], srcs, types=["seek"])
    a, b = sorted(inc.collect(), key=lambda r: r.entry_ord)
    assert a.title == "Data analyst & BI" and a.company == "Acme" and a.location == "Adelaide"
    assert a.description == "<b>hi</b>" and a.job_board_id == key("seek", "https://s/1")
    assert b.title == "Untitled" and b.company == "Unknown" and b.description == ""


def test_rss_default_location(spark):
    feed = "<rss><channel><item><title>x</title><link>l</link></item></channel></rss>"
    inc, _ = scan(spark, [(0, "seek", None, feed)], types=["seek"])
    assert inc.collect()[0].location == "All Australia"


def test_dispatch_unknown_type_rejected(spark):
    rows = [(0, "greenhouse", "acme", GREENHOUSE), (1, "workday", "x", "{}")]
    inc, rej = scan(spark, rows)
    assert inc.count() == 2
    r = rej.collect()
    assert len(r) == 1 and r[0].reason == "Unknown source type: workday"


def test_register_adapter(spark):
    from pyspark.sql import functions as F

    from postflow import schema
    from postflow.sources import adapters

    def lever(prepared):
        inc = prepared.select(
            "source_ord", "payload_ord", F.lit(0).alias("entry_ord"), F.lit("lever").alias("source"),
            F.lit("lever-x").alias("job_board_id"), F.lit("T").alias("title"), F.col("token").alias("company"),
            F.lit("").alias("location"), F.col("body").alias("description"), F.lit("").alias("url"))
        return adapters.AdapterResult(inc, prepared.sparkSession.createDataFrame([], schema.REJECTS))

    adapters.register_adapter("lever", lever)
    try:
        inc, rej = scan(spark, [(0, "lever", "co", "raw")])
        assert [(r.source, r.company) for r in inc.collect()] == [("lever", "co")]
    finally:
        adapters._REGISTRY.pop("lever")
