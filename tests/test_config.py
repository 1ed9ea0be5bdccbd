import pytest
from helpers import sources

from postflow import schema
from postflow.sources import config


def test_legacy_block_is_one_feed_source(spark):
    r = config.resolve_sources(None, config.legacy_source(spark, "data analyst")).collect()
    assert [(x.type, x.title, x.location) for x in r] == [("seek", "data analyst", "All Australia")]


def test_list_beats_legacy(spark):
    listed = sources(spark, [(0, "seek", None, "a", "Adelaide", None), (1, "greenhouse", "acme", None, None, None)])
    r = config.resolve_sources(listed, config.legacy_source(spark, "ignored"))
    assert r.count() == 2


def test_empty_list_falls_back_and_nothing_is_error(spark):
    empty = spark.createDataFrame([], schema.SOURCES)
    assert config.resolve_sources(empty, config.legacy_source(spark, "x")).count() == 1
    with pytest.raises(ValueError):
        config.resolve_sources(empty, None)


def test_unknown_type_rejected(spark):
    srcs = sources(spark, [(0, "workday", "x", None, None, None), (1, "greenhouse", None, None, None, None),
                           (2, "lever", "figma", None, None, None)])
    bad = {r.source_ord: r.reason for r in config.invalid_sources(srcs).collect()}
    assert bad == {0: "Unknown source type: workday", 1: "greenhouse source needs a board token"}


def test_request_urls(spark):
    srcs = sources(spark, [(0, "seek", None, " Data Analyst ", None, None),
                           (1, "seek", None, "data analyst", "Adelaide SA", None),
                           (2, "greenhouse", " stripe ", None, None, None),
                           (3, "ashby", "ashby", None, None, None),
                           (4, "lever", "figma", None, None, None)])
    got = {r.source_ord: r.request_url for r in config.plan_requests(srcs).collect()}
    assert got == {
        0: "https://www.seek.com.au/data-analyst-jobs/in-all-australia?rss=true",
        1: "https://www.seek.com.au/data-analyst-jobs/in-adelaide-sa?rss=true",
        2: "https://boards-api.greenhouse.io/v1/boards/stripe/jobs?content=true",
        3: "https://api.ashbyhq.com/posting-api/job-board/ashby",
    }


def test_adzuna_country_normalised(spark):
    srcs = sources(spark, [(0, "adzuna", " AU ", None, None, None)])
    assert config.with_defaults(srcs).collect()[0].token == "au"


def test_source_lines(spark):
    lines = spark.createDataFrame([("# comment",), ("",), ("greenhouse stripe",), ("  Ashby   ashby  ",),
                                   ("workday x",), ("lever",)], "value string")
    got = [(r.type, r.token, r.reason) for r in config.parse_source_lines(lines).collect()]
    assert got == [("greenhouse", "stripe", None), ("ashby", "ashby", None),
                   ("workday", "x", "Unknown source type: workday"), ("lever", None, "missing board token")]


@pytest.mark.parametrize("url,expected", [
    ("https://boards.greenhouse.io/stripe", ("greenhouse", "stripe", None)),
    ("job-boards.greenhouse.io/stripe/jobs/123", ("greenhouse", "stripe", None)),
    ("jobs.lever.co/figma?lever-origin=x", ("lever", "figma", None)),
    ("HTTPS://JOBS.ASHBYHQ.COM/ashby/abc-def", ("ashby", "ashby", None)),
    ("https://example.com/careers", (None, None, "not a known careers host: example.com")),
    ("https://jobs.lever.co/", (None, None, "no board token in URL")),
])
def test_board_from_url(spark, url, expected):
    df = spark.createDataFrame([(url,)], "url string")
    r = df.select(config.board_from_url("url").alias("r")).collect()[0].r
    assert (r.type, r.token, r.error) == expected
