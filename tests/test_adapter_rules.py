"""Adapter rules on JSON boards, one line each: the field as it stands in the entry,
and what becomes of it. A fatal entry rejects its whole board."""

import json

import pytest
from helpers import payloads, sources

from postflow.operators import ingest

GH = {"title": "Data Analyst", "absolute_url": "https://b/1", "location": {"name": "Perth"}, "content": "text"}
AB = {"title": "Data Analyst", "jobUrl": "https://j/1", "applyUrl": "https://a/1", "location": "Perth",
      "descriptionPlain": "plain", "descriptionHtml": "<p>", "isListed": True, "isRemote": False}
GONE = object()  # the key is absent
FATAL = object()  # the board is rejected
SKIPPED = object()  # the entry makes no row, the board stays

# (field, value, needle, column, expected)
GREENHOUSE = [
    ("title", GONE, None, "title", "Untitled"),
    ("title", None, None, "title", FATAL),  # a posting needs a title: the row goes to rejects, see below
    ("title", "", None, "title", ""),
    ("title", 7, None, "title", "7"),
    ("title", GONE, "unt", "title", "Untitled"),
    ("title", None, "x", "title", FATAL),
    ("title", 7, "x", "title", FATAL),
    ("title", "Chef", "analyst", "title", SKIPPED),
    ("title", "Data ANALYST", "analyst", "title", "Data ANALYST"),
    ("absolute_url", GONE, None, "url", ""),
    ("absolute_url", "", None, "url", ""),
    ("absolute_url", None, None, "url", FATAL),
    ("absolute_url", 7, None, "url", FATAL),
    ("location", GONE, None, "location", ""),
    ("location", None, None, "location", ""),
    ("location", {}, None, "location", ""),
    ("location", [], None, "location", ""),
    ("location", "", None, "location", ""),
    ("location", "Perth", None, "location", FATAL),
    ("location", [1], None, "location", FATAL),
    ("content", GONE, None, "description", ""),
    ("content", "", None, "description", ""),
]
ASHBY = [
    ("title", GONE, "title", "Untitled"),
    ("jobUrl", GONE, "url", "https://a/1"),
    ("jobUrl", "", "url", "https://a/1"),
    ("jobUrl", None, "url", "https://a/1"),
    ("jobUrl", 7, "url", FATAL),
    ("location", GONE, "location", ""),
    ("location", None, "location", ""),
    ("isRemote", True, "location", "Perth (Remote)"),
    ("isRemote", None, "location", "Perth"),
    ("isRemote", "yes", "location", "Perth (Remote)"),
    ("isListed", False, "title", SKIPPED),
    ("isListed", None, "title", "Data Analyst"),
    ("isListed", GONE, "title", "Data Analyst"),
    ("descriptionPlain", "", "description", "<p>"),
    ("descriptionPlain", GONE, "description", "<p>"),
]


def _entry(base, field, value):
    e = {**base, field: value}
    if value is GONE:
        del e[field]
    return e


def _run(spark, kind, entries, needles):
    """Each entry on a board of its own, behind a good one; (rows of the entry, rejected) by board."""
    good = {**(GH if kind == "greenhouse" else AB), "title": "good analyst unt x"}
    rows = [(i, kind, "acme", json.dumps({"jobs": [good, e]})) for i, e in enumerate(entries)]
    srcs = sources(spark, [(i, kind, "acme", None, None, n) for i, n in enumerate(needles)])
    res = ingest.scan(payloads(spark, rows), srcs, types=[kind])
    got = {i: [] for i in range(len(entries))}
    for r in res.incoming.collect():
        got[r.source_ord].append(r)
    return got, {r.source_ord for r in res.rejects.collect()}


def _check(got, bad, i, column, expected):
    if expected is FATAL:
        assert i in bad and not got[i]
        return
    assert i not in bad
    mine = [r for r in got[i] if r.entry_ord == 1]
    assert [r for r in got[i] if r.entry_ord == 0], "the good entry stays"
    if expected is SKIPPED:
        assert not mine
    else:
        assert [r[column] for r in mine] == [expected]


def test_greenhouse_rules(spark):
    cases = [c for c in GREENHOUSE if c[:3] != ("title", None, None)]
    got, bad = _run(spark, "greenhouse", [_entry(GH, f, v) for f, v, *_ in cases], [c[2] for c in cases])
    for i, (_, _, _, column, expected) in enumerate(cases):
        _check(got, bad, i, column, expected)


def test_ashby_rules(spark):
    got, bad = _run(spark, "ashby", [_entry(AB, f, v) for f, v, *_ in ASHBY], [None] * len(ASHBY))
    for i, (_, _, column, expected) in enumerate(ASHBY):
        _check(got, bad, i, column, expected)


def test_null_title_is_a_row_without_title(spark):
    got, bad = _run(spark, "greenhouse", [_entry(GH, "title", None)], [None])
    assert not bad and got[0][-1].title is None
    valid, rejects = ingest.split_required(spark.createDataFrame(got[0]))
    assert valid.count() == 1 and "title" in rejects.collect()[0].reason


def test_skipped_entry_cannot_fail_its_board(spark):
    jobs = [GH, {"title": "Chef", "absolute_url": None, "location": "text"}]
    p = payloads(spark, [(0, "greenhouse", "acme", {"jobs": jobs})])
    res = ingest.scan(p, sources(spark, [(0, "greenhouse", "acme", None, None, "data")]), types=["greenhouse"])
    assert [r.title for r in res.incoming.collect()] == ["Data Analyst"] and res.rejects.isEmpty()


ITEM = "<item><title>a</title><link>https://s/1</link></item>"


@pytest.mark.parametrize("body, rows, rejected", [
    (f"<rss><channel><title>f</title>{ITEM}</channel></rss>", 1, False),
    ("<rss><channel><title>f</title></channel></rss>", 0, False),
    ("plain text", 0, True),
    ("", 0, True),
    (None, 0, True),
    ("<html><body>error</body></html>", 0, True),
    ("<feed><entry><title>x</title></entry></feed>", 0, True),
    (f"<rss><channel>{ITEM}{ITEM}<item><title>cut", 2, True),
])
def test_feed_bodies(spark, body, rows, rejected):
    res = ingest.scan(payloads(spark, [(0, "seek", None, body)]), None, types=["seek"])
    assert res.incoming.count() == rows and (res.rejects.count() == 1) == rejected


def test_every_landed_payload_is_accounted_for(spark):
    bodies = ["{", '{"jobs": null}', '{"jobs": []}', "[]", json.dumps({"jobs": [GH]})]
    rows = [(i, "greenhouse", "acme", b) for i, b in enumerate(bodies)] + [(9, "workday", "acme", "{}")]
    res = ingest.scan(payloads(spark, rows), None)
    seen = {r.source_ord for r in res.incoming.collect()} | {r.source_ord for r in res.rejects.collect()}
    assert seen | {2} == {0, 1, 2, 3, 4, 9}  # 2: a board without entries
