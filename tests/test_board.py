import datetime as dt

from helpers import AS_OF, postings

from postflow import schema
from postflow.operators import board


def changes(spark, rows):
    return spark.createDataFrame(rows, schema.STATUS_CHANGES)


def test_fold_orders_by_seq_within_second(spark):
    t = dt.datetime(2026, 1, 2, 3, 4, 5)
    ch = changes(spark, [("k", "Applied", t, 2), ("k", "Rejected", t, 3), ("k", "Interviewing", t, 1),
                         ("j", "Applied", t - dt.timedelta(seconds=1), 99)])
    got = {r.job_board_id: (r.status, r.changes) for r in board.fold_status(ch).collect()}
    assert got == {"k": ("Rejected", 3), "j": ("Applied", 1)}


def test_current_view_folds_everything(spark):
    posts = postings(spark, [{"job_board_id": "a"}, {"job_board_id": "b", "status": "Weird"}])
    ch = changes(spark, [("a", "Applied", AS_OF, 1)])
    mats = spark.createDataFrame(
        [("a", "L1", "E1", "g", AS_OF, None), ("a", None, None, "g", AS_OF + dt.timedelta(1), "Timeout"),
         ("b", "", "", "g", AS_OF, None)], schema.MATERIALS)
    dead = spark.createDataFrame([("a", AS_OF + dt.timedelta(2)), ("a", AS_OF + dt.timedelta(1))], schema.DEAD_MARKS)
    v = {r.job_board_id: r for r in board.current_view(posts, ch, mats, dead).collect()}
    assert v["a"].status == "Applied" and v["a"].generated_cover_letter == "L1"
    assert v["a"].dead_at == AS_OF + dt.timedelta(1)
    assert v["b"].generated_cover_letter == "" and v["b"].dead_at is None
    lst = {r.job_board_id: r for r in board.listing(board.current_view(posts, ch, mats, dead)).collect()}
    assert lst["b"].status_shown == "To Apply" and not lst["b"].has_cover_letter
    assert lst["a"].header == "t0 — c  ·  Applied"


def test_unknown_status_written_back(spark):
    posts = postings(spark, [{"job_board_id": "a", "status": "Ghosted"}, {"job_board_id": "b"}])
    ch = board.normalisation_changes(posts, AS_OF).collect()
    assert [(r.job_board_id, r.status) for r in ch] == [("a", "To Apply")]


def test_status_change_only_when_different(spark):
    posts = postings(spark, [{"job_board_id": "a", "status": "Applied"}])
    assert board.status_change(posts, "a", "Applied", AS_OF).count() == 0
    assert board.status_change(posts, "a", "Rejected", AS_OF).count() == 1
    assert [r.job_board_id for r in board.status_change_by_id(posts, 1, "Rejected", AS_OF).collect()] == ["a"]


def test_listing_order_and_page(spark):
    posts = postings(spark, [{"id": i, "date_scraped": AS_OF - dt.timedelta(days=i % 3)} for i in range(1, 10)])
    ids = [r.id for r in board.listing(posts, limit=4).collect()]
    assert ids == [9, 6, 3, 7]  # newest day first (i % 3 == 0), then id descending


def test_status_history_matches_brute_force(spark):
    t = dt.datetime(2026, 1, 1)
    rows = []
    statuses = ["To Apply", "Applied", "Interviewing", "Rejected"]
    for i in range(400):  # one hot key with most of the changes, spread over ranges
        key = "hot" if i % 5 else f"k{i % 7}"
        rows.append((key, statuses[i % 4], t + dt.timedelta(seconds=i // 3), i))
    ch = changes(spark, rows)
    got = {(r.job_board_id, r.seq): r.previous_status for r in board.status_history(ch).collect()}
    expect = {}
    last = {}
    for key, st, ts, seq in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        expect[(key, seq)] = last.get(key)
        last[key] = st
    assert got == expect


def test_lookup(spark):
    posts = postings(spark, [{"job_board_id": "seek-abc", "id": 5}, {"job_board_id": "seek-def", "id": 6}])
    assert [r.id for r in board.lookup(posts, "seek-def").collect()] == [6]
    assert [r.job_board_id for r in board.lookup(posts, id=5).collect()] == ["seek-abc"]
