from helpers import AS_OF, incoming, postings

from postflow.operators import ingest


def _summary(df):
    return {r.source_ord: (r.seen, r.new, r.rejected) for r in df.collect()}


def test_first_write_wins_within_run(spark):
    inc = incoming(spark, [
        {"source_ord": 1, "entry_ord": 0, "url": "u1", "title": "later source"},
        {"source_ord": 0, "entry_ord": 5, "url": "u1", "title": "earlier source"},
        {"source_ord": 0, "entry_ord": 6, "url": "u1", "title": "same source, later entry"},
        {"source_ord": 0, "entry_ord": 7, "url": "u2", "title": "other"},
    ])
    new = ingest.new_postings(inc, None)
    got = {r.job_board_id: r.title for r in new.collect()}
    assert sorted(got.values()) == ["earlier source", "other"]
    s = _summary(ingest.summary(inc, None))
    assert s[0] == (3, 2, 0) and s[1] == (1, 0, 0) and s[None] == (4, 2, 0)


def test_existing_key_untouched_and_rerun_adds_nothing(spark):
    inc = incoming(spark, [{"url": "u1", "title": "new text"}, {"url": "u2"}])
    first = ingest.with_defaults(ingest.new_postings(inc, None), AS_OF)
    stored = first.select("job_board_id")
    again = ingest.new_postings(inc, stored)
    assert again.count() == 0
    assert _summary(ingest.summary(inc, stored))[None] == (2, 0, 0)


def test_failed_source_absent_other_kept(spark):
    # a source that produced nothing simply has no rows; the other still inserts
    inc = incoming(spark, [{"source_ord": 1, "url": "u9"}])
    s = _summary(ingest.summary(inc, None))
    assert 0 not in s and s[1] == (1, 1, 0)


def test_null_required_field_goes_to_rejects(spark):
    inc = incoming(spark, [{"url": "u1", "title": None}, {"url": "u1", "title": "ok", "entry_ord": 9}])
    valid, bad = ingest.split_required(inc)
    assert valid.count() == 1
    r = bad.collect()[0]
    assert r.reason == "null required field: title"
    new = ingest.new_postings(inc, None).collect()
    assert [x.title for x in new] == ["ok"]
    assert _summary(ingest.summary(inc, None))[None] == (2, 1, 1)


def test_empty_url_is_one_hot_key(spark):
    inc = incoming(spark, [{"url": "", "entry_ord": i, "title": f"t{i}"} for i in range(50)])
    new = ingest.new_postings(inc, None).collect()
    assert len(new) == 1 and new[0].title == "t0" and new[0].job_board_id == "seek-da39a3ee5e"
    total = [r for r in ingest.summary(inc, None).collect() if r.source_ord is None][0]
    assert (total.seen, total.new, total.blank_urls) == (50, 1, 50)


def test_row_defaults(spark):
    inc = incoming(spark, [{"url": "u1"}])
    r = ingest.with_defaults(ingest.new_postings(inc, None), AS_OF).collect()[0]
    assert r.status == "To Apply" and r.date_scraped == AS_OF
    assert r.generated_cover_letter is None and r.generated_cold_email is None and r.dead_at is None


def test_assign_ids_dense_in_run_order(spark):
    rows = [{"source_ord": i % 3, "payload_ord": i % 2, "entry_ord": i, "url": f"u{i}"} for i in range(40)]
    inc = incoming(spark, rows)
    ids = ingest.assign_ids(inc, 100, partitions=4).collect()
    got = sorted((r.source_ord, r.payload_ord, r.entry_ord, r.id) for r in ids)
    assert [g[3] for g in got] == list(range(101, 141))
    stored = postings(spark, [{"id": 7}])
    assert min(r.id for r in ingest.assign_ids(inc, stored).collect()) == 8


def test_summary_invariants(spark):
    rows = [{"source_ord": i % 4, "entry_ord": i, "url": f"u{i % 13}"} for i in range(60)]
    inc = incoming(spark, rows)
    stored = incoming(spark, [{"url": "u1"}, {"url": "u2"}]).select("job_board_id")
    s = _summary(ingest.summary(inc, stored))
    assert all(seen >= new for seen, new, _ in s.values())
    assert s[None][1] == 11  # 13 distinct keys, 2 stored
    assert sum(v[1] for k, v in s.items() if k is not None) == s[None][1]
