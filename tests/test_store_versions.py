"""Versions of the store, key identity, id blocks and replays."""

import tempfile
import threading

import pytest
from helpers import AS_OF, incoming, payloads, postings
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import posting_key
from postflow.operators import extras, keys
from postflow.sources.files import Files
from postflow.sources.store import PostingStore


def new_store(spark, seeds=0):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-versions-"))
    if seeds:
        store.seed(postings(spark, [{"url": f"https://seed/{i}", "job_board_id": f"seek-seed{i}"} for i in range(seeds)]))
    return store


def scrape(spark, store, batch, *entries, **kw):
    body = {"jobs": [{"title": f"J{e}" if not isinstance(e, dict) else "T", "absolute_url": f"https://b/{e}"} | (e if isinstance(e, dict) else {})
                     for e in entries]}
    rows = store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", body)]), None, AS_OF, batch, **kw).collect()
    return next(r for r in rows if r.source_ord is None)


def state(store):
    return sorted((r.id, r.job_board_id, r.status, r.dead_at is not None, r.generated_cover_letter) for r in store.view().collect())


def filled(spark):
    """A store with something in every table."""
    store = new_store(spark, 3)
    scrape(spark, store, 0, 1, 2, 3, {"title": None})
    store.set_status("seek-seed0", "Applied", AS_OF)
    store.append_dead(spark.createDataFrame([("seek-seed1", AS_OF)], schema.DEAD_MARKS), 0)
    store.generate("cv", lambda: lambda ps: ["made" for _ in ps], AS_OF, 0, limit=4)
    return store


def test_compaction_keeps_every_table_and_refuses_a_version_that_exists(spark):
    store = filled(spark)
    moved = PostingStore(spark, store.compact("postings", 1))
    assert state(moved) == state(store) and "Applied" in {r[2] for r in state(moved)}
    for name in ("rejects", "summaries", "materials", "status_changes", "dead_marks"):
        assert moved.read(name).count() == store.read(name).count() > 0
    scrape(spark, store, 1, 9)
    with pytest.raises(ValueError, match="exists"):
        store.compact("postings", 1)
    second = PostingStore(spark, store.compact("postings", 2))
    assert len(state(second)) == len(state(moved)) + 1


def test_replays_after_a_move_write_nothing(spark):
    store = filled(spark)
    first = scrape(spark, store, 0, 1, 2, 3)
    for root in (store.compact("postings", 1), store.prune_removed(2)):
        moved = PostingStore(spark, root)
        moved = PostingStore(spark, moved.compact("postings", 7))  # marks are carried on
        before = state(moved), moved.read("rejects").count()
        assert scrape(spark, moved, 0, 1, 2, 3, {"title": None}) == first
        moved.generate("cv", lambda: lambda ps: ["again" for _ in ps], AS_OF, 0, limit=4)
        assert (state(moved), moved.read("rejects").count()) == before


def test_pruned_postings_stay_away(spark):
    store = filled(spark)
    pruned = PostingStore(spark, store.prune_removed(1))
    assert "seek-seed1" not in {r[1] for r in state(pruned)} and len(state(pruned)) == len(state(store)) - 1
    assert pruned.read("dead_marks").count() == 0


def test_an_unfinished_version_does_not_open(spark):
    store = new_store(spark, 1)
    assert Files(spark).create(f"{store.root}_v4/_claim", "{}")
    with pytest.raises(ValueError, match="not written to its end"):
        PostingStore(spark, f"{store.root}_v4")
    with pytest.raises(ValueError, match="exists"):
        store.compact("postings", 4)


# ---- key identity


def test_the_same_id_under_a_new_url_is_a_repeat(spark):
    url = "https://a.example/land/ad/{}?a={}"
    made = {"id in the URL": lambda i, a: (posting_key(F.lit("adzuna"), F.lit(str(i))), None),
            "page": lambda i, a: (extras.provider_key("adzuna", None, F.lit(url.format(f"x{i}", a))), None),
            "provider": lambda i, a: (posting_key(F.lit("adzuna"), F.lit(f"p{i}")), f"p{i}")}
    for name, key in made.items():
        store = new_store(spark)
        runs = []
        for a in (1, 2):
            rows = []
            for i in range(5):
                k, pid = key(i, a)
                rows.append(incoming(spark, [{"url": url.format(i if name == "id in the URL" else f"x{i}", a), "entry_ord": i, "source": "adzuna"}])
                            .withColumn("job_board_id", k).withColumn("provider_id", F.lit(pid).cast("string")))
            inc = rows[0]
            for r in rows[1:]:
                inc = inc.unionByName(r)
            total = next(r for r in store.ingest(inc, AS_OF, a).collect() if r.source_ord is None)
            runs.append((total.new, total.key_collisions))
        assert runs == [(5, 0), (0, 0)], name
        assert store.read("rejects").count() == 0


def test_rekey_then_scrape_again_adds_nothing(spark):
    store = new_store(spark)
    board = [{"id": 7, "absolute_url": "https://b/jobs/7?x=1"}, {"id": 8, "absolute_url": "https://b/jobs/eight"},
             {"absolute_url": "https://b/jobs/none"}, {"absolute_url": ""}]
    assert scrape(spark, store, 0, *board).new == 4
    store.set_status(store.postings().filter("url like '%eight'").first().job_board_id, "Applied", AS_OF)
    moved = PostingStore(spark, store.rekey("greenhouse", 1))
    again = scrape(spark, moved, 1, *board)
    assert (again.new, again.key_collisions, moved.read("rejects").count()) == (0, 0, 0)
    # a new address of a known id is the same posting, and an unknown id a new one
    changed = [{"id": 7, "absolute_url": "https://b/jobs/7?x=2"}, {"id": 8, "absolute_url": "https://b/other"},
               {"id": 9, "absolute_url": "https://b/jobs/9"}, {"id": 5, "absolute_url": "https://b/jobs/none"}]
    total = scrape(spark, moved, 2, *changed)
    assert (total.new, total.key_collisions) == (1, 0)
    keys_now = {r.job_board_id for r in moved.postings().collect()}
    of = lambda x: spark.range(1).select(posting_key(F.lit("greenhouse"), F.lit(x))).first()[0]
    assert {of("7"), of("8"), of("9"), of("https://b/jobs/none"), of("")} == keys_now
    assert {r.status for r in moved.view().filter("url like '%eight'").collect()} == {"Applied"}
    # an old key still finds its posting
    assert moved.set_status(of("https://b/jobs/eight"), "Rejected", AS_OF) == 1


def test_aliases_of_two_moves_are_one_step(spark):
    old = spark.createDataFrame([("a", "b"), ("x", "x"), ("k", "l")], schema.ALIASES)
    moved = spark.createDataFrame([("b", "c"), ("x", "y"), ("n", "m")], schema.ALIASES)
    got = {tuple(r) for r in keys.chained(old, moved).collect()}
    assert got == {("a", "c"), ("x", "y"), ("k", "l"), ("b", "c"), ("n", "m")}


# ---- ids of several writers


def test_two_ingests_at_once_take_different_ids(spark):
    store = new_store(spark, 3)
    errors = []

    def run(writer):
        try:
            for batch in range(2):
                scrape(spark, PostingStore(spark, store.root), batch, *[f"{writer}{batch}{i}" for i in range(6)], writer=writer)
        except Exception as exc:  # noqa: BLE001 - shown by the assertion
            errors.append(exc)

    threads = [threading.Thread(target=run, args=(w,)) for w in ("one", "two", "three")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    ids = sorted(r.id for r in store.postings().collect())
    assert ids == list(range(1, 3 + 3 * 2 * 6 + 1))  # distinct, and no gap


def test_claims_go_to_one_of_many(spark):
    files, path = Files(spark), tempfile.mkdtemp(prefix="pf-claim-") + "/deep/claim"
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create(path, f"by {i}") else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read(path) == f"by {won[0]}"


def test_a_batch_done_again_keeps_its_block(spark):
    store = new_store(spark, 2)
    assert store.reserve_ids(5, "w", 0) == 3 and store.reserve_ids(4, "v", 0) == 8
    assert store.reserve_ids(5, "w", 0) == 3 and store.reserve_ids(1, "w", 1) == 12


# ---- replays of appends, edits as a table


def test_an_append_replayed_adds_nothing(spark):
    store = new_store(spark, 2)
    rows = [("seek-seed0", "letter", "mail", "g", AS_OF, None), ("seek-seed1", "letter", "mail", "g", AS_OF, None)]
    for _ in range(2):
        store.append_materials(spark.createDataFrame(rows, schema.MATERIALS), 3)
        store.append_materials(spark.createDataFrame(rows[::-1], schema.MATERIALS), 3)  # the same rows
        store.append_dead(spark.createDataFrame([("seek-seed0", AS_OF)], schema.DEAD_MARKS), 3)
    store.append_materials(spark.createDataFrame(rows[:1], schema.MATERIALS), 3)
    store.append_dead(spark.createDataFrame([], schema.DEAD_MARKS), 3)
    assert store.read("materials").count() == 3 and store.read("dead_marks").count() == 1


def test_a_table_of_edits(spark):
    store = new_store(spark, 3)
    store.set_status("seek-seed1", "Applied", AS_OF)
    edits = spark.createDataFrame(
        [("seek-seed0", "Applied", 0), ("seek-seed0", "Rejected", 1), ("seek-seed1", "Applied", 0), ("seek-seed1", "Rejected", 1),
         ("seek-seed1", "Applied", 2), ("seek-none", "Applied", 0)], "job_board_id string, status string, ord int")
    for _ in range(2):
        assert store.edit_statuses(edits, AS_OF, 0).count() == 4
    got = {r.job_board_id: r.status for r in store.view().collect()}
    assert got == {"seek-seed0": "Rejected", "seek-seed1": "Applied", "seek-seed2": "To Apply"}
    mine = [r.seq for r in store.read("status_changes").filter("job_board_id = 'seek-seed1'").orderBy("seq").collect()]
    assert mine == [0, 1, 2]


# ---- snapshots


@pytest.mark.parametrize("seed", [1, 2])
def test_the_view_over_a_snapshot_is_the_full_fold(spark, seed):
    import datetime as dt
    import random

    from postflow.operators import board

    rng = random.Random(seed)
    store = new_store(spark, 6)
    key = lambda: f"seek-seed{rng.randrange(6)}"
    at = lambda: AS_OF + dt.timedelta(hours=rng.randrange(50))
    n = 0
    for step in range(4):
        for _ in range(2):
            n += 1
            store.append_status(spark.createDataFrame(
                [(key(), rng.choice(schema.STATUSES), at(), 1000 * n + i) for i in range(3)], schema.STATUS_CHANGES), n)
            store.append_materials(spark.createDataFrame(
                [(key(), f"letter {n} {i}", "mail", "g", at(), rng.choice([None, "failed"])) for i in range(2)], schema.MATERIALS), n)
            store.append_dead(spark.createDataFrame([(key(), at())], schema.DEAD_MARKS), n)
        full = board.current_view(store.postings(), *(store.read(t) for t in ("status_changes", "materials", "dead_marks")))
        assert sorted(map(str, store.view().collect())) == sorted(map(str, full.collect()))
        if step < 3:
            assert store.snapshot() == step
    # only the batches after the snapshot are read
    read = [f for f in store._changes("status_changes").inputFiles() if "/batch_id=" in f]
    assert {f.split("/batch_id=")[1].split("/")[0] for f in read} == {"7", "8"}
    moved = PostingStore(spark, store.compact("postings", 1))
    assert state(moved) == state(store)
    moved.snapshot()
    moved.set_status("seek-seed0", "Interviewing", AS_OF + dt.timedelta(days=9))
    assert {r[1]: r[2] for r in state(moved)}["seek-seed0"] == "Interviewing"


# -- versions bucketed by key ----------------------------------------------------------

def above_scans(df, mark):
    """For each scan whose line holds `mark`: the plan's operators from it up to the top join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if mark in line:
            path, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    path.append(lines[j].strip(" :+-"))
                    at = depth[j]
            joins = [k for k, p in enumerate(path) if "Join" in p]
            found.append(path[:joins[-1] + 1])
    return found


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def later_work(spark, store):
    """A repeated and a new posting, edits before and after a snapshot, texts, a dead link."""
    got = scrape(spark, store, 7, 2, 3, 50)
    store.set_status("seek-seed2", "Interviewing", AS_OF, 1)
    store.snapshot()
    store.set_status("seek-seed2", "Rejected", AS_OF, 2)
    store.set_status(posting_key_of("https://b/50"), "Applied", AS_OF, 3)
    store.generate("cv", lambda: lambda ps: ["later" for _ in ps], AS_OF, 9, limit=1)
    store.append_dead(spark.createDataFrame([("seek-seed0", AS_OF)], schema.DEAD_MARKS), 4)
    return got.seen, got.new


def posting_key_of(url):
    import hashlib
    return "greenhouse-" + hashlib.sha1(url.encode()).hexdigest()[:10]


def test_a_bucketed_version_does_what_a_plain_one_does(spark):
    store = filled(spark)
    plain = PostingStore(spark, store.compact("postings", 1))
    keyed = PostingStore(spark, store.compact("postings", 2, buckets=4))
    assert keyed.buckets == 4 and state(keyed) == state(plain)
    assert later_work(spark, plain) == later_work(spark, keyed) == (3, 1)
    assert state(keyed) == state(plain) and len({r[2] for r in state(keyed)}) == 3
    assert sorted(keyed.read("postings").collect()) == sorted(plain.read("postings").collect())
    # a session that does not know the tables finds them by their folders
    for t in spark.catalog.listTables():
        if t.name.startswith("postflow_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = PostingStore(spark, keyed.root)
    assert state(again) == state(plain)
    # the next version keeps the buckets; a replay writes nothing there
    kept = PostingStore(spark, again.compact("postings", 1))
    scrape(spark, kept, 7, 2, 3, 50)
    assert kept.buckets == 4 and state(kept) == state(plain)


def test_a_bucketed_version_is_not_shuffled_for_the_lookup_and_the_view(spark, no_broadcast):
    from postflow.operators import ingest

    keyed = PostingStore(spark, filled(spark).compact("postings", 1, buckets=6))
    keyed.snapshot()
    keyed.set_status("seek-seed2", "Rejected", AS_OF, 2)
    new = incoming(spark, [{"url": "https://seed/1", "job_board_id": "seek-seed1"}, {"url": "https://n"}])
    tags = ingest.tag(new, keyed._later("postings", {keyed._base}), True, keyed.read("aliases"), (), keyed._postings_by_key())
    for df, scans in ((tags, 1), (keyed.view(), 4)):
        paths = above_scans(df, "Bucketed: true")
        assert len(paths) >= scans and not [p for path in paths for p in path if "Exchange" in p]
    assert sorted(r.is_new for r in tags.collect()) == [False, True]
