import tempfile
from pathlib import Path

import pytest
from helpers import AS_OF, incoming, payloads, postings

from postflow import schema
from postflow.plans import derive
from postflow.sources.store import PostingStore
from postflow.streaming import ingest as streaming

BODY = {"jobs": [{"title": f"Job {i}", "absolute_url": f"https://b/{i % 7}", "content": "x",
                  "location": {"name": "Adelaide"}} for i in range(20)]}


def test_checkpoint_folder_rule(spark):
    from postflow.session import checkpoint_dir

    d = checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir") in d


def test_missing_table_reads_empty(spark):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-store-"))
    assert store.postings().count() == 0
    assert store.view().count() == 0


def test_ingest_twice_adds_nothing_and_replay_is_idempotent(spark):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-store-"))
    p = payloads(spark, [(0, "greenhouse", "acme", BODY)])
    s1 = {r.source_ord: (r.seen, r.new) for r in store.ingest_payloads(p, None, AS_OF, 0).collect()}
    assert s1[None] == (20, 7)
    assert store.postings().count() == 7
    # batch 0 is committed: once more, it returns its summary and writes nothing
    s0 = {r.source_ord: (r.seen, r.new) for r in store.ingest_payloads(p, None, AS_OF, 0).collect()}
    assert s0 == s1
    assert store.postings().count() == 7
    # a new batch with the same payload inserts nothing
    s2 = {r.source_ord: (r.seen, r.new) for r in store.ingest_payloads(p, None, AS_OF, 1).collect()}
    assert s2[None] == (20, 0)
    rows = store.postings().collect()
    assert sorted(r.id for r in rows) == list(range(1, 8))
    assert len({r.job_board_id for r in rows}) == 7


def test_stream_equals_batch(spark):
    docs = derive.table(spark, "/root/testdata/sf0.001", "documents")
    pay = derive.payloads(docs, "greenhouse")
    batch = PostingStore(spark, tempfile.mkdtemp(prefix="pf-batch-"))
    batch.ingest_payloads(pay, None, AS_OF, 0)

    base = tempfile.mkdtemp(prefix="pf-stream-")
    streaming.land_payloads(pay, f"{base}/landing")
    store = PostingStore(spark, f"{base}/store")
    q = streaming.ingest_stream(spark, f"{base}/landing", store, f"{base}/ckpt", as_of=AS_OF)
    q.awaitTermination()
    assert q.exception() is None
    cols = ["id", "job_board_id", "title", "company", "location", "description", "url", "status"]
    a = sorted(tuple(r) for r in batch.postings().select(*cols).collect())
    b = sorted(tuple(r) for r in store.postings().select(*cols).collect())
    assert a == b and len(a) > 0
    # running the stream again over the same files adds nothing
    q = streaming.ingest_stream(spark, f"{base}/landing", store, f"{base}/ckpt", as_of=AS_OF)
    q.awaitTermination()
    assert store.postings().count() == len(a)


def test_generation_stream_skips_done(spark):
    base = tempfile.mkdtemp(prefix="pf-gen-")
    store = PostingStore(spark, f"{base}/store")
    p = payloads(spark, [(0, "greenhouse", "acme", BODY)])
    store.ingest_payloads(p, None, AS_OF, 0)
    q = streaming.generation_stream(spark, store, f"{base}/ckpt", "cv", "echo", as_of=AS_OF)
    q.awaitTermination()
    assert q.exception() is None
    m = store.read("materials").collect()
    assert len(m) == 7
    v = store.view().collect()
    assert all(r.generated_cover_letter is not None or any(x.error for x in m) for r in v)


def test_stream_many_batches_keeps_keys_unique_and_ids_dense(spark):
    docs = derive.table(spark, "/root/testdata/sf0.001", "documents")
    pay = derive.payloads(docs, "greenhouse")
    base = tempfile.mkdtemp(prefix="pf-multi-")
    # one landed file per source type partition and page, read a few files per micro-batch
    streaming.land_payloads(pay.repartition(6, "source_ord"), f"{base}/landing")
    store = PostingStore(spark, f"{base}/store")
    q = streaming.ingest_stream(spark, f"{base}/landing", store, f"{base}/ckpt", as_of=AS_OF,
                                max_files_per_trigger=2)
    q.awaitTermination()
    assert q.exception() is None
    rows = store.read("postings", with_batch=True).collect()
    assert len({r.batch_id for r in rows}) > 1
    assert len({r.job_board_id for r in rows}) == len(rows)
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    batch = PostingStore(spark, tempfile.mkdtemp(prefix="pf-one-"))
    batch.ingest_payloads(pay, None, AS_OF, 0)
    assert {r.job_board_id for r in rows} == {r.job_board_id for r in batch.postings().collect()}


def test_compaction_keeps_the_view(spark):
    base = tempfile.mkdtemp(prefix="pf-compact-")
    store = PostingStore(spark, base)
    for b in range(3):
        body = {"jobs": [{"title": f"J{b}-{i}", "absolute_url": f"https://b/{b}/{i}"} for i in range(5)]}
        store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", body)]), None, AS_OF, b)
    new_root = store.compact("postings", 1)
    compacted = PostingStore(spark, new_root)
    cols = ["id", "job_board_id", "title", "status"]
    assert sorted(map(tuple, store.view().select(*cols).collect())) == \
        sorted(map(tuple, compacted.view().select(*cols).collect()))


def test_pending_plus_generated_is_everything(spark):
    from pyspark.sql import functions as F

    base = tempfile.mkdtemp(prefix="pf-pend-")
    store = PostingStore(spark, base)
    store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", BODY)]), None, AS_OF, 0)
    from postflow.operators import materials as M

    produced = M.run_generation(store.view(), "cv", "echo", AS_OF, limit=3)
    store.append_materials(produced, 0)
    failed = store.read("materials").filter(F.col("error").isNotNull()).count()
    v = store.view()
    pending = M.pending(v).count()
    done = v.filter(F.col("generated_cover_letter").isNotNull()).count()
    # a failed row (the echo generator fails some prompts on purpose) stays pending
    assert pending + done == v.count() == 7 and done == 3 - failed


def test_stored_row_never_changes(spark):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-keep-"))
    first = {"jobs": [{"title": "Original", "absolute_url": "https://b/1", "content": "old"}]}
    again = {"jobs": [{"title": "Rewritten", "absolute_url": "https://b/1", "content": "new"},
                      {"title": "Other", "absolute_url": "https://b/2"}]}
    store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", first)]), None, AS_OF, 0)
    s = {r.source_ord: (r.seen, r.new) for r in
         store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", again)]), None, AS_OF, 1).collect()}
    assert s[None] == (2, 1)
    rows = {r.url: (r.id, r.title, r.description) for r in store.postings().collect()}
    assert rows["https://b/1"] == (1, "Original", "old") and rows["https://b/2"][0] == 2


def test_store_commands(spark, tmp_path):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-cmd-"))
    body = {"jobs": [{"title": f"J{i}", "absolute_url": f"https://b/{i}", "content": "x"} for i in range(4)]}
    store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", body)]), None, AS_OF, 0)
    resp = spark.createDataFrame([("https://b/0", 404, 404, "gone", None, AS_OF), ("https://b/1", 200, 200, "open", None, AS_OF),
                                  ("https://b/2", 503, None, None, None, AS_OF)], schema.RESPONSES)
    c = store.check_links(resp, AS_OF, 0, dead_out=str(tmp_path / "dead")).collect()[0]
    assert (c.live, c.dead, c.unknown, c.checked) == (1, 1, 2, 4)
    assert [r.value for r in spark.read.text(str(tmp_path / "dead")).collect()] == ["1\thttps://b/0\t404"]
    # dead postings are not checked again
    c2 = store.check_links(resp, AS_OF, 1).collect()[0]
    assert c2.checked == 3
    s = store.generate("cv", "echo", AS_OF, 0).collect()[0]
    assert s.generated + s.empty + s.failed == 4
    assert store.set_status("greenhouse-" + __import__("hashlib").sha1(b"https://b/1").hexdigest()[:10],
                            "Applied", AS_OF, 0) == 1
    assert {r.status for r in store.view().collect()} == {"To Apply", "Applied"}


def test_store_command_replay_keeps_work(spark):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-replay-"))
    body = {"jobs": [{"title": f"J{i}", "absolute_url": f"https://b/{i}", "content": "x"} for i in range(5)]}
    store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", body)]), None, AS_OF, 0)
    store.generate("cv", "echo", AS_OF, 7)
    first = sorted(r.job_board_id for r in store.read("materials").collect())
    store.generate("cv", "echo", AS_OF, 7)  # the same batch again
    assert sorted(r.job_board_id for r in store.read("materials").collect()) == first and len(first) == 5


def test_stream_json_lines_landing(spark, tmp_path):
    import json

    body = json.dumps({"jobs": [{"title": "A", "absolute_url": "https://b/1"}, {"title": "B", "absolute_url": "https://b/1"}]})
    land = tmp_path / "landing"
    land.mkdir()
    (land / "part-0.json").write_text(json.dumps({"source_ord": 0, "payload_ord": 0, "type": "greenhouse",
                                                  "token": "acme", "fetched_at": "2026-01-01T00:00:00",
                                                  "body": body}) + "\n")
    store = PostingStore(spark, str(tmp_path / "store"))
    q = streaming.ingest_stream(spark, str(land), store, str(tmp_path / "ckpt"), as_of=AS_OF, fmt="json")
    q.awaitTermination()
    assert q.exception() is None
    assert [(r.title, r.company) for r in store.postings().collect()] == [("A", "acme")]


def _board(*urls):
    return {"jobs": [{"title": f"J {u}", "absolute_url": f"https://b/{u}", "content": "x"} for u in urls]}


def _ingest(spark, store, batch, *urls):
    return store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", _board(*urls))]), None, AS_OF, batch)


def _store(spark, n=0):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-safe-"))
    if n:
        store.seed(postings(spark, [{"url": f"https://seed/{i}", "job_board_id": f"seek-seed{i}"} for i in range(n)]))
    return store


def test_seed_then_batch_zero_keeps_the_seed(spark):
    store = _store(spark, 5)
    _ingest(spark, store, 0, 1, 2)
    rows = store.postings().collect()
    assert len(rows) == 7 and sorted(r.id for r in rows) == list(range(1, 8))
    with pytest.raises(ValueError):
        store.seed(store.postings())
    assert store.postings().count() == 7


def test_seed_then_stream_keeps_the_seed(spark):
    store = _store(spark, 3)
    base = tempfile.mkdtemp(prefix="pf-safe-")
    streaming.land_payloads(payloads(spark, [(0, "greenhouse", "acme", _board(1, 2))]), f"{base}/landing")
    _ingest(spark, store, 0, 9)
    q = streaming.ingest_stream(spark, f"{base}/landing", store, f"{base}/ckpt", as_of=AS_OF)
    q.awaitTermination()
    assert q.exception() is None
    assert store.postings().count() == 6


def test_compact_then_batch_zero_keeps_all(spark):
    store = _store(spark, 8)
    compacted = PostingStore(spark, store.compact("postings", 1))
    _ingest(spark, compacted, 0, 1)
    assert compacted.postings().count() == 9


def test_two_edits_under_one_batch(spark):
    store = _store(spark, 2)
    assert store.set_status("seek-seed0", "Applied", AS_OF, batch_id=5) == 1
    assert store.set_status("seek-seed1", "Rejected", AS_OF, batch_id=5) == 1
    assert store.set_status("seek-seed0", "Interviewing", AS_OF, batch_id=5) == 1  # the same second: it wins
    assert store.set_status("seek-seed0", "Interviewing", AS_OF, batch_id=5) == 0
    got = {r.job_board_id: r.status for r in store.view().collect()}
    assert got == {"seek-seed0": "Interviewing", "seek-seed1": "Rejected"}
    assert sorted(r.seq for r in store.read("status_changes").collect()) == [0, 0, 1]


def test_two_appends_under_one_batch(spark):
    store = _store(spark, 2)
    for i in range(2):
        row = (f"seek-seed{i}", "letter", "mail", "g", AS_OF, None)
        store.append_materials(spark.createDataFrame([row], schema.MATERIALS), 0)
        store.append_dead(spark.createDataFrame([(f"seek-seed{i}", AS_OF)], schema.DEAD_MARKS), 0)
    assert store.read("materials").count() == 2 and store.read("dead_marks").count() == 2


def test_replay_of_an_older_batch_writes_nothing(spark):
    store = _store(spark)
    _ingest(spark, store, 0, 1, 2)
    _ingest(spark, store, 1, 2, 3, 4)
    before = sorted(map(tuple, store.postings().collect()))
    s = {r.source_ord: r.new for r in _ingest(spark, store, 0, 1, 2).collect()}
    assert s[None] == 2  # what it did the first time
    assert sorted(map(tuple, store.postings().collect())) == before


def test_stream_does_not_touch_texts_of_a_command(spark):
    store = _store(spark, 4)
    store.generate("cv", lambda: lambda ps: ["made" for _ in ps], AS_OF, 0, limit=3)
    base = tempfile.mkdtemp(prefix="pf-safe-")
    q = streaming.generation_stream(spark, store, f"{base}/ckpt", "cv", lambda: lambda ps: ["late" for _ in ps], as_of=AS_OF)
    q.awaitTermination()
    assert q.exception() is None
    assert sorted(r.cover_letter for r in store.read("materials").collect()) == ["late", "made", "made", "made"]


def test_key_collision_is_reported(spark):
    from postflow.operators import ingest

    inc = incoming(spark, [{"url": "https://x/1", "job_board_id": "seek-same"},
                           {"url": "https://x/2", "job_board_id": "seek-same"},
                           {"url": "https://x/1", "job_board_id": "seek-same"},
                           {"url": "https://x/3", "job_board_id": "seek-held"}])
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-safe-"))
    store.seed(postings(spark, [{"url": "https://other", "job_board_id": "seek-held"}]))
    total = [r for r in store.ingest(inc, AS_OF, 0).collect() if r.source_ord is None][0]
    assert (total.seen, total.new, total.key_collisions) == (4, 1, 2)
    lost = store.read("rejects").filter("reason = 'key collision'").collect()
    assert sorted(r.entry_ord for r in lost) == [1, 3] and all("https://x/" in r.raw for r in lost)
    assert ingest.KEY_COLLISION == "key collision"


def test_ingest_leaves_no_text_in_checkpoints(spark):
    from postflow.session import checkpoint_dir

    store = _store(spark)
    marker = "zq" * 40
    body = {"jobs": [{"title": "T", "absolute_url": "https://b/1", "content": marker}]}
    store.ingest_payloads(payloads(spark, [(0, "greenhouse", "acme", body)]), None, AS_OF, 0)
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    assert not any(marker.encode() in f.read_bytes() for f in folder.rglob("part-*") if f.is_file())


def test_store_rekey_and_prune(spark):
    store = PostingStore(spark, tempfile.mkdtemp(prefix="pf-safe-"))
    store.seed(postings(spark, [
        {"id": 1, "url": "https://a.example/land/ad/77?x=1", "source": "adzuna", "job_board_id": "adzuna-old"},
        {"id": 2, "url": "https://s/2", "job_board_id": "seek-2"}]))
    store.set_status("adzuna-old", "Applied", AS_OF)
    store.append_dead(spark.createDataFrame([("seek-2", AS_OF)], schema.DEAD_MARKS), 0)
    moved = PostingStore(spark, store.rekey("adzuna", 1))
    got = {r.id: (r.job_board_id, r.status) for r in moved.view().collect()}
    assert got[1][0] != "adzuna-old" and got[1][1] == "Applied" and got[2] == ("seek-2", "To Apply")
    pruned = PostingStore(spark, moved.prune_removed(2))
    assert [r.id for r in pruned.view().collect()] == [1]
