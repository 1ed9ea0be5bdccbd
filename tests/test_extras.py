from helpers import incoming, postings
from pyspark.sql import functions as F

from postflow.operators import extras


def test_provider_key_prefers_id(spark):
    df = spark.createDataFrame([("123", "https://a.example/land/ad/123?se=x&utm=y"),
                                (None, "https://a.example/land/ad/123?se=z"),
                                ("", "https://a.example/land/ad/123#frag")], "pid string, url string")
    keys = [r.k for r in df.select(extras.provider_key("adzuna", "pid", "url").alias("k")).collect()]
    assert keys[1] == keys[2] != keys[0]  # query and fragment do not change the URL key
    assert keys[0].startswith("adzuna-") and len(keys[0]) == 17


def test_rekey_collapses_and_is_idempotent(spark):
    old = extras.provider_key("adzuna", None, "url")
    rows = postings(spark, [
        {"id": 1, "url": "https://a.example/land/ad/77?x=1", "source": "adzuna"},
        {"id": 2, "url": "https://a.example/land/ad/77?x=2", "source": "adzuna"},
        {"id": 3, "url": "https://a.example/about", "source": "adzuna"},
        {"id": 4, "url": "https://s.example/9", "source": "seek", "job_board_id": "seek-keep"},
    ]).withColumn("job_board_id", F.when(F.col("source") == "adzuna", old).otherwise(F.col("job_board_id")))
    once = extras.rekey(rows, "adzuna")
    got = {r.id: (r.job_board_id, r.rekeyed) for r in once.collect()}
    assert set(got) == {1, 3, 4}  # 1 and 2 collapse onto one id-keyed row (lowest id kept)
    assert got[1][1] and not got[3][1] and got[4] == ("seek-keep", False)
    twice = {r.id: (r.job_board_id, r.rekeyed) for r in extras.rekey(once.drop("rekeyed"), "adzuna").collect()}
    assert {k: v[0] for k, v in twice.items()} == {k: v[0] for k, v in got.items()}
    assert not any(v[1] for v in twice.values())


def test_remote_always_passes(spark):
    df = spark.createDataFrame([("Data Analyst", "Remote - EU"), ("Data Analyst", "Paris"),
                                ("Chef", "Adelaide"), ("Data Analyst", "Adelaide")], "title string, location string")
    got = [r.ok for r in df.select(extras.matches_filters("title", "location", ["analyst"], ["adelaide"])
                                   .alias("ok")).collect()]
    assert got == [True, False, False, True]


def test_contacts(spark):
    rows = postings(spark, [{"description": "Write to jane.doe@acme.example.com today"},
                            {"description": "no address"},
                            {"description": "x@y.example.org", "contact_confidence": "none"}])
    got = sorted((r.contact_confidence, r.contact_email or "") for r in extras.find_contacts(rows).collect())
    assert got == [("none", ""), ("published", "jane.doe@acme.example.com")]


def test_board_candidates(spark):
    comp = spark.createDataFrame([("Acme Corp",), ("acme-corp",), ("Zed",)], "company string")
    known = spark.createDataFrame([("greenhouse", "acmecorp")], "type string, token string")
    got = sorted((r.type, r.token) for r in extras.board_candidates(comp, known).collect())
    assert got == [("ashby", "acmecorp"), ("ashby", "zed"), ("greenhouse", "zed"), ("lever", "acmecorp"),
                   ("lever", "zed")]


def test_manual_postings_key(spark):
    rows = spark.createDataFrame([("T", "C", "L", "D", "https://m/1")],
                                 "title string, company string, location string, description string, url string")
    r = extras.manual_postings(rows).collect()[0]
    assert r.job_board_id.startswith("manual-") and r.source == "manual"


def test_canonical_locations(spark):
    raw = spark.createDataFrame([("bengaluru",), ("Bangalore",), ("Mumbai",)], "location string")
    aliases = spark.createDataFrame([("Bangalore", "Bengaluru"), ("bengaluru", "Bengaluru")],
                                    "alias string, canonical string")
    got = sorted(r.location for r in extras.canonical_locations(raw, aliases).collect())
    assert got == ["Bengaluru", "Mumbai"]


def test_source_of_key(spark):
    inc = incoming(spark, [{"source": "greenhouse"}]).drop("source")
    assert extras.with_source(inc).collect()[0].source == "greenhouse"


def test_rekey_tables_keep_what_the_user_did(spark):
    from helpers import AS_OF

    from postflow import schema
    from postflow.operators import board

    rows = postings(spark, [{"id": 1, "url": "https://a.example/land/ad/77?x=1", "source": "adzuna", "job_board_id": "adzuna-old"}])
    sides = {
        "status_changes": spark.createDataFrame([("adzuna-old", "Applied", AS_OF, 0)], schema.STATUS_CHANGES),
        "materials": spark.createDataFrame([("adzuna-old", "letter", "mail", "g", AS_OF, None)], schema.MATERIALS),
        "dead_marks": spark.createDataFrame([("adzuna-old", AS_OF)], schema.DEAD_MARKS)}
    new = extras.rekey_tables(rows, "adzuna", **sides)
    r = board.current_view(new["postings"], new["status_changes"], new["materials"], new["dead_marks"]).collect()[0]
    assert r.job_board_id != "adzuna-old"
    assert (r.status, r.generated_cover_letter, r.dead_at) == ("Applied", "letter", AS_OF)


def test_board_states_lists_empty_boards(spark):
    from helpers import payloads

    from postflow.operators import ingest

    p = payloads(spark, [(0, "greenhouse", "empty", {"jobs": []}), (1, "greenhouse", "broken", "x"),
                         (2, "greenhouse", "match", {"jobs": [{"title": "Data", "absolute_url": "u", "location": {"name": "Remote"}}]}),
                         (3, "greenhouse", "other", {"jobs": [{"title": "Chef", "absolute_url": "u"}]})])
    res = ingest.scan(p, None)
    got = {r.token: r.state for r in extras.board_states(p, res.incoming, res.rejects, ["data"], []).collect()}
    assert got == {"empty": "live", "broken": "dead", "match": "match", "other": "live"}


def test_text_history_numbers_versions(spark):
    import datetime as dt

    from helpers import AS_OF

    from postflow import schema

    later = AS_OF + dt.timedelta(days=1)
    m = spark.createDataFrame([("k", "one", "m", "g", AS_OF, None), ("k", "two", "m", "g", later, None),
                               ("k", None, None, "g", later + dt.timedelta(days=1), "Timeout")], schema.MATERIALS)
    got = {r.version: (r.cover_letter, r.current) for r in extras.text_history(m, "k").collect()}
    assert got == {1: ("one", False), 2: ("two", True), 3: (None, False)}
