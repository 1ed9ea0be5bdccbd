"""Sharding, mixing, decontamination and the pipeline against plain versions."""

import hashlib
import importlib
import zlib
from collections import Counter

import pytest
from fixtures import frame, lower, rows, split, with_clashes
from pyspark.sql import functions as F

from postflow.llm import op01_sharding, op05_mixing, op08_decontamination, queries

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# -- sharding --------------------------------------------------------------------

def check_shards(got, data, shards):
    assert len(got) == len(data)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_even_and_gapless(spark, shards):
    data = rows()
    got = op01_sharding.shard_rows(with_clashes(frame(spark, data)), shards=shards).collect()
    check_shards(got, data, shards)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in data:
        b = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32, by_id[i].law, by_id[i].grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)


def test_shards_of_repeated_rows_and_null_ids(spark):
    data = [(5, "t", None, None, 1)] * 50 + [(5, "u", None, None, 1)] * 20 + [(None, None, None, None, 1)] * 13
    check_shards(op01_sharding.shard_rows(frame(spark, data), shards=7).collect(), data, 7)


def test_shards_do_not_depend_on_partitions(spark):
    data = rows()
    a, b = ({(r.doc_id, r.shard, r.slot) for r in op01_sharding.shard_rows(frame(spark, data, n), shards=7).collect()} for n in (1, 6))
    assert a == b


def walk(counts, shards, nodes):
    """Keys one by one: each to the first virtual node clockwise whose shard has room;
    keys at home first, as in `place`."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    ring = op01_sharding.ring(shards, nodes)
    home = {c: next((i for i, (slot, _) in enumerate(ring) if slot >= c[0]), 0) for c in counts}
    out, late = Counter(), []
    for c in sorted(counts):
        for _ in range(counts[c]):
            s = ring[home[c]][1]
            if room[s]:
                room[s] -= 1
                out[c, s] += 1
            else:
                late.append(c)
    at = dict(home)
    for c in late:
        while not room[ring[at[c]][1]]:
            at[c] = (at[c] + 1) % len(ring)
        room[ring[at[c]][1]] -= 1
        out[c, ring[at[c]][1]] += 1
    return out


@pytest.mark.parametrize("counts", [{}, {(0, 0): 1}, {(5, 1): 100}, {(i * 37 % 16384, i % 8): i % 11 for i in range(300)}])
def test_placement_is_the_clockwise_walk(counts):
    pieces = op01_sharding.place(counts, 6, 8)
    got = Counter()
    for *cell, lo, hi, shard, _ in pieces:
        got[tuple(cell), shard] += hi - lo
    assert +got == +walk(counts, 6, 8)


def test_most_keys_stay_when_the_table_grows(spark):
    ids = [(i, str(i), None, None, 1) for i in range(2000)]
    a, b = ({r.doc_id: r.shard for r in op01_sharding.shard_rows(frame(spark, ids[:n]), shards=10).collect()} for n in (1800, 2000))
    assert sum(a[i] == b[i] for i in a) > 0.75 * len(a)


# -- mixing ----------------------------------------------------------------------

def water_fill(sizes, weights, total, epochs):
    """The redistribution as it is told: clamp, share the excess, until feasible."""
    clamped = {}
    while True:
        open_ = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return {**clamped, **share}
        clamped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 3, "d": 5, "e": 9}, {"a": 10, "b": 0, "c": 7}, {"a": 5},
    {"é": 3, "z": 50, "a": 2, None: 400}, {}])
def test_targets_are_the_redistribution(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op05_mixing.targets(df).collect()}
    want = water_fill(sizes, weights, sum(sizes.values()), 3)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_targets_above_all_caps_are_the_caps(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20)], "source string, source_size long")
    assert {r.source: r.target for r in op05_mixing.targets(df, share=5.0).collect()} == {"a": 30, "b": 60}


def test_taken_words_meet_the_targets(spark):
    data = rows()
    got = op05_mixing.allot(with_clashes(frame(spark, data))).collect()
    assert len(got) == len(data)
    size = {i: len(split(t)) for i, t, *_ in data}
    per = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        per[r.source] += r.taken
    assert all(per[r.source] == int(r.target) for r in got)
    again = op05_mixing.allot(frame(spark, data, 2)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def plain_times(allotted):
    return Counter({i: (2 * taken + size) // (2 * size) for i, taken, size in allotted if size})


def test_mix_repeats_documents_as_planned(spark):
    data = rows()
    docs = with_clashes(frame(spark, data))
    want = plain_times((r.doc_id, r.taken, r["size"]) for r in op05_mixing.allot(docs).collect())
    out = op05_mixing.mix(docs)
    assert out.columns == docs.columns
    text = {i: t for i, t, *_ in data}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += 1
        assert r.text == text[r.doc_id]
    assert got == +want


def test_mix_of_null_and_repeated_ids_meets_the_targets(spark):
    words = [" ".join(f"w{i}" for i in range(10 + n)) for n in range(10)]
    data = [(None, words[n % 10 if n < 10 else 0], "en", "b", 0) for n in range(20)]
    data += [(7, words[n % 3], "en", None, 0) for n in range(12)] + [(n, words[n], "en", "a", 0) for n in range(9)]
    docs = frame(spark, data, 4)
    targets = {r.source: (r.target, max(len(split(w)) for w in words)) for r in op05_mixing.allot(docs).collect()}
    taken, times = Counter(), Counter()
    for r in op05_mixing.mix(docs).collect():
        taken[r.source] += len(split(r.text))
        times[r.doc_id, r.text, r.source] += 1
    assert all(abs(taken[s] - t) <= longest / 2 + 1 for s, (t, longest) in targets.items())
    held = Counter((i, t, s) for i, t, _, s, _ in data)
    assert all(n <= 3 * held[k] for k, n in times.items())


# -- decontamination ---------------------------------------------------------------

def brute_hits(data, items, width=10):
    windows = {}
    for item, t in items:
        w = split(lower(t), WORD)
        n = min(len(w), width)
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for i, t, *_ in data:
        w = split(lower(t), WORD)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p:p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def items_of(data):
    long = [t for _, t, *_ in data if t and 12 < len(split(t)) < 100]
    return [(1, long[0]), (2, " ".join(split(long[3])[2:14])), (10, long[5].upper() + "!"), (3, split(long[7])[0]), (4, "é"), (5, ""),
            (6, None), (7, "never seen in any text at all, not once"), (8, long[0]), (8, long[0]), (11, "ab ab ab ab ab ab ab ab ab ab ab")]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination_matches_brute_force(spark, limit):
    data = rows()
    items = items_of(data)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(1)})
    got = op08_decontamination.contamination(with_clashes(frame(spark, data)), bench, broadcast_rows=limit)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect())) == brute_hits(data, items)
    clean = {r[0] for r in brute_hits(data, items) if not r[5]}
    assert {r.doc_id for r in op08_decontamination.drop_contaminated(frame(spark, data), bench).collect()} == clean


def test_contamination_of_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    data = [(None, "one two", None, None, 0), (1, None, None, None, 0), (1, None, None, None, 0)]
    got = op08_decontamination.contamination(frame(spark, data), none).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (0, 0, False), (2, 0, False)]
    assert op08_decontamination.contamination(frame(spark, []), none).isEmpty()
    bench = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    got = [r for r in op08_decontamination.contamination(frame(spark, data), bench).collect() if r.doc_id is None][0]
    assert (got.n_hit, got.n_items, got.contaminated) == (2, 0, True)


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_drop_contaminated_judges_each_row(spark, broadcast_rows):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    data = [(i, t, None, None, 0) for i in (None, 4) for t in ("one two", "three", "so one two", "three", None)]
    out = op08_decontamination.drop_contaminated(with_clashes(frame(spark, data)), bench, broadcast_rows=broadcast_rows)
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [
        (0, ""), (0, "three"), (0, "three"), (4, ""), (4, "three"), (4, "three")]


@pytest.mark.parametrize("run", [op01_sharding.shard_rows, op05_mixing.allot, op05_mixing.mix])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).isEmpty()


# -- the queries and the pipeline ----------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {','.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_no_python_in_the_native_plans(spark):
    for name in ("op1_sharding", "op2_exact_dedup", "op5_mixing", "op8_decontamination"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, before = docs.columns, None
    for name, stage in pipeline.STAGES:
        out = pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        got = out.collect()
        if name == "near_dedup":
            from test_llm_dedup import brute_near

            data = [tuple(r) for r in docs.collect()]
            assert {r.doc_id for r in got} == {i for i, _, _, k in brute_near(data, 5, 80) if k}
        if name == "decontamination":
            data = [tuple(r) for r in docs.collect()]
            hits = brute_hits(data, [tuple(r) for r in benchmark.select("item_id", "text").collect()])
            assert {r.doc_id for r in got} == {r[0] for r in hits if not r[5]}
        if name == "mixing":
            plan = plain_times((r.doc_id, r.taken, r["size"]) for r in op05_mixing.allot(docs).collect())
            assert Counter(r.doc_id for r in got) == +plan
            assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in docs.collect()}
        if name == "sharding":
            check_shards(got, docs.collect(), 40)
        else:
            assert out.columns == columns
            assert before is None or name == "mixing" or len(got) <= before
        docs, before = out, len(got)
    assert pipeline.run(spark, SF).count() == before


def test_pipeline_on_an_empty_table_and_null_and_repeated_ids(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":
            id_ = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 7 == 0, 7).otherwise(F.col("doc_id"))
            table = table.withColumn("doc_id", id_).union(table.limit(20))
        table.write.parquet(f"{tmp_path}/odd/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert any(r.doc_id is None for r in got) and any(r.doc_id is not None for r in got)
    slots = Counter(r.shard for r in got)
    assert sum(slots.values()) == len(got)
