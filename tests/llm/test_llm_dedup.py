"""Exact, near, substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, lower, rows, split, with_clashes
from pyspark.sql import functions as F

from postflow.llm import op02_exact_dedup, op03_suffix_dedup, op06_near_dedup, op07_substring_dedup, runs
from postflow.llm import textarrays as ta
from postflow.llm.common import materialize
from postflow.llm.components import components, joined


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- exact ---------------------------------------------------------------------

def brute_exact(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha((t or "").encode()))
                  for i, t, *_ in data)


def test_exact_matches_brute_force(spark):
    data = rows()
    got = op02_exact_dedup.exact_duplicates(with_clashes(frame(spark, data)))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_exact(data)


def test_exact_survives_hash_collisions(spark):
    data = rows()
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 5), 32, "0"))  # noqa: E731  five hashes for all
    got = op02_exact_dedup.exact_duplicates(frame(spark, data), hashed=weak)
    assert sorted(map(tuple, got.collect())) == brute_exact(data)


def test_exact_repeated_rows_and_null_ids(spark):
    data = [(1, "t", None, None, 1), (1, "t", None, None, 1), (None, "t", None, None, 1), (None, "only", None, None, 1)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in
                  op02_exact_dedup.exact_duplicates(frame(spark, data)).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=repr)


# -- near ----------------------------------------------------------------------

def shingles(text, k):
    w = split(lower(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(data, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in data]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("k, percent", [(4, 80), (5, 80)])
def test_near_matches_brute_force(spark, k, percent):
    data = rows()
    got = op06_near_dedup.near_duplicates(with_clashes(frame(spark, data)), words=k, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute_near(data, k, percent)


def test_near_large_group_of_variants(spark):
    """Variants of one text: most pairs are below the threshold, some components hang
    together through others, and no pivot alone finds them."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(160):
        w = list(base)
        for p in rng.choice(150, rng.integers(1, 7), replace=False):
            w[p] = f"x{i}_{p}"
        if i % 9 == 0:
            del w[rng.integers(0, 140)]
        data.append((i, " ".join(w), None, None, 0))
    got = op06_near_dedup.near_duplicates(frame(spark, data), words=4, percent=80)
    assert sorted(map(tuple, got.collect())) == brute_near(data, 4, 80)


def test_near_short_texts_with_one_common_line(spark):
    line = "this line stands at the head of every text here"
    data = [(i, f"{line} own{i} words{i} of{i} text{i}" + (" tail" if i % 5 == 0 else ""), None, None, 0) for i in range(120)]
    data += [(200 + i, f"{line} own{i} words{i} of{i} text{i}x", None, None, 0) for i in range(5)]
    got = op06_near_dedup.near_duplicates(frame(spark, data), words=2, percent=80)
    assert sorted(map(tuple, got.collect())) == brute_near(data, 2, 80)


def test_near_repeated_rows_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten"
    data = [(5, t, None, None, 1), (5, t, None, None, 1), (None, t, None, None, 1), (None, "alone in here", None, None, 1)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in
                  op06_near_dedup.near_duplicates(frame(spark, data)).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, True), (None, None, True)], key=repr)


def test_near_copies_of_a_text_without_id(spark):
    """The base has no id, its copies are near the base only; two texts share an id."""
    base = [f"w{i}" for i in range(200)]
    copy = lambda i: " ".join(base[:15 * i + 5] + [f"own{i}_{j}" for j in range(14)] + base[15 * i + 19:])
    data = [(None, " ".join(base), None, None, 0)] * 3 + [(i, copy(i), None, None, 0) for i in range(1, 11)]
    data += [(None, copy(11), None, None, 0), (3, "a text of its own under the id of another", None, None, 0)]
    numbered = [(i, t, *r) for i, (_, t, *r) in enumerate(data)]
    assert len({c for i, _, c, _ in brute_near(numbered, 5, 80) if i < 14}) == 1
    assert len({c for i, _, c, _ in brute_near(numbered[3:], 5, 80)}) == 12  # without the base: no link
    got = op06_near_dedup.near_duplicates(frame(spark, data)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == sorted(
        [(0, 1, True)] * 4 + [(i, 1, i == 1) for i in range(1, 11)] + [(3, 3, True)])


def test_drop_near_keeps_one_of_each_group(spark):
    data = rows()
    kept = {i for i, _, _, k in brute_near(data, 5, 80) if k}
    out = op06_near_dedup.drop_near_duplicates(with_clashes(frame(spark, data)))
    assert out.columns == with_clashes(frame(spark, data)).columns
    assert {r.doc_id for r in out.collect()} == kept


def test_drop_near_with_null_and_repeated_ids(spark):
    copies = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcd"}
    rows = [(None, "a"), (None, "a"), (7, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (5, "d"), (9, "d")]
    data = [(i, copies[x], None, None, n) for n, (i, x) in enumerate(rows)] + [(None, " ", None, None, 0), (5, None, None, None, 0)]
    out = op06_near_dedup.drop_near_duplicates(with_clashes(frame(spark, data)))
    got = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in out.collect())
    assert got == sorted([(7, "a"), (5, "b"), (0, "c"), (5, "d"), (0, " "), (5, "")])


def test_register_estimates():
    rng = np.random.default_rng(1)
    for n, share in ((200, 0.8), (5000, 0.8), (5000, 0.3)):
        u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        both = int(len(u) * 2 * share / (1 + share))
        a, b = u, np.unique(np.concatenate([u[:both], ta.mix(u[both:])]))
        make, over = (op06_near_dedup.small_registers, 1) if n <= op06_near_dedup.SMALL else (op06_near_dedup.registers, 256)
        est, m = op06_near_dedup.estimate(make(a)[None], make(b)[None], np.array([len(a) / over]), np.array([len(b) / over]))
        true = both / (len(a) + len(b) - both)
        assert abs(est[0] - true) < 5 * (true * (1 - true) / m[0]) ** 0.5


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_components_take_few_rounds(spark, monkeypatch):
    """The driver plans every round: a chain of any length takes a few small ones, without
    a join to hang its nodes up."""
    plans = []

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        assert len(plans) <= 8
        return materialize(df, name)

    monkeypatch.setattr("postflow.llm.components.materialize", written)
    n = 2000
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(6)
    got = components(chain)
    assert got.count() == n + 1 and got.filter("component != 0").isEmpty()
    assert not [p for name, p in plans if name == "hooks" and "Join" in p]


def test_components_of_random_links(spark, monkeypatch):
    """Repeated links, links to itself, either end first; at one go, and a few links at a time."""
    rng = random.Random(8)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(130)]
    links += links[:20] + [(b, a) for a, b in links[20:40]] + [(400, 400), (1 << 60, -(1 << 60)), (1 << 60, (1 << 60) - 1)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert sorted(map(tuple, components(links).collect())) == sorted(root.items())
    monkeypatch.setattr("postflow.llm.components.LINKS", 7)
    taken = [b.num_rows for b in joined(iter(links.toArrow().to_batches()))]
    assert len(taken) > 20 and max(taken) <= 14
    assert sorted(map(tuple, components(links).collect())) == sorted(root.items())


# -- substring -------------------------------------------------------------------

def brute_windows(data, n=20):
    seen, out = set(), []
    for i, t, *_ in sorted(data):
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            key = tuple(w[p:p + n])
            if key in seen:
                gone[p:p + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode())))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 6])
def test_substring_matches_brute_force(spark, parts):
    data = rows()
    got = op07_substring_dedup.remove_repeats(with_clashes(frame(spark, data, parts)), window=20)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_windows(data)


def brute_bytes(data, n=50):
    first, out = {}, []
    for i, t, *_ in sorted(data, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p:p + n], i)
    for i, t, *_ in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < i:
                gone[p:p + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out)


@pytest.mark.parametrize("parts, index_bytes", [(1, 200), (6, 1 << 20)])
def test_suffix_matches_brute_force(spark, monkeypatch, parts, index_bytes):
    monkeypatch.setattr(op03_suffix_dedup, "INDEX_BYTES", index_bytes)  # small: many batches and levels
    data = rows()
    got = op03_suffix_dedup.remove_repeats(with_clashes(frame(spark, data, parts)))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_bytes(data)


def test_levels_merge_geometrically():
    rng = np.random.default_rng(2)
    family, held = op03_suffix_dedup.Levels(), {}
    for batch in range(200):
        values = np.unique(rng.integers(0, 5000, 20))
        found, key = family.least_key(values)
        for v, f, k in zip(values.tolist(), found, key, strict=True):
            assert f == (v in held) and (not f or k == held[v])
        new = values[~found]
        family.add(new, np.full(len(new), batch))
        held |= dict.fromkeys(new.tolist(), batch)
    sizes = [len(v) for v, _ in family.levels]
    assert sum(sizes) == len(held) and len(sizes) <= 13
    assert all(a >= 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))


def test_owners_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    h[50:120] = np.tile(h[50:57], 10)  # ties
    own = runs.owners(h, 11)
    for i, o in enumerate(own):
        w = h[i:i + 11] >> np.uint64(32)
        assert o - i == int(np.argmin(w))


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_scans_do_not_depend_on_batches(size):
    h = [1, 1, 2, 3, 3, 3, 4, 5]
    many = [False, False, False, False, False, False, True, False]
    full = pa.table({"h": pa.array(h, pa.int64()), "many": many, "key": pa.array(range(8), pa.int64()),
                     "tag": pa.array([0] * 8, pa.int64()), "at": pa.array([0] * 8, pa.int32())})
    out = runs.repeated_rows(full.to_batches(max_chunksize=size))
    assert sorted(k for b in out for k in b.column("key").to_pylist()) == [0, 1, 3, 4, 5, 6]
    later = pa.table({"h": pa.array([1, 1, 1, 2, 2, None], pa.int64()), "g": pa.array([0, 0, 1, 0, 0, 0], pa.int32()),
                      "key": pa.array([1, 1, 1, 2, 2, 9], pa.int64()),
                      "tag": pa.array([0] * 6, pa.int64()), "lo": pa.array([0, 4, 7, 3, 3, 5], pa.int32()),
                      "n": pa.array([1] * 6, pa.int32())})
    out = runs.later_rows(later.to_batches(max_chunksize=size))
    got = sorted((k, lo) for b in out for k, lo in zip(b.column("key").to_pylist(), b.column("lo").to_pylist(), strict=True))
    assert got == [(1, 4), (9, 5)]  # the same place twice is one place


@pytest.mark.parametrize("run", [
    op02_exact_dedup.exact_duplicates, op03_suffix_dedup.remove_repeats, op06_near_dedup.near_duplicates,
    op06_near_dedup.drop_near_duplicates, op07_substring_dedup.remove_repeats])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


@pytest.mark.parametrize("run", [op03_suffix_dedup.remove_repeats, op07_substring_dedup.remove_repeats])
def test_removal_with_repeated_rows_and_null_ids(spark, run):
    t = " ".join(f"w{i}" for i in range(60))
    data = [(5, t, None, None, 1), (5, t, None, None, 1), (None, t, None, None, 1), (9, None, None, None, 1)]
    got = sorted(((r.doc_id, r.n_removed > 0) for r in run(frame(spark, data)).collect()), key=repr)
    # the row without an id comes first, so its text stays; equal rows are treated alike
    assert got == sorted([(None, False), (5, True), (5, True), (9, False)], key=repr)


def shared_rows():
    """The table's texts under few ids, many of them null or shared, some rows twice."""
    rng = np.random.default_rng(5)
    ids = [None, None, 1, 2, 3, *range(10, 40)]
    data = [(ids[rng.integers(len(ids))], *r[1:]) for r in rows()]
    return data + data[:20]


def test_suffix_cuts_each_row_by_its_own_text(spark):
    data = shared_rows()
    got = [tuple(r) for r in op03_suffix_dedup.remove_repeats(frame(spark, data, 5)).collect()]
    least = -(1 << 63)
    want = brute_bytes([(least if i is None else i, *r) for i, *r in data])
    assert sorted((least if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_substring_cuts_each_row_by_its_own_text(spark):
    data = shared_rows()
    df = frame(spark, data, 5)
    got = [tuple(r) for r in op07_substring_dedup.remove_repeats(df).collect()]
    least, order = -(1 << 63), {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    # rows of one id are told apart by, and come in the order of, their texts' hashes
    texts = {((least if i is None else i), order[t], t) for i, t, *_ in data}
    texts = sorted(texts, key=lambda r: r[:2])
    one_each = {k: w[1:] for k, w in zip(texts, brute_windows_in_order(texts), strict=True)}
    want = sorted((least if i is None else i, *one_each[least if i is None else i, order[t], t]) for i, t, *_ in data)
    assert sorted((least if r[0] is None else r[0], *r[1:]) for r in got) == want


def brute_windows_in_order(texts, n=20):
    seen, out = set(), []
    for i, _, t in texts:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            key = tuple(w[p:p + n])
            if key in seen:
                gone[p:p + n] = [True] * n
            seen.add(key)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


@pytest.mark.parametrize("run", [op03_suffix_dedup.remove_repeats, op07_substring_dedup.remove_repeats])
def test_texts_of_one_id_leave_each_other_alone(spark, run):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(1, a, None, None, 1), (5, a[:200] + " " + c, None, None, 1), (5, b, None, None, 1)]
    got = sorted((r.doc_id, r.n_removed) for r in run(frame(spark, data)).collect())
    assert [g[0] for g in got] == [1, 5, 5] and got[0][1] == got[1][1] == 0 and got[2][1] > 0
