"""Divergence audit, URL filters and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from fixtures import CLASHING, SCHEMA, texts
from pyspark.sql import functions as F

from postflow.llm import op11_divergence, op12_url_filter, op13_conversation


def plain_divergence(rows, least_docs=3, top=200):
    docs = []
    for text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs.append((lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)))
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= least_docs}
        counts = defaultdict(Counter)
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if t in kept)
        total = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            parts = {"pair": [(o, sum(f(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s],
                     "term": [(t, f(share(c, t), share(total, t))) for t in kept if c[t] and share(c, t) > share(total, t)]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return out


def document_rows():
    rng = random.Random(11)
    long = "日本" * 40  # 240 bytes: prefixes of six levels
    own = [*texts(), *[long, long + "x"] * 8, *["abcdefgh " * 3, "ABCDEFGH", "abcdefghi", "abcdefgh"],
           *["abcd"] * 3, *["abcde x"] * 2]
    return [(rng.choice([0, 1, i, None]), t, rng.choice(["en", "fr", "", None, "en"]), rng.choice(["a", "b", "é", "", None]), 0)
            for i, t in enumerate(own)] + [(1, None, "xx", "a", 0), (2, "lone words", "xx", "b", 0), (2, "", "yy", "b", 0)]


def test_divergence_is_the_plain_one(spark, monkeypatch):
    rows = document_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING + ("lang_", "part", "rank", "prefix", "docs", "mass"):
        df = df.withColumn(c, F.lit("x"))
    monkeypatch.setattr(op11_divergence, "CELLS", 4000)  # many blocks of terms
    got = [tuple(r) for r in op11_divergence.divergence(df.repartition(3), top=20).collect()]
    assert sorted(got) == sorted(plain_divergence([r[1:4] for r in rows], top=20))


def test_kept_terms_whatever_the_bitmap(spark):
    rows = document_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r["lang"], bytes(r["prefix"])) for r in op11_divergence.kept_terms(df).collect()}
    assert want == {(r["lang"], bytes(r["prefix"])) for r in op11_divergence.kept_terms(df, bits=32768).collect()}
    assert ("en", ("日本" * 40).encode()) in want or ("", ("日本" * 40).encode()) in want
    assert not op11_divergence.divergence(df.limit(0)).collect()


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in rules:
        if h is None or v not in ("allow", "block"):
            continue
        h, p = re.sub("[A-Z]", lambda m: m[0].lower(), h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v)
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best and best[1], best[2] if best else default


def url_rows():
    rng = random.Random(12)
    labels = ["a", "b", "com", "Example", "x.y", "é", "www"]
    made = ["http" + rng.choice(["://", "s://", ":/"]) + ".".join(rng.choice(labels) for _ in range(rng.randint(0, 4)))
            + rng.choice(["", "/", "/en/", "/en", "/é/1", "//", ":8080/en/x"]) + rng.choice(["", "?a=/en/", "#x", "?"])
            for _ in range(300)]
    made += [None, "", "://", "x", "a://b://c/en/", "http://a.b\n.com/en/", "http://" + "a." * 3000 + "com/" + "en/" * 5000]
    return [(i if i % 7 else None, u, "<p>") for i, u in enumerate(made + made[:9])]


def url_rules():
    rng = random.Random(13)
    hosts = ["com", "a.com", "example.com", "www.Example.com", "b", "", "x.y.b", "é", "a"]
    return [(rng.choice(hosts), rng.choice(["", "/", "/en/", "/é", "/e"]), rng.choice(["allow", "block"])) for _ in range(25)] + [
        (None, "/", "block"), ("com", None, "block"), ("b", "/", None), ("b", "/", "other"), ("c", "/", "block"), ("c", "/", "allow")]


RULES = "host string, path string, verdict string"


@pytest.mark.parametrize("keys_a_file", [4_000_000, 10])
def test_url_verdicts_are_the_plain_ones(spark, monkeypatch, keys_a_file):
    monkeypatch.setattr(op12_url_filter, "KEYS_A_FILE", keys_a_file)
    rows, rules = url_rows(), url_rules()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    got = op12_url_filter.judge_urls(df.repartition(3), spark.createDataFrame(rules, RULES)).collect()
    want = [(i, *plain_verdict(u, rules)) for i, u, _ in rows]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in op12_url_filter.judge_urls(pages, none, "block").collect()] == [(1, "a.com", "/x", None, "block")]
    assert not op12_url_filter.judge_urls(pages.limit(0), spark.createDataFrame(url_rules(), RULES)).collect()


def test_equal_digests_are_told_apart_by_the_strings(monkeypatch):
    monkeypatch.setattr(op12_url_filter, "_digest", lambda key: len(key) % 2)
    batch = next(op12_url_filter._digests(iter([_keys([("a", "/", "block", None), ("b", "/", "allow", None), ("a", "", None, [1]),
                                                      ("b", "", None, [1])])])))
    order = batch.to_pandas().sort_values(["digest", "key"])
    [blob] = op12_url_filter._file(iter([pa.RecordBatch.from_pandas(order, schema=batch.schema, preserve_index=False)]))
    with tempfile.NamedTemporaryFile(suffix=".idx") as f:
        f.write(blob.column("bytes")[0].as_py() + b"\n")
        f.flush()
        index = op12_url_filter.DigestIndex([f.name], digest=lambda key: len(key) % 2)
        got = op12_url_filter.longest_rules(index, ["a", "b", "c", "x.b"], ["/", "/1", "/", "/"])
    assert got == [("a/", "block"), ("b/", "allow"), None, ("b/", "allow")]


def _keys(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]),
         pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["host", "path", "verdict", "lengths"])


# ---- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    """Every state's cheapest (cost, audit, lines), extended row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    n, seen, symbols = Counter(), set(), []
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        n[fault] += 1
        seen.add((role, text))
        symbols.append((role, text, fault))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for q, (c, a, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    to = NEXT.get((q, role[0]))
                    if to:
                        new = (c + 5, a + "I", lines + (f"{role}:",))
                        states[to] = min(states.get(to, new), new)
        return states

    states = {"": (0, "", ())}
    for role, text, fault in symbols:
        new = {}

        def put(q, value, new=new):
            new[q] = min(new.get(q, value), value)

        for q, (c, a, lines) in inserted(states).items():
            put(q, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if (q, role[:1]) in NEXT:
                put(NEXT[q, role[:1]], (c + extra, a + "K", lines + (f"{role}:{text}",)))
            for other in ("user", "assistant"):
                if (q, other[0]) in NEXT:
                    put(NEXT[q, other[0]], (c + extra + 1, a + "R", lines + (f"{other}:{text}",)))
        states = new
    c, a, lines = min(v for q, v in inserted(states).items() if q in ("", "a"))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, c, a, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation_rows(seed=14):
    rng = random.Random(seed)
    said = ["Hello.", "Yes!", "No?", "cut off", "", " \n", "é. ", "Hello.", None, ". cut", "x" * 2000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, 0]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]), rng.choice(said)))
    rows += [(None, t, "user", "Hi.") for t in range(6)] + rows[:30]
    rows += [(70, t, rng.choice(["user", "assistant", "system"]), rng.choice(said) if t % 3 else f"Turn {t}.") for t in range(400)]
    rows += [(71, None, "assistant", "Same.")] * 200 + [(-5, t, "user", "Again.") for t in range(150)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_repairs_are_the_plain_ones(spark, parts):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("seg", F.lit("x")).withColumn("cost", F.lit(1)).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in op13_conversation.repair_damaged(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by_conv = {c: [] for c in {r[0] for r in rows}}
    for r in plain_damage(rows):
        by_conv[r[0]].append(r)
    want = [(c, *plain_repair(own)) for c, own in by_conv.items()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_conversations_and_dropped_ones(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert not op13_conversation.repair_damaged(empty).collect()
    dropped = [(c, 0, "user", "Hi.") for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = op13_conversation.repair_damaged(spark.createDataFrame(dropped, CONVERSATIONS)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(dropped)


def test_powers_are_repeated_products():
    for symbol in ("s", "u!", "o", "x", "a"):
        m = op13_conversation.transition(symbol)
        product = op13_conversation._identity()
        for n in range(1, 40):
            product = op13_conversation._times(product, m)
            assert op13_conversation.whole_transition([[symbol, n]]) == product
