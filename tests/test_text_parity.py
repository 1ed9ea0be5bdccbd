"""The JVM text rules agree with the Python ones they replace (strip, key hash, folding)."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postflow.functions import text

# Unicode text including the white space Python's strip removes (tabs, newlines,
# no-break and other spaces, U+001C..U+001F) and characters whose case folds oddly.
_chars = st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f  　 abcXYZé İß-._/?"))
_texts = st.lists(_chars, max_size=12).map("".join) | st.text(max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(_texts, min_size=1, max_size=40))
def test_strip_and_key_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(text.strip("v").alias("s"), text.posting_key(F.lit("seek"), "v").alias("k"),
                    text.slug("v").alias("g")).collect()
    for v, r in zip(values, got):
        assert r.s == v.strip(), repr(v)
        assert r.k == "seek-" + hashlib.sha1(v.encode()).hexdigest()[:10]
        assert r.g == v.strip().replace(" ", "-").lower()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(_texts, _texts), min_size=1, max_size=30))
def test_folded_contains_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, n string")
    got = df.select(text.contains_folded("h", "n").alias("c")).collect()
    for (h, n), r in zip(pairs, got):
        assert r.c == (n.lower() in h.lower()), (h, n)


def test_first_non_empty_and_remote(spark):
    df = spark.createDataFrame([(None, "", "c"), ("", None, None), ("a", "b", None)], "a string, b string, c string")
    got = [r.x for r in df.select(text.first_non_empty("a", "b", "c").alias("x")).collect()]
    assert got == ["c", "", "a"]
    df = spark.createDataFrame([("", True), ("Berlin", True), ("remote - EU", True), ("Berlin", False),
                                ("Berlin", None)], "l string, r boolean")
    got = [r.x for r in df.select(text.fold_remote("l", "r").alias("x")).collect()]
    assert got == ["Remote", "Berlin (Remote)", "remote - EU", "Berlin", "Berlin"]
