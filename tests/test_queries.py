"""Every driver query against its DuckDB oracle on the smallest given tables."""

import hashlib
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from postflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("\x1f".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha256("\x1e".join(rows).encode()).hexdigest()


# The training-data queries have tests of their own, in tests/llm.
NAMES = sorted(catalog.QUERIES)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["source_ord", "source", "seen", "new", "rejected", "blank_urls", "key_collisions"]
    total = [r for r in rows if r.source_ord is None][0]
    assert total.seen >= total.new > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    s = entry.queries()[name](spark, SF).toPandas()
    o = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _digest(s) == _digest(o)
