"""Readers of landed tables (what a fetcher wrote), always with the declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from postflow import schema

LANDED: dict[str, T.StructType] = {
    "payloads": schema.PAYLOADS,
    "responses": schema.RESPONSES,
    "fetch_log": schema.FETCH_LOG,
    "status_changes": schema.STATUS_CHANGES,
    "dead_marks": schema.DEAD_MARKS,
    "materials": schema.MATERIALS,
    "sources": schema.SOURCES,
}


def read_landed(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed table in Parquet or JSON lines; nothing is inferred.

    JSON lines are read in FAILFAST mode so a malformed line stops the job
    instead of silently turning into nulls.
    """
    st = LANDED[name]
    reader = spark.read.schema(st)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.option("mode", "FAILFAST").json(path)
    raise ValueError(f"unsupported landed format: {fmt!r}")


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """A `<type> <token>` source-list file as lines (parse with `config.parse_source_lines`)."""
    return spark.read.text(path)
