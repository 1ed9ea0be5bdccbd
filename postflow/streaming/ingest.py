"""Incremental ingest and generation with Structured Streaming.

Both run `foreachBatch` over a file stream with an explicit schema and a
checkpoint, usually with `trigger(availableNow=True)` (process what has
landed, then stop). A stream is a writer of the store, named by its checkpoint,
and each micro-batch a batch of that writer: a batch replayed after a failure is
done once, and no other writer's rows are touched.
Keys stay unique for ever by the anti join against the stored table, not by
a streaming dedup with a watermark (which would forget old keys).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postflow import schema
from postflow.operators import materials as M
from postflow.sources.store import BATCH_COLUMNS, PostingStore, _with_batch, writer_of_stream


def land_payloads(payloads: DataFrame, landing_path: str, mode: str = "append") -> None:
    """Write fetched responses where the stream picks them up, one folder per source type."""
    payloads.select(*[f.name for f in schema.PAYLOADS.fields]).write.mode(mode).partitionBy("type").parquet(landing_path)


def ingest_stream(spark: SparkSession, landing_path: str, store: PostingStore, checkpoint_location: str,
                  sources: DataFrame | None = None, as_of: dt.datetime | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None,
                  fmt: str = "parquet") -> StreamingQuery:
    """Stream landed payload files (Parquet or JSON lines) into the store
    (scan -> first wins -> insert-if-absent)."""
    reader = spark.readStream.schema(schema.PAYLOADS).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(landing_path)
    writer = writer_of_stream(checkpoint_location)

    def batch(df: DataFrame, batch_id: int) -> None:
        stamp = as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        store.ingest_payloads(df, sources, stamp, batch_id, writer=writer)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def generation_stream(spark: SparkSession, store: PostingStore, checkpoint_location: str,
                      resume_summary: str, generator: str | M.GeneratorFactory,
                      as_of: dt.datetime | None = None, available_now: bool = True) -> StreamingQuery:
    """Generate texts for postings as they arrive in the store.

    A replayed batch that was committed generates nothing; rows that already hold
    a successful text, by whichever writer, are not sent to the generator.
    """
    writer = writer_of_stream(checkpoint_location)
    stream = spark.readStream.schema(_with_batch(schema.POSTINGS)).parquet(store.path("postings"))

    def batch(df: DataFrame, batch_id: int) -> None:
        stamp = as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        if store.committed("materials", writer, batch_id):
            return
        todo = M.pending_from(df.drop(*BATCH_COLUMNS), store.read_others("materials", writer, batch_id))
        store.write("materials", M.generate(M.prompts(todo, resume_summary), generator, stamp), writer, batch_id)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
