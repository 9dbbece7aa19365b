"""Ingestion of dropped files as micro-batches over a versioned state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.mutations import KEY, expired, keyed_replace, retain
from ..sources.tables import Versions


def keyed_versions(spark: SparkSession, state: str, buckets: tuple[int, int] = (4, 4)) -> Versions:
    """A table of documents in buckets by their key, the tenant first."""
    return Versions(spark, state, KEY, buckets)


def merged_batch(versions: Versions, stream: str) -> int:
    """The number of the stream's last batch that the table holds, -1 if none."""
    latest = versions.latest()
    return -1 if latest is None else versions.manifest(latest)["streams"].get(stream, -1)


def merge_batch(versions: Versions, batch: DataFrame, number: int, empty: DataFrame, stream: str = "stream") -> None:
    """M10, ST2: the next version is the latest with the batch merged in, and names the stream and the batch.

    A batch that comes again after a failure and is in the table already
    changes nothing. Versions that others write between batches are built on.
    Of a table in buckets by the documents' key only those of the batch's keys
    are read and written.
    """
    if number <= merged_batch(versions, stream):
        return
    latest = versions.latest()
    touched = versions.buckets_of(batch)
    before = empty if latest is None else versions.read(latest, touched)
    versions.append(keyed_replace(before, batch, top=versions.top(latest)).state, latest, f"{stream} batch {number}", touched, batch=(stream, number))


def ingest(
    spark: SparkSession, source: str, schema: StructType, prepare, empty: DataFrame, state: str, checkpoint: str, every: str | None = "10 minutes", files: int = 100
) -> StreamingQuery:
    """ST1-ST4: merge files that appear in `source`; every=None takes what is there and ends.

    prepare: file rows -> incoming documents. One batch runs at a time. The
    stream is named by its checkpoint, so a new checkpoint over an old state
    begins a new stream upon it.
    """
    versions = keyed_versions(spark, state)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_batch(versions, prepare(df), n, empty, checkpoint))
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def retention_job(versions: Versions, as_of, days: int = 90) -> int:
    """ST5: write the version after the latest without expired documents; returns its number. Buckets without any stay as they are."""
    latest = versions.latest()
    touched = versions.buckets_of(versions.read(latest).where(expired(as_of, days)))
    return versions.append(retain(versions.read(latest, touched), as_of, days), latest, f"retention {uuid.uuid4().hex}", touched)
