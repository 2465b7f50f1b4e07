"""Ingestion as Structured Streaming: deduplication, event windows, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.snapshots import Snapshots


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """A folder of Parquet files as a stream with an event time that watermarks accept."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, time: str = "ts", ttl: str = "30 days") -> DataFrame:
    """The first row of each key within the time a key is remembered."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, time: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Rows per window and key; works on streams and on tables."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), *keys, "n")


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process all that is there in micro-batches; ``handle`` must be idempotent per batch number."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stage_counts(events: DataFrame, time: str, width: str, stage: str, status: str, late: str = "1 hour") -> DataFrame:
    """Events of each stage and status in each window."""
    return tumbling_counts(events, time, width, stage, status, late=late)


def resumed(spark: SparkSession, path: str, schema, checkpoint: str, sink: str, key: str, time: str = "ts") -> None:
    """Take up new files since the last run: each batch's rows, once a key, go to a folder of their own number.

    The offsets are in ``checkpoint``; a batch that is run again after a failure overwrites its own folder.
    """
    once = deduplicated(event_stream(spark, path, schema, time), key, time)
    run_available(once, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}"))


def recomputed(changes: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], store: Snapshots) -> Callable[[DataFrame, int], None]:
    """A handler that works out aggregates again for the keys a batch touches alone, from all of ``changes``, and stores them.

    ``store`` holds one row a key, the newest one (its rules should be ``always``); a batch that is run again changes nothing.
    """

    def handle(batch: DataFrame, n: int) -> None:
        affected = batch.select(*keys).distinct()
        store.upsert(compute(changes.join(affected, keys, "left_semi")), f"batch {n}")

    return handle
