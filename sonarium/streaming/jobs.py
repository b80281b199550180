"""Incremental processing on Structured Streaming: new files once, current state, emit-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators.state import last_wins
from sonarium.session import exists


def new_rows(spark: SparkSession, folder: str, schema: str, form: str = "parquet") -> DataFrame:
    """X-01, X-02: a stream of the rows of files that appear in a folder; the checkpoint remembers which were read."""
    return spark.readStream.format(form).schema(schema).load(folder)


def run_once(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, most_seconds: float | None = None):
    """X-01, X-10: all that is there now, in batches through ``body``; a later call takes up where this one stopped.

    After ``most_seconds``, or if the caller is interrupted, the query is stopped: a batch that was not committed is run again by
    the next call, so nothing is lost and sinks that emit once emit nothing twice.
    """
    q = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(most_seconds) if most_seconds else q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    return q


def stages(*steps: Callable[[DataFrame], DataFrame], to: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """X-09: one body that prepares, enriches, converts and so on, step by step, and hands the result to the sink ``to``."""

    def body(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            batch = step(batch)
        to(batch, batch_id)

    return body


def emit_once(to: str, key: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """K-01, X-05: a sink that appends rows whose key the table does not hold yet, one row a key; a batch that is tried again adds nothing.

    The table is partitioned by a hash of the key, and of what is there a batch reads only the key column of the partitions
    that its own keys fall into. A table that cannot be read fails the batch.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if exists(spark, to):
            own = [r._bucket for r in new.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            seen = spark.read.parquet(to).where(F.col("_bucket").isin(own)).select(F.col(key).alias("_seen"), "_bucket").distinct()
            new = new.join(seen, (new["_bucket"] == seen["_bucket"]) & new[key].eqNullSafe(seen["_seen"]), "left_anti")
        new.write.mode("append").partitionBy("_bucket").parquet(to)

    return body


def upsert_log(to: str) -> Callable[[DataFrame, int], None]:
    """X-03, K-09: a sink that appends to a log whose current view is last_wins."""

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(to)

    return body


def current(spark: SparkSession, log: str, key: list[str], order: list[str]) -> DataFrame:
    """X-03: the current view of a log written by upsert_log."""
    return last_wins(spark.read.parquet(log), key, ["_batch", *order]).drop("_batch")


def deduplicated(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """X-05, in the stream itself: one row a key within the watermark ``late``, so the state is bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per window and key, late rows admitted up to the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))
