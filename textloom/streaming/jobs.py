"""Structured Streaming variants: they read what has arrived, run to the end of it and leave a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import supervise


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of this name below the folder, as files that arrive; a table of one file is picked out by its name."""
    batch = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(batch.schema)
    if all(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles()[:1]):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


def drained(stream: DataFrame, out: str) -> DataFrame:
    """Append the stream to Parquet below out until nothing is left, with its checkpoint beside it; then the table."""
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def drained_batches(stream: DataFrame, out: str, work: Callable[[DataFrame, int], DataFrame], schema: str) -> DataFrame:
    """work on each micro-batch, its result appended under the batch's own folder, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{out}/data")


def deduplicated(docs: DataFrame, content: str = "text", at: str | None = None, late: str = "7 days") -> DataFrame:
    """One row per content as it arrives; the state holds a hash per distinct content.

    With at, the time of a row, the state of a content goes once the watermark is past its time by late, and copies that
    come later still pass. Without it the state is kept for as long as the stream runs, so that suits streams that end.
    """
    rows = docs.withColumn("content_hash", F.md5(F.col(content).cast("binary")))
    return rows.dropDuplicates(["content_hash"]) if at is None else rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per window; state is dropped once the watermark passes a window, as expired cache entries are."""
    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def supervised(batch: DataFrame, number: int, std: supervise.Standards) -> DataFrame:
    """The report of one micro-batch of (platform, status, title)."""
    return supervise.batch_report(batch, std).select("platform", "total", "success", "quality_issues")
