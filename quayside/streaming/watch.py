"""A watched folder: each file that arrives is handled once; and event counts by time, with late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watch_folder(spark: SparkSession, folder: str, on_files: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Calls on_files with the files (path, modificationTime, length, content) that arrived since the last time. Changed and removed files are told by feedback.snapshot_diff over two listings."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    writer = files.writeStream.foreachBatch(on_files).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total of a stream or table of events (ts, event_type, value); later than `late` events don't count in a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_counts(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, width: str = "1 hour") -> DataFrame:
    """Reads the parquet files of a folder as a stream until all are in, into a table of windows; the last state of each window counts."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = event_counts(stream, width).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    return found.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
