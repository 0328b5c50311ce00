"""Observation streams: late rows stay out behind a watermark, windows are final once closed, re-runs replace their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 4) -> DataFrame:
    """The rows of a folder's parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def final_windows(events: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums per key and window of event time; in append mode a window comes out once, when the watermark has passed its end."""
    held = events.withWatermark(time, late)
    grouped = held.groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), key, "n", "total")


def distinct_events(events: DataFrame, time: str, event_id: str, late: str = "2 hours") -> DataFrame:
    """Each event once, repeats within the watermark's reach dropped; state is bounded by it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])


def append_once(table: str, partition: str):
    """For foreachBatch: writes a micro-batch so that a re-run of a partition replaces it instead of adding to it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)

    return write


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is available now to a parquet table and stops; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
