"""Indicators over a stream of events, beyond what batch readings need: the same
counts as the batch query, kept up to date in windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their values by window and type; rows later than ``late`` are
    dropped on a stream. Works on a batch table as well."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        stamped.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "value")
    )


def events_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Handles all that is there and stops. The result is a table in the shared
    folder, written by executors and replaced as a whole at each batch (mode
    ``complete``) or added to (``append``); nothing comes to the driver."""
    save = "overwrite" if mode == "complete" else "append"
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode(save).parquet(path)).start()
    )
    query.awaitTermination()
