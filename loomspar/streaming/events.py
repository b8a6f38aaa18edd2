"""Structured Streaming over the event table: windowed counts with a watermark, and last writes by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.runtime import shared_dir, table


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet*")


def daily_counts(stream: DataFrame, late: str = "100 days") -> DataFrame:
    """(day, event_type, n, total) by event time; events later than the watermark are dropped by design of a stream, so it must exceed the disorder of the source."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def run_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The stream run over all that is there now; complete mode keeps every window, and the last batch is the result."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    run = daily_counts(read_events(spark, folder)).writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out")
