"""Survivors per source over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.session import shared_folder


def hourly_survivors(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, alive, n of each hour; events (batch or stream) later than ``late`` are dropped from a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count_if(F.col("event_id") % 9 != 0).alias("alive"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "alive", "n")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream, run to its end; one row per hour and type is kept.

    Each micro-batch writes the hours that it changed to a folder of its own, anew if it is repeated after a failure, so what is read
    at the end is each hour as the last batch left it.
    """
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}/survivors"
    counted = hourly_survivors(events)
    run = (
        counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/hours/batch={n}")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    written = spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{folder}/hours")
    return written.groupBy("start", "event_type").agg(F.max_by(F.struct("alive", "n"), "batch").alias("last")).select("start", "event_type", "last.*")
