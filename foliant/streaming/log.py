"""The request log as a stream: file source, watermark, window counts, deduplication, and an append-only sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, ts: str, by: Sequence[str], length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per window and key; the same plan runs on a table or a stream (``late`` sets the watermark)."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        stamped = stamped.withWatermark("__ts", late)
    out = stamped.groupBy(F.window("__ts", length, slide), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n")


def distinct_events(events: DataFrame, ts: str, key: Sequence[str], late: str) -> DataFrame:
    """Events once each, whatever was delivered again within the watermark."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(list(key)).drop("__ts")


def over_limit(events: DataFrame, ts: str, client: str, most: int = 60, length: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Clients that ask more often than a fixed window allows."""
    return window_counts(events, ts, [client], length, late=late).where(F.col("n") > most)


def append_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now and stops; the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
