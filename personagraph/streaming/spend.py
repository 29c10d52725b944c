"""Spend per hour as a stream, with the cap as an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import policy
from ..schemas import API_USAGE


#: Bookings as they arrive: each with an id, by which one that is delivered again is known.
BOOKINGS = f"booking_id bigint, {API_USAGE}"


def usage_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(BOOKINGS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def spend_per_window(usage: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Cents per service and window; bookings later than the delay are left to the batch ledger.

    Of a stream a booking counts once however often it is delivered within the delay, and in append mode every window
    is told once, when the watermark has passed it.
    """
    if usage.isStreaming:
        usage = usage.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["booking_id"])
    sums = usage.groupBy("service", F.window("occurred_at", window).alias("w")).agg(
        F.sum("est_cost_cents").alias("cents"), F.sum("units").alias("units")
    )
    return sums.select("service", F.col("w.start").alias("window_start"), "cents", "units")


def over_cap(windows: DataFrame, cap: int = policy.DEFAULT_CAP_CENTS) -> DataFrame:
    """Alerts: of a stream in append mode one for each window beyond the cap."""
    return windows.filter(F.col("cents") > cap)


def run_available(rows: DataFrame, folder: str) -> StreamingQuery:
    """Append what a stream tells of everything that is there to files in ``folder``, then stop."""
    query = (
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
