"""Snapshots as a stream, and how a stream is run over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import SNAPSHOTS


def snapshot_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Append-only snapshot files as a stream."""
    reader = spark.readStream.schema(SNAPSHOTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand everything that is there to ``apply`` in micro batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
