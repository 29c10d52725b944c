"""Counters of a run, observed while its frames are written: no pass or job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_COUNTERS = "run string, step string, counter string, value bigint"


class Counters:
    """What the steps of a run saw. A step is counted when the frame that ``watch`` returns is first written or read."""

    def __init__(self, run: str):
        self.run = run
        self._steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str, **counters: Column) -> DataFrame:
        """The frame, with its rows and ``counters`` (aggregates of whole numbers) observed as it passes."""
        seen = Observation()
        self._steps.append((step, seen))
        named = [F.coalesce(c.cast("bigint"), F.lit(0)).alias(name) for name, c in counters.items()]
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *named)

    def table(self, spark: SparkSession) -> DataFrame:
        """run, step, counter and value of every step; all watched frames must have been written by now."""
        rows = [(self.run, step, name, value) for step, seen in self._steps for name, value in sorted(seen.get.items())]
        return spark.createDataFrame(rows, RUN_COUNTERS)


def watched(counters: Counters | None, df: DataFrame, step: str, **more: Column) -> DataFrame:
    return df if counters is None else counters.watch(df, step, **more)
