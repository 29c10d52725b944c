"""Spend ledger and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from .spread import running


class BudgetExceeded(RuntimeError):
    pass


def bill(batches: DataFrame, cents_per_unit: float, as_of: Column) -> DataFrame:
    """Ledger rows (service, endpoint, units, note) with the cost of each batch rounded up."""
    return batches.filter("units > 0").select(
        "service", "endpoint", "units",
        F.ceil(F.col("units") * cents_per_unit).cast("int").alias("est_cost_cents"),
        as_of.alias("occurred_at"),
        "note",
    )


def spend_by_service(usage: DataFrame) -> DataFrame:
    return usage.groupBy("service").agg(F.coalesce(F.sum("est_cost_cents"), F.lit(0)).alias("cents"))


def spent(usage: DataFrame, service: str = "x_api") -> DataFrame:
    return usage.filter(F.col("service") == service).agg(F.coalesce(F.sum("est_cost_cents"), F.lit(0)).alias("cents"))


def recent_spend(usage: DataFrame, service: str, note: str | None = None, newest: int = 8) -> DataFrame:
    """Spend per time of booking, the newest ones first."""
    rows = usage.filter(F.col("service") == service)
    if note is not None:
        rows = rows.filter(F.col("note") == note)
    sums = rows.groupBy("occurred_at").agg(F.sum("units").alias("units"), F.sum("est_cost_cents").alias("cents"))
    return sums.orderBy(F.col("occurred_at").desc()).limit(newest)


def ensure_budget(usage: DataFrame, planned_cents: float, cap: int = policy.DEFAULT_CAP_CENTS, service: str = "x_api") -> None:
    """Refuse before any paid call when the plan would pass the cap."""
    used = spent(usage, service).first()["cents"]
    if used + planned_cents > cap:
        raise BudgetExceeded(f"spent {used}c and planned {planned_cents:.0f}c exceed the cap of {cap}c")


def within_budget(batches: DataFrame, order: list[Column], cost: Column, keys: list[str], cap: Column) -> DataFrame:
    """Batches whose running cost stays within the cap."""
    return running(batches, keys, order, {"running_cents": cost}).filter(F.col("running_cents") <= cap)


def cap_new(ranked: DataFrame, known: Column, order: list[Column], limit: int, keys: list[str] | None = None) -> DataFrame:
    """Known rows always pass; of the new ones the first ``limit`` in order."""
    flagged = ranked.withColumn("_new", (~known).cast("bigint"))
    counted = running(flagged, keys or [], order, {"new_so_far": F.col("_new")})
    return counted.filter((F.col("_new") == 0) | (F.col("new_so_far") <= limit)).drop("_new")
