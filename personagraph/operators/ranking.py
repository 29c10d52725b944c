"""Recorded cuts, hint verification, corrections and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import running
from .upsert import append


def stratified_rank(rows: DataFrame, strata: list[str], score: str, key: str, cut: int, border: int) -> DataFrame:
    """Rank by score in each stratum, mark who is in and who is near the line."""
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    ranked = running(rows.select(*strata, key, score), strata, order, {}, position="rank")
    return ranked.withColumns(
        {"included": F.col("rank") <= cut, "border": F.abs(F.col("rank") - cut) <= border}
    )


def verify_hints(hints: DataFrame, published: DataFrame, as_of: Column, window_days: int) -> DataFrame:
    """A pending hint is verified by a link the artist published, and expires after a while."""
    links = published.select("platform", F.lower("handle").alias("_h")).distinct().withColumn("_seen", F.lit(True))
    joined = hints.join(
        links, (hints["platform"] == links["platform"]) & (F.lower("hinted_handle") == F.col("_h")), "left"
    ).drop(links["platform"])
    old = F.col("created_at") < as_of - F.expr(f"interval {window_days} days")
    status = (
        F.when(F.col("status") != "pending", F.col("status"))
        .when(F.col("_seen"), F.lit("verified"))
        .when(old, F.lit("expired"))
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).select(*hints.columns)


def resolve_corrections(corrections: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Close open community reports (correction_id, status, resolved_at) with their recorded outcome."""
    outcome = decisions.select("correction_id", F.col("outcome").alias("_outcome"))
    joined = corrections.join(outcome, "correction_id", "left")
    hit = F.col("_outcome").isNotNull() & (F.col("status") == "open")
    return joined.withColumns(
        {
            "status": F.when(hit, F.col("_outcome")).otherwise(F.col("status")),
            "resolved_at": F.when(hit, as_of).otherwise(F.col("resolved_at")),
        }
    ).select(*corrections.columns)


def compare_runs(before: DataFrame, after: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: rows of the last run, rows gone in this one, and their share."""
    old = before.select(key, group)
    new = after.select(key, F.lit(True).alias("_still")).distinct()
    joined = old.join(new, key, "left")
    gone = F.count_if(F.col("_still").isNull())
    return joined.groupBy(group).agg(
        F.count("*").alias("before"), gone.alias("dropped"), F.round(gone / F.count("*"), 4).alias("dropped_share")
    )


def record_cut(entries: DataFrame, ranked: DataFrame, as_of: Column) -> DataFrame:
    """Append a run's ranking to the recorded entries."""
    return append(entries, ranked.withColumn("created_at", as_of))
