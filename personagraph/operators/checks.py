"""Integrity checks: each returns the rows that break a rule, so empty means sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..schemas import State
from . import evidence as ev
from .spread import lookup


def suppressed_but_listed(directory: DataFrame, state: State) -> DataFrame:
    return directory.join(ev.suppressed_artists(state.suppressions), "artist_id", "left_semi")


def badge_missing(directory: DataFrame, state: State) -> DataFrame:
    """Listed artists with an active statement on a visible account but no badge, or adult and not marked."""
    from .directory import visible_members

    members = visible_members(state).select("artist_id", "account_id")
    signed = members.join(state.attestations.filter("active"), "account_id", "left_semi").select("artist_id").distinct()
    adult = state.flags.filter("active and flag = 'nsfw'")
    marked = members.join(adult, "account_id", "left_semi").select("artist_id").distinct()
    no_badge = directory.filter("not no_ai_attested").join(signed, "artist_id", "left_semi").select("artist_id")
    no_mark = directory.filter("not nsfw").join(marked, "artist_id", "left_semi").select("artist_id")
    return no_badge.withColumn("missing", F.lit("badge")).unionByName(no_mark.withColumn("missing", F.lit("nsfw")))


def suppressed_account_shown(directory_accounts: DataFrame, state: State) -> DataFrame:
    hidden = state.accounts.join(ev.suppressed_accounts(state.suppressions), "account_id", "left_semi")
    keys = hidden.select("platform", "handle").distinct()
    return directory_accounts.join(keys, ["platform", "handle"], "left_semi")


def lineage(df: DataFrame) -> list[str]:
    """Files a result is computed from; quarantined tables must not be among them."""
    return sorted(df.inputFiles())


def evidence_missing(edges: DataFrame, attestations: DataFrame, flags: DataFrame) -> DataFrame:
    parts = [
        f.filter("evidence_snapshot_id is null").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        for name, f in (("edges", edges), ("attestations", attestations), ("flags", flags))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge_chains(artists: DataFrame) -> DataFrame:
    """Artists whose keeper itself points on."""
    onward = artists.filter("merged_into is not null").select(
        F.col("artist_id").alias("merged_into"), F.col("merged_into").alias("onward")
    )
    pointing = artists.filter("merged_into is not null").select("artist_id", "merged_into")
    return lookup(pointing, onward, ["merged_into"])


def duplicates(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def double_members(memberships: DataFrame) -> DataFrame:
    return duplicates(ev.live(memberships), ["account_id"])


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return duplicates(edges, ["source_account_id", "target_account_id", "evidence_type"])


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("source_account_id = target_account_id")


def double_suppressions(suppressions: DataFrame) -> DataFrame:
    return duplicates(ev.in_force(suppressions), ["artist_id", "account_id", "reason"])


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    bad = df.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def unknown_states(state: State) -> DataFrame:
    tests = [
        (state.accounts, "status", policy.ACCOUNT_STATUSES),
        (state.edges, "evidence_type", policy.EVIDENCE_TYPES),
        (state.edges, "status", policy.EDGE_STATUSES),
        (state.edges, "claim", policy.CLAIMS),
        (state.memberships, "confidence", policy.CONFIDENCES),
    ]
    out = None
    for df, column, allowed in tests:
        part = unknown_values(df, column, allowed).withColumn("column", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_signals(signals: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(signals.withColumn("text", F.coalesce("matched_text", F.lit(""))), [*keys, "text"])


def state_violations(state: State) -> DataFrame:
    """Number of violations per structural rule."""
    rules = {
        "merge_chains": merge_chains(state.artists),
        "double_members": double_members(state.memberships),
        "duplicate_edges": duplicate_edges(state.edges),
        "self_loops": self_loops(state.edges),
        "double_suppressions": double_suppressions(state.suppressions),
        "duplicate_attestations": duplicate_signals(state.attestations, ["account_id", "signal"]),
        "duplicate_flags": duplicate_signals(state.flags, ["account_id", "flag", "signal"]),
        "unknown_values": unknown_states(state),
    }
    out = None
    for name, bad in rules.items():
        part = bad.agg(F.count("*").alias("violations")).withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("rule", "violations")
