"""Shared inputs of clustering: newest texts, usable edges, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.text import looks_like_artist, looks_like_project
from .spread import dealt, first_per_key


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per account; the id breaks ties."""
    return first_per_key(snapshots, ["account_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()])


def latest_bios(snapshots: DataFrame) -> DataFrame:
    newest = F.struct("captured_at", "snapshot_id")
    return snapshots.groupBy("account_id").agg(F.max_by("bio_text", newest).alias("bio"))


def latest_adds(events: DataFrame) -> DataFrame:
    """Newest account_added event per (artist, account)."""
    adds = events.filter("event = 'account_added'")
    order = [F.col("created_at").desc(), F.col("edge_id").desc_nulls_last()]
    return first_per_key(adds, ["artist_id", "account_id"], order)


def live(memberships: DataFrame) -> DataFrame:
    return memberships.filter("removed_at is null")


def in_force(suppressions: DataFrame) -> DataFrame:
    return suppressions.filter("lifted_at is null")


def suppressed_artists(suppressions: DataFrame) -> DataFrame:
    return in_force(suppressions).filter("artist_id is not null").select("artist_id").distinct()


def suppressed_accounts(suppressions: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """Accounts suppressed themselves or, with memberships given, through their live artist."""
    own = in_force(suppressions).filter("account_id is not null").select("account_id")
    if memberships is not None:
        via = live(memberships).join(suppressed_artists(suppressions), "artist_id", "left_semi")
        own = own.unionByName(via.select("account_id"))
    return own.distinct()


def human_closed(events: DataFrame) -> DataFrame:
    """(artist, account) pairs a person closed; automation never reopens them."""
    removed = events.filter("event = 'account_removed'").filter(F.col("actor").startswith("admin"))
    return removed.select("artist_id", "account_id").distinct()


def rejected_pairs(reviews: DataFrame) -> DataFrame:
    rejected = reviews.filter("kind = 'cluster_merge' and status = 'rejected'")
    return rejected.select(F.col("review_key").alias("pair_key")).distinct()


def pair_key(a, b):
    """Name of an unordered artist pair in review items."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return F.concat_ws(",", low.cast("string"), high.cast("string"))


def usable(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges that touch no project account."""
    projects = accounts.filter("project").select("account_id")
    no_source = edges.join(projects.withColumnRenamed("account_id", "source_account_id"), "source_account_id", "left_anti")
    return no_source.join(
        projects.withColumnRenamed("account_id", "target_account_id"), "target_account_id", "left_anti"
    )


def strong_edges(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Present same-person edges of strong evidence, projects left out."""
    strong = edges.filter(
        (F.col("status") == "present")
        & (F.col("claim") == "same_person")
        & F.col("evidence_type").isin(policy.STRONG_EVIDENCE)
    )
    return usable(strong, accounts)


def flipped_edges(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges the guards turned into connections; each may be restored later."""
    flipped = edges.filter(
        (F.col("status") == "present")
        & (F.col("claim") == "related")
        & F.col("relation_hint").isin(policy.FLIP_HINTS)
    )
    return usable(flipped, accounts)


def account_facts(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per account: what the clustering rules ask about it."""
    kinds = F.broadcast(policy.platforms(accounts.sparkSession).select("platform", "kind"))
    texts = dealt(accounts.join(latest_bios(snapshots), "account_id", "left"), "account_id").join(kinds, "platform", "left")
    words = F.concat_ws("\n", "bio", "display_name", "handle")
    # No hint of an artist holds white space, so a text has one if a line of it has; the long lines are searched once.
    texts = texts.withColumn("artist_text", looks_like_artist(F.concat_ws("\n", "bio", "display_name")))
    return texts.select(
        "account_id", "platform", "handle", "display_name", "status", "discovered_via", "project", "last_hydrated",
        "kind",
        F.coalesce("followers_count", F.lit(0)).alias("followers"),
        (F.col("artist_text") | looks_like_artist(F.col("handle"))).alias("artist_like"),
        "artist_text",
        looks_like_project(words).alias("project_like"),
        (F.col("discovered_via").isin(policy.ROSTER_SOURCES) | (F.col("discovered_via") == "manual")).alias("vouched"),
    )


def platform_counts(memberships: DataFrame, facts: DataFrame) -> DataFrame:
    """(artist, platform) tallies of live members."""
    members = live(memberships).select("artist_id", "account_id")
    return members.join(facts.select("account_id", "platform"), "account_id").groupBy("artist_id", "platform").agg(
        F.count("*").alias("members")
    )


def endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """Two rows per edge, (account, other): the equi-join form of "account is either end"."""
    ends = F.array(
        F.struct(
            F.col("source_account_id").alias("account_id"),
            F.col("target_account_id").alias("other_id"),
            F.lit("outgoing").alias("direction"),
        ),
        F.struct(
            F.col("target_account_id").alias("account_id"),
            F.col("source_account_id").alias("other_id"),
            F.lit("incoming").alias("direction"),
        ),
    )
    return edges.select(*extra, F.explode(ends).alias("_e")).select(*extra, "_e.*")
