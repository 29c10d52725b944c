"""Shapes that deserve a human look: credits pages, crowded hubs, accounts many artists touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..schemas import State
from . import evidence as ev
from .clustering import add_reviews
from .spread import lookup
from .upsert import resolve_reviews


def present(edges: DataFrame) -> DataFrame:
    return edges.filter("status = 'present'")


def listed(artists: DataFrame) -> DataFrame:
    return artists.filter("status = 'active' and merged_into is null")


def hub_fanout(edges: DataFrame, accounts: DataFrame, memberships: DataFrame) -> DataFrame:
    """(artist_id, hub_fanout): present edges of the artist's busiest hub account."""
    hubs = policy.platforms(edges.sparkSession).filter("kind = 'link_hub'").select("platform")
    pages = accounts.join(F.broadcast(hubs), "platform", "left_semi").select("account_id")
    per_hub = present(edges).groupBy(F.col("source_account_id").alias("account_id")).agg(F.count("*").alias("_n"))
    owned = per_hub.join(pages, "account_id", "left_semi").join(ev.live(memberships), "account_id")
    return owned.groupBy("artist_id").agg(F.max("_n").alias("hub_fanout"))


def hub_attached(accounts: DataFrame, memberships: DataFrame) -> DataFrame:
    """(artist_id, hub_attached): members known only because a hub listed them."""
    via = accounts.filter("discovered_via = 'link_hub'").select("account_id")
    found = ev.live(memberships).join(via, "account_id", "left_semi")
    return found.groupBy("artist_id").agg(F.count("*").alias("hub_attached"))


def related_connections(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """(artist_id, related_connections): related edges with a member at either end, each counted once."""
    ends = ev.endpoints(present(edges).filter("claim = 'related'"), "edge_id")
    homes = ev.live(memberships).select("account_id", "artist_id")
    touched = lookup(ends, homes, ["account_id"]).select("artist_id", "edge_id").distinct()
    return touched.groupBy("artist_id").agg(F.count("*").alias("related_connections"))


def artist_anomalies(state: State) -> DataFrame:
    """Listed artists past a threshold, with the measures that tripped."""
    base = listed(state.artists).select("artist_id", "public_slug")
    measures = (
        base.join(hub_fanout(state.edges, state.accounts, state.memberships), "artist_id", "left")
        .join(hub_attached(state.accounts, state.memberships), "artist_id", "left")
        .join(related_connections(state.edges, state.memberships), "artist_id", "left")
    )
    limits = {
        "hub_fanout": policy.ANOMALY_HUB_FANOUT,
        "hub_attached": policy.ANOMALY_HUB_ATTACHED,
        "related_connections": policy.ANOMALY_RELATED_CONNECTIONS,
    }
    tripped = {n: F.when(F.col(n) >= limit, F.col(n)) for n, limit in limits.items()}
    return measures.withColumns(tripped).filter(F.coalesce(*limits).isNotNull())


def cross_links(edges: DataFrame, memberships: DataFrame, artists: DataFrame) -> DataFrame:
    """Distinct (artist_id, account_id, other_artist) where a member's present edge reaches another artist."""
    homes = ev.live(memberships).select("account_id", "artist_id")
    mine = homes.join(listed(artists).select("artist_id"), "artist_id", "left_semi")
    theirs = homes.select(F.col("account_id").alias("other_id"), F.col("artist_id").alias("other_artist"))
    ends = ev.endpoints(present(edges)).select("account_id", "other_id").distinct()
    met = lookup(lookup(ends, mine, ["account_id"]), theirs, ["other_id"])
    return met.filter("artist_id <> other_artist").select("artist_id", "account_id", "other_artist").distinct()


def cross_references(edges: DataFrame, memberships: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, account_id, other_artists) of members that touch three or more other artists."""
    counted = cross_links(edges, memberships, artists).groupBy("artist_id", "account_id").agg(
        F.count("*").alias("other_artists")
    )
    return counted.filter(F.col("other_artists") >= policy.ANOMALY_CROSS_ARTIST_REFS)


def referencing_slugs(edges: DataFrame, memberships: DataFrame, artists: DataFrame) -> DataFrame:
    """One row per flagged account and artist that touches it; long form, so no list can grow without bound."""
    links = cross_links(edges, memberships, artists)
    flagged = cross_references(edges, memberships, artists).select("artist_id", "account_id")
    names = artists.select(F.col("artist_id").alias("other_artist"), F.col("public_slug").alias("other_slug"))
    return links.join(flagged, ["artist_id", "account_id"], "left_semi").join(names, "other_artist")


def flag_anomalies(state: State, as_of: Column) -> State:
    """Ask about new anomalies and withdraw open questions whose shape is gone."""
    crowded = artist_anomalies(state)
    crossed = cross_references(state.edges, state.memberships, state.artists)
    kind, reason = F.lit("other").alias("kind"), F.lit("anomaly").alias("reason")
    asked_artists = state.reviews.filter("kind = 'other'").select("artist_id").distinct()
    about_artists = crowded.join(asked_artists, "artist_id", "left_anti").select(
        kind, reason, F.concat(F.lit("artist:"), F.col("artist_id").cast("string")).alias("review_key"), "artist_id"
    )
    about_accounts = crossed.select(
        kind, reason, F.concat(F.lit("account:"), F.col("account_id").cast("string")).alias("review_key"),
        "artist_id", "account_id",
    )
    reviews = add_reviews(state.reviews, about_artists, as_of)
    reviews = add_reviews(reviews, about_accounts, as_of)

    still_artist = crowded.select("artist_id", F.lit(True).alias("_crowded")).distinct()
    still_account = crossed.select("account_id", F.lit(True).alias("_crossed")).distinct()
    marked = reviews.join(still_artist, "artist_id", "left").join(still_account, "account_id", "left")
    stale = F.when(F.col("account_id").isNotNull(), F.col("_crossed").isNull()).otherwise(F.col("_crowded").isNull())
    hit = (F.col("kind") == "other") & (F.col("reason") == "anomaly") & stale
    healed = resolve_reviews(marked, hit, "rejected", "pipeline:anomaly_cleared", as_of)
    return state.with_(reviews=healed.select(*reviews.columns))
