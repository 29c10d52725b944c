"""The publish surface: one row per listed artist, plus its accounts in display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..schemas import State
from . import evidence as ev
from .spread import lookup, running

ACCOUNTS_PER_PART = 500


def visible_members(state: State) -> DataFrame:
    """Live members of listed artists whose account is visible, with their platform's rank.

    Account-scoped suppressions drop only the account, artist-scoped ones the whole artist.
    """
    listed = state.artists.filter("status = 'active' and merged_into is null").join(
        ev.suppressed_artists(state.suppressions), "artist_id", "left_anti"
    )
    shown = state.accounts.filter(F.col("status").isin(policy.VISIBLE_STATUSES)).join(
        ev.suppressed_accounts(state.suppressions), "account_id", "left_anti"
    )
    ranks = F.broadcast(policy.platforms(state.accounts.sparkSession).select("platform", "display_rank"))
    names = listed.select("artist_id", "public_slug", F.col("display_name").alias("stored_name"), "region", "language")
    members = ev.live(state.memberships).select("artist_id", "account_id", "confidence")
    owned = members.join(shown, "account_id").join(ranks, "platform")
    return lookup(owned, names, ["artist_id"])


def display_order(handle: bool = True) -> list[Column]:
    """Rank, then followers with unknown last, then platform, then handle."""
    keys = [F.col("display_rank"), F.coalesce(-F.col("followers_count"), F.lit(1)), F.col("platform")]
    return keys + ([F.lower("handle")] if handle else []) + [F.col("account_id")]


def first_shown(value: Column, handle: bool = True) -> Column:
    """Value of the first member in display order that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*display_order(handle))))


def source_label(via: Column) -> Column:
    return (
        F.when(via == "skeb_ranking", "skeb")
        .when(via.startswith("bsky_"), "bluesky")
        .when(via.isin("portfolioday", "portfolioday_mention", "twitter_list"), "twitter")
        .when(via.isin("pixiv_ranking", "pixiv_tag_search"), "pixiv")
        .when(via == "patreon_ranking", "patreon")
        .when(via == "artstation_ranking", "artstation")
        .when(via == "deviantart_popular", "deviantart")
        .when(via == "vgen_marketplace", "vgen")
        .when(via == "manual_tag", "tagged")
    )


def from_platform(slug: str) -> Column:
    return F.coalesce(F.col("commission_detail").startswith(f"{slug}:"), F.lit(False))


def platform_open(slug: str) -> Column:
    return (F.col("platform") == slug) & (F.col("commission_status") == "open") & from_platform(slug)


def directory(state: State, as_of: Column) -> DataFrame:
    """Scalar part of the directory, all in one grouped pass over the visible members."""
    signed = state.attestations.filter("active").select("account_id", F.lit(True).alias("_signed")).distinct()
    adult = state.flags.filter("active and flag = 'nsfw'").select("account_id", F.lit(True).alias("_adult")).distinct()
    seen = state.snapshots.groupBy("account_id").agg(F.max("captured_at").alias("_seen"))
    members = (
        visible_members(state)
        .join(signed, "account_id", "left")
        .join(adult, "account_id", "left")
        .join(seen, "account_id", "left")
    )
    known = F.col("commission_status") != "unknown"
    in_bio = known & ~from_platform("skeb") & ~from_platform("pixiv")
    # Newest reading, then the surest; a reading without a time or confidence loses.
    recency = F.struct(
        F.col("commission_checked_at").isNotNull(),
        F.col("commission_checked_at"),
        F.col("commission_confidence").isNotNull(),
        F.col("commission_confidence"),
        -F.col("account_id"),
    )
    grouped = members.groupBy("artist_id", "public_slug", "stored_name", "region", "language").agg(
        first_shown(F.coalesce(F.nullif("display_name", F.lit("")), "handle")).alias("_name"),
        F.max(F.coalesce("_signed", F.lit(False))).alias("no_ai_attested"),
        F.max(F.coalesce("_adult", F.lit(False))).alias("nsfw"),
        F.max("last_post_at").alias("last_active_at"),
        F.count_if(known).alias("_known"),
        F.max(F.when(known, platform_open("skeb"))).alias("skeb_open"),
        F.max(F.when(known, platform_open("pixiv"))).alias("pixiv_open"),
        F.max_by("commission_status", F.when(in_bio, recency)).alias("bio_status"),
        F.max(F.when(known, F.col("commission_checked_at"))).alias("checked_at"),
        first_shown(F.col("avatar_url"), handle=False).alias("avatar_url"),
        F.array_sort(F.collect_set(source_label(F.col("discovered_via")))).alias("sources"),
        F.coalesce(
            F.max(F.when(F.col("platform") == "twitter", F.col("_seen"))), F.max("_seen")
        ).alias("hydrated_at"),
        F.max("followers_count").alias("followers"),
        F.count("*").alias("account_count"),
    )
    old = F.col("last_active_at") < as_of - F.expr(f"interval {policy.DORMANT_AFTER_DAYS} days")
    commissions = F.when(
        F.col("_known") > 0, F.struct("skeb_open", "pixiv_open", "bio_status", "checked_at")
    )
    return grouped.select(
        "artist_id",
        "public_slug",
        F.coalesce("_name", "stored_name").alias("display_name"),
        "region",
        "no_ai_attested",
        "nsfw",
        "last_active_at",
        F.coalesce(old, F.lit(False)).alias("dormant"),
        commissions.alias("commissions"),
        "language",
        "avatar_url",
        "sources",
        "hydrated_at",
        "followers",
        "account_count",
    )


ACCOUNT_FIELDS = [
    "platform", "handle", "display_name", "url", "confidence", "last_post_at", "contact_email",
    "commission_status", "stats", "avatar_url",
]


def directory_accounts(state: State) -> DataFrame:
    """The accounts of each listed artist in display order, one row each with its position."""
    members = visible_members(state)
    placed = running(members, ["artist_id"], display_order(), {})
    return placed.select(
        "artist_id",
        "position",
        "platform",
        "handle",
        "display_name",
        F.col("profile_url").alias("url"),
        "confidence",
        "last_post_at",
        "contact_email",
        F.nullif("commission_status", F.lit("unknown")).alias("commission_status"),
        F.col("platform_stats").alias("stats"),
        "avatar_url",
    )


def nest_accounts(rows: DataFrame, per_part: int = ACCOUNTS_PER_PART) -> DataFrame:
    """Arrays of accounts, in parts of bounded length: one part for any ordinary artist."""
    part = F.floor((F.col("position") - 1) / per_part).cast("int").alias("part")
    listed = F.array_sort(F.collect_list(F.struct("position", *ACCOUNT_FIELDS[:8], "avatar_url", F.to_json("stats").alias("stats"))))
    return rows.groupBy("artist_id", part).agg(listed.alias("accounts"))


def publish(state: State, as_of: Column, root: str) -> None:
    """Static export: the directory and its account parts as JSON files."""
    directory(state, as_of).write.mode("errorifexists").json(f"{root}/directory")
    nest_accounts(directory_accounts(state)).write.mode("errorifexists").json(f"{root}/accounts")
