"""Which unhydrated handles are worth a paid read: someone who reads like an artist points at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.text import looks_like_artist, looks_like_project
from ..schemas import State
from . import evidence as ev
from .anomalies import listed, present
from .spread import lookup


def vouchers(state: State) -> DataFrame:
    """(account_id, vouches): what an account's links say about their targets."""
    member = ev.live(state.memberships).join(listed(state.artists).select("artist_id"), "artist_id", "left_semi")
    member = member.select("account_id", F.lit(True).alias("_member")).distinct()
    rows = state.accounts.join(ev.latest_bios(state.snapshots), "account_id", "left").join(member, "account_id", "left")
    words = F.concat_ws(" ", "handle", "display_name", "bio")
    good = F.col("_member") | F.col("discovered_via").isin(policy.ROSTER_SOURCES) | looks_like_artist(words)
    clean = ~F.coalesce("project", F.lit(False)) & ~looks_like_project(words)
    return rows.select("account_id", (clean & F.coalesce(good, F.lit(False))).alias("vouches"))


def gated_backlog(state: State) -> DataFrame:
    """Handle-only X accounts awaiting hydration with ``vouched``.

    A hub says nothing about itself, so whoever links to the hub vouches through it. "Some referrer
    vouches" folds per hub first, so a crowded hub costs its edges, never referrers times targets.
    """
    waiting = state.accounts.filter(
        "platform = 'twitter' and native_id is null and last_hydrated is null and status = 'unknown' "
        "and discovered_via <> 'bio_mention' and not coalesce(project, false)"
    ).select("account_id", "handle", "discovered_via")
    links = present(state.edges).select("source_account_id", "target_account_id").distinct()
    says = vouchers(state).filter("vouches").select(F.col("account_id").alias("source_account_id"))
    backed = links.join(says, "source_account_id", "left_semi")
    hubs = policy.platforms(links.sparkSession).filter("kind = 'link_hub'").select("platform")
    pages = state.accounts.join(F.broadcast(hubs), "platform", "left_semi").select("account_id")
    backed_hubs = (
        backed.select(F.col("target_account_id").alias("account_id"))
        .distinct()
        .join(pages, "account_id", "left_semi")
        .withColumnRenamed("account_id", "source_account_id")
    )
    direct = backed.select(F.col("target_account_id").alias("account_id"))
    through = lookup(links, backed_hubs, ["source_account_id"]).select(F.col("target_account_id").alias("account_id"))
    passed = direct.unionByName(through).distinct().withColumn("_passed", F.lit(True))
    self_vouched = F.col("discovered_via").isin(policy.ROSTER_SOURCES) | looks_like_artist(F.col("handle"))
    return waiting.join(passed, "account_id", "left").select(
        "account_id", "handle", (self_vouched | F.col("_passed").isNotNull()).alias("vouched")
    )


def backlog_report(state: State) -> DataFrame:
    """One row: vouched and skipped handles and the planned cost in cents."""
    return gated_backlog(state).agg(
        F.coalesce(F.sum(F.col("vouched").cast("bigint")), F.lit(0)).alias("vouched"),
        F.coalesce(F.sum((~F.col("vouched")).cast("bigint")), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.col("vouched").cast("double")) * policy.USER_READ_CENTS, F.lit(0.0)).alias("planned_cents"),
    )
