"""Bluesky profiles, rosters and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import common as c

PROFILE = (
    "struct<did:string,handle:string,displayName:string,description:string,followersCount:bigint,"
    "followsCount:bigint,avatar:string,labels:array<struct<val:string,src:string>>>"
)


def normalize(payloads: DataFrame, via: str = "bsky_feed", source: str = "bsky:profile") -> tuple[DataFrame, DataFrame]:
    parsed = c.bodies(payloads, source).select("fetched_at", "body", F.from_json("body", PROFILE).alias("p"))
    parsed = parsed.filter("p.did is not null")
    handle = F.coalesce("p.handle", "p.did")
    own = F.filter(
        F.coalesce("p.labels", F.array().cast("array<struct<val:string,src:string>>")),
        lambda l: l["val"].isin(P.BLUESKY_ADULT_LABELS) & (l["src"] == F.col("p.did")),
    )
    labels = F.transform(own, lambda l: F.struct(F.lit("self_label").alias("signal"), l["val"].alias("matched_text")))
    rows = c.profiles(
        parsed,
        platform=F.lit("bluesky"),
        native_id=F.col("p.did"),
        handle=handle,
        display_name=F.col("p.displayName"),
        profile_url=F.concat(F.lit("https://bsky.app/profile/"), handle),
        followers_count=F.col("p.followersCount"),
        following_count=F.col("p.followsCount"),
        bio_text=F.col("p.description"),
        avatar_url=F.col("p.avatar"),
        raw=F.col("body"),
        fetch_source=F.lit("bsky:getProfiles"),
        discovered_via=F.lit(via),
        fetched_at=F.col("fetched_at"),
        commission_text=F.concat_ws("\n", "p.description", "p.displayName"),
        extra_flags=labels,
    )
    links = c.text_links(rows, "bio_text", "bio_link", 0).unionByName(c.mention_links(rows, 1))
    return rows, links


def roster(sightings: DataFrame) -> DataFrame:
    """Distinct actors over (did, via, uri, pos): feeds before starter packs before lists, then first seen."""
    rank = F.when(F.col("via") == "bsky_feed", 0).when(F.col("via") == "bsky_starter_pack", 1).otherwise(2)
    return c.first_per_key(sightings.withColumn("_r", rank), ["did"], [F.col("_r"), F.col("uri"), F.col("pos")]).drop("_r")


FEED = (
    "struct<feed:array<struct<post:struct<indexedAt:string,author:struct<did:string>>,"
    "reason:struct<indexedAt:string>>>>"
)


def feed_authors(payloads: DataFrame, source: str = "bsky:feed") -> DataFrame:
    """(did, via, uri, pos) of the authors of feed pages."""
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select(F.col("key").alias("uri"), F.from_json("body", FEED).alias("f")).select(
        "uri", F.posexplode("f.feed").alias("pos", "i")
    )
    return items.select(F.col("i.post.author.did").alias("did"), F.lit("bsky_feed").alias("via"), "uri", "pos")


def last_activity(payloads: DataFrame, source: str = "bsky:author_feed") -> DataFrame:
    """(did, last_post_at): a repost counts with the time it was made."""
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select(F.col("key").alias("did"), F.from_json("body", FEED).alias("f")).select(
        "did", F.explode("f.feed").alias("i")
    )
    moment = F.coalesce("i.reason.indexedAt", "i.post.indexedAt")
    return items.groupBy("did").agg(F.max(F.try_to_timestamp(moment)).alias("last_post_at"))
