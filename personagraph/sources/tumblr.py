"""Tumblr blog information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import bio_from_html
from . import common as c

BLOG = (
    "struct<uuid:string,name:string,title:string,description:string,url:string,total_posts:bigint,"
    "is_nsfw:boolean,updated:bigint,avatar:array<struct<url:string,width:int>>>"
)


def best_avatar(avatars: Column) -> Column:
    """The widest picture, the first one on equal width."""
    placed = F.transform(
        avatars, lambda a, i: F.struct(F.coalesce(a["width"], F.lit(0)).alias("w"), (-i).alias("i"), a["url"].alias("url"))
    )
    return F.array_max(F.filter(placed, lambda a: F.coalesce(a["url"], F.lit("")) != ""))["url"]


def normalize(payloads: DataFrame, source: str = "tumblr:blog") -> tuple[DataFrame, DataFrame]:
    parsed = c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", BLOG).alias("b"))
    parsed = parsed.filter("b is not null")
    name = F.coalesce("b.name", "key")
    title = F.nullif(F.trim("b.title"), F.lit(""))
    bio = bio_from_html(F.col("b.description"))
    rows = c.profiles(
        parsed,
        platform=F.lit("tumblr"),
        native_id=F.col("b.uuid"),
        handle=name,
        display_name=title,
        profile_url=F.col("b.url"),
        last_post_at=F.timestamp_seconds("b.updated"),
        bio_text=bio,
        avatar_url=best_avatar(F.col("b.avatar")),
        raw=F.col("body"),
        fetch_source=F.lit("tumblr:blog/info"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(tumblr_posts=F.col("b.total_posts"), tumblr_is_nsfw=F.coalesce("b.is_nsfw", F.lit(False))),
        commission_text=F.concat_ws("\n", bio, title),
        extra_flags=c.flag(F.col("b.is_nsfw"), "platform_flag", "tumblr is_nsfw"),
    )
    return rows, c.emitted(c.text_links(rows, "bio_text", "bio_link", 0))
