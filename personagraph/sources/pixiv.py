"""pixiv users, rankings and tag searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

USER = (
    "struct<userId:string,name:string,comment:string,webpage:string,imageBig:string,following:bigint,"
    "official:boolean,premium:boolean,region:struct<region:string>,commission:struct<acceptRequest:boolean>,"
    "social:struct<twitter:struct<url:string>,instagram:struct<url:string>>>"
)


def normalize(payloads: DataFrame, via: str = "pixiv_ranking", source: str = "pixiv:user",
              adult_sightings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profile and link rows; ``adult_sightings`` (key) came out of R-18 lists."""
    parsed = c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", USER).alias("u"))
    parsed = parsed.filter("u.userId is not null")
    if adult_sightings is not None:
        marks = adult_sightings.select("key", F.lit(True).alias("r18")).distinct()
        parsed = parsed.join(marks, "key", "left")
    else:
        parsed = parsed.withColumn("r18", F.lit(None).cast("boolean"))
    evidence = "pixiv:r18_tag_search" if via == "pixiv_tag_search" else "pixiv:r18_ranking"
    social = F.concat_ws("\n", "u.social.twitter.url", "u.social.instagram.url")
    rows = c.profiles(
        parsed.withColumns({"social_text": social, "webpage": F.col("u.webpage")}),
        keep=["social_text", "webpage"],
        platform=F.lit("pixiv"),
        native_id=F.col("u.userId"),
        handle=F.col("u.userId"),
        display_name=F.col("u.name"),
        profile_url=F.concat(F.lit("https://www.pixiv.net/users/"), "u.userId"),
        following_count=F.col("u.following"),
        bio_text=F.coalesce("u.comment", F.lit("")),
        avatar_url=F.col("u.imageBig"),
        raw=F.col("body"),
        fetch_source=F.lit("pixiv:ajax/user"),
        discovered_via=F.lit(via),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(region=F.col("u.region.region"), official=F.col("u.official"), premium=F.col("u.premium")),
        platform_commission=c.reading(F.col("u.commission.acceptRequest"), "open", 0.9, "pixiv:accept_request"),
        extra_flags=c.flag(F.col("r18"), "platform_flag", evidence),
    )
    links = (
        c.text_links(rows, "social_text", "profile_field", 0, websites=False)
        .unionByName(c.text_links(rows, "webpage", "profile_field", 1))
        .unionByName(c.text_links(rows, "bio_text", "bio_link", 2))
    )
    return rows.drop("social_text", "webpage"), c.emitted(links)


def best_ranks(payloads: DataFrame, source: str = "pixiv:ranking") -> DataFrame:
    """(mode, user_id, rank): the best rank of a user per ranking mode; an unranked entry counts as 999."""
    schema = "struct<mode:string,contents:array<struct<user_id:string,rank:int>>>"
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select(F.from_json("body", schema).alias("p")).select(
        F.col("p.mode").alias("mode"), F.explode("p.contents").alias("i")
    )
    return items.groupBy("mode", F.col("i.user_id").alias("user_id")).agg(
        F.min(F.coalesce("i.rank", F.lit(999))).alias("rank")
    )


def tag_sightings(payloads: DataFrame, source: str = "pixiv:search") -> DataFrame:
    """(user_id, tag, page, r18) of tag searches, first sighting wins."""
    schema = (
        "struct<tag:string,page:int,body:struct<illustManga:struct<data:array<struct<userId:string,xRestrict:int>>>>>"
    )
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select("fetched_at", F.from_json("body", schema).alias("p")).select(
        "fetched_at", F.col("p.tag").alias("tag"), F.col("p.page").alias("page"),
        F.posexplode("p.body.illustManga.data").alias("pos", "i"),
    )
    seen = items.select(
        F.col("i.userId").alias("user_id"), "tag", "page", "pos", "fetched_at",
        (F.coalesce("i.xRestrict", F.lit(0)) >= 1).alias("r18"),
    ).filter(F.coalesce("user_id", F.lit("0")) != "0")
    firsts = c.first_per_key(seen, ["user_id"], [F.col("fetched_at"), F.col("tag"), F.col("page"), F.col("pos")])
    return firsts.select("user_id", "tag", "page", "r18")
