"""X user payloads, search pages and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import snowflake_time
from . import common as c

URLS = "struct<urls:array<struct<expanded_url:string>>>"
USER = (
    "struct<id:string,username:string,name:string,description:string,location:string,protected:boolean,"
    "profile_image_url:string,most_recent_tweet_id:string,"
    "public_metrics:struct<followers_count:bigint,following_count:bigint>,"
    f"entities:struct<url:{URLS},description:{URLS}>>"
)


def users(payloads: DataFrame, source: str = "x:user") -> DataFrame:
    return c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", USER).alias("u"))


def expanded_urls():
    """Expanded addresses of the profile link and the description, in that order."""
    parts = [F.col(f"u.entities.{p}.urls.expanded_url") for p in ("url", "description")]
    lists = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
    return F.filter(F.concat(*lists), lambda u: u.isNotNull() & (u != ""))


def normalize(payloads: DataFrame, via: str = "hydration", source: str = "x:user") -> tuple[DataFrame, DataFrame]:
    """Profile rows and link rows of X users."""
    parsed = users(payloads, source).filter("u.username is not null")
    bio = F.coalesce("u.description", F.lit(""))
    rows = c.profiles(
        parsed.withColumn("link_text", F.concat_ws("\n", bio, F.coalesce("u.location", F.lit("")), F.array_join(expanded_urls(), "\n"))),
        keep=["link_text"],
        platform=F.lit("twitter"),
        native_id=F.col("u.id"),
        handle=F.col("u.username"),
        display_name=F.col("u.name"),
        profile_url=F.concat(F.lit("https://x.com/"), "u.username"),
        followers_count=F.col("u.public_metrics.followers_count"),
        following_count=F.col("u.public_metrics.following_count"),
        last_post_at=snowflake_time(F.col("u.most_recent_tweet_id")),
        bio_text=bio,
        avatar_url=F.col("u.profile_image_url"),
        raw=F.col("body"),
        fetch_source=F.lit(f"x:{via}"),
        discovered_via=F.lit(via),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(protected=F.coalesce("u.protected", F.lit(False))),
        email_text=F.concat_ws("\n", bio, "u.location"),
        commission_text=F.concat_ws("\n", bio, "u.name", "u.location"),
    )
    links = c.text_links(rows, "link_text", "bio_link", 0).unionByName(c.mention_links(rows, 1))
    return rows.drop("link_text"), drop_self(links)


def drop_self(links: DataFrame) -> DataFrame:
    own = (F.col("platform") == F.col("own_platform")) & (F.lower("handle") == F.lower("own_handle"))
    return links.filter(~F.coalesce(own, F.lit(False)))


def search_authors(payloads: DataFrame, source: str = "x:search") -> DataFrame:
    """Distinct authors over search pages in page order, first sighting wins; body is the author's JSON."""
    schema = f"struct<includes:struct<users:array<{USER}>>>"
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    listed = pages.select("key", "fetched_at", F.from_json("body", schema).alias("p")).select(
        "key", "fetched_at", F.posexplode("p.includes.users").alias("pos", "user")
    )
    first = c.first_per_key(
        listed.withColumn("id", F.col("user.id")), ["id"], [F.col("fetched_at"), F.col("key"), F.col("pos")]
    )
    return first.select(
        F.lit("x:user").alias("source"), F.col("id").alias("key"), "fetched_at", F.lit(200).alias("status_code"),
        F.to_json("user").alias("body"),
    )


def top_authors(authors: DataFrame, limit: int) -> DataFrame:
    """The harvested authors with most followers."""
    followers = F.get_json_object("body", "$.public_metrics.followers_count").cast("bigint")
    return authors.orderBy(followers.desc_nulls_last(), "key").limit(limit)


def lookup_results(payloads: DataFrame, parameter: str, source: str = "x:lookup") -> tuple[DataFrame, DataFrame]:
    """Found users (as user payloads) and missing keys of batch lookups by ``usernames`` or ``ids``."""
    schema = f"struct<data:array<{USER}>,errors:array<struct<parameter:string,value:string>>>"
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    parsed = pages.select("fetched_at", F.from_json("body", schema).alias("p"))
    found = parsed.select("fetched_at", F.explode("p.data").alias("user")).select(
        F.lit("x:user").alias("source"), F.col("user.id").alias("key"), "fetched_at",
        F.lit(200).alias("status_code"), F.to_json("user").alias("body"),
    )
    missing = parsed.select(F.explode("p.errors").alias("e")).filter(F.col("e.parameter") == parameter)
    return found, missing.select(F.col("e.value").alias("key")).distinct()
