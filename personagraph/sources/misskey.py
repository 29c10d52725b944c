"""Fediverse profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match
from . import common as c

USER = (
    "struct<id:string,host:string,name:string,description:string,avatarUrl:string,followersCount:bigint,"
    "followingCount:bigint,fields:array<struct<name:string,value:string>>,roles:array<struct<name:string>>>"
)
REFERENCE = r"^https?://([^/]+)/@([A-Za-z0-9_]+)(?:@([A-Za-z0-9._-]+))?"


def parse_reference(url: Column) -> Column:
    """struct(instance, username, host) of a profile address; host names a remote home."""
    return F.when(
        url.rlike(REFERENCE),
        F.struct(
            F.lower(first_match(url, REFERENCE, 1)).alias("instance"),
            first_match(url, REFERENCE, 2).alias("username"),
            F.lower(first_match(url, REFERENCE, 3)).alias("host"),
        ),
    )


def field_lines(fields: Column) -> Column:
    """The profile table, one "name: value" line per filled field."""
    filled = F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    lines = F.transform(filled, lambda f: F.concat(F.coalesce(f["name"], F.lit("")), F.lit(": "), f["value"]))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def normalize(payloads: DataFrame, source: str = "misskey:user") -> tuple[DataFrame, DataFrame]:
    """Payload keys are profile addresses; the stable id is instance and user id together."""
    parsed = c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", USER).alias("u"))
    parsed = parsed.withColumn("ref", parse_reference(F.col("key"))).filter("u.id is not null and ref is not null")
    parsed = parsed.withColumn("field_text", field_lines(F.col("u.fields")))
    roles = F.filter("u.roles.name", lambda r: F.coalesce(r, F.lit("")) != "")
    bio = F.coalesce("u.description", F.lit(""))
    name = F.nullif("u.name", F.lit(""))
    rows = c.profiles(
        parsed,
        keep=["field_text"],
        platform=F.lit("misskey"),
        native_id=F.concat_ws(":", "ref.instance", "u.id"),
        handle=F.col("ref.username"),
        display_name=name,
        profile_url=F.col("key"),
        followers_count=F.col("u.followersCount"),
        following_count=F.col("u.followingCount"),
        bio_text=bio,
        avatar_url=F.col("u.avatarUrl"),
        raw=F.col("body"),
        fetch_source=F.lit("misskey:users/show"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(misskey_roles=F.nullif(F.array_join(roles, ", "), F.lit(""))),
        email_text=F.concat_ws("\n", bio, "field_text"),
        commission_text=F.concat_ws("\n", bio, name, "field_text"),
        flag_text=F.concat_ws("\n", bio, "field_text"),
    )
    links = c.text_links(rows, "field_text", "profile_field", 0).unionByName(c.text_links(rows, "bio_text", "bio_link", 1))
    return rows.drop("field_text"), c.emitted(links)
