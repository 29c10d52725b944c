"""Small scalar functions shared by sources and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def slugify(handle: Column, platform: Column, account_id: Column) -> Column:
    base = F.when(platform == "bluesky", F.substring_index(handle, ".", 1)).otherwise(handle)
    slug = F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9-]+", "-"), "-+", "-")
    slug = F.trim(slug, F.lit("-"))
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("artist-"), account_id.cast("string")))


def category_slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def normal_name(name: Column) -> Column:
    """Lower-case letters and digits only, known host endings removed."""
    hosts = "|".join(s.replace(".", r"\.") for s in P.HOST_SUFFIXES)
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\.(?:{hosts})$", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def snowflake_time(post_id: Column) -> Column:
    """Time inside a post id; anything that is no number gives null."""
    ticks = F.shiftright(post_id.try_cast("bigint"), 22)
    return F.timestamp_millis(ticks + F.lit(P.TWEET_EPOCH_MS))


def grouped_int(text: Column) -> Column:
    """Number with thousands commas to integer."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("int")


def age_label(moment: Column, as_of: Column) -> Column:
    """Compact age: 45m, 6h, 3d, 5w."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(moment)

    def unit(size: int, letter: str) -> Column:
        return F.concat(F.greatest(F.lit(1), F.floor(seconds / size)).cast("string"), F.lit(letter))

    return (
        F.when(seconds < 60 * 60, unit(60, "m"))
        .when(seconds < 24 * 3600, unit(3600, "h"))
        .when(seconds < 7 * 86400, unit(86400, "d"))
        .otherwise(F.concat(F.floor(seconds / 604800).cast("string"), F.lit("w")))
    )


def account_label(platform: Column, handle: Column, name: Column) -> Column:
    """Opaque-id platforms show the name when there is one."""
    return F.when(platform.isin("pixiv", "youtube") & (F.coalesce(name, F.lit("")) != ""), name).otherwise(handle)


def account_url(platform: Column, handle: Column, url: Column) -> Column:
    circle = F.concat(F.lit("https://www.dlsite.com/maniax/circle/profile/=/maker_id/"), handle)
    fallback = F.when((platform == "dlsite") & F.upper(handle).startswith("RG"), circle)
    return F.coalesce(F.nullif(url, F.lit("")), fallback)


def percent_of_max(value: Column, top: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(100 * value / top).cast("int"))
