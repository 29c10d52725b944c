"""Language and region per artist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import patterns as P
from ..schemas import State
from . import evidence as ev


def region_score(language: Column, east_platforms: Column, west_platforms: Column) -> Column:
    """struct(region, confidence) from a language and the numbers of eastern and western platforms."""
    cap = F.lit(3)
    east = F.when(language.isin("ja", "ko"), 2.0).when(language == "zh", 1.5).otherwise(0.0) + F.least(east_platforms, cap)
    west = F.when(language == "en", 1.0).otherwise(0.0) + F.least(west_platforms, cap)
    margin = F.abs(east - west)
    clear = margin >= 0.75
    return F.struct(
        F.when(~clear, "unknown").when(east > west, "eastern").otherwise("western").alias("region"),
        F.when(clear, F.round(F.least(margin / 4, F.lit(1.0)), 2)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def script_flags(text: Column) -> list[Column]:
    return [F.coalesce(text.rlike(p), F.lit(False)).alias(f"has_{code}") for code, p in P.LANGUAGE_SCRIPTS]


def language_of_flags() -> Column:
    found = F.lit("unknown")
    for code, _ in reversed(P.LANGUAGE_SCRIPTS):
        found = F.when(F.col(f"has_{code}"), code).otherwise(found)
    return found


def classify_artists(state: State) -> DataFrame:
    """(artist_id, language, region, confidence) of automatic, unmerged artists.

    Script runs never span two texts, so each member is tested alone and the flags are or-ed: the
    aggregation combines map-side and no artist's texts are ever gathered.
    """
    due = state.artists.filter("region_source = 'auto' and merged_into is null").select("artist_id")
    members = ev.live(state.memberships).select("artist_id", "account_id").join(due, "artist_id", "left_semi")
    texts = state.accounts.select("account_id", "platform", "display_name").join(
        ev.latest_bios(state.snapshots), "account_id", "left"
    )
    words = F.concat(F.coalesce("bio", F.lit("")), F.lit(" "), F.coalesce("display_name", F.lit("")))
    flagged = texts.select("account_id", "platform", *script_flags(words))
    joined = members.join(flagged, "account_id")

    def distinct_in(slugs: list[str]) -> Column:
        return F.size(F.collect_set(F.when(F.col("platform").isin(slugs), F.col("platform"))))

    per_artist = joined.groupBy("artist_id").agg(
        *[F.max(f"has_{code}").alias(f"has_{code}") for code, _ in P.LANGUAGE_SCRIPTS],
        distinct_in(policy.EAST_PLATFORMS).alias("east"),
        distinct_in(policy.WEST_PLATFORMS).alias("west"),
    )
    scored = per_artist.withColumn("language", language_of_flags())
    scored = scored.withColumn("s", region_score(F.col("language"), F.col("east"), F.col("west")))
    return scored.select("artist_id", "language", "s.region", "s.confidence")


def apply_classes(artists: DataFrame, classes: DataFrame, as_of: Column) -> DataFrame:
    """Write classes to automatic artists; manual regions are never touched."""
    new = classes.select("artist_id", F.struct("language", "region", "confidence").alias("_c"))
    joined = artists.join(new, "artist_id", "left")
    hit = F.col("_c").isNotNull() & (F.col("region_source") == "auto")
    return joined.withColumns(
        {
            "region": F.when(hit, F.col("_c.region")).otherwise(F.col("region")),
            "region_confidence": F.when(hit, F.col("_c.confidence")).otherwise(F.col("region_confidence")),
            "language": F.when(hit, F.col("_c.language")).otherwise(F.col("language")),
            "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*artists.columns)
