"""VGen: category listings and artist pages, read from the page's embedded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match
from . import common as c
from .deviantart import same_platform_mentions

# Category roots that mark an illustrator.
ARTIST_ROOTS = [
    "character-illustrations", "chibi-illustrations", "creature-illustrations",
    "character-reference-sheets", "creature-reference-sheets", "other-reference-sheets",
    "custom-character-design", "custom-creature-design", "custom-outfit-design", "custom-backgrounds",
    "other-custom-illustrations", "illustrations", "custom-comics-creation", "custom-dakimakura",
    "custom-book-cover", "custom-drawings", "other-custom-original-design",
    "original-animatics-storyboards", "digital-illustration-advice",
    "vtuber-model-art", "chibi-vtuber-model-art", "creature-model-art", "other-2d-vtuber-model-art",
    "custom-pngtuber-giftuber-avatar", "custom-chibi-pngtuber-giftuber-avatar",
    "custom-creature-pngtuber-giftuber-avatar", "other-custom-reactive-avatars", "2d-avatars",
    "custom-emotes", "emotes-badges", "custom-chat-stickers", "custom-subscriber-badges",
    "custom-stickers", "custom-vtuber-stream-props", "custom-vtuber-throwables",
    "custom-vtuber-debut-graphics", "custom-vtuber-model-add-ons",
    "other-custom-2d-vtuber-model-add-ons", "custom-stream-avatar-sprites", "custom-acrylic-charms",
    "custom-posters-prints", "custom-patterns",
]
STATS = "struct<totalReviews:int,averageRating:double>"
LISTING = (
    "struct<props:struct<pageProps:struct<initialServices:struct<services:array<struct<userID:string,"
    f"containsMatureContent:boolean,artistReviewStats:{STATS},"
    "userModeration:struct<username:string,displayName:string,discoveryStatus:string>>>>>>>"
)
PROFILE = (
    "struct<props:struct<pageProps:struct<services:array<struct<tags:array<string>,containsMatureContent:boolean>>,"
    "user:struct<userID:string,username:string,displayName:string,bio:string,avatarURL:string,"
    f"servicesStatus:string,languages:array<string>,artistReviewStats:{STATS},socials:array<struct<link:string>>>>>>"
)


def embedded_state(body: Column) -> Column:
    """JSON text of the page's data script."""
    return first_match(body, r"(?s)__NEXT_DATA__[^>]*>(.*?)</script>", 1)


def category_path(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "/category/", -1), "/catalogue/", -1)


def listing_urls(payloads: DataFrame, source: str = "vgen:sitemap", all_categories: bool = False,
                 exclude: list[str] | None = None) -> DataFrame:
    """Category listings of sitemaps, kept when their root is an illustrator category."""
    found = c.bodies(payloads, source).select(F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("url"))
    found = found.filter(F.contains("url", F.lit("/category/")) | F.contains("url", F.lit("/catalogue/"))).distinct()
    rows = found.withColumn("root", F.substring_index(category_path(F.col("url")), "/", 1))
    if not all_categories:
        rows = rows.filter(F.col("root").isin(ARTIST_ROOTS))
    for prefix in exclude or []:
        rows = rows.filter(~F.substring_index("url", "/category/", -1).startswith(prefix))
    return rows


def listed_services(payloads: DataFrame, source: str = "vgen:listing") -> DataFrame:
    """(url, username, ...) of live services on listing pages; the payload key is the listing's address."""
    pages = c.bodies(payloads, source).select(
        F.col("key").alias("url"), F.from_json(embedded_state(F.col("body")), LISTING).alias("p")
    )
    found = pages.select("url", F.posexplode("p.props.pageProps.initialServices.services").alias("pos", "s"))
    rows = found.select(
        "url", "pos", "s.userID", "s.containsMatureContent", "s.artistReviewStats", "s.userModeration.*"
    )
    alive = F.col("discoveryStatus").isNull() | (F.col("discoveryStatus") == "LIVE")
    return rows.filter(F.col("username").isNotNull() & (F.col("username") != "") & alive)


def marketplace_artists(services: DataFrame) -> DataFrame:
    """One row per artist: most reviews, its rating (later listing on ties), any mature service, categories."""
    reviews = F.coalesce("artistReviewStats.totalReviews", F.lit(0))
    rating = F.round("artistReviewStats.averageRating", 2)
    order = F.struct(reviews.alias("r"), "url", "pos")
    first = F.struct("url", "pos")
    return services.groupBy("username").agg(
        F.min_by(F.coalesce("displayName", "username"), first).alias("display_name"),
        F.min_by("userID", F.when(F.col("userID").isNotNull(), first)).alias("user_id"),
        F.max(reviews).alias("reviews"),
        F.max_by(rating, F.when(F.coalesce(rating, F.lit(0.0)) != 0, order)).alias("rating"),
        F.max(F.coalesce("containsMatureContent", F.lit(False))).alias("mature"),
        F.count_distinct("url").alias("listings"),
    )


def marketplace_categories(services: DataFrame) -> DataFrame:
    """Distinct (username, category)."""
    return services.select("username", category_path(F.col("url")).alias("category")).distinct()


def profile_fields(payloads: DataFrame, source: str = "vgen:profile") -> DataFrame:
    pages = c.bodies(payloads, source).select(
        "key", "fetched_at", F.from_json(embedded_state(F.col("body")), PROFILE).alias("p")
    )
    pages = pages.select("key", "fetched_at", F.col("p.props.pageProps.user").alias("u"), F.col("p.props.pageProps.services").alias("services"))
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.flatten(F.transform("services", lambda s: F.coalesce(s["tags"], none))))
    return pages.filter("u is not null").select(
        "key",
        "fetched_at",
        F.col("u.userID").alias("user_id"),
        F.col("u.username").alias("username"),
        F.col("u.displayName").alias("display_name"),
        F.col("u.artistReviewStats.totalReviews").alias("reviews"),
        F.round("u.artistReviewStats.averageRating", 2).alias("rating"),
        F.trim(F.coalesce("u.bio", F.lit(""))).alias("bio"),
        F.col("u.avatarURL").alias("avatar"),
        F.array_compact(F.coalesce(F.col("u.socials.link"), none)).alias("socials"),
        F.col("u.servicesStatus").alias("services_status"),
        F.coalesce("u.languages", none).alias("languages"),
        F.coalesce(tags, none).alias("tags"),
        F.coalesce(F.exists("services", lambda s: F.coalesce(s["containsMatureContent"], F.lit(False))), F.lit(False)).alias("mature"),
    )


def normalize(payloads: DataFrame, source: str = "vgen:profile") -> tuple[DataFrame, DataFrame]:
    fields = profile_fields(payloads, source)
    status = F.col("services_status")
    shown = F.nullif(F.array_join("tags", ", "), F.lit(""))
    rows = c.profiles(
        fields.withColumn("social", F.array_join("socials", "\n")),
        keep=["social"],
        platform=F.lit("vgen"),
        native_id=F.col("user_id"),
        handle=F.coalesce("username", "key"),
        display_name=F.col("display_name"),
        profile_url=F.concat(F.lit("https://vgen.co/"), F.coalesce("username", "key")),
        bio_text=F.col("bio"),
        avatar_url=F.col("avatar"),
        raw=F.to_json(F.struct("user_id", "socials", "services_status", "languages", "tags")),
        fetch_source=F.lit("vgen:profile"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(
            vgen_tags=shown, vgen_reviews=F.when(F.col("reviews") > 0, F.col("reviews")),
            vgen_rating=F.when(F.col("rating") > 0, F.col("rating")),
        ),
        platform_commission=F.coalesce(
            c.reading(status == "OPEN", "open", 0.95, "vgen:services_status"),
            c.reading(status == "CLOSED", "closed", 0.95, "vgen:services_status"),
        ),
        commission_text=F.lit(None),
        extra_flags=c.flag(F.col("mature"), "platform_flag", "vgen:mature_service"),
    )
    text = same_platform_mentions(c.text_links(rows, "bio_text", "bio_link", 1), "vgen")
    links = c.text_links(rows, "social", "profile_field", 0).unionByName(text)
    return rows.drop("social"), c.emitted(links)
