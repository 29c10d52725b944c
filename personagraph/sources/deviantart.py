"""DeviantArt: popular feeds and about pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import unescape
from ..functions.jsontree import find_key, page_state
from ..functions.text import first_match, strip_space
from ..operators import upsert as up
from ..operators.spread import running
from . import common as c

# Feed markup.
ITEM = r"(?s)<item>(.*?)</item>"
CREDIT = r'<media:credit role="author"[^>]*>([^<]+)</media:credit>'
RATING = r"<media:rating>([^<]+)</media:rating>"


def feed_items(payloads: DataFrame, source: str = "deviantart:rss") -> DataFrame:
    """(feed_order, pos, username, avatar, adult) of feed items; pages are read in fetch order."""
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select(
        "fetched_at", "key", F.posexplode(F.regexp_extract_all("body", F.lit(ITEM), F.lit(1))).alias("pos", "item")
    )
    credits = F.regexp_extract_all("item", F.lit(CREDIT), F.lit(1))
    names = F.filter(credits, lambda x: ~x.startswith("http"))
    avatars = F.filter(credits, lambda x: x.startswith("http"))
    return items.select(
        "fetched_at",
        "key",
        "pos",
        strip_space(unescape(F.get(names, F.lit(0)))).alias("username"),
        F.get(avatars, F.lit(0)).alias("avatar"),
        F.coalesce(strip_space(first_match(F.col("item"), RATING, 1)) == "adult", F.lit(False)).alias("adult"),
    ).filter("username is not null")


def popular_authors(items: DataFrame) -> DataFrame:
    """One row per author: rank of first appearance, first avatar, items, adult if any item is."""
    at = F.struct("fetched_at", "key", "pos")
    authors = items.groupBy("username").agg(
        F.min(at).alias("first"), F.min_by("avatar", at).alias("avatar"), F.count("*").alias("items"),
        F.max("adult").alias("adult"),
    )
    return running(authors, [], [F.col("first"), F.col("username")], {}, position="rank").drop("first")


def popular_profiles(authors: DataFrame, top: int, fetched_at) -> DataFrame:
    rows = authors.filter(F.col("rank") <= top)
    return c.profiles(
        rows,
        platform=F.lit("deviantart"),
        handle=F.col("username"),
        display_name=F.col("username"),
        profile_url=F.concat(F.lit("https://www.deviantart.com/"), "username"),
        avatar_url=F.col("avatar"),
        raw=F.to_json(F.struct("rank", "items", "adult")),
        fetch_source=F.lit("deviantart:rss"),
        discovered_via=F.lit("deviantart_popular"),
        discovery_details=F.create_map(F.lit("rank"), F.col("rank").cast("string")),
        fetched_at=fetched_at,
        hydrated=F.lit(False),
        extra_flags=c.flag(F.col("adult"), "platform_flag", "deviantart:adult_item"),
    )


STATE = (
    "struct<profileOwner:struct<tagline:string,stats:struct<watchers:bigint>,"
    "user:struct<userId:string,id:string,usericon:string>>,"
    "`@@entities`:struct<user:map<string,struct<userId:string,username:string,usericon:string>>>>"
)
ABOUT = "struct<website:string,textContent:struct<excerpt:string,html:struct<markup:string>>>"


def about_fields(payloads: DataFrame, source: str = "deviantart:about") -> DataFrame:
    """(key, user_id, avatar, watchers, tagline, excerpt, markup, website, social) of about pages."""
    pages = c.bodies(payloads, source).withColumn("state", page_state(F.col("body"))).filter("state is not null")
    parsed = pages.select(
        "key",
        "fetched_at",
        F.from_json("state", STATE).alias("s"),
        F.from_json(find_key("about")(F.col("state")), ABOUT).alias("a"),
        F.from_json(find_key("socialLinks")(F.col("state")), "array<struct<value:string>>").alias("links"),
        F.get_json_object(F.concat(F.lit('{"v":'), find_key("gruserId")(F.col("state")), F.lit("}")), "$.v").alias("gruser"),
    )
    owner = F.col("s.profileOwner.user")
    uid = F.coalesce("s.profileOwner.user.userId", "s.profileOwner.user.id")
    stored = F.try_element_at(F.col("s")["@@entities"]["user"], uid)
    # The store entry belongs to this page only if its name agrees.
    own = F.when(
        owner["usericon"].isNull() & (F.lower(F.coalesce(stored["username"], "key")) == F.lower("key")), stored
    )
    return parsed.select(
        "key",
        "fetched_at",
        F.coalesce(owner["userId"], own["userId"], "gruser").alias("user_id"),
        F.coalesce(owner["usericon"], own["usericon"]).alias("avatar"),
        F.col("s.profileOwner.stats.watchers").alias("watchers"),
        F.trim(F.coalesce("s.profileOwner.tagline", F.lit(""))).alias("tagline"),
        F.trim(F.coalesce("a.textContent.excerpt", F.lit(""))).alias("excerpt"),
        F.coalesce("a.textContent.html.markup", F.lit("")).alias("markup"),
        F.trim(F.coalesce("a.website", F.lit(""))).alias("website"),
        F.array_compact(F.coalesce(F.col("links.value"), F.array().cast("array<string>"))).alias("social"),
    )


def normalize(payloads: DataFrame, source: str = "deviantart:about") -> tuple[DataFrame, DataFrame]:
    fields = about_fields(payloads, source)
    registered = F.array_join(F.concat("social", F.array(F.nullif("website", F.lit("")))), "\n")
    bio = F.concat_ws("\n", F.nullif("tagline", F.lit("")), F.nullif("excerpt", F.lit("")))
    rows = c.profiles(
        fields.withColumns({"registered": registered, "scan": F.concat_ws("\n", "tagline", "excerpt", "markup")}),
        keep=["registered", "scan"],
        platform=F.lit("deviantart"),
        native_id=F.col("user_id"),
        handle=F.col("key"),
        profile_url=F.concat(F.lit("https://www.deviantart.com/"), "key"),
        followers_count=F.col("watchers"),
        bio_text=bio,
        avatar_url=F.col("avatar"),
        raw=F.to_json(F.struct("user_id", "website", "social")),
        fetch_source=F.lit("deviantart:about"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        email_text=F.concat_ws("\n", "tagline", "excerpt", "markup"),
        commission_text=F.concat_ws("\n", "tagline", "excerpt", "markup"),
    )
    named = c.text_links(rows, "scan", "bio_link", 1)
    named = up.drop_mention_dumps(named, ["own_platform", "own_native_id", "own_handle"], "deviantart")
    links = c.text_links(rows, "registered", "profile_field", 0).unionByName(same_platform_mentions(named, "deviantart"))
    return rows.drop("registered", "scan"), c.emitted(links)


def same_platform_mentions(links: DataFrame, platform: str) -> DataFrame:
    """A text link to another account of the page's own platform is a mention, not an identity."""
    own = (F.col("platform") == platform) & (F.col("evidence_type") == "bio_link")
    return links.withColumns(
        {
            "claim": F.when(own, "related").otherwise(F.col("claim")),
            "relation_hint": F.when(own, "same_platform_mention").otherwise(F.col("relation_hint")),
        }
    )
