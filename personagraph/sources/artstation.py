"""ArtStation: the trending feed and archived profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import upsert as up
from ..operators.ledger import cap_new
from ..operators.spread import running
from ..schemas import State
from ..session import cut_lineage
from . import common as c

# Address fields of a profile, and the feed dimensions in order of priority.
URL_FIELDS = [
    "twitter_url", "instagram_url", "tumblr_url", "twitch_url", "youtube_url", "deviantart_url",
    "behance_url", "website_url", "pinterest_url", "sketchfab_url", "vimeo_url",
]
DIMENSIONS = ["2d", "3d", "all"]
FEED = (
    "struct<dimension:string,page:int,data:array<struct<title:string,url:string,"
    "user:struct<id:string,username:string,full_name:string,medium_avatar_url:string,pro_member:boolean>>>>"
)
PROFILE = (
    "struct<id:string,username:string,full_name:string,headline:string,followers_count:bigint,"
    "medium_avatar_url:string,timestamp:string,social_profiles:array<struct<social_network:string,url:string>>,"
    + ",".join(f"{f}:string" for f in URL_FIELDS)
    + ">"
)


def trending(payloads: DataFrame, source: str = "artstation:trending") -> DataFrame:
    """All feed entries with their place: (dimension priority, page, pos)."""
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    items = pages.select(F.from_json("body", FEED).alias("p")).select(
        F.col("p.dimension").alias("dimension"), F.col("p.page").alias("page"), F.posexplode("p.data").alias("pos", "i")
    )
    rank = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension"))
    return items.select(rank.alias("priority"), "dimension", "page", "pos", "i.title", F.col("i.url").alias("work_url"), "i.user.*").filter(
        "coalesce(id, '') <> '' and coalesce(username, '') <> ''"
    )


PLACE = ["priority", "page", "pos"]
#: Entries of a full page of the feed.
PAGE_ENTRIES = 100


def trending_creators(entries: DataFrame) -> DataFrame:
    """Distinct creators, each at its first place, with a running position."""
    firsts = c.first_per_key(entries, ["id"], [F.col(p) for p in PLACE])
    return running(firsts, [], [*[F.col(p) for p in PLACE], F.col("id")], {})


def new_creators(creators: DataFrame, accounts: DataFrame, limit: int) -> DataFrame:
    """Known creators always pass; of the others the first ``limit`` by position."""
    mine = accounts.filter("platform = 'artstation'")
    ids = mine.filter("native_id is not null").select(F.col("native_id").alias("id"), F.lit(True).alias("_id")).distinct()
    names = mine.select(F.lower("handle").alias("_low"), F.lit(True).alias("_name")).distinct()
    marked = creators.join(ids, "id", "left").join(names, F.lower("username") == F.col("_low"), "left")
    known = F.col("_id").isNotNull() | F.col("_name").isNotNull()
    return cap_new(marked, known, [F.col("position")], limit).drop("_id", "_low", "_name")


def refresh_known(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """First feed place of accounts that exist already; creates nothing."""
    mine = accounts.filter("platform = 'artstation'").select(F.lower("handle").alias("_low")).distinct()
    known = entries.join(mine, F.lower("username") == F.col("_low"), "left_semi")
    return c.first_per_key(known.withColumn("_low", F.lower("username")), ["_low"], [F.col(p) for p in PLACE]).drop("_low")


def enrich_known(state: State, entries: DataFrame, as_of: Column) -> State:
    """Refresh accounts that chart with the id, names, picture and place of their first entry; creates nothing."""
    known = cut_lineage(refresh_known(entries, state.accounts))
    none = F.lit(None)
    refs = known.select(
        F.col("id").alias("seq"), F.lit("artstation").alias("platform"), F.col("id").alias("native_id"), F.col("username").alias("handle"),
        F.col("full_name").alias("display_name"), F.concat(F.lit("https://www.artstation.com/"), "username").alias("profile_url"),
        F.lit("active").alias("status"), none.cast("bigint").alias("followers_count"), none.cast("timestamp").alias("last_post_at"),
        F.lit("bio_link").alias("discovered_via"), none.cast("map<string,string>").alias("discovery_details"), F.lit(True).alias("hydrated"),
    )
    accounts, resolved = up.upsert_accounts(state.accounts, refs, as_of)
    stats = c.stats_map(
        artstation_dimension=F.col("dimension"), artstation_position=(F.col("page") - 1) * PAGE_ENTRIES + F.col("pos") + 1,
        pro_member=F.coalesce("pro_member", F.lit(False)),
    )
    said = known.select(F.col("id").alias("native_id"), F.col("medium_avatar_url").alias("_avatar"), stats.alias("_stats"))
    said = resolved.select("account_id", "native_id").join(said, "native_id").drop("native_id")
    joined = accounts.join(said, "account_id", "left").withColumns(
        {
            "avatar_url": F.coalesce("_avatar", "avatar_url"),
            "platform_stats": F.when(F.col("_stats").isNotNull(), up.merge_stats(F.col("platform_stats"), F.col("_stats"))).otherwise(F.col("platform_stats")),
        }
    )
    return state.with_(accounts=cut_lineage(joined.select(*state.accounts.columns)))


def normalize(payloads: DataFrame, source: str = "artstation:wayback") -> tuple[DataFrame, DataFrame]:
    """Archived profiles: address fields and the social list, minus mail entries and masked addresses."""
    parsed = c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", PROFILE).alias("p"))
    parsed = parsed.filter("p is not null")
    listed = F.transform(
        F.filter(
            F.coalesce("p.social_profiles", F.array().cast("array<struct<social_network:string,url:string>>")),
            lambda s: ~s["social_network"].eqNullSafe(F.lit("public_email")),
        ),
        lambda s: s["url"],
    )
    urls = F.array_distinct(F.array_compact(F.concat(F.array(*[F.col(f"p.{f}") for f in URL_FIELDS]), listed)))
    usable = F.filter(urls, lambda u: (u != "") & ~F.contains(u, F.lit("*")))
    rows = c.profiles(
        parsed.withColumn("social", F.array_join(usable, "\n")),
        keep=["social"],
        platform=F.lit("artstation"),
        native_id=F.col("p.id"),
        handle=F.coalesce("p.username", "key"),
        display_name=F.col("p.full_name"),
        profile_url=F.concat(F.lit("https://www.artstation.com/"), "key"),
        followers_count=F.col("p.followers_count"),
        bio_text=F.coalesce("p.headline", F.lit("")),
        avatar_url=F.col("p.medium_avatar_url"),
        raw=F.col("body"),
        fetch_source=F.lit("artstation:wayback"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(wayback_checked=F.lit(True), wayback_archived=F.substring("p.timestamp", 1, 8)),
        email_text=F.lit(None),
        commission_text=F.lit(None),
    )
    links = c.text_links(rows, "social", "profile_field", 0).filter("platform <> 'artstation'")
    return rows.drop("social"), c.emitted(links)
