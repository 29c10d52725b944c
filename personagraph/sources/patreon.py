"""Patreon: public ranking lists, creator statistics pages, creator pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import patterns as P
from ..functions.html import strip_tags, unescape
from ..functions.jsontree import linked_data
from ..functions.scalars import category_slug, grouped_int
from ..functions.text import first_match, strip_space
from ..operators import upsert as up
from ..schemas import State
from ..session import cut_lineage
from . import common as c

# Markup of the ranking lists and of the statistics pages.
ROW_MARK = 'class="creator-column'
VANITY = r'href="/creator/([A-Za-z0-9_.~-]+)"'
CAMPAIGN = r"/campaign/(\d+)/"
NAME = r'(?s)creator-name">\s*(.*?)\s*<'
BLURB = r'(?s)<p class="no-margin">\s*(.*?)\s*</p>'
STAT = r'(earnings-value|paid-members-value)">\s*\$?(-?[\d,]+)'
STAT_NAMES = {"earnings-value": "monthly_earnings_usd", "paid-members-value": "paid_members"}
CATEGORY_NAMES = [
    "3D Printing", "Animals", "Animation", "Comics", "Cosplay", "Crafts & DIY", "Dance & Theater",
    "Drawing & Painting", "Finance", "Games", "Magazine", "Mastodon", "Music", "Other", "Photography",
    "Podcasts", "Video", "Writing",
]
CATEGORY = rf"((?:Adult )?(?:{'|'.join(CATEGORY_NAMES)}))\s+Rank\s+([\d,]+)(?:st|nd|rd|th)"
MEMBERS = r"Paid Members\s+([\d,]+)"


def list_rows(pages: DataFrame) -> DataFrame:
    """Creators of list pages (page, body): rank is the place among a page's distinct creators."""
    blocks = pages.select("page", F.posexplode(F.split("body", ROW_MARK)).alias("pos", "block")).filter("pos > 0")
    found = blocks.withColumn("vanity", first_match(F.col("block"), VANITY, 1)).filter("vanity is not null")
    firsts = c.first_per_key(found, ["page", "vanity"], [F.col("pos")])
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("pos")))
    return ranked.select(
        "page",
        "rank",
        "vanity",
        first_match(F.col("block"), CAMPAIGN, 1).alias("campaign"),
        unescape(first_match(F.col("block"), NAME, 1)).alias("name"),
        unescape(F.regexp_replace(first_match(F.col("block"), BLURB, 1), P.TAGS, "")).alias("blurb"),
    )


def list_stats(pages: DataFrame) -> DataFrame:
    """(page, vanity, stat, value): stat cells stand before the creator they belong to.

    Each cell is carried to the next creator link of its page; of equal cells before one link the first
    counts, and a later link of the same creator replaces an earlier one.
    """
    tokens = pages.select(
        "page", F.posexplode(F.regexp_extract_all("body", F.lit(f"{STAT}|{VANITY}"), F.lit(0))).alias("pos", "token")
    )
    read = tokens.select(
        "page",
        "pos",
        first_match(F.col("token"), VANITY, 1).alias("vanity"),
        first_match(F.col("token"), STAT, 1).alias("cell"),
        grouped_int(F.regexp_extract("token", STAT, 2)).alias("value"),
    )
    # Backwards, as a frame that grows costs each token once; one that shrinks would be folded anew at every token.
    onward = Window.partitionBy("page").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    link = F.struct("pos", "vanity")
    carried = read.withColumn("owner", F.last(F.when(F.col("vanity").isNotNull(), link), ignorenulls=True).over(onward))
    cells = carried.filter("cell is not null and value >= 0 and owner is not null")
    per_link = cells.groupBy("page", F.col("owner.vanity").alias("vanity"), "cell", F.col("owner.pos").alias("at")).agg(
        F.min_by("value", "pos").alias("value")
    )
    last = per_link.groupBy("page", "vanity", "cell").agg(F.max_by("value", "at").alias("value"))
    names = F.create_map(*[F.lit(x) for pair in STAT_NAMES.items() for x in pair])
    return last.select("page", "vanity", names[F.col("cell")].alias("stat"), "value")


def merge_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per creator over all lists (page, metric, category, list_order): the first sighting's details."""
    seen = rows.join(lists, "page")
    order = F.struct("list_order", "rank")
    detail = F.struct("name", "blurb", "metric", "category", "rank")
    merged = seen.groupBy("vanity").agg(
        F.min_by(detail, order).alias("d"),
        F.min_by("campaign", F.when(F.col("campaign").isNotNull(), order)).alias("campaign"),
        F.max(F.col("category").startswith("adult-")).alias("adult"),
    )
    return merged.select("vanity", "campaign", "adult", "d.*")


def merge_stats(stats: DataFrame) -> DataFrame:
    """(vanity, stat, value): the best value over all lists."""
    return stats.groupBy("vanity", "stat").agg(F.max("value").alias("value"))


def ranking_profiles(creators: DataFrame, stats: DataFrame, fetched_at) -> DataFrame:
    """Profile rows of merged list creators."""
    per = stats.groupBy("vanity").agg(
        F.max(F.when(F.col("stat") == "paid_members", F.col("value"))).alias("paid_members"),
        F.max(F.when(F.col("stat") == "monthly_earnings_usd", F.col("value"))).alias("monthly_earnings_usd"),
    )
    rows = creators.join(per, "vanity", "left")
    return c.profiles(
        rows,
        platform=F.lit("patreon"),
        native_id=F.col("campaign"),
        handle=F.col("vanity"),
        display_name=F.col("name"),
        profile_url=F.concat(F.lit("https://www.patreon.com/"), "vanity"),
        followers_count=F.col("paid_members"),
        bio_text=F.col("blurb"),
        raw=F.to_json(F.struct("metric", "category", "rank")),
        fetch_source=F.lit("graphtreon:ranking"),
        discovered_via=F.lit("patreon_ranking"),
        discovery_details=F.create_map(F.lit("category"), "category", F.lit("rank"), F.col("rank").cast("string")),
        fetched_at=fetched_at,
        hydrated=F.lit(False),
        stats=c.stats_map(
            graphtreon_category=F.col("category"), graphtreon_rank=F.col("rank"),
            paid_members=F.col("paid_members"), monthly_earnings_usd=F.col("monthly_earnings_usd"),
        ),
        extra_flags=c.flag(F.col("adult"), "platform_flag", "patreon:adult_category"),
    )


def page_stats(payloads: DataFrame, source: str = "graphtreon:creator") -> DataFrame:
    """(key, category, rank, paid_members, tracked) of statistics pages; a missing page is remembered."""
    text = F.regexp_replace(strip_tags(F.col("body"), scripts=False), r"\s+", " ")
    found = c.bodies(payloads, source).select("key", unescape(text).alias("text"))
    read = found.select(
        "key",
        category_slug(first_match(F.col("text"), CATEGORY, 1)).alias("category"),
        grouped_int(first_match(F.col("text"), CATEGORY, 2)).alias("rank"),
        grouped_int(first_match(F.col("text"), MEMBERS, 1)).alias("paid_members"),
        F.lit(True).alias("tracked"),
    )
    none = c.gone(payloads, source).select("key", F.lit(False).alias("tracked"))
    return read.unionByName(none, allowMissingColumns=True)


def enrich(state: State, payloads: DataFrame, as_of: Column) -> State:
    """Write what statistics pages say to the accounts they are about: stats, paid members as followers, adult flag.

    A page that is not there is remembered as checked and not tracked. A page without members leaves the followers as
    they are; only creators of an adult category get a snapshot, which their flag names as evidence.
    """
    mine = state.accounts.filter("platform = 'patreon'").select("account_id", F.lower("handle").alias("_low"))
    pages = c.first_per_key(page_stats(payloads).withColumn("_low", F.lower("key")), ["_low"], [F.col("tracked").desc(), F.col("key")])
    told = cut_lineage(pages.join(mine, "_low"))
    stats = c.stats_map(
        graphtreon_checked=F.lit(True), graphtreon_tracked=F.when(~F.col("tracked"), F.lit(False)), graphtreon_category=F.col("category"),
        graphtreon_rank=F.col("rank"), paid_members=F.col("paid_members"),
    )
    new = told.select("account_id", stats.alias("_stats"), F.nullif("paid_members", F.lit(0)).alias("_members"))
    joined = state.accounts.join(new, "account_id", "left")
    accounts = joined.withColumns(
        {
            "platform_stats": F.when(F.col("_stats").isNotNull(), up.merge_stats(F.col("platform_stats"), F.col("_stats"))).otherwise(F.col("platform_stats")),
            "followers_count": F.coalesce("_members", "followers_count"),
        }
    ).select(*state.accounts.columns)
    adult = told.filter("tracked and startswith(category, 'adult-')").select(
        "account_id", as_of.alias("captured_at"), F.nullif("paid_members", F.lit(0)).alias("followers_count"),
        F.to_json(F.struct("category", "rank", "paid_members")).alias("raw"), F.lit("graphtreon:creator").alias("fetch_source"),
    )
    adult = cut_lineage(up.next_ids(adult, state.snapshots, "snapshot_id", [F.col("account_id")]))
    marks = adult.select(
        "account_id", F.lit("nsfw").alias("flag"), F.lit("platform_flag").alias("signal"), F.lit("patreon:adult_category").alias("matched_text"),
        F.col("snapshot_id").alias("evidence_snapshot_id"),
    )
    return state.with_(
        accounts=cut_lineage(accounts), snapshots=up.append(state.snapshots, adult), flags=cut_lineage(up.upsert_flags(state.flags, marks, as_of))
    )


def normalize(payloads: DataFrame, source: str = "patreon:creator") -> tuple[DataFrame, DataFrame]:
    """Creator pages: what a page states about itself as linked data."""
    pages = c.bodies(payloads, source).select("key", "fetched_at", linked_data(F.col("body")).alias("p"))
    rows = c.profiles(
        pages.withColumn("social", F.array_join("p.same_as", "\n")),
        keep=["social"],
        platform=F.lit("patreon"),
        handle=F.col("key"),
        display_name=F.col("p.name"),
        profile_url=F.concat(F.lit("https://www.patreon.com/"), "key"),
        bio_text=strip_space(F.coalesce("p.description", F.lit(""))),
        avatar_url=F.col("p.image"),
        raw=F.to_json("p"),
        fetch_source=F.lit("patreon:creator_page"),
        discovered_via=F.lit("bio_link"),
        fetched_at=F.col("fetched_at"),
        commission_text=F.concat_ws("\n", "p.description", "p.name"),
    )
    links = c.text_links(rows, "social", "profile_field", 0).unionByName(c.text_links(rows, "bio_text", "bio_link", 1))
    return rows.drop("social"), c.emitted(drop_service(links, policy.PATREON_SERVICE_HANDLES))


def drop_service(links: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Links to a service's own accounts are on every page and name nobody."""
    key = F.concat_ws("\u0001", "platform", F.lower(F.coalesce("handle", F.lit(""))))
    return links.filter(~key.isin([f"{p}\u0001{h}" for p, h in pairs]))


