"""Link hub pages and shortened links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import text as T
from ..functions.html import hub_markup, linked_urls, open_graph, strip_tags, unescape
from ..functions.links import (
    SHORT_LINK_SCAN,
    explode_links,
    same_host,
    short_links,
    with_links,
    with_platform_links,
    with_website_links,
)
from ..functions.text import strip_space
from ..operators import evidence as ev
from ..operators import upsert as up
from ..schemas import State
from ..session import cut_lineage
from . import common as c
from .patreon import drop_service

SOURCE = "hub:page"


def pages(payloads: DataFrame, hubs: DataFrame) -> DataFrame:
    """Hub pages with their account: payload key is the profile address, hubs (account_id, platform, profile_url)."""
    found = c.bodies(payloads, SOURCE).select(F.col("key").alias("profile_url"), "fetched_at", hub_markup(F.col("body")).alias("markup"))
    return found.join(hubs.select("account_id", "platform", "handle", "profile_url"), "profile_url")


def page_links(rows: DataFrame, key: list[str]) -> DataFrame:
    """Link rows of hub pages with claims: other platforms, and websites unless the page lists too many."""
    base = rows.select(*key, F.col("platform").alias("own_platform"), F.col("handle").alias("own_handle"), "markup",
                       F.array_join(linked_urls(F.col("markup")), "\n").alias("linked"))
    found = with_website_links(with_platform_links(base, "markup"), "linked").drop("markup", "linked")
    few = F.size("website_links") <= policy.HUB_MAX_WEBSITES
    both = F.concat("platform_links", F.when(few, F.col("website_links")).otherwise(F.slice("website_links", 1, 0)))
    links = explode_links(found.withColumn("links", both).drop("platform_links", "website_links"))
    other = links.filter(F.col("platform") != F.col("own_platform"))
    return up.hub_claims(drop_service(other, policy.HUB_SERVICE_ACCOUNTS), key)


def page_signals(rows: DataFrame) -> DataFrame:
    """Name, picture, description, commission and e-mail of hub pages."""
    og = open_graph(F.col("markup"))
    read = rows.withColumn("og", F.when(F.col("platform") == "potofu", og))
    name = F.regexp_replace(strip_space(unescape(F.col("og.title"))), r"(?:\s*\|\s*POTOFU)+\s*$", "")
    image = F.col("og.image")
    text = strip_tags(F.col("markup"))
    return read.select(
        "account_id",
        "fetched_at",
        F.nullif(name, F.lit("")).alias("og_name"),
        F.nullif(strip_space(unescape(F.col("og.description"))), F.lit("")).alias("og_text"),
        F.when(image.startswith("http") & ~F.contains(image, F.lit("default_profile")), image).alias("image"),
        T.commission_status(text, policy.HUB_COMMISSION_MULTIPLIER).alias("commission"),
        T.email(text).alias("email"),
    )


def crawl(state: State, payloads: DataFrame, as_of: Column) -> State:
    """Store hub pages: status, snapshot, signals and link_hub edges; edges not found again are retracted."""
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    hubs = state.accounts.filter(F.col("platform").isin(policy.HUB_PLATFORMS)).join(barred, "account_id", "left_anti")
    lost = c.gone(payloads, SOURCE).withColumnRenamed("key", "profile_url").join(hubs, "profile_url").select("account_id")
    rows = cut_lineage(pages(payloads, hubs))
    links = cut_lineage(page_links(rows, ["account_id"]))
    signals = cut_lineage(page_signals(rows))

    urls = links.groupBy("account_id").agg(F.count("*").alias("n"))
    snaps = signals.join(urls, "account_id", "left").select(
        "account_id",
        F.col("fetched_at").alias("captured_at"),
        F.col("og_text").alias("bio_text"),
        F.col("og_name").alias("display_name"),
        F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("link_count"))).alias("raw"),
        F.lit("hub_crawl").alias("fetch_source"),
    )
    snaps = cut_lineage(up.next_ids(snaps, state.snapshots, "snapshot_id", [F.col("account_id"), F.col("captured_at")]))
    evidence = snaps.select("account_id", F.col("snapshot_id").alias("evidence_snapshot_id"))

    said = signals.join(evidence, "account_id")
    statements = T.explode_rows(said, T.attestations(F.col("og_text")), "s")
    markers = T.explode_rows(said, T.adult_markers(F.coalesce("og_text", F.lit(""))), "s")
    accounts = up.mark_deleted(state.accounts, lost, as_of)
    seen = signals.select("account_id", *[F.col(x).alias(f"_{x}") for x in ("og_name", "image", "commission", "email")])
    joined = accounts.join(seen.withColumn("_seen", F.lit(True)), "account_id", "left")
    hit, read = F.col("_seen").isNotNull(), F.col("_commission").isNotNull()
    accounts = joined.withColumns(
        {
            "status": F.when(hit & (F.col("status") != "hidden"), F.lit("active")).otherwise(F.col("status")),
            "last_hydrated": F.when(hit, as_of).otherwise(F.col("last_hydrated")),
            "display_name": F.coalesce("_og_name", "display_name"),
            "avatar_url": F.coalesce("_image", "avatar_url"),
            "contact_email": F.coalesce("_email", "contact_email"),
            "commission_status": F.coalesce("_commission.status", "commission_status"),
            "commission_confidence": F.coalesce("_commission.confidence", "commission_confidence"),
            "commission_detail": F.coalesce("_commission.detail", "commission_detail"),
            "commission_checked_at": F.when(read, as_of).otherwise(F.col("commission_checked_at")),
        }
    ).select(*state.accounts.columns)
    state = state.with_(
        accounts=cut_lineage(accounts),
        snapshots=up.append(state.snapshots, snaps),
        attestations=up.upsert_attestations(
            state.attestations, statements.select("account_id", "evidence_snapshot_id", "s.*"), as_of),
        flags=up.upsert_flags(
            state.flags, markers.select("account_id", "evidence_snapshot_id", F.lit("nsfw").alias("flag"), "s.*"), as_of),
    )
    sources = rows.select(
        "account_id", F.col("platform").alias("own_platform"), F.col("handle").alias("own_handle")
    ).join(evidence, "account_id")
    rowed = links.select(
        "own_platform", F.col("account_id").cast("string").alias("own_native_id"), "own_handle", "link_pos", "platform",
        "handle", "native_id", "url", "evidence_type", "claim", "relation_hint", F.lit(0).alias("emit_order"),
        F.col("url").alias("evidence_url"), F.lit(None).cast("string").alias("matched_text"),
    )
    named = sources.select(
        "own_platform", F.col("account_id").cast("string").alias("own_native_id"), "own_handle",
        F.col("account_id").alias("source_account_id"), "evidence_snapshot_id",
    )
    stored = c.store_links(state, rowed, named, as_of)
    fresh = stored.edges.filter((F.col("evidence_type") == "link_hub") & (F.col("last_verified") == as_of))
    edges, _ = up.retract_missing(stored.edges, fresh, rows.select("account_id"), ["link_hub"])
    return stored.with_(edges=cut_lineage(edges))


def short_link_rows(state: State) -> DataFrame:
    """(account_id, snapshot_id, platform, handle, short_url) of the newest snapshots that carry short links."""
    text = F.concat_ws(" ", F.coalesce("bio_text", F.lit("")), F.coalesce(F.get_json_object("raw", "$.location"), F.lit("")))
    maybe = state.snapshots.withColumn("scan", text).filter(F.col("scan").rlike(SHORT_LINK_SCAN))
    newest = ev.latest_snapshots(maybe.select("account_id", "snapshot_id", "captured_at", "scan"))
    rows = newest.join(state.accounts.select("account_id", "platform", "handle"), "account_id")
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    rows = rows.join(barred, "account_id", "left_anti")
    found = T.explode_rows(rows, short_links(F.col("scan")), "short_url")
    found = found.select("account_id", "snapshot_id", "platform", "handle", "short_url")
    # X wraps its own links; those arrive expanded with the profile.
    wrapped = (F.col("platform") == "twitter") & F.col("short_url").startswith("https://t.co/")
    return found.filter(~wrapped)


def resolve_short_links(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add the final address from the lookup table; an address on the shortener's own host is no result."""
    joined = found.join(resolved.select("short_url", "final_url"), "short_url", "left")
    dead = same_host(F.col("short_url"), F.col("final_url"))
    return joined.withColumn("final_url", F.when(~dead, F.col("final_url")))


def short_link_edges(resolved: DataFrame) -> DataFrame:
    """Link rows of resolved short links; the evidence shows both addresses."""
    known = resolved.filter("final_url is not null").select(
        F.col("account_id").alias("source_account_id"), "snapshot_id", F.col("platform").alias("own_platform"),
        F.col("handle").alias("own_handle"), "short_url", "final_url",
    )
    links = explode_links(with_links(known, "final_url"))
    links = up.edge_claims(links)
    return links.withColumn("evidence_url", F.concat("short_url", F.lit(" -> "), "final_url"))
