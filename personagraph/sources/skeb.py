"""Skeb creator details: platform flags, registered ids, service links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.links import explode_links, with_links
from . import common as c

# Detail field, platform, value is a stable id, address of a value.
ID_FIELDS = [
    ("pixiv_id", "pixiv", True, "https://www.pixiv.net/users/{}"),
    ("fanbox_id", "fanbox", False, "https://{}.fanbox.cc"),
    ("fantia_id", "fantia", True, "https://fantia.jp/fanclubs/{}"),
    ("booth_id", "booth", False, "https://{}.booth.pm"),
    ("dlsite_id", "dlsite", False, None),
    ("nijie_id", "nijie", True, "https://nijie.info/members.php?id={}"),
    ("skima_id", "skima", True, "https://skima.jp/profile?id={}"),
    ("coconala_id", "coconala", True, "https://coconala.com/users/{}"),
    ("patreon_id", "patreon", False, "https://www.patreon.com/{}"),
    ("youtube_id", "youtube", False, None),
]
FIELD_JUNK = ["www", "http", "https", "none", "null"]
STAT_KEYS = [
    "received_works_count", "received_nsfw_works_count", "complete_rate", "acceptable", "busy", "nsfw_acceptable",
]
DETAIL = (
    "struct<id:string,screen_name:string,name:string,description:string,avatar_url:string,acceptable:boolean,"
    "nsfw_acceptable:boolean,busy:boolean,twitter_uid:string,url:string,received_works_count:string,"
    "received_nsfw_works_count:string,complete_rate:string,"
    "user_service_links:array<struct<provider:string,screen_name:string,url:string>>,"
    + ",".join(f"{field}:string" for field, *_ in ID_FIELDS)
    + ">"
)
REGISTERED = "array<struct<platform:string,native_id:string,handle:string,url:string,hint:string>>"


def _link(platform: str, native: Column, handle: Column, url: Column, hint: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(platform).alias("platform"), native.alias("native_id"), handle.alias("handle"), url.alias("url"),
        (F.lit(hint) if hint else none).alias("hint"),
    )


def registered_links(detail: str = "d") -> Column:
    """Accounts the creator registered: the verified X account, then ten entered ids, junk dropped."""
    none = F.lit(None).cast("string")
    services = F.coalesce(
        f"{detail}.user_service_links", F.array().cast("array<struct<provider:string,screen_name:string,url:string>>")
    )
    name = F.get(F.filter(services, lambda s: s["provider"] == "twitter"), F.lit(0))["screen_name"]
    uid = F.col(f"{detail}.twitter_uid")
    has_uid = F.coalesce(uid, F.lit("")) != ""
    out = [F.when(has_uid, _link("twitter", uid, name, F.concat(F.lit("https://x.com/"), name), "oauth"))]
    blocked = [F.lit(f"{p}\u0001{v}") for p, v in policy.SKEB_FIELD_VALUE_BLOCKLIST]
    for field, platform, stable, address in ID_FIELDS:
        value = F.col(f"{detail}.{field}")
        usable = (
            value.isNotNull()
            & (F.length(value) >= 2)
            & ~F.lower(value).isin(FIELD_JUNK)
            & ~F.concat(F.lit(f"{platform}\u0001"), value).isin(*blocked)
        )
        url = none
        if address:
            head, tail = address.split("{}")
            url = F.concat(F.lit(head), value, F.lit(tail))
        native = value if stable else none
        if platform == "youtube":
            channel = value.startswith("UC")
            native = F.when(channel, value)
            url = F.when(channel, F.concat(F.lit("https://www.youtube.com/channel/"), value))
        out.append(F.when(usable, _link(platform, native, value, url)))
    return F.array_compact(F.array(*out)).cast(REGISTERED)


def structured_text(detail: str = "d") -> Column:
    """The url field and service links other than X, one per line."""
    services = F.coalesce(
        f"{detail}.user_service_links", F.array().cast("array<struct<provider:string,screen_name:string,url:string>>")
    )
    other = F.transform(F.filter(services, lambda s: ~s["provider"].eqNullSafe(F.lit("twitter"))), lambda s: s["url"])
    parts = F.concat(F.array(F.col(f"{detail}.url")), other)
    return F.array_join(F.filter(parts, lambda u: u.isNotNull() & (u != "")), "\n")


def weak_claims(links: DataFrame) -> DataFrame:
    """Any X account besides the verified one is a project or collaboration."""
    second = F.col("platform") == "twitter"
    return links.withColumns(
        {
            "claim": F.when(second, "related").otherwise(F.col("claim")),
            "relation_hint": F.when(second, "skeb_secondary").otherwise(F.col("relation_hint")),
        }
    )


def normalize(payloads: DataFrame, source: str = "skeb:detail") -> tuple[DataFrame, DataFrame]:
    parsed = c.bodies(payloads, source).select("key", "fetched_at", "body", F.from_json("body", DETAIL).alias("d"))
    parsed = parsed.filter("d.screen_name is not null")
    bio = F.coalesce("d.description", F.lit(""))
    takes = F.coalesce("d.acceptable", F.lit(False))
    rows = c.profiles(
        parsed.withColumns({"registered": registered_links(), "field_text": structured_text()}),
        keep=["registered", "field_text"],
        platform=F.lit("skeb"),
        native_id=F.col("d.id"),
        handle=F.col("d.screen_name"),
        display_name=F.col("d.name"),
        profile_url=F.concat(F.lit("https://skeb.jp/@"), "d.screen_name"),
        bio_text=bio,
        avatar_url=F.col("d.avatar_url"),
        raw=F.col("body"),
        fetch_source=F.lit("skeb:api/users"),
        discovered_via=F.lit("skeb_ranking"),
        fetched_at=F.col("fetched_at"),
        stats=c.stats_map(**{k: F.col(f"d.{k}") for k in STAT_KEYS}),
        platform_commission=F.coalesce(
            c.reading(takes, "open", 0.95, "skeb:acceptable"), c.reading(~takes, "closed", 0.95, "skeb:not accepting")
        ),
        extra_flags=c.flag(F.col("d.nsfw_acceptable"), "platform_flag", "skeb:nsfw_acceptable"),
    )
    links = (
        _registered_rows(rows)
        .unionByName(weak_claims(c.text_links(rows, "field_text", "profile_field", 1)))
        .unionByName(weak_claims(c.text_links(rows, "bio_text", "bio_link", 2)))
    )
    return rows.drop("registered", "field_text"), c.emitted(links)


def _registered_rows(rows: DataFrame) -> DataFrame:
    named = rows.select(
        F.col("platform").alias("own_platform"), F.col("native_id").alias("own_native_id"),
        F.col("handle").alias("own_handle"), F.posexplode("registered").alias("link_pos", "l"),
    )
    return named.select(
        "own_platform", "own_native_id", "own_handle", "link_pos", "l.platform", "l.handle", "l.native_id", "l.url",
        F.lit("profile_field").alias("evidence_type"), F.lit("same_person").alias("claim"),
        F.col("l.hint").alias("relation_hint"), F.lit(0).alias("emit_order"),
        F.coalesce("l.url", F.concat(F.lit("https://skeb.jp/@"), "own_handle")).alias("evidence_url"),
        F.lit(None).cast("string").alias("matched_text"),
    )


def stored_links(read: DataFrame) -> DataFrame:
    """Registered links out of stored snapshots, so a bio re-read never loses them."""
    parsed = read.select(
        F.col("account_id").alias("source_account_id"), "snapshot_id", F.col("handle").alias("own_handle"),
        F.from_json("raw", DETAIL).alias("d"),
    ).filter("d is not null")
    named = parsed.select(
        "source_account_id", "snapshot_id", "own_handle", F.posexplode(registered_links()).alias("link_pos", "l")
    ).select(
        "source_account_id", "snapshot_id", "own_handle", "link_pos", "l.platform", "l.native_id", "l.handle", "l.url",
        F.lit("same_person").alias("claim"), F.col("l.hint").alias("relation_hint"), F.lit(0).alias("emit_order"),
    )
    texts = parsed.select("source_account_id", "snapshot_id", "own_handle", structured_text().alias("field_text"))
    found = explode_links(with_links(texts, "field_text").drop("field_text"))
    found = weak_claims(c.up.edge_claims(found, "profile_field")).drop("evidence_type")
    both = named.unionByName(found.withColumn("emit_order", F.lit(1)))
    target = F.coalesce(F.concat(F.lit("id:"), "native_id"), F.concat(F.lit("h:"), F.lower("handle")))
    once = c.first_per_key(
        both.withColumn("_t", target), ["source_account_id", "platform", "_t"], [F.col("emit_order"), F.col("link_pos")]
    )
    return once.withColumns(
        {
            "discovered_via": F.lit("bio_link"),
            "evidence_type": F.lit("profile_field"),
            "evidence_url": F.coalesce("url", F.concat(F.lit("https://skeb.jp/@"), "own_handle")),
            "matched_text": F.lit(None).cast("string"),
            "link_pos": F.col("emit_order") * 1_000_000 + F.col("link_pos"),
        }
    )


def ranked_creators(payloads: DataFrame, top: int, source: str = "skeb:ranking") -> DataFrame:
    """(screen_name, algolia_rank) of ranking pages in page order, the first sighting per creator."""
    schema = "struct<page:int,hits:array<struct<screen_name:string>>>"
    pages = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200))
    hits = pages.select(F.from_json("body", schema).alias("p")).select(
        F.col("p.page").alias("page"), F.posexplode("p.hits").alias("pos", "h")
    )
    firsts = c.first_per_key(
        hits.select(F.col("h.screen_name").alias("screen_name"), "page", "pos"), ["screen_name"], [F.col("page"), F.col("pos")]
    )
    from ..operators.spread import running

    ranked = running(firsts, [], [F.col("page"), F.col("pos"), F.col("screen_name")], {}, position="algolia_rank")
    return ranked.filter(F.col("algolia_rank") <= top).select("screen_name", "algolia_rank")
