"""Standing sweeps: junk accounts, duplicate channels, project accounts, tiny accounts, misfiled links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import patterns as P
from ..functions.links import on_blocked_domain
from ..functions.text import project_account
from ..schemas import State
from ..session import cut_lineage
from . import evidence as ev
from .clustering import demote_artists, listed_untouched, remove_members
from .spread import first_per_key
from .upsert import resolve_reviews


def junk_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts that page markup minted: blocked hosts, files, fused addresses, reserved words."""
    handle = F.col("handle")
    site = (F.col("platform") == "website") & (
        on_blocked_domain(F.split_part(handle, F.lit("/"), F.lit(1)))
        | handle.rlike(P.ASSET_PATH)
        | handle.rlike("(?i)https?:/")
    )
    word = ~F.col("platform").isin("website", "bluesky") & F.lower(handle).isin(P.RESERVED_HANDLES)
    return accounts.filter(site | word).select("account_id")


def duplicate_channels(accounts: DataFrame, memberships: DataFrame) -> DataFrame:
    """Channel-id accounts of artists that also have a named channel."""
    channels = accounts.filter((F.col("platform") == "youtube") & F.col("status").isin(policy.VISIBLE_STATUSES))
    owned = channels.select("account_id", F.col("handle").rlike(P.YOUTUBE_CHANNEL_ID).alias("is_id")).join(
        ev.live(memberships).select("account_id", "artist_id"), "account_id"
    )
    named = owned.filter(~F.col("is_id")).select("artist_id").distinct()
    return owned.filter("is_id").join(named, "artist_id", "left_semi").select("account_id").distinct()


def retire(state: State, accounts: DataFrame, reason: str, as_of: Column, keep: list[str]) -> State:
    """Retract the edges of accounts, close their memberships and hide them unless in a kept status."""
    ids = cut_lineage(accounts.select("account_id").distinct())
    flag = ids.withColumn("_out", F.lit(True))
    edges = state.edges
    marked = edges
    for side in ("source_account_id", "target_account_id"):
        marked = marked.join(flag.select(F.col("account_id").alias(side), F.col("_out").alias(f"_{side}")), side, "left")
    touched = F.col("_source_account_id").isNotNull() | F.col("_target_account_id").isNotNull()
    status = F.when(touched & (F.col("status") == "present"), F.lit("retracted")).otherwise(F.col("status"))
    edges = marked.withColumn("status", status).select(*edges.columns)
    closing = ev.live(state.memberships).join(ids, "account_id", "left_semi").select("artist_id", "account_id")
    state = remove_members(state.with_(edges=edges), closing, reason, "pipeline", as_of)
    held = state.accounts.join(flag, "account_id", "left")
    hide = F.col("_out") & ~F.col("status").isin(keep)
    hidden = held.withColumn("status", F.when(hide, F.lit("hidden")).otherwise(F.col("status")))
    return state.with_(accounts=hidden.select(*state.accounts.columns))


def purge_junk(state: State, as_of: Column) -> State:
    return retire(state, junk_accounts(state.accounts), "junk_website_purge", as_of, ["hidden", "deleted"])


def drop_duplicate_channels(state: State, as_of: Column) -> State:
    dupes = duplicate_channels(state.accounts, state.memberships)
    return retire(state, dupes, "youtube_channel_id_duplicate", as_of, ["hidden"])


def flag_projects(state: State, as_of: Column) -> State:
    """Mark zines, events and anthologies; close their open gates; demote artists made of nothing else."""
    human = ev.live(state.memberships).filter("added_by = 'human'").select("account_id").distinct()
    exempt = human.withColumn("_human", F.lit(True))
    texts = state.accounts.join(ev.latest_bios(state.snapshots), "account_id", "left").join(exempt, "account_id", "left")
    found = project_account(F.col("handle"), F.col("display_name"), F.col("bio")) & F.col("_human").isNull()
    flagged = texts.withColumn("project", F.coalesce("project", F.lit(False)) | found)
    accounts = cut_lineage(flagged.select(*state.accounts.columns))

    projects = accounts.filter("project").select("account_id", F.lit(True).alias("_project"))
    marked = state.reviews.join(projects, "account_id", "left")
    hit = F.col("_project") & (F.col("kind") == "singleton_gate")
    reviews = resolve_reviews(marked, hit, "rejected", "pipeline:project_gate", as_of).select(*state.reviews.columns)
    state = state.with_(accounts=accounts, reviews=reviews)

    # A member vouches for a person when it is no project and has a name or any text of its own.
    worded = state.snapshots.filter("coalesce(bio_text, '') <> ''").select("account_id").distinct()
    worded = worded.withColumn("_worded", F.lit(True))
    members = ev.live(state.memberships).join(accounts.select("account_id", "project", "display_name"), "account_id")
    members = members.join(worded, "account_id", "left")
    person = ~F.col("project") & ((F.coalesce("display_name", F.lit("")) != "") | F.col("_worded").isNotNull())
    only = members.groupBy("artist_id").agg(F.max("project").alias("_any"), F.max(person).alias("_person"))
    only = only.filter("_any and not _person").join(listed_untouched(state).select("artist_id"), "artist_id", "left_semi")
    return demote_artists(state, cut_lineage(only.select("artist_id")), "project_account", as_of)


def cull_low_followers(accounts: DataFrame) -> DataFrame:
    """Hide active X and Bluesky accounts below the follower floor, hand-tagged ones excepted."""
    small = (
        F.col("platform").isin("twitter", "bluesky")
        & (F.col("status") == "active")
        & (F.col("followers_count") < policy.CULL_MIN_FOLLOWERS)
        & (F.col("discovered_via") != "manual_tag")
    )
    return accounts.withColumn("status", F.when(small, F.lit("hidden")).otherwise(F.col("status")))


# Misfiled forms: platform, pattern, address prefix, key is a native id.
#: Platform, address form, address to store, whether the key is a native id. Earlier forms win.
MISFILED = [
    ("misskey", r"(?i)misskey\.(?:io|design|art)/@([A-Za-z0-9_]+)", "https://misskey.io/@", False),
    ("weibo", r"(?i)weibo\.(?:com|cn)/(?:u/)?(\d{6,})", "https://weibo.com/u/", True),
    ("profcard", r"(?i)profcard\.info/u/([A-Za-z0-9]+)", "https://profcard.info/u/", False),
    ("twpf", r"(?i)twpf\.jp/([A-Za-z0-9_]{1,15})", "https://twpf.jp/", False),
    ("tsunagu", r"(?i)tsunagu\.cloud/users/([A-Za-z0-9_.-]+)", "https://tsunagu.cloud/users/", False),
    ("tiktok", r"(?i)tiktok\.com/@([A-Za-z0-9_.]{2,24})", "https://www.tiktok.com/@", False),
    ("threads", r"(?i)threads\.(?:net|com)/@([a-z0-9._]{1,30})", "https://www.threads.net/@", False),
    ("bilibili", r"(?i)space\.bilibili\.com/(\d+)", "https://space.bilibili.com/", True),
    ("weibo", r"(?i)weibo\.(?:com|cn)/(?!(?:u|n|p|tv|hot)/|search|login|signup)([a-z][a-z0-9_-]{2,29})", "https://weibo.com/", False),
    (
        "facebook",
        r"(?i)facebook\.com/(?!profile\.php|sharer?|groups|pages|events|watch|marketplace|photos?|permalink|story|hashtag|login"
        r"|people|reel|gaming|help|policies)([a-z0-9.]{5,50})",
        "https://www.facebook.com/",
        False,
    ),
]


def reclassify_websites(accounts: DataFrame, forms: list[tuple] | None = None) -> DataFrame:
    """Move misfiled website accounts to their platform, one per handle, skipping names already taken there."""
    none = F.lit(None).cast("struct<platform:string,key:string,url:string,native:boolean>")
    target = none
    for platform, pattern, url, native in reversed(MISFILED if forms is None else forms):
        # The stored address tells the account before its handle does.
        key = F.coalesce(F.nullif(F.regexp_extract("profile_url", pattern, 1), F.lit("")), F.regexp_extract("handle", pattern, 1))
        made = F.struct(
            F.lit(platform).alias("platform"), key.alias("key"), F.concat(F.lit(url), key).alias("url"),
            F.lit(native).alias("native"),
        )
        target = F.when(key != "", made).otherwise(target)
    found = accounts.filter("platform = 'website'").select("account_id", target.alias("t")).filter("t is not null")
    found = found.select("account_id", "t", F.col("t.platform").alias("_platform"), F.lower("t.key").alias("_key"))
    one = first_per_key(found, ["_platform", "_key"], [F.col("account_id")])
    names = F.array_compact(F.array(F.lower("handle"), F.lower("native_id")))
    held = accounts.filter("platform <> 'website'").select(F.col("platform").alias("_platform"), F.explode(names).alias("_key"))
    moves = one.join(held.distinct(), ["_platform", "_key"], "left_anti").select("account_id", "t")
    joined = accounts.join(moves, "account_id", "left")
    return joined.withColumns(
        {
            "platform": F.coalesce("t.platform", "platform"),
            "handle": F.coalesce("t.key", "handle"),
            "native_id": F.when(F.col("t.native"), F.col("t.key")).otherwise(F.col("native_id")),
            "profile_url": F.coalesce("t.url", "profile_url"),
        }
    ).select(*accounts.columns)


def retract_mention_dumps(edges: DataFrame, accounts: DataFrame, platform: str = "deviantart") -> DataFrame:
    """Retract the same-platform mentions of pages that name more than five accounts."""
    mention = (F.col("status") == "present") & (F.col("relation_hint") == "same_platform_mention")
    own = accounts.filter(F.col("platform") == platform).select(F.col("account_id").alias("source_account_id"))
    named = edges.filter(mention).join(own, "source_account_id", "left_semi")
    counts = named.groupBy("source_account_id").agg(F.countDistinct("target_account_id").alias("_n"))
    dumps = counts.filter(F.col("_n") > policy.MAX_MENTIONS_PER_PAGE).select("source_account_id")
    marked = edges.join(dumps.withColumn("_dump", F.lit(True)), "source_account_id", "left")
    hit = F.col("_dump") & mention
    return marked.withColumn("status", F.when(hit, F.lit("retracted")).otherwise(F.col("status"))).select(*edges.columns)


def resolve_old_thresholds(reviews: DataFrame, anomalies: DataFrame, as_of: Column) -> DataFrame:
    """Open anomaly items that no measure supports under today's thresholds."""
    current = anomalies.select("artist_id", F.lit(True).alias("_now")).distinct()
    marked = reviews.join(current, "artist_id", "left")
    hit = (F.col("reason") == "anomaly") & F.col("account_id").isNull() & F.col("_now").isNull()
    return resolve_reviews(marked, hit, "rejected", "pipeline:threshold_raise", as_of).select(*reviews.columns)


def backfill_from_snapshots(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fill missing avatars and the protected flag from the newest snapshot that carries them."""
    newest = F.struct("captured_at", "snapshot_id")

    def latest(path: str) -> Column:
        value = F.get_json_object("raw", path)
        return F.max_by(value, F.when(value.isNotNull(), newest))

    found = snapshots.groupBy("account_id").agg(
        latest("$.profile_image_url").alias("_avatar"), latest("$.protected").alias("_protected")
    )
    joined = accounts.join(found, "account_id", "left")
    known = F.map_contains_key(F.coalesce("platform_stats", F.create_map().cast("map<string,string>")), "protected")
    added = F.map_concat(
        F.coalesce("platform_stats", F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("protected"), F.col("_protected")),
    )
    needs = (F.col("platform") == "twitter") & F.col("_protected").isNotNull() & ~known
    return joined.withColumns(
        {
            "avatar_url": F.coalesce("avatar_url", "_avatar"),
            "platform_stats": F.when(needs, added).otherwise(F.col("platform_stats")),
        }
    ).select(*accounts.columns)
