"""State changes as joins: account identity, edges, signals, status, and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..session import extended
from .spread import first_per_key, hot_of, lookup, running

# ``seq`` may be of any orderable type; it says which reference came first.
ACCOUNT_REFS = (
    "seq bigint, platform string, native_id string, handle string, display_name string, "
    "profile_url string, status string, followers_count bigint, last_post_at timestamp, "
    "discovered_via string, discovery_details map<string,string>, hydrated boolean"
)


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give a frame the columns and types of another; missing columns become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def append(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return extended(stored, align(rows, stored))


def next_ids(rows: DataFrame, stored: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """Dense new ids after the largest stored one, in a stated order."""
    top = stored.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = running(rows, [], order, {}, position="_position")
    ids = numbered.join(F.broadcast(top))
    return ids.withColumn(id_column, (F.col("_top") + F.col("_position")).cast("bigint")).drop("_top", "_position")


def _last(column: str) -> Column:
    """Value of the last reference that has one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def _first(column: str) -> Column:
    return F.min_by(column, "seq").alias(column)


def upsert_accounts(
    accounts: DataFrame, refs: DataFrame, as_of: Column, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Match references to accounts and refresh or create them.

    A native id finds its account, else claims the handle-only account of its handle, else creates one.
    References without a native id come second: they reuse any account of the handle (one with a native
    id first) and change nothing. Returns (accounts, references with account_id). ``accounts`` may be a part
    of the table that holds all that the references name; ``ids`` then has the ids of the whole table.
    """
    ids = (accounts if ids is None else ids).select("account_id")
    known = refs.filter(F.col("native_id").isNotNull())
    groups = known.groupBy("platform", "native_id").agg(
        F.min("seq").alias("seq"),
        F.lower(F.min_by("handle", "seq")).alias("_claim"),
        F.max_by("handle", "seq").alias("handle"),
        F.max_by("status", "seq").alias("status"),
        _last("display_name"),
        _last("profile_url"),
        _last("followers_count"),
        _last("last_post_at"),
        _first("discovered_via"),
        _first("discovery_details"),
        F.max(F.coalesce("hydrated", F.lit(False))).alias("hydrated"),
    )
    by_native = accounts.filter("native_id is not null").select("platform", "native_id", "account_id")
    matched = groups.join(by_native, ["platform", "native_id"], "left")
    unmatched = matched.filter("account_id is null").drop("account_id")
    open_rows = (
        accounts.filter("native_id is null")
        .groupBy("platform", F.lower("handle").alias("_claim"))
        .agg(F.min("account_id").alias("account_id"))
    )
    claimable = unmatched.join(open_rows, ["platform", "_claim"], "left")
    claims = first_per_key(claimable.filter("account_id is not null"), ["account_id"], [F.col("seq")])
    claimed = claims.select("platform", "native_id", "account_id")
    fresh = unmatched.join(claimed.drop("account_id"), ["platform", "native_id"], "left_anti")
    changes = matched.filter("account_id is not null").select(claims.columns).unionByName(claims)

    new = changes.select("account_id", F.struct(*[c for c in changes.columns if c != "account_id"]).alias("_n"))
    n = F.col("_n")
    changed = n.isNotNull()
    refreshed = {
        "native_id": F.coalesce(n["native_id"], "native_id"),
        "handle": F.coalesce(n["handle"], "handle"),
        "display_name": F.coalesce(n["display_name"], "display_name"),
        "profile_url": F.coalesce(n["profile_url"], "profile_url"),
        "status": F.when(changed & (F.col("status") != "hidden"), n["status"]).otherwise(F.col("status")),
        "followers_count": F.coalesce(n["followers_count"], "followers_count"),
        "last_post_at": F.coalesce(n["last_post_at"], "last_post_at"),
        "last_hydrated": F.when(changed & n["hydrated"], as_of).otherwise(F.col("last_hydrated")),
    }
    updated = accounts.join(new, "account_id", "left").withColumns(refreshed).select(*accounts.columns)
    minted = _mint(fresh, ids, as_of)
    with_native = append(updated, minted)

    loose = refs.filter(F.col("native_id").isNull()).withColumn("_low", F.lower("handle"))
    wanted = loose.groupBy("platform", "_low").agg(
        F.min("seq").alias("seq"),
        *[_first(c) for c in ("handle", "display_name", "profile_url", "status", "discovered_via", "discovery_details")],
    )
    by_handle = with_native.groupBy("platform", F.lower("handle").alias("_low")).agg(
        F.min_by(
            "account_id", F.struct(F.col("native_id").isNull(), F.coalesce("native_id", F.lit("")), "account_id")
        ).alias("account_id")
    )
    found = wanted.join(by_handle, ["platform", "_low"], "left")
    missing = found.filter("account_id is null").drop("account_id", "_low")
    held = ids.unionByName(minted.select("account_id"))
    minted_loose = _mint(missing.withColumn("native_id", F.lit(None).cast("string")), held, as_of)
    result = append(with_native, minted_loose)

    native_ids = result.filter("native_id is not null").select("platform", "native_id", "account_id")
    loose_ids = found.filter("account_id is not null").select("platform", "_low", "account_id")
    loose_ids = loose_ids.unionByName(minted_loose.select("platform", F.lower("handle").alias("_low"), "account_id"))
    resolved = known.join(native_ids, ["platform", "native_id"]).unionByName(
        loose.join(loose_ids, ["platform", "_low"]).drop("_low"), allowMissingColumns=True
    )
    return result, resolved


def _mint(rows: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    numbered = next_ids(rows, stored, "account_id", [F.col("platform"), F.lower("handle"), F.col("native_id"), F.col("seq")])
    hydrated = F.col("hydrated") if "hydrated" in rows.columns else F.lit(False)
    return numbered.withColumns(
        {
            "status": F.coalesce("status", F.lit("unknown")),
            "first_seen": as_of,
            "last_hydrated": F.when(hydrated, as_of),
            "commission_status": F.lit("unknown"),
            "project": F.lit(False),
        }
    )


EDGE_KEY = ["source_account_id", "target_account_id", "evidence_type"]


def upsert_edges(stored: DataFrame, produced: DataFrame, as_of: Column, ids: DataFrame | None = None) -> DataFrame:
    """Refresh or add edges; a dismissed edge never comes back and nothing points at itself.

    ``stored`` may be a part of the table that holds all edges of the produced keys; ``ids`` then has the ids of
    the whole table.
    """
    latest = first_per_key(
        produced.filter("source_account_id <> target_account_id"), EDGE_KEY, [F.col("seq").desc()]
    ).drop("seq")
    body = [c for c in latest.columns if c not in EDGE_KEY]
    new = latest.select(*EDGE_KEY, F.struct(*body).alias("_n"))
    n = F.col("_n")
    take = n.isNotNull() & (F.col("status") != "dismissed")
    fields = ("evidence_snapshot_id", "evidence_url", "matched_text", "claim", "relation_hint")
    refreshed = {c: F.when(take, n[c]).otherwise(F.col(c)) for c in fields}
    refreshed["last_verified"] = F.when(take, as_of).otherwise(F.col("last_verified"))
    refreshed["status"] = F.when(take, F.lit("present")).otherwise(F.col("status"))
    kept = stored.join(new, EDGE_KEY, "left").withColumns(refreshed).select(*stored.columns)
    added = latest.join(stored.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    added = added.withColumns({"status": F.lit("present"), "first_seen": as_of, "last_verified": as_of})
    return append(kept, next_ids(added, stored if ids is None else ids, "edge_id", [F.col(c) for c in EDGE_KEY]))


def upsert_signals(stored: DataFrame, produced: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Attestations and content flags: seen again means newest evidence, active, first_seen kept."""
    text = F.coalesce("matched_text", F.lit("")).alias("_text")
    new = produced.groupBy(*keys, text).agg(
        F.max("evidence_snapshot_id").alias("_snapshot"), F.max("matched_text").alias("_matched")
    )
    old = stored.withColumn("_text", F.coalesce("matched_text", F.lit("")))
    both = old.join(new, [*keys, "_text"], "full_outer")
    seen = F.col("_snapshot").isNotNull()
    return both.select(
        *keys,
        F.coalesce("matched_text", "_matched").alias("matched_text"),
        F.coalesce("_snapshot", "evidence_snapshot_id").alias("evidence_snapshot_id"),
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(seen, as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        (seen | F.coalesce("active", F.lit(False))).alias("active"),
    ).select(*stored.columns)


def upsert_attestations(stored: DataFrame, produced: DataFrame, as_of: Column) -> DataFrame:
    return upsert_signals(stored, produced, ["account_id", "signal"], as_of)


def upsert_flags(stored: DataFrame, produced: DataFrame, as_of: Column) -> DataFrame:
    return upsert_signals(stored, produced, ["account_id", "flag", "signal"], as_of)


def deactivate_missing(
    stored: DataFrame, produced: DataFrame, scanned: DataFrame, signals: list[str], keys: list[str]
) -> DataFrame:
    """Signals of re-read accounts that the newest text no longer yields turn inactive."""
    text = F.coalesce("matched_text", F.lit(""))
    made = produced.select(*keys, text.alias("_text")).distinct().withColumn("_made", F.lit(True))
    read = scanned.select("account_id").distinct().withColumn("_read", F.lit(True))
    old = stored.withColumn("_text", text).join(made, [*keys, "_text"], "left").join(read, "account_id", "left")
    gone = F.col("_read") & F.col("_made").isNull() & F.col("signal").isin(signals)
    stay = F.col("active") & ~F.coalesce(gone, F.lit(False))
    return old.withColumn("active", stay).select(*stored.columns)


def retract_missing(
    stored: DataFrame,
    produced: DataFrame,
    scanned: DataFrame,
    evidence_types: list[str],
    keep: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Present edges of re-read sources that were not produced again become retracted.

    ``keep`` marks edges another job owns (short-link edges carry an arrow in their evidence).
    Returns (edges, ids of the retracted ones).
    """
    owned = F.lit(False) if keep is None else keep
    made = produced.select(*EDGE_KEY).distinct()
    due = stored.filter((F.col("status") == "present") & F.col("evidence_type").isin(evidence_types) & ~owned)
    read = scanned.select(F.col("account_id").alias("source_account_id")).distinct()
    gone = due.join(read, "source_account_id", "left_semi").join(made, EDGE_KEY, "left_anti").select("edge_id")
    flagged = stored.join(gone.withColumn("_gone", F.lit(True)), "edge_id", "left")
    status = F.when(F.col("_gone"), F.lit("retracted")).otherwise(F.col("status"))
    return flagged.withColumn("status", status).select(*stored.columns), gone


def short_link_evidence() -> Column:
    return F.contains(F.coalesce("evidence_url", F.lit("")), F.lit(" -> "))


def merge_stats(old: Column, new: Column) -> Column:
    """Union of two stat maps; the later writer wins per key, whatever the session's duplicate rule."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(F.coalesce(new, empty), k))
    return F.map_concat(kept, F.coalesce(new, empty))


def fill(new: Column, old: Column) -> Column:
    """A value the text does not yield never wipes a stored one."""
    return F.coalesce(new, old)


def newer(new: Column, old: Column) -> Column:
    return F.greatest(new, old)


def fold_status(accounts: DataFrame, observations: DataFrame) -> DataFrame:
    """Newest HTTP observation decides: gone pages are deleted, live ones active unless hidden."""
    last = observations.groupBy("account_id").agg(
        F.max_by("status_code", "checked_at").alias("_code"), F.max("checked_at").alias("_at")
    )
    code, held = F.col("_code"), F.col("status")
    status = F.when(code.isin(404, 410), "deleted").when((code == 200) & (held != "hidden"), "active").otherwise(held)
    joined = accounts.join(last, "account_id", "left")
    return joined.withColumns({"status": status, "link_checked_at": F.coalesce("_at", "link_checked_at")}).select(
        *accounts.columns
    )


def mark_deleted(accounts: DataFrame, missing: DataFrame, as_of: Column) -> DataFrame:
    """Requested accounts the platform no longer knows."""
    gone = missing.select("account_id").distinct().withColumn("_gone", F.lit(True))
    joined = accounts.join(gone, "account_id", "left")
    return joined.withColumns(
        {
            "status": F.when(F.col("_gone"), F.lit("deleted")).otherwise(F.col("status")),
            "last_hydrated": F.when(F.col("_gone"), as_of).otherwise(F.col("last_hydrated")),
        }
    ).select(*accounts.columns)


def lower_handles(accounts: DataFrame, platform: str) -> DataFrame:
    """Lower-case unhydrated handles of a platform unless the lower-case twin exists."""
    mine = (F.col("platform") == platform) & F.col("last_hydrated").isNull() & (F.col("handle") != F.lower("handle"))
    twins = accounts.filter(F.col("platform") == platform).filter(F.col("handle") == F.lower("handle"))
    twins = twins.select(F.col("handle").alias("_low")).distinct().withColumn("_twin", F.lit(True))
    joined = accounts.join(twins, F.lower("handle") == F.col("_low"), "left")
    handle = F.when(mine & F.col("_twin").isNull(), F.lower("handle")).otherwise(F.col("handle"))
    return joined.withColumn("handle", handle).select(*accounts.columns)


def retire_aliases(accounts: DataFrame, held: DataFrame, as_of: Column) -> DataFrame:
    """Held rows whose profile came back under another account leave the backlog."""
    stale = accounts.join(held.select("account_id").distinct(), "account_id", "left_semi")
    return mark_deleted(accounts, stale.filter("last_hydrated is null"), as_of)


def pin_native_ids(accounts: DataFrame, found: DataFrame) -> DataFrame:
    """Give accounts their native id unless another account has it or wins it in this batch."""
    open_rows = accounts.filter("native_id is null").select("account_id", "platform")
    wanted = found.select("account_id", F.col("native_id").alias("_native")).join(open_rows, "account_id")
    wanted = first_per_key(wanted, ["account_id"], [F.col("_native")])
    winners = first_per_key(wanted, ["platform", "_native"], [F.col("account_id")])
    taken = accounts.filter("native_id is not null").select("platform", F.col("native_id").alias("_native"))
    free = winners.join(taken, ["platform", "_native"], "left_anti").select("account_id", "_native")
    joined = accounts.join(free, "account_id", "left")
    return joined.withColumn("native_id", F.coalesce("native_id", "_native")).select(*accounts.columns)


def close_memberships(memberships: DataFrame, closing: DataFrame, as_of: Column) -> DataFrame:
    """Set removed_at on live rows named by (artist_id, account_id)."""
    flagged = closing.select("artist_id", "account_id").distinct().withColumn("_close", F.lit(True))
    joined = memberships.join(flagged, ["artist_id", "account_id"], "left")
    removed = F.when(F.col("_close") & F.col("removed_at").isNull(), as_of).otherwise(F.col("removed_at"))
    return joined.withColumn("removed_at", removed).select(*memberships.columns)


def repair_downstream(
    memberships: DataFrame, events: DataFrame, reviews: DataFrame, retracted: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close memberships that retracted edges justified, log it, reject open questions about them."""
    ids = retracted.select("edge_id").distinct()
    adds = events.filter("event = 'account_added' and edge_id is not null")
    justified = adds.join(ids, "edge_id", "left_semi").select("artist_id", "account_id", "edge_id")
    live = memberships.filter("removed_at is null").select("artist_id", "account_id").distinct()
    closing = first_per_key(
        justified.join(live, ["artist_id", "account_id"], "left_semi"), ["artist_id", "account_id"], [F.col("edge_id")]
    )
    logged = closing.withColumns(
        {
            "event": F.lit("account_removed"),
            "actor": F.lit("pipeline"),
            "reason": F.lit("evidence_retracted"),
            "created_at": as_of,
        }
    )
    marked = reviews.join(ids.withColumn("_dead", F.lit(True)), "edge_id", "left")
    hit = F.col("_dead") & (F.col("status") == "pending")
    new_reviews = resolve_reviews(marked, hit, "rejected", "pipeline", as_of, "evidence retracted by re-extraction")
    return (
        close_memberships(memberships, closing, as_of),
        append(events, logged),
        new_reviews.select(*reviews.columns),
    )


def resolve_reviews(
    reviews: DataFrame, hit: Column, status: str, decided_by: str, as_of: Column, note: str | None = None
) -> DataFrame:
    """Close pending items where ``hit`` holds."""
    hit = F.coalesce(hit & (F.col("status") == "pending"), F.lit(False))
    out = reviews.withColumn("_hit", hit)
    changes = {
        "status": F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")),
        "resolved_at": F.when(F.col("_hit"), as_of).otherwise(F.col("resolved_at")),
        "decided_by": F.when(F.col("_hit"), F.lit(decided_by)).otherwise(F.col("decided_by")),
    }
    if note is not None:
        changes["resolution_note"] = F.when(F.col("_hit"), F.lit(note)).otherwise(F.col("resolution_note"))
    return out.withColumns(changes).drop("_hit")


def edge_claims(links: DataFrame, evidence: str | Column = "bio_link") -> DataFrame:
    """Claim and hint of link rows: a website is related, everything else says same person."""
    site = F.col("platform") == "website"
    kind = F.lit(evidence) if isinstance(evidence, str) else evidence
    return links.withColumns(
        {
            "evidence_type": kind,
            "claim": F.when(site, "related").otherwise("same_person"),
            "relation_hint": F.when(site, "website"),
        }
    )


def hub_claims(links: DataFrame, hub: list[str]) -> DataFrame:
    """Claims of a hub page: three or more links to one platform are credits, not identity."""
    per_platform = links.groupBy(*hub, "platform").agg(F.count("*").alias("_n"))
    keys = [*hub, "platform"]
    counted = lookup(links, per_platform, keys, hot=hot_of(per_platform, keys))
    site = F.col("platform") == "website"
    credits = F.col("_n") >= policy.HUB_CREDITS_MIN
    return counted.withColumns(
        {
            "evidence_type": F.lit("link_hub"),
            "claim": F.when(site | credits, "related").otherwise("same_person"),
            "relation_hint": F.when(site, "website").when(credits, "hub_credits"),
        }
    ).drop("_n")


def drop_mention_dumps(links: DataFrame, page: list[str], platform: str) -> DataFrame:
    """A page naming more than five other accounts of its own platform loses all of those links."""
    own = links.filter((F.col("platform") == platform) & F.col("handle").isNotNull())
    named = own.filter(F.lower("handle") != F.lower("own_handle")).select(*page, F.lower("handle").alias("_h")).distinct()
    dumps = named.groupBy(*page).count().filter(F.col("count") > policy.MAX_MENTIONS_PER_PAGE)
    marked = links.join(dumps.select(*page, F.lit(True).alias("_dump")), page, "left")
    return marked.filter(F.col("_dump").isNull() | (F.col("platform") != platform)).drop("_dump")


def emit_once(links: DataFrame, source: list[str]) -> DataFrame:
    """Links to oneself go, and of several links to one target the first by evidence order stays."""
    others = links.filter(~((F.col("platform") == F.col("own_platform")) & (F.lower("handle") == F.lower("own_handle"))
                            & F.col("handle").isNotNull() & F.col("own_handle").isNotNull()))
    target = F.coalesce(F.concat(F.lit("id:"), "native_id"), F.concat(F.lit("h:"), F.lower("handle")))
    keyed = others.withColumn("_target", target)
    return first_per_key(keyed, [*source, "platform", "_target"], [F.col("emit_order"), F.col("link_pos")]).drop("_target")


def commission_of(platform_value: Column, text_value: Column, stored: Column) -> Column:
    """Platform state beats text, text beats nothing, and nothing erases a known value."""
    return F.coalesce(platform_value, text_value, stored)
