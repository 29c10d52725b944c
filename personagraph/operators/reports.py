"""Review and report queries over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import patterns as P
from ..functions.scalars import normal_name, percent_of_max
from ..functions.similarity import name_score
from ..schemas import State
from . import evidence as ev
from .anomalies import present
from .directory import visible_members
from .search import member_accounts
from .spread import first_per_key, lookup, top_per_key


def _member_summary(state: State) -> DataFrame:
    """Per artist: most followers, platform list and leading avatar of its live members."""
    ranks = F.broadcast(policy.platforms(state.accounts.sparkSession).select("platform", "display_rank"))
    members = member_accounts(state).join(ranks, "platform")
    order = F.struct("display_rank", F.coalesce(-F.col("followers_count"), F.lit(1)), "account_id")
    return members.groupBy("artist_id").agg(
        F.max("followers_count").alias("followers"),
        F.array_join(F.array_sort(F.collect_set("platform")), ", ").alias("platforms"),
        F.min_by("avatar_url", F.when(F.col("avatar_url").isNotNull(), order)).alias("avatar_url"),
    )


def demoted(state: State) -> DataFrame:
    """Artists under review with the newest reason and bio."""
    down = state.events.filter("event = 'suppressed'")
    why = down.groupBy("artist_id").agg(
        F.max("created_at").alias("demoted_at"),
        F.max_by("reason", F.struct("created_at", F.coalesce("reason", F.lit("")))).alias("reason"),
    )
    # The newest snapshot of any member, its id breaking ties.
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    bios = state.snapshots.select("account_id", "bio_text", "captured_at", "snapshot_id").join(homes, "account_id")
    bios = bios.groupBy("artist_id").agg(F.max_by("bio_text", F.struct("captured_at", "snapshot_id")).alias("bio"))
    waiting = state.artists.filter("status = 'needs_review'").select("artist_id", "public_slug", "display_name")
    out = waiting.join(_member_summary(state), "artist_id", "left").join(why, "artist_id", "left")
    return out.join(bios, "artist_id", "left").orderBy(F.col("followers").desc_nulls_last(), "artist_id")


def suppressed_list(state: State) -> DataFrame:
    """In-force artist suppressions, newest first."""
    rows = ev.in_force(state.suppressions).filter("artist_id is not null").drop("account_id")
    names = state.artists.select("artist_id", "public_slug", "display_name")
    rows = rows.select("artist_id", "reason", "note", "created_at").join(names, "artist_id")
    return rows.orderBy(F.col("created_at").desc(), "artist_id")


def _homes(state: State) -> DataFrame:
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    return homes.join(state.artists.select("artist_id", "public_slug"), "artist_id", "left")


def suppressed_account_list(state: State) -> DataFrame:
    rows = ev.in_force(state.suppressions).filter("account_id is not null").select("account_id", "reason", "created_at")
    accounts = state.accounts.select("account_id", "platform", "handle", "display_name")
    return rows.join(accounts, "account_id").join(_homes(state), "account_id", "left").orderBy(
        F.col("created_at").desc(), "account_id"
    )


def hidden_list(state: State, size: int = policy.REMOVED_LIST_SIZE) -> DataFrame:
    """Hidden accounts that are not website leftovers, most followed first: the first page, of ``size`` rows."""
    rows = state.accounts.filter("status = 'hidden' and platform <> 'website'").select(
        "account_id", "platform", "handle", "display_name", "followers_count", "discovered_via"
    )
    return rows.join(_homes(state), "account_id", "left").orderBy(
        F.col("followers_count").desc_nulls_last(), "account_id"
    ).limit(size)


def invisible_accounts(state: State) -> DataFrame:
    """Accounts of active artists that have nothing to show and are not suppressed, one row each."""
    shown = visible_members(state).select("artist_id").distinct()
    active = state.artists.filter("status = 'active' and merged_into is null").select("artist_id", "public_slug")
    hidden = active.join(shown, "artist_id", "left_anti").join(
        ev.suppressed_artists(state.suppressions), "artist_id", "left_anti"
    )
    return member_accounts(state).select("artist_id", "account_id", "platform", "handle", "status").join(
        hidden, "artist_id"
    )


def source_report(accounts: DataFrame, memberships: DataFrame) -> DataFrame:
    """Accounts and artists per source and the share of the largest."""
    homes = ev.live(memberships).select("account_id", "artist_id")
    rows = accounts.select("account_id", F.col("discovered_via").alias("source")).join(homes, "account_id", "left")
    counts = rows.groupBy("source").agg(
        F.countDistinct("account_id").alias("accounts"), F.countDistinct("artist_id").alias("artists")
    )
    top = counts.agg(F.greatest(F.max("artists"), F.lit(1)).alias("_top"))
    return counts.join(F.broadcast(top)).select(
        "source", "accounts", "artists", percent_of_max(F.col("artists"), F.col("_top")).alias("pct")
    )


def breakdown(rows: DataFrame, group: str, label: str, shown: int = policy.BREAKDOWN_SHOWN) -> DataFrame:
    """Top labels per group and one row for the rest (its label is null, ``labels`` says how many)."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col(label).asc()]
    top = top_per_key(counts, [group], order, shown)
    rest = counts.join(top.select(group, label), [group, label], "left_anti")
    rest = rest.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
    return top.select(group, label, "n", F.lit(1).cast("bigint").alias("labels")).unionByName(
        rest.select(group, F.lit(None).cast("string").alias(label), "n", "labels")
    )


def rule_counters(state: State, usage: DataFrame) -> DataFrame:
    """One row of counters behind the rules page; one aggregate per table."""
    shown = F.col("status") == "present"
    related = shown & (F.col("claim") == "related")
    edges = state.edges.agg(
        F.count_if(shown & (F.col("claim") == "same_person")).alias("same_edges"),
        F.count_if(related & F.col("relation_hint").isin(policy.FLIP_HINTS)).alias("flipped"),
        F.count_if(related & (F.col("relation_hint") == "unreciprocated_prominent")).alias("flip_prominent"),
        F.count_if(related & (F.col("relation_hint") == "secondary_link")).alias("flip_secondary"),
    )
    healed = ["pipeline:anomaly_cleared", "pipeline:merged_away", "pipeline:threshold_raise"]
    reviews = state.reviews.agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("decided_by").isin(healed)).alias("anomalies_healed"),
    )
    accounts = state.accounts.agg(
        F.count_if((F.col("status") == "hidden") & (F.col("platform") == "website")).alias("junk_hidden"),
        F.count_if("project").alias("project_flagged"),
    )
    out = ev.in_force(state.suppressions).agg(F.countDistinct("artist_id").alias("suppressed"))
    spent = usage.filter("service = 'x_api'").agg(F.coalesce(F.sum("est_cost_cents"), F.lit(0)).alias("spent"))
    row = edges
    for other in (reviews, accounts, out, spent):
        row = row.join(F.broadcast(other))
    return row


# --- artist detail ---


def signals(state: State) -> DataFrame:
    """Active statements and flags of live members in one list."""
    statements = state.attestations.filter("active").select(
        "account_id", F.lit("attestation").alias("kind"), "signal", "matched_text", "first_seen", "last_seen"
    )
    flags = state.flags.filter("active").select(
        "account_id", F.lit("content_flag").alias("kind"), "signal", "matched_text", "first_seen", "last_seen"
    )
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    return statements.unionByName(flags).join(homes, "account_id")


def connections(state: State) -> DataFrame:
    """Every artist's outside accounts, one row per account, same-person edges before related ones."""
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    ends = ev.endpoints(present(state.edges), "edge_id", "claim", "relation_hint")
    mine = lookup(ends, homes, ["account_id"]).select("artist_id", "edge_id", "claim", "relation_hint", "direction", "other_id")
    inside = homes.select("artist_id", F.col("account_id").alias("other_id"))
    outside = mine.join(inside, ["artist_id", "other_id"], "left_anti")
    others = state.accounts.filter("not coalesce(project, false)").select(
        F.col("account_id").alias("other_id"),
        F.col("handle").alias("other_handle"),
        F.col("display_name").alias("other_name"),
        F.col("followers_count").alias("other_followers"),
    )
    one = first_per_key(outside, ["artist_id", "other_id"], [F.col("claim").desc(), F.col("edge_id")])
    unmerged = state.artists.filter("merged_into is null").select("artist_id")
    theirs = homes.join(unmerged, "artist_id", "left_semi").select(
        F.col("account_id").alias("other_id"), F.col("artist_id").alias("other_artist")
    )
    return lookup(one, others, ["other_id"]).join(theirs, "other_id", "left")


def names_of(accounts: DataFrame, id_column: str, out: str) -> DataFrame:
    """Distinct normalized handle and name per account."""
    both = F.array(normal_name(F.col("handle")), normal_name(F.col("display_name")))
    return accounts.select(F.col("account_id").alias(id_column), F.explode(both).alias(out)).filter(
        F.col(out) != ""
    ).distinct()


def tiered_connections(state: State) -> DataFrame:
    """Connections with the best name similarity to any member name, and their tier.

    Equal names are found by a join; only the rest is compared, member names against one account's two.
    """
    rows = connections(state)
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    member_names = names_of(state.accounts, "account_id", "member_name").join(homes, "account_id")
    member_names = member_names.select("artist_id", "member_name").distinct()
    other_names = names_of(state.accounts, "other_id", "other_name_norm")
    named = rows.select("artist_id", "other_id").join(other_names, "other_id")
    equal = named.join(
        member_names, (named["artist_id"] == member_names["artist_id"]) & (F.col("other_name_norm") == F.col("member_name")),
        "left_semi",
    ).select("artist_id", "other_id").distinct()
    rest = named.join(equal, ["artist_id", "other_id"], "left_anti").join(member_names, "artist_id")
    # The same two names meet often; each distinct pair is compared once.
    pairs = rest.select("other_name_norm", "member_name").distinct()
    scored = pairs.withColumn("score", name_score(F.col("other_name_norm"), F.col("member_name")))
    best = rest.join(scored, ["other_name_norm", "member_name"]).groupBy("artist_id", "other_id").agg(
        F.max("score").alias("name_score")
    )
    best = best.unionByName(equal.withColumn("name_score", F.lit(1.0)))
    out = rows.join(best, ["artist_id", "other_id"], "left").withColumn("name_score", F.coalesce("name_score", F.lit(0.0)))
    return out.withColumn("tier", connection_tier())


def connection_tier() -> Column:
    low = F.coalesce(F.col("relation_hint").isin(policy.LOW_SIGNAL_HINTS), F.lit(False))
    return (
        F.when(F.col("name_score") >= policy.NAME_MATCH_MIN, 0)
        .when(F.col("claim") == "same_person", 1)
        .when(~low, 2)
        .otherwise(3)
    )


def connection_order() -> list[Column]:
    return [F.col("tier"), F.col("name_score").desc(), F.coalesce("other_followers", F.lit(0)).desc(), F.col("other_id")]


def pending_for_artists(state: State) -> DataFrame:
    """Open questions per artist they are about: named artists, and gates on member accounts."""
    open_items = state.reviews.filter("status = 'pending'")
    named = open_items.filter("kind in ('other', 'cluster_merge')").select(
        "item_id", "kind", F.explode(F.array("artist_id", "other_artist_id")).alias("artist_id")
    )
    named = named.filter("artist_id is not null")
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    gates = open_items.filter("kind = 'singleton_gate'").select("item_id", "kind", "account_id").join(homes, "account_id")
    return named.unionByName(gates.select("item_id", "kind", "artist_id")).distinct()


def merge_evidence(state: State, pairs: DataFrame, shown: int = policy.MERGE_EVIDENCE_SHOWN) -> DataFrame:
    """Up to eight present edges across each artist pair (low, high), two-way ones first."""
    from .clustering import artist_claims

    edges = present(state.edges)
    from .components import mutual_pairs

    mutual = mutual_pairs(edges).withColumn("mutual", F.lit(True))
    across = artist_claims(edges, state.memberships).withColumns(
        {"low": F.least("from_artist", "to_artist"), "high": F.greatest("from_artist", "to_artist")}
    )
    across = across.join(pairs.select("low", "high").distinct(), ["low", "high"], "left_semi")
    src, tgt = F.col("source_account_id"), F.col("target_account_id")
    keyed = across.withColumns({"_a": F.least(src, tgt), "_b": F.greatest(src, tgt)})
    two_way = mutual.select(F.col("low").alias("_a"), F.col("high").alias("_b"), "mutual")
    marked = keyed.join(two_way, ["_a", "_b"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))
    return top_per_key(marked.drop("_a", "_b"), ["low", "high"], [F.col("mutual").desc(), F.col("edge_id")], shown, "shown")


def review_queue(state: State) -> DataFrame:
    """Open items with the account, edge and artists they are about, from one join each."""
    items = state.reviews.filter("status = 'pending'").select(
        "item_id", "kind", "reason", "artist_id", "other_artist_id", "account_id", "edge_id", "created_at"
    )
    accounts = state.accounts.select("account_id", "platform", "handle", "followers_count")
    edges = state.edges.select("edge_id", "evidence_type", "matched_text", "evidence_url")
    slugs = state.artists.select("artist_id", "public_slug")
    others = slugs.select(F.col("artist_id").alias("other_artist_id"), F.col("public_slug").alias("other_slug"))
    bios = ev.latest_bios(state.snapshots)
    out = items.join(accounts, "account_id", "left").join(edges, "edge_id", "left")
    out = out.join(bios, "account_id", "left").join(slugs, "artist_id", "left").join(others, "other_artist_id", "left")
    return out


# --- handle states ---

STATE_RANK = {"listed": 5, "tagged": 4, "queued": 3, "tracked": 2, "removed": 1, "untracked": 0}


def check_request(raw: DataFrame, limit: int = policy.MAX_HANDLES_PER_REQUEST) -> None:
    """A request of too many handles is an error, never a cut; for callers that answer outside requests."""
    if raw.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} handles in one request")


def clean_handles(raw: DataFrame, column: str = "handle") -> DataFrame:
    """Requested handles: trimmed, without @, lower case, valid, each once."""
    low = F.lower(F.ltrim(F.trim(F.col(column)), F.lit("@")))
    return raw.select(low.alias("handle")).filter(F.col("handle").rlike(P.X_HANDLE)).distinct()


def handle_states(requested: DataFrame, state: State) -> DataFrame:
    """Directory state of each requested X handle; of several matching accounts the strongest counts."""
    listed = visible_members(state).select("artist_id", F.lit(True).alias("_listed")).distinct()
    barred_accounts = ev.suppressed_accounts(state.suppressions).withColumn("_barred", F.lit(True))
    barred_artists = ev.suppressed_artists(state.suppressions).withColumn("_barred_artist", F.lit(True))
    unmerged = state.artists.filter("merged_into is null").select(
        "artist_id", "public_slug", F.col("status").alias("artist_status")
    )
    homes = ev.live(state.memberships).select("account_id", "artist_id").join(unmerged, "artist_id")
    rows = state.accounts.filter("platform = 'twitter'").select(
        F.lower("handle").alias("handle"), "account_id", "status", "discovered_via", "project",
        F.col("last_hydrated").isNotNull().alias("hydrated"),
    )
    rows = rows.join(requested.select("handle").distinct(), "handle", "left_semi").join(homes, "account_id", "left")
    rows = rows.join(listed, "artist_id", "left").join(barred_accounts, "account_id", "left")
    rows = rows.join(barred_artists, "artist_id", "left")
    tag = F.col("discovered_via") == "manual_tag"
    barred = F.col("_barred").isNotNull() | F.col("_barred_artist").isNotNull()
    artist_detail = F.concat(F.lit("artist "), F.col("artist_status"))
    cases = [
        (barred, "removed", F.lit("suppressed")),
        (F.col("status") == "hidden", "removed", F.lit("hidden (culled)")),
        (F.col("status") == "deleted", "removed", F.lit("deleted on X")),
        (tag & ~F.col("hydrated"), "queued", F.lit(None).cast("string")),
        (F.col("_listed").isNotNull(), "listed", F.lit(None).cast("string")),
        (tag, "tagged", F.coalesce(artist_detail, F.lit("awaiting cluster run"))),
        (F.col("artist_id").isNotNull(), "tracked", artist_detail),
    ]
    last = F.when(F.col("project"), F.lit("project account")).otherwise(F.col("discovered_via"))
    verdict = F.struct(F.lit("tracked").alias("state"), last.alias("detail"))
    for test, name, detail in reversed(cases):
        verdict = F.when(test, F.struct(F.lit(name).alias("state"), detail.alias("detail"))).otherwise(verdict)
    judged = rows.withColumn("v", verdict)
    rank = F.lit(0)
    for name, value in STATE_RANK.items():
        rank = F.when(F.col("v.state") == name, value).otherwise(rank)
    best = judged.groupBy("handle").agg(
        F.max_by(F.struct("v.state", "v.detail", "artist_id", "public_slug"), F.struct(rank, -F.col("account_id"))).alias("b")
    )
    return requested.select("handle").distinct().join(best, "handle", "left").select(
        "handle",
        F.coalesce("b.state", F.lit("untracked")).alias("state"),
        "b.detail",
        "b.artist_id",
        "b.public_slug",
    )


def tag_queue(accounts: DataFrame) -> DataFrame:
    return accounts.filter(
        "platform = 'twitter' and discovered_via = 'manual_tag' and last_hydrated is null "
        "and native_id is null and status = 'unknown'"
    )


def tag_queue_cost(accounts: DataFrame, usage: DataFrame, cap_cents: int = policy.DEFAULT_CAP_CENTS) -> DataFrame:
    queued = tag_queue(accounts).agg(F.count("*").alias("queued"))
    spent = usage.filter("service = 'x_api'").agg(F.coalesce(F.sum("est_cost_cents"), F.lit(0)).alias("spent_cents"))
    return queued.join(F.broadcast(spent)).select(
        "queued",
        F.floor(F.col("queued") * policy.USER_READ_CENTS).cast("bigint").alias("est_cents"),
        "spent_cents",
        F.lit(cap_cents).alias("cap_cents"),
    )


def tag_dashboard(state: State, which: str = "", text: str = "", number: int = 1) -> DataFrame:
    """Hand-tagged accounts in one state, newest first, a hundred per page."""
    listed = visible_members(state).select("artist_id", F.lit(True).alias("listed")).distinct()
    unmerged = state.artists.filter("merged_into is null").select("artist_id", "public_slug")
    homes = ev.live(state.memberships).select("account_id", "artist_id").join(unmerged, "artist_id")
    rows = state.accounts.filter("platform = 'twitter' and discovered_via = 'manual_tag'").select(
        "account_id", "handle", "display_name", "followers_count", "last_hydrated", "status"
    )
    rows = rows.join(homes, "account_id", "left").join(listed, "artist_id", "left")
    rows = rows.withColumn("listed", F.coalesce("listed", F.lit(False)))
    gone = F.col("status").isin("hidden", "deleted")
    tests = {
        "queued": F.col("last_hydrated").isNull() & (F.col("status") == "unknown"),
        "listed": F.col("listed"),
        "hydrated": F.col("last_hydrated").isNotNull() & ~F.col("listed") & ~gone,
        "removed": gone,
    }
    if which in tests:
        rows = rows.filter(tests[which])
    if text:
        low = text.lower()
        rows = rows.filter(F.contains(F.lower("handle"), F.lit(low)) | F.contains(F.lower("display_name"), F.lit(low)))
    size = policy.TAG_PAGE_SIZE
    return rows.orderBy(F.col("account_id").desc()).offset((max(1, number) - 1) * size).limit(size)


def tag_counts(state: State) -> DataFrame:
    """Distinct counts over hand-tagged accounts; membership history must not count anyone twice."""
    rows = state.accounts.filter("platform = 'twitter' and discovered_via = 'manual_tag'").join(
        ev.live(state.memberships).select("account_id", "artist_id"), "account_id", "left"
    )
    gone = F.col("status").isin("hidden", "deleted")

    def distinct(test: Column) -> Column:
        return F.countDistinct(F.when(test, F.col("account_id")))

    return rows.agg(
        F.countDistinct("account_id").alias("tagged"),
        distinct(F.col("last_hydrated").isNull() & (F.col("status") == "unknown")).alias("queued"),
        distinct(F.col("last_hydrated").isNotNull() & ~gone).alias("hydrated"),
        F.countDistinct("artist_id").alias("artists"),
        distinct(gone).alias("removed"),
    )


def link_check_queue(state: State, as_of: Column, recheck_days: int = 30, limit: int = 300,
                     never: list[str] | None = None) -> DataFrame:
    """Profiles to probe: listed ones first, never checked before oldest."""
    due = F.col("link_checked_at").isNull() | (F.col("link_checked_at") < as_of - F.expr(f"interval {recheck_days} days"))
    rows = state.accounts.filter((F.col("status") != "deleted") & F.col("profile_url").isNotNull() & due)
    rows = rows.filter(~F.col("platform").isin(policy.NEVER_PROBED if never is None else never))
    active = state.artists.filter("status = 'active'").select("artist_id")
    member = ev.live(state.memberships).join(active, "artist_id", "left_semi").select("account_id").distinct()
    rows = rows.join(member.withColumn("listed", F.lit(True)), "account_id", "left")
    rows = rows.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return rows.select("account_id", "platform", "profile_url", "listed", "link_checked_at").orderBy(
        F.col("listed").desc(), F.col("link_checked_at").asc_nulls_first(), "account_id"
    ).limit(limit)


def hydration_queue(accounts: DataFrame, platform: str, limit: int) -> DataFrame:
    """Never hydrated first, then the longest ago."""
    rows = accounts.filter((F.col("platform") == platform) & (F.col("status") != "deleted"))
    return rows.orderBy(F.col("last_hydrated").asc_nulls_first(), "account_id").limit(limit)
