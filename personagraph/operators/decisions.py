"""Recorded human decisions applied as one batch; automation never overrides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.links import with_platform_links, with_website_links
from ..schemas import State
from ..session import cut_lineage
from . import evidence as ev
from .clustering import answer_merges, create_artists, log_events, merge_artists, set_edges, settle
from .components import components
from .reports import clean_handles, handle_states
from .spread import first_per_key
from .upsert import append, close_memberships, resolve_reviews, upsert_accounts

ACTOR = "admin:review"


def of_kind(decisions: DataFrame, *kinds: str) -> DataFrame:
    return decisions.filter(F.col("kind").isin(*kinds))


def connecting_edges(state: State, pairs: DataFrame) -> DataFrame:
    """(edge_id, artist_id, account_id) of edges between an account and members of an artist."""
    ends = ev.endpoints(state.edges, "edge_id")
    named = ends.join(pairs.select("artist_id", "account_id").distinct(), "account_id")
    homes = ev.live(state.memberships).select(F.col("account_id").alias("other_id"), "artist_id")
    return named.join(homes, ["artist_id", "other_id"], "left_semi").select("edge_id", "artist_id", "account_id").distinct()


def _with_claim(state: State, edges: DataFrame, claim: str) -> DataFrame:
    held = state.edges.filter((F.col("claim") == claim) & (F.col("status") == "present")).select("edge_id")
    return edges.select("edge_id").distinct().join(held, "edge_id", "left_semi")


def detach(state: State, decisions: DataFrame, as_of: Column) -> State:
    """Close the membership, log it, and keep the account visible as a connection."""
    pairs = cut_lineage(decisions.select("artist_id", "account_id").distinct())
    closed = state.with_(memberships=close_memberships(state.memberships, pairs, as_of))
    wires = _with_claim(closed, connecting_edges(closed, pairs), "same_person").withColumns(
        {"claim": F.lit("related"), "relation_hint": F.lit("manual_detach")}
    )
    return closed.with_(
        events=log_events(state.events, pairs, "account_removed", ACTOR, as_of, reason="manual_detach"),
        edges=set_edges(state.edges, wires),
    )


def confirm(state: State, decisions: DataFrame, as_of: Column) -> State:
    """A connection is the same person: merge the other artist in, or attach the free account."""
    pairs = decisions.select("artist_id", "account_id").distinct()
    homes = ev.live(state.memberships).select("account_id", F.col("artist_id").alias("other_artist"))
    pairs = cut_lineage(pairs.join(homes, "account_id", "left"))
    merging = pairs.filter("other_artist is not null and other_artist <> artist_id")
    # All artists that a batch links are one; of those that nobody takes in the smallest keeps, in a cycle the smallest.
    merging = cut_lineage(merging.select("artist_id", "other_artist").distinct())
    taken = merging.select(F.col("other_artist").alias("node"), F.lit(True).alias("_taken")).distinct()
    parts = components(merging, "artist_id", "other_artist").join(taken, "node", "left")
    keepers = parts.groupBy("component").agg(F.min(F.struct(F.col("_taken").isNotNull().alias("t"), "node")).alias("k"))
    mapping = parts.join(keepers, "component").select(F.col("node").alias("loser"), F.col("k.node").alias("keeper"))
    mapping = cut_lineage(mapping.filter("loser <> keeper"))
    state = merge_artists(state, mapping, ACTOR, as_of)
    pair = [F.least("artist_id", "other_artist").alias("low"), F.greatest("artist_id", "other_artist").alias("high")]
    state = state.with_(reviews=answer_merges(state.reviews, merging.select(*pair), ACTOR, as_of))
    free = first_per_key(pairs.filter("other_artist is null"), ["account_id"], [F.col("artist_id")])
    # An artist that has just been merged hands its new account on.
    into = mapping.select(F.col("loser").alias("artist_id"), "keeper")
    free = free.join(into, "artist_id", "left").withColumn("artist_id", F.coalesce("keeper", "artist_id"))
    state = _attach(state, free, "manual_confirm_connection", as_of)
    wires = _with_claim(state, connecting_edges(state, pairs), "related").withColumns(
        {"claim": F.lit("same_person"), "relation_hint": F.lit("manual_confirm")}
    )
    return state.with_(edges=set_edges(state.edges, wires))


def _attach(state: State, rows: DataFrame, reason: str, as_of: Column) -> State:
    rows = cut_lineage(rows.select("artist_id", "account_id"))
    added = rows.withColumns({"confidence": F.lit("strong"), "added_by": F.lit("human"), "added_at": as_of})
    return state.with_(
        memberships=append(state.memberships, added),
        events=log_events(state.events, rows, "account_added", ACTOR, as_of, reason=reason),
    )


def dismiss(state: State, decisions: DataFrame, as_of: Column) -> State:
    """The connection is noise: its edges are dismissed for good and the account never attaches again."""
    pairs = cut_lineage(decisions.select("artist_id", "account_id").distinct())
    wires = connecting_edges(state, pairs).select("edge_id", F.lit(True).alias("_dismiss")).distinct()
    marked = state.edges.join(wires, "edge_id", "left")
    hit = F.col("_dismiss") & (F.col("status") == "present")
    edges = marked.withColumns(
        {
            "relation_hint": F.when(hit, F.lit("manual_dismiss")).otherwise(F.col("relation_hint")),
            "status": F.when(hit, F.lit("dismissed")).otherwise(F.col("status")),
        }
    ).select(*state.edges.columns)
    events = log_events(state.events, pairs, "account_removed", ACTOR, as_of, reason="connection_dismissed")
    return state.with_(edges=edges, events=events)


def add_account(state: State, decisions: DataFrame, as_of: Column) -> State:
    """Attach the account a pasted address names, unless another artist already holds it."""
    parsed = with_website_links(with_platform_links(decisions, "payload"), "payload")
    first = F.coalesce(F.get("platform_links", F.lit(0)), F.get("website_links", F.lit(0)))
    links = cut_lineage(parsed.select("decision_id", "artist_id", first.alias("_l"))).filter("_l is not null")
    refs = links.select(
        F.col("decision_id").alias("seq"),
        "artist_id",
        "_l.platform",
        "_l.native_id",
        F.coalesce("_l.handle", "_l.native_id").alias("handle"),
        F.col("_l.url").alias("profile_url"),
        F.lit(None).cast("string").alias("display_name"),
        F.lit("unknown").alias("status"),
        F.lit(None).cast("bigint").alias("followers_count"),
        F.lit(None).cast("timestamp").alias("last_post_at"),
        F.lit("manual").alias("discovered_via"),
        F.lit(None).cast("map<string,string>").alias("discovery_details"),
        F.lit(False).alias("hydrated"),
    )
    accounts, resolved = upsert_accounts(state.accounts, refs, as_of)
    state = state.with_(accounts=cut_lineage(accounts))
    wanted = first_per_key(resolved.select("artist_id", "account_id", "seq"), ["account_id"], [F.col("seq")])
    taken = ev.live(state.memberships).select("account_id")
    return _attach(state, wanted.join(taken, "account_id", "left_anti"), "manual_add", as_of)


def suppress(state: State, decisions: DataFrame, as_of: Column) -> State:
    """Put artists out of the directory; the reason is the decision's payload."""
    rows = decisions.select("artist_id", F.col("payload").alias("reason")).distinct()
    held = ev.in_force(state.suppressions).filter("artist_id is not null").select("artist_id", "reason").distinct()
    fresh = cut_lineage(rows.join(held, ["artist_id", "reason"], "left_anti"))
    made = fresh.withColumns({"requested_by": F.lit(ACTOR), "created_at": as_of})
    events = log_events(state.events, fresh, "suppressed", ACTOR, as_of)
    return state.with_(suppressions=append(state.suppressions, made), events=events)


def unsuppress(state: State, decisions: DataFrame, as_of: Column) -> State:
    named = decisions.select("artist_id").distinct().withColumn("_lift", F.lit(True))
    joined = state.suppressions.join(named, "artist_id", "left")
    lifted = F.when(F.col("_lift") & F.col("lifted_at").isNull(), as_of).otherwise(F.col("lifted_at"))
    rows = joined.withColumn("lifted_at", lifted).select(*state.suppressions.columns)
    return state.with_(
        suppressions=rows, events=log_events(state.events, named.select("artist_id"), "unsuppressed", ACTOR, as_of)
    )


def restore(state: State, decisions: DataFrame, as_of: Column) -> State:
    """Bring demoted artists back."""
    named = decisions.select("artist_id").distinct().withColumn("_back", F.lit(True))
    joined = state.artists.join(named, "artist_id", "left")
    artists = joined.withColumns(
        {
            "status": F.when(F.col("_back"), F.lit("active")).otherwise(F.col("status")),
            "updated_at": F.when(F.col("_back"), as_of).otherwise(F.col("updated_at")),
        }
    ).select(*state.artists.columns)
    events = log_events(
        state.events, named.select("artist_id"), "unsuppressed", ACTOR, as_of, reason="restored_from_demotion"
    )
    return state.with_(artists=artists, events=events)


def unhide(state: State, decisions: DataFrame) -> State:
    named = decisions.select("account_id").distinct().withColumn("_show", F.lit(True))
    joined = state.accounts.join(named, "account_id", "left")
    shown = F.when(F.col("_show") & (F.col("status") == "hidden"), F.lit("active")).otherwise(F.col("status"))
    return state.with_(accounts=joined.withColumn("status", shown).select(*state.accounts.columns))


def decide(state: State, decisions: DataFrame, as_of: Column) -> State:
    """Approve or reject pending items (kind approve / reject, item_id); the last word per item counts."""
    last = first_per_key(of_kind(decisions, "approve", "reject"), ["item_id"], [F.col("decision_id").desc()])
    verdicts = last.select("item_id", F.col("kind").alias("verdict"))
    items = cut_lineage(state.reviews.filter("status = 'pending'").join(verdicts, "item_id"))
    approved = items.filter("verdict = 'approve'")

    attach = approved.filter("kind = 'one_directional_attach'").select("artist_id", "account_id", "edge_id")
    taken = ev.live(state.memberships).select("account_id")
    attach = first_per_key(attach.join(taken, "account_id", "left_anti"), ["account_id"], [F.col("artist_id")])
    state = _attach(state, attach, "approved", as_of)

    gates = approved.filter("kind = 'singleton_gate'").select("account_id").distinct()
    anchors = state.accounts.join(gates, "account_id", "left_semi")
    anchors = anchors.join(ev.live(state.memberships).select("account_id"), "account_id", "left_anti")
    state = create_artists(state, anchors, ACTOR, as_of)

    # All live artists of an approved merge fold into the smallest of them.
    named = approved.filter("kind = 'cluster_merge'").select(
        "item_id", F.explode(F.transform(F.split("review_key", ","), lambda x: x.cast("bigint"))).alias("artist_id")
    )
    alive = named.join(state.artists.filter("merged_into is null").select("artist_id"), "artist_id", "left_semi")
    keepers = alive.groupBy("item_id").agg(F.min("artist_id").alias("keeper"))
    mapping = alive.join(keepers, "item_id").filter("artist_id <> keeper")
    mapping = first_per_key(mapping.select(F.col("artist_id").alias("loser"), "keeper"), ["loser"], [F.col("keeper")])
    state = merge_artists(state, cut_lineage(mapping), ACTOR, as_of)

    marked = state.reviews.join(verdicts, "item_id", "left")
    yes = resolve_reviews(marked, F.col("verdict") == "approve", "approved", ACTOR, as_of)
    both = resolve_reviews(yes, F.col("verdict") == "reject", "rejected", ACTOR, as_of)
    return state.with_(reviews=both.select(*state.reviews.columns))


def tag(state: State, handles: DataFrame, as_of: Column) -> State:
    """Hand-tag X handles: new ones queue, incidental finds are promoted, hidden or deleted ones return."""
    states = cut_lineage(handle_states(handles, state))
    idle = F.col("state").isin("listed", "queued", "tagged")
    barred = (F.col("state") == "removed") & (F.col("detail") == "suppressed")
    due = cut_lineage(states.filter(~idle & ~F.coalesce(barred, F.lit(False))).select("handle"))
    refs = due.select(
        F.col("handle").alias("seq"),
        F.lit("twitter").alias("platform"),
        F.lit(None).cast("string").alias("native_id"),
        "handle",
        F.lit(None).cast("string").alias("display_name"),
        F.concat(F.lit("https://x.com/"), "handle").alias("profile_url"),
        F.lit("unknown").alias("status"),
        F.lit(None).cast("bigint").alias("followers_count"),
        F.lit(None).cast("timestamp").alias("last_post_at"),
        F.lit("manual_tag").alias("discovered_via"),
        F.create_map(F.lit("source"), F.lit("tag")).alias("discovery_details"),
        F.lit(False).alias("hydrated"),
    )
    accounts, resolved = upsert_accounts(state.accounts, refs, as_of)
    named = resolved.select("account_id", F.lit(True).alias("_tag")).distinct()
    joined = accounts.join(named, "account_id", "left")
    hit = F.col("_tag").isNotNull()
    back = F.when(F.col("last_hydrated").isNull(), F.lit("unknown")).otherwise(F.lit("active"))
    tagged = joined.withColumns(
        {
            "discovered_via": F.when(
                hit & F.col("discovered_via").isin(policy.INCIDENTAL_SOURCES), F.lit("manual_tag")
            ).otherwise(F.col("discovered_via")),
            "status": F.when(hit & F.col("status").isin("hidden", "deleted"), back).otherwise(F.col("status")),
        }
    )
    return state.with_(accounts=tagged.select(*state.accounts.columns))


def untag(state: State, handles: DataFrame, as_of: Column) -> State:
    """Take X handles out: listed artists are suppressed, bare tags vanish, the rest is hidden."""
    states = cut_lineage(handle_states(handles, state))
    listed = states.filter("state = 'listed'").select("artist_id").distinct()
    made = listed.withColumns(
        {"reason": F.lit("other"), "note": F.lit("tag removal"), "requested_by": F.lit("admin:tag"), "created_at": as_of}
    )
    events = log_events(state.events, listed, "suppressed", "admin:tag", as_of, reason="tag removal")
    going = states.filter(F.col("state").isin("queued", "tracked", "tagged")).select("handle")
    mine = state.accounts.filter("platform = 'twitter'").select(
        "account_id", "discovered_via", F.lower("handle").alias("handle")
    ).join(going, "handle", "left_semi")
    bare = mine.filter("discovered_via = 'manual_tag'").select("account_id", "handle")
    ends = ev.endpoints(state.edges).select("account_id").distinct()
    for used in (state.snapshots, ends, state.memberships):
        bare = bare.join(used.select("account_id").distinct(), "account_id", "left_anti")
    bare = cut_lineage(bare)
    hide = mine.join(bare.select("handle").distinct(), "handle", "left_anti").select("account_id", F.lit(True).alias("_hide"))
    kept = state.accounts.join(bare.select("account_id"), "account_id", "left_anti").join(hide, "account_id", "left")
    status = F.when(F.col("_hide") & (F.col("status") != "deleted"), F.lit("hidden")).otherwise(F.col("status"))
    return state.with_(
        suppressions=append(state.suppressions, made),
        events=events,
        accounts=kept.withColumn("status", status).select(*state.accounts.columns),
    )


def apply_decisions(state: State, decisions: DataFrame, as_of: Column) -> State:
    """All recorded decisions of one batch, kind by kind; kinds nobody decided are skipped."""
    present = {row["kind"] for row in decisions.select("kind").distinct().collect()}
    steps = [
        ({"detach"}, lambda s, d: detach(s, d, as_of)),
        ({"dismiss"}, lambda s, d: dismiss(s, d, as_of)),
        ({"confirm"}, lambda s, d: confirm(s, d, as_of)),
        ({"add_account"}, lambda s, d: add_account(s, d, as_of)),
        ({"suppress"}, lambda s, d: suppress(s, d, as_of)),
        ({"unsuppress"}, lambda s, d: unsuppress(s, d, as_of)),
        ({"restore"}, lambda s, d: restore(s, d, as_of)),
        ({"unhide"}, lambda s, d: unhide(s, d)),
        ({"approve", "reject"}, lambda s, d: decide(s, d, as_of)),
        ({"tag"}, lambda s, d: tag(s, clean_handles(d, "payload"), as_of)),
        ({"untag"}, lambda s, d: untag(s, clean_handles(d, "payload"), as_of)),
    ]
    for kinds, step in steps:
        if kinds & present:
            state = settle(step(state, of_kind(decisions, *kinds)))
    return state
