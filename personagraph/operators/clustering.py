"""From evidence edges to artists: components, guarded attachment, merging and healing.

Every stage maps one version of the state to the next. Where several edges compete for a slot the order
is fixed: verified links, then stated alternate accounts, then the rest, by edge id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions.scalars import slugify
from ..schemas import State
from ..session import cut_added, cut_lineage, each_apart, is_cut
from . import evidence as ev
from .components import components, mutual_pairs, resolve_chains
from .spread import first_per_key, hot_keys, lookup, running, top_per_key
from .upsert import append, close_memberships, next_ids, resolve_reviews

PIPELINE = "pipeline"


# --- logging and membership changes ---


def log_events(events: DataFrame, rows: DataFrame, event: str, actor: str, as_of: Column, **fixed) -> DataFrame:
    stamped = rows.withColumns({"event": F.lit(event), "actor": F.lit(actor), "created_at": as_of})
    for name, value in fixed.items():
        stamped = stamped.withColumn(name, F.lit(value))
    return append(events, stamped)


def add_members(state: State, adds: DataFrame, actor: str, as_of: Column) -> State:
    """Attach accounts to artists (artist_id, account_id, confidence, reason, edge_id).

    An account that is a live member anywhere stays where it is, and a pair a person closed stays closed.
    """
    if actor == PIPELINE:
        adds = adds.join(ev.human_closed(state.events), ["artist_id", "account_id"], "left_anti")
    taken = ev.live(state.memberships).select("account_id")
    adds = adds.join(taken, "account_id", "left_anti")
    adds = cut_lineage(first_per_key(adds, ["account_id"], [F.col("artist_id"), F.col("edge_id").asc_nulls_first()]))
    by = "clustering" if actor == PIPELINE else "human"
    rows = adds.withColumns({"added_by": F.lit(by), "added_at": as_of})
    return state.with_(
        memberships=append(state.memberships, rows),
        events=log_events(state.events, adds, "account_added", actor, as_of),
    )


def remove_members(state: State, closing: DataFrame, reason: str, actor: str, as_of: Column) -> State:
    """Close live memberships (artist_id, account_id[, edge_id]) and log each."""
    open_rows = ev.live(state.memberships).select("artist_id", "account_id").distinct()
    closing = cut_lineage(closing.distinct().join(open_rows, ["artist_id", "account_id"], "left_semi"))
    return state.with_(
        memberships=close_memberships(state.memberships, closing, as_of),
        events=log_events(state.events, closing, "account_removed", actor, as_of, reason=reason),
    )


def set_edges(edges: DataFrame, changes: DataFrame, only_claim: str | None = None) -> DataFrame:
    """Apply (edge_id, claim, relation_hint) to edges, optionally only where the claim still is a given one."""
    new = changes.select("edge_id", F.struct("claim", "relation_hint").alias("_c"))
    joined = edges.join(new, "edge_id", "left")
    hit = F.col("_c").isNotNull()
    if only_claim:
        hit = hit & (F.col("claim") == only_claim)
    return joined.withColumns(
        {
            "claim": F.when(hit, F.col("_c")["claim"]).otherwise(F.col("claim")),
            "relation_hint": F.when(hit, F.col("_c")["relation_hint"]).otherwise(F.col("relation_hint")),
        }
    ).select(*edges.columns)


def add_reviews(reviews: DataFrame, items: DataFrame, as_of: Column, match: list[str] | None = None) -> DataFrame:
    """New questions (kind, review_key, ...); one that was ever asked is not asked again."""
    match = match or ["kind", "review_key"]
    asked = reviews.select(*match).distinct()
    order = [F.col("edge_id").asc_nulls_first()] if "edge_id" in items.columns else [F.lit(0)]
    fresh = first_per_key(items, match, order).join(asked, match, "left_anti")
    fresh = fresh.withColumns({"status": F.lit("pending"), "created_at": as_of})
    return append(reviews, next_ids(fresh, reviews, "item_id", [F.col("kind"), F.col("review_key")]))


# --- artists ---


def unique_slugs(rows: DataFrame, taken: DataFrame, order: str = "account_id") -> DataFrame:
    """Give every row with a ``base`` its own ``public_slug``: base, base-2, base-3 and so on.

    The k-th new row of a base gets the k-th number that is free. A number n is taken when base-n is
    stored (the bare base counts as 1). Candidates that meet a name of another base are dealt again.
    """
    done = None
    todo = rows
    while True:
        numbered = taken.select(F.col("public_slug").alias("s")).distinct()
        plain = numbered.select(F.col("s").alias("base"), F.lit(1).cast("bigint").alias("n"))
        suffix = numbered.filter(F.col("s").rlike("^.+-([2-9]|[1-9][0-9]{1,17})$")).select(
            F.regexp_extract("s", "^(.+)-([0-9]+)$", 1).alias("base"),
            F.regexp_extract("s", "^(.+)-([0-9]+)$", 2).cast("bigint").alias("n"),
        )
        bases = todo.select("base").distinct()
        used = plain.unionByName(suffix).join(bases, "base", "left_semi")
        # Free numbers below a taken number n that is j-th in order: n - j.
        used = running(used, ["base"], [F.col("n")], {}, position="j").select(
            "base", (F.col("n") - F.col("j")).alias("v"), F.lit(0).cast("bigint").alias(order), F.lit(1).alias("held")
        )
        asked = running(todo.select("base", order), ["base"], [F.col(order)], {}, position="k").select(
            "base", F.col("k").alias("v"), order, F.lit(0).alias("held")
        )
        mixed = used.unionByName(asked)
        dealt = running(mixed, ["base"], [F.col("v"), F.col("held"), F.col(order)], {"below": F.col("held")})
        number = F.col("v") + F.col("below")
        named = dealt.filter("held = 0").select(
            order, F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string"))).alias("public_slug")
        )
        named = cut_lineage(todo.join(named, order))
        won = first_per_key(named, ["public_slug"], [F.col(order)])
        won = won.join(taken.select("public_slug"), "public_slug", "left_anti")
        done = won if done is None else done.unionByName(won)
        todo = named.join(won.select(order), order, "left_anti").drop("public_slug")
        todo = cut_lineage(todo)
        if todo.isEmpty():
            return done
        taken = taken.select("public_slug").unionByName(won.select("public_slug"))


def create_artists(state: State, anchors: DataFrame, actor: str, as_of: Column) -> State:
    """One new artist per anchor account (account_id, handle, display_name, platform)."""
    based = anchors.select(
        "account_id",
        F.coalesce(F.nullif("display_name", F.lit("")), "handle").alias("display_name"),
        slugify(F.col("handle"), F.col("platform"), F.col("account_id")).alias("base"),
    )
    named = unique_slugs(based, state.artists.select("public_slug"))
    made = cut_lineage(next_ids(named, state.artists, "artist_id", [F.col("account_id")]))
    rows = made.withColumns(
        {
            "primary_account_id": F.col("account_id"),
            "region": F.lit("unknown"),
            "region_source": F.lit("auto"),
            "language": F.lit("unknown"),
            "status": F.lit("active"),
            "created_at": as_of,
            "updated_at": as_of,
        }
    )
    by = "clustering" if actor == PIPELINE else "human"
    members = made.select("artist_id", "account_id").withColumns(
        {"confidence": F.lit("near_proof"), "added_by": F.lit(by), "added_at": as_of}
    )
    return state.with_(
        artists=append(state.artists, rows),
        memberships=append(state.memberships, members),
        events=log_events(state.events, made.select("artist_id", "account_id"), "created", actor, as_of),
    )


def merge_artists(state: State, mapping: DataFrame, actor: str, as_of: Column, chains: bool = True) -> State:
    """Fold losers into keepers (loser, keeper): members move, pointers collapse, open anomalies end.

    Without ``chains`` no keeper of the mapping is a loser as well, as among the pairs of ``pick_merges``.
    """
    if chains:
        mapping = resolve_chains(mapping, "loser", "keeper")
    moving = ev.live(state.memberships).select("artist_id", "account_id", "confidence")
    # One artist may hold a large share of all members, so its rows are salted.
    moving = moving.withColumnRenamed("artist_id", "loser")
    moving = lookup(moving, mapping, ["loser"], hot=hot_keys(moving, ["loser"]))
    moving = cut_lineage(moving)
    closing = moving.select(F.col("loser").alias("artist_id"), "account_id")
    closed = close_memberships(state.memberships, closing, as_of)
    arriving = moving.select(F.col("keeper").alias("artist_id"), "account_id", "confidence")
    blocked = None
    if actor == PIPELINE:
        shut = ev.human_closed(state.events)
        blocked = arriving.join(shut, ["artist_id", "account_id"], "left_semi")
        arriving = arriving.join(shut, ["artist_id", "account_id"], "left_anti")
    arriving = first_per_key(arriving, ["account_id"], [F.col("artist_id")])
    arriving = arriving.join(ev.live(closed).select("account_id"), "account_id", "left_anti")
    by = "clustering" if actor == PIPELINE else "human"
    arrived = arriving.withColumns({"added_by": F.lit(by), "added_at": as_of})

    pointer = mapping.select(F.col("loser").alias("artist_id"), F.col("keeper").alias("_into"))
    onward = mapping.select(F.col("loser").alias("merged_into"), F.col("keeper").alias("_onward"))
    artists = lookup(state.artists.join(pointer, "artist_id", "left"), onward, ["merged_into"], "left")
    artists = artists.withColumns(
        {
            "merged_into": F.coalesce("_into", "_onward", "merged_into"),
            "updated_at": F.when(F.col("_into").isNotNull(), as_of).otherwise(F.col("updated_at")),
        }
    ).select(*state.artists.columns)

    merged = mapping.select(F.col("loser").alias("artist_id"), F.col("keeper").alias("into_artist_id"))
    events = log_events(state.events, merged, "merged", actor, as_of)
    if blocked is not None:
        events = log_events(events, blocked, "account_removed", actor, as_of, reason="merge_kept_closed")
    gone = mapping.select(F.col("loser").alias("artist_id"), F.lit(True).alias("_gone"))
    marked = state.reviews.join(gone, "artist_id", "left")
    moot = F.col("_gone") & (F.col("kind") == "other") & (F.col("reason") == "anomaly")
    reviews = resolve_reviews(marked, moot, "rejected", "pipeline:merged_away", as_of).select(*state.reviews.columns)
    return state.with_(memberships=append(closed, arrived), artists=artists, events=events, reviews=reviews)


def answer_merges(reviews: DataFrame, pairs: DataFrame, decided_by: str, as_of: Column) -> DataFrame:
    """An automatic merge answers the open question about the same pair (low, high)."""
    keys = pairs.select(ev.pair_key("low", "high").alias("review_key"), F.lit(True).alias("_done")).distinct()
    marked = reviews.join(keys, "review_key", "left")
    hit = F.col("_done") & (F.col("kind") == "cluster_merge")
    return resolve_reviews(marked, hit, "approved", decided_by, as_of).select(*reviews.columns)


# --- self healing ---


def heal_memberships(state: State, as_of: Column) -> State:
    """Close automatic memberships whose newest justifying edge was retracted or turned into a connection."""
    broken = state.edges.filter("status = 'retracted' or claim = 'related'").select("edge_id")
    automatic = ev.live(state.memberships).filter("added_by = 'clustering'").select("artist_id", "account_id")
    closing = (
        ev.latest_adds(state.events)
        .select("artist_id", "account_id", "edge_id")
        .join(broken, "edge_id", "left_semi")
        .join(automatic, ["artist_id", "account_id"], "left_semi")
    )
    return remove_members(state, closing, "evidence_retracted", PIPELINE, as_of)


# --- components to artists ---


def component_facts(parts: DataFrame, facts: DataFrame, memberships: DataFrame) -> DataFrame:
    """One row per component: size, fullest platform, artists in it, its text evidence and its anchor."""
    members = parts.withColumnRenamed("node", "account_id").join(facts, "account_id")
    held = members.join(ev.live(memberships).select("account_id", "artist_id"), "account_id", "left")
    whole = held.groupBy("component").agg(
        F.count("*").alias("size"),
        F.min("account_id").alias("first_member"),
        F.min("artist_id").alias("low"),
        F.max("artist_id").alias("high"),
        F.countDistinct("artist_id").alias("artists"),
        F.max_by("account_id", F.struct("followers", -F.col("account_id"))).alias("anchor_id"),
        F.max("vouched").alias("vouched"),
        F.max("artist_like").alias("artist_like"),
        F.max("project_like").alias("project_like"),
    )
    fullest = members.groupBy("component", "platform").count().groupBy("component").agg(F.max("count").alias("fullest"))
    return whole.join(fullest, "component")


def combined_fullest(pairs: DataFrame, counts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Pairs (low, high) with the member count of their fullest platform if they were one artist."""
    sides = pairs.select("low", "high", F.explode(F.array("low", "high")).alias("artist_id"))
    tally = lookup(sides, counts, ["artist_id"]).select("low", "high", "platform", "members")
    if extra is not None:
        tally = tally.unionByName(extra.select("low", "high", "platform", "members"))
    per_platform = tally.groupBy("low", "high", "platform").agg(F.sum("members").alias("members"))
    return per_platform.groupBy("low", "high").agg(F.max("members").alias("fullest"))


#: How often a round of merges looks again for pairs among the artists that it left over.
PICKS = 3


def pick_merges(pairs: DataFrame) -> DataFrame:
    """A set of pairs in which no artist appears twice: pairs that are each other's first choice.

    Which pair an artist prefers is decided by a hash of the pair, so along a path of n artists the choices do not wait
    for each other and about log n rounds are enough; the pair with the smallest hash of all is always taken.
    """
    left = cut_lineage(pairs.select("low", "high"))
    picked = _first_choices(left)
    for _ in range(PICKS - 1):
        picked = cut_lineage(picked)
        used = picked.select(F.explode(F.array("low", "high")).alias("_a"))
        for side in ("low", "high"):
            left = left.join(used.withColumnRenamed("_a", side), side, "left_anti")
        picked = picked.unionByName(_first_choices(left))
    return picked


def _first_choices(pairs: DataFrame) -> DataFrame:
    pair = F.struct(F.xxhash64("low", "high").alias("turn"), "low", "high")
    sides = pairs.select(F.explode(F.array("low", "high")).alias("a"), pair.alias("p"))
    choice = sides.groupBy("a").agg(F.min("p").alias("p"))
    twice = choice.groupBy("p").count().filter("count = 2")
    return twice.select(F.col("p.low").alias("low"), F.col("p.high").alias("high"))


def _mergeable(state: State, about: DataFrame, parts: DataFrame, facts: DataFrame) -> DataFrame:
    """Artist pairs (low, high) of two-artist components that fit under the cap and were never rejected."""
    two = about.filter("artists = 2").select("component", "low", "high")
    homes = ev.live(state.memberships).select("account_id")
    loose = parts.withColumnRenamed("node", "account_id").join(homes, "account_id", "left_anti")
    joining = (
        loose.join(two, "component")
        .join(facts.select("account_id", "platform"), "account_id")
        .groupBy("low", "high", "platform")
        .agg(F.count("*").alias("members"))
    )
    pairs = two.select("low", "high").distinct()
    full = combined_fullest(pairs, ev.platform_counts(state.memberships, facts), joining)
    fits = full.filter(F.col("fullest") <= policy.MAX_SAME_PLATFORM).withColumn("pair_key", ev.pair_key("low", "high"))
    return fits.join(ev.rejected_pairs(state.reviews), "pair_key", "left_anti").select("low", "high")


def build_components(state: State, facts: DataFrame, edges: DataFrame, as_of: Column) -> State:
    """Turn components of mutual links into artists, merges or questions."""
    pairs = mutual_pairs(edges)
    parts = cut_lineage(components(pairs))
    about = cut_lineage(component_facts(parts, facts, state.memberships))
    giant = F.col("fullest") > policy.MAX_SAME_PLATFORM

    reviews = about.filter(giant).select(
        F.lit("other").alias("kind"),
        F.lit("giant_component").alias("reason"),
        F.concat_ws(":", F.col("first_member").cast("string"), F.col("size").cast("string")).alias("review_key"),
    )
    state = state.with_(reviews=cut_lineage(add_reviews(state.reviews, reviews, as_of)))

    # Two artists in one component of two-way links are one person, unless the whole would be too full.
    # A merge can bring two further components together, so this repeats until no pair is left.
    while True:
        merging = cut_lineage(pick_merges(_mergeable(state, about.filter(~giant), parts, facts)))
        if merging.isEmpty():
            break
        mapping = merging.select(F.col("high").alias("loser"), F.col("low").alias("keeper"))
        state = merge_artists(state, mapping, PIPELINE, as_of, chains=False)
        state = state.with_(reviews=answer_merges(state.reviews, merging, "pipeline:reciprocal_component", as_of))
        state = settle(state)
        about = cut_lineage(component_facts(parts, facts, state.memberships))
    usable = about.filter(~giant)
    conflict = usable.filter("artists > 1")
    names = (
        parts.withColumnRenamed("node", "account_id")
        .join(conflict.select("component"), "component")
        .join(ev.live(state.memberships).select("account_id", "artist_id"), "account_id")
        .select("component", "artist_id")
        .distinct()
    )
    # Components past the giant guard hold at most three accounts per platform, so this list is short.
    keyed = names.groupBy("component").agg(F.array_sort(F.collect_set("artist_id")).alias("ids"))
    questions = keyed.select(
        F.lit("cluster_merge").alias("kind"),
        F.lit("reciprocal_component").alias("reason"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("review_key"),
        F.element_at("ids", 1).alias("artist_id"),
        F.element_at("ids", 2).alias("other_artist_id"),
    )
    state = state.with_(reviews=add_reviews(state.reviews, questions, as_of))

    # Components nobody owns yet: the anchor must be free, and strangers must look like artists.
    unowned = usable.filter("artists = 0")
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    unowned = unowned.join(barred.withColumnRenamed("account_id", "anchor_id"), "anchor_id", "left_anti")
    gated = ~F.col("vouched") & (F.col("project_like") | ~F.col("artist_like"))
    gates = unowned.filter(gated).select(
        F.lit("singleton_gate").alias("kind"),
        F.when(F.col("project_like"), "project_like").otherwise("no_artist_evidence").alias("reason"),
        F.col("anchor_id").cast("string").alias("review_key"),
        F.col("anchor_id").alias("account_id"),
    )
    state = state.with_(reviews=cut_lineage(add_reviews(state.reviews, gates, as_of)))
    anchors = unowned.filter(~gated).select(F.col("anchor_id").alias("account_id"))
    state = create_artists(state, facts.join(anchors, "account_id", "left_semi"), PIPELINE, as_of)

    # Everyone else in a component with exactly one artist joins it.
    ready = parts.withColumnRenamed("node", "account_id").join(usable.select("component"), "component", "left_semi")
    owned = ready.join(ev.live(state.memberships).select("account_id", "artist_id"), "account_id", "left")
    owners = owned.groupBy("component").agg(F.min("artist_id").alias("artist_id"), F.max("artist_id").alias("_other"))
    owners = owners.filter("artist_id = _other").drop("_other")
    adds = (
        owned.filter("artist_id is null")
        .select("component", "account_id")
        .join(owners, "component")
        .join(barred, "account_id", "left_anti")
        .select(
            "artist_id",
            "account_id",
            F.lit("near_proof").alias("confidence"),
            F.lit("reciprocal").alias("reason"),
            F.lit(None).cast("bigint").alias("edge_id"),
        )
    )
    return add_members(state, adds, PIPELINE, as_of)


# --- verified links, singletons, demotion ---


def verified(edges: DataFrame) -> DataFrame:
    return edges.filter("evidence_type = 'profile_field' and relation_hint = 'oauth'")


def slots_left(adds: DataFrame, counts: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates (artist_id, account_id, platform, ...) that fit under the per-platform cap, in order."""
    ranked = top_per_key(adds, ["artist_id", "platform"], order, policy.MAX_SAME_PLATFORM, "_slot")
    filled = ranked.join(counts, ["artist_id", "platform"], "left")
    return filled.filter(F.col("_slot") + F.coalesce("members", F.lit(0)) <= policy.MAX_SAME_PLATFORM).drop(
        "_slot", "members"
    )


def reverse_attach(state: State, facts: DataFrame, edges: DataFrame, as_of: Column) -> State:
    """A free account whose platform-verified link points at a member joins that artist."""
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    links = verified(edges).select("edge_id", F.col("source_account_id").alias("account_id"), "target_account_id")
    links = links.join(homes.select("account_id"), "account_id", "left_anti").join(barred, "account_id", "left_anti")
    targets = homes.select(F.col("account_id").alias("target_account_id"), "artist_id")
    joined = lookup(links, targets, ["target_account_id"])
    joined = joined.join(ev.human_closed(state.events), ["artist_id", "account_id"], "left_anti")
    joined = joined.join(facts.select("account_id", "platform"), "account_id")
    one = first_per_key(joined, ["account_id"], [F.col("edge_id")])
    fits = slots_left(one, ev.platform_counts(state.memberships, facts), [F.col("edge_id")])
    adds = fits.withColumns({"confidence": F.lit("near_proof"), "reason": F.lit("platform_verified_link")})
    return add_members(state, adds, PIPELINE, as_of)


def harvest_without_evidence(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Open-harvest accounts with neither an outbound link nor art words."""
    sources = edges.select(F.col("source_account_id").alias("account_id")).distinct()
    open_harvest = facts.filter(F.col("discovered_via").isin(policy.HARVEST_NEEDS_EVIDENCE) & ~F.col("artist_text"))
    return open_harvest.join(sources, "account_id", "left_anti").select("account_id")


def singletons(state: State, facts: DataFrame, edges: DataFrame, as_of: Column) -> State:
    """Roster accounts without links become artists of their own; doubtful harvests are asked about."""
    homes = ev.live(state.memberships).select("account_id")
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    untouched_tag = (F.col("discovered_via") == "manual_tag") & F.col("last_hydrated").isNull()
    alone = facts.filter(
        F.col("discovered_via").isin(policy.ROSTER_SOURCES)
        & (F.col("kind") != "link_hub")
        & F.col("status").isin(policy.VISIBLE_STATUSES)
        & ~untouched_tag
    )
    alone = alone.join(homes, "account_id", "left_anti").join(barred, "account_id", "left_anti")
    doubtful = harvest_without_evidence(facts, edges)
    gates = alone.join(doubtful, "account_id", "left_semi").select(
        F.lit("singleton_gate").alias("kind"),
        F.lit(None).cast("string").alias("reason"),
        F.col("account_id").cast("string").alias("review_key"),
        "account_id",
    )
    state = state.with_(reviews=add_reviews(state.reviews, gates, as_of))
    return create_artists(state, alone.join(doubtful, "account_id", "left_anti"), PIPELINE, as_of)


def demote_artists(state: State, artists: DataFrame, reason: str, as_of: Column) -> State:
    """Send active artists back to review and say why."""
    down = artists.select("artist_id").distinct().withColumn("_down", F.lit(True))
    joined = state.artists.join(down, "artist_id", "left")
    changed = joined.withColumns(
        {
            "status": F.when(F.col("_down"), F.lit("needs_review")).otherwise(F.col("status")),
            "updated_at": F.when(F.col("_down"), as_of).otherwise(F.col("updated_at")),
        }
    ).select(*state.artists.columns)
    events = log_events(state.events, artists, "suppressed", PIPELINE, as_of, reason=reason)
    return state.with_(artists=changed, events=events)


def listed_untouched(state: State) -> DataFrame:
    """Active, unmerged artists no person ever acted on."""
    touched = state.events.filter(F.col("actor").startswith("admin")).select("artist_id").distinct()
    return state.artists.filter("status = 'active' and merged_into is null").join(touched, "artist_id", "left_anti")


def demote_without_evidence(state: State, facts: DataFrame, edges: DataFrame, as_of: Column) -> State:
    """Single-account artists of open harvests that fail the evidence test."""
    singles = (
        ev.live(state.memberships)
        .join(listed_untouched(state).select("artist_id"), "artist_id", "left_semi")
        .groupBy("artist_id")
        .agg(F.min("account_id").alias("account_id"), F.count("*").alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )
    failing = cut_lineage(singles.join(harvest_without_evidence(facts, edges), "account_id", "left_semi"))
    return demote_artists(state, failing, "no_artist_evidence", as_of)


# --- one-directional links ---


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is not claimed."""
    pairs = mutual_pairs(edges)
    src, tgt = F.col("source_account_id"), F.col("target_account_id")
    keyed = edges.withColumns({"low": F.least(src, tgt), "high": F.greatest(src, tgt)})
    return keyed.join(pairs, ["low", "high"], "left_anti").drop("low", "high")


def shared_targets(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """Accounts that members of two or more artists link to without a link back: nobody's own account."""
    homes = ev.live(memberships).select(F.col("account_id").alias("source_account_id"), "artist_id")
    owned = lookup(one_way(edges), homes, ["source_account_id"])
    # Two different artists exist exactly when the smallest and the largest differ.
    spread = owned.groupBy("target_account_id").agg(F.min("artist_id").alias("_a"), F.max("artist_id").alias("_b"))
    return spread.filter("_a <> _b").select(F.col("target_account_id").alias("account_id"))


def detach_shared(state: State, shared: DataFrame, as_of: Column) -> State:
    """Close earlier automatic attachments of shared targets."""
    weak = ev.live(state.memberships).filter("added_by = 'clustering' and confidence = 'strong'")
    closing = weak.join(shared, "account_id", "left_semi").select("artist_id", "account_id")
    return remove_members(state, closing, "shared_target", PIPELINE, as_of)


def shared_reciprocity(
    candidates: DataFrame, edges: DataFrame, memberships: DataFrame, shared: DataFrame, facts: DataFrame
) -> DataFrame:
    """(artist_id, account_id, shared_links): targets both the artist's members and the account link to.

    Shared and prominent targets prove nothing and are left out first, which also bounds every join key.
    """
    plain = facts.filter(F.col("followers") < policy.REVIEW_FOLLOWER_THRESHOLD).select("account_id")
    out = edges.select(F.col("source_account_id").alias("account_id"), F.col("target_account_id").alias("link_id"))
    out = out.distinct().join(shared.withColumnRenamed("account_id", "link_id"), "link_id", "left_anti")
    out = out.join(plain.withColumnRenamed("account_id", "link_id"), "link_id", "left_semi")
    homes = ev.live(memberships).select("account_id", "artist_id")
    by_artist = out.join(homes, "account_id").select("artist_id", "link_id").distinct()
    by_target = out.join(candidates.select("artist_id", "account_id").distinct(), "account_id")
    return by_target.join(by_artist, ["artist_id", "link_id"], "left_semi").groupBy("artist_id", "account_id").agg(
        F.countDistinct("link_id").alias("shared_links")
    )


def one_directional_ladder(
    edges: DataFrame, state: State, facts: DataFrame, shared: DataFrame
) -> DataFrame:
    """Decide every one-way edge from a member to a free account, in one round.

    Returns edge_id, artist_id, account_id, decision (attach / flip / none), confidence, reason,
    relation_hint. Verified links fill slots first, then stated alternates; any other link needs a
    platform the artist has no account on, and a prominent target needs proof.
    """
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    links = one_way(edges).select("edge_id", "source_account_id", F.col("target_account_id").alias("account_id"),
                                  "evidence_type", "relation_hint")
    links = links.join(homes.select("account_id"), "account_id", "left_anti")
    sources = homes.withColumnRenamed("account_id", "source_account_id")
    links = lookup(links, sources, ["source_account_id"])
    oauth = (F.col("evidence_type") == "profile_field") & F.col("relation_hint").eqNullSafe(F.lit("oauth"))
    tier = F.when(oauth, 0).when(F.col("evidence_type") == "bio_mention", 1).otherwise(2)
    links = links.withColumn("tier", tier).drop("relation_hint")
    flagged = shared.withColumn("_shared", F.lit(True))
    links = links.join(flagged, "account_id", "left").filter("tier = 0 or _shared is null").drop("_shared")
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    links = links.join(barred, "account_id", "left_anti")
    links = links.join(facts.select("account_id", "platform", "followers"), "account_id")
    shut = ev.human_closed(state.events).withColumn("_shut", F.lit(True))
    links = links.join(shut, ["artist_id", "account_id"], "left").withColumn("closed", F.col("_shut").isNotNull())
    links = cut_lineage(links.drop("_shut"))

    # Used several times below, and small beside the links.
    counts = cut_lineage(ev.platform_counts(state.memberships, facts))
    by_edge = [F.col("edge_id")]
    open_links = links.filter(~F.col("closed"))

    # Verified and stated links: one candidate per account, ranked by tier, then edge.
    strong = first_per_key(open_links.filter("tier < 2"), ["artist_id", "account_id"], [F.col("tier"), *by_edge])
    strong = first_per_key(strong, ["account_id"], [F.col("tier"), *by_edge])
    taken = cut_lineage(slots_left(strong, counts, [F.col("tier"), *by_edge]))
    filled = counts.unionByName(taken.groupBy("artist_id", "platform").agg(F.count("*").alias("members")))
    used = cut_lineage(filled.select("artist_id", "platform").distinct()).withColumn("_used", F.lit(True))

    # Other links: the artist must have no account there; prominent targets need shared links.
    plain = open_links.filter("tier = 2").join(taken.select("account_id"), "account_id", "left_anti")
    famous = plain.filter(F.col("followers") >= policy.REVIEW_FOLLOWER_THRESHOLD)
    proof = shared_reciprocity(famous, edges, state.memberships, shared, facts)
    plain = plain.join(proof, ["artist_id", "account_id"], "left").join(used, ["artist_id", "platform"], "left")
    proven = (F.col("followers") < policy.REVIEW_FOLLOWER_THRESHOLD) | (
        F.coalesce("shared_links", F.lit(0)) >= policy.RECIPROCITY_SHARED_MIN
    )
    eligible = plain.filter(proven & F.col("_used").isNull())
    winners = first_per_key(eligible, ["artist_id", "platform"], by_edge)
    winners = cut_lineage(first_per_key(winners, ["account_id"], by_edge))

    picks = taken.select("edge_id").unionByName(winners.select("edge_id")).withColumn("_pick", F.lit(True))
    settled = taken.select("account_id").unionByName(winners.select("account_id")).withColumn("_settled", F.lit(True))
    full = used.unionByName(winners.select("artist_id", "platform", F.lit(True).alias("_used"))).distinct()
    judged = links.join(picks, "edge_id", "left").join(settled, "account_id", "left")
    judged = judged.join(full, ["artist_id", "platform"], "left")
    attach = F.col("_pick").isNotNull()
    # Further edges to an account that just found its artist are moot.
    moot = F.col("_settled").isNotNull() & ~attach
    prominent = F.col("followers") >= policy.REVIEW_FOLLOWER_THRESHOLD
    blocked = prominent | ~F.col("closed") | F.col("_used").isNotNull()
    flip = ~attach & ~moot & ((F.col("tier") == 1) | ((F.col("tier") == 2) & blocked))
    hint = (
        F.when(F.col("tier") == 1, "over_platform_cap").when(prominent, "unreciprocated_prominent").otherwise("secondary_link")
    )
    reason = (
        F.when(F.col("tier") == 0, "platform_verified_link")
        .when(F.col("tier") == 1, "alt_mention")
        .when(prominent, "shared_hub_reciprocity")
        .otherwise("one_directional")
    )
    return judged.select(
        "edge_id",
        "artist_id",
        "account_id",
        F.when(attach, "attach").when(flip, "flip").otherwise("none").alias("decision"),
        F.when(attach, F.when(F.col("tier") == 0, "near_proof").otherwise("strong")).alias("confidence"),
        F.when(attach, reason).alias("reason"),
        F.when(flip, hint).alias("relation_hint"),
    )


def apply_ladder(state: State, decisions: DataFrame, as_of: Column) -> State:
    decisions = cut_lineage(decisions)
    flips = decisions.filter("decision = 'flip'").withColumn("claim", F.lit("related"))
    state = state.with_(edges=set_edges(state.edges, flips, only_claim="same_person"))
    return add_members(state, decisions.filter("decision = 'attach'"), PIPELINE, as_of)


# --- artist-level merging ---


def artist_claims(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """Edges lifted to (from_artist, to_artist, edge_id) between two different artists."""
    homes = ev.live(memberships).select("account_id", "artist_id")
    src = homes.select(F.col("account_id").alias("source_account_id"), F.col("artist_id").alias("from_artist"))
    tgt = homes.select(F.col("account_id").alias("target_account_id"), F.col("artist_id").alias("to_artist"))
    lifted = lookup(lookup(edges, src, ["source_account_id"]), tgt, ["target_account_id"])
    return lifted.filter("from_artist <> to_artist").select("from_artist", "to_artist", "edge_id", "source_account_id",
                                                            "target_account_id")


def reciprocal_artists(claims: DataFrame) -> DataFrame:
    """Artist pairs (low, high) that claim each other through any accounts."""
    a, b = F.col("from_artist"), F.col("to_artist")
    both = claims.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(
        F.min(a < b).alias("_x"), F.max(a < b).alias("_y")
    )
    return both.filter("_x <> _y").select("low", "high")


def personal(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """One-way edges that name somebody: shared targets are left out unless the platform verified the link."""
    flagged = shared.select(F.col("account_id").alias("target_account_id"), F.lit(True).alias("_shared"))
    marked = one_way(edges).join(flagged, "target_account_id", "left")
    kept = F.col("_shared").isNull() | F.col("relation_hint").eqNullSafe(F.lit("oauth"))
    return marked.filter(kept).drop("_shared")


def merge_reciprocal_artists(state: State, facts: DataFrame, shared: DataFrame, as_of: Column) -> State:
    """Merge artists that reference each other, round by round, until no pair qualifies.

    A pair comes up through a one-way or a flipped edge; all edges between the two count as claims.
    Every merge of a keeper adds members under a per-platform cap, so rounds are few.
    """
    while True:
        same = ev.strong_edges(state.edges, state.accounts)
        flipped = ev.flipped_edges(state.edges, state.accounts)
        claims = artist_claims(same.unionByName(flipped), state.memberships)
        raised = personal(same, shared).select(same.columns).unionByName(flipped)
        raised = artist_claims(raised, state.memberships).select(
            F.least("from_artist", "to_artist").alias("low"), F.greatest("from_artist", "to_artist").alias("high")
        )
        pairs = reciprocal_artists(claims).join(raised, ["low", "high"], "left_semi")
        barred = ev.suppressed_artists(state.suppressions)
        for side in ("low", "high"):
            pairs = pairs.join(barred.withColumnRenamed("artist_id", side), side, "left_anti")
        pairs = pairs.withColumn("pair_key", ev.pair_key("low", "high"))
        pairs = pairs.join(ev.rejected_pairs(state.reviews), "pair_key", "left_anti").select("low", "high")
        full = combined_fullest(pairs, ev.platform_counts(state.memberships, facts))
        fits = full.filter(F.col("fullest") <= policy.MAX_SAME_PLATFORM).select("low", "high")
        merging = cut_lineage(pick_merges(fits))
        if merging.isEmpty():
            return state
        wires = artist_claims(flipped, state.memberships)
        wires = wires.withColumns(
            {"low": F.least("from_artist", "to_artist"), "high": F.greatest("from_artist", "to_artist")}
        )
        restored = wires.join(merging, ["low", "high"], "left_semi").select("edge_id").withColumns(
            {"claim": F.lit("same_person"), "relation_hint": F.lit("artist_reciprocity")}
        )
        edges = set_edges(state.edges, restored, only_claim="related")
        mapping = merging.select(F.col("high").alias("loser"), F.col("low").alias("keeper"))
        state = merge_artists(state.with_(edges=edges), mapping, PIPELINE, as_of, chains=False)
        state = state.with_(reviews=answer_merges(state.reviews, merging, "pipeline:artist_reciprocity", as_of))
        state = settle(state)


def ask_conflicts(state: State, shared: DataFrame, as_of: Column) -> State:
    """One question per pair of artists that a one-way same-person edge still connects."""
    edges = personal(ev.strong_edges(state.edges, state.accounts), shared)
    claims = artist_claims(edges, state.memberships)
    items = claims.select(
        F.lit("cluster_merge").alias("kind"),
        F.lit("cross_artist_link").alias("reason"),
        ev.pair_key("from_artist", "to_artist").alias("review_key"),
        F.least("from_artist", "to_artist").alias("artist_id"),
        F.greatest("from_artist", "to_artist").alias("other_artist_id"),
        "edge_id",
    )
    return state.with_(reviews=add_reviews(state.reviews, items, as_of))


def restore_flipped(state: State, facts: DataFrame, edges: DataFrame, shared: DataFrame, as_of: Column) -> State:
    """Test every flipped edge against its own condition again and attach where it cleared."""
    homes = ev.live(state.memberships).select("account_id", "artist_id")
    flips = ev.flipped_edges(state.edges, state.accounts).select(
        "edge_id", "source_account_id", F.col("target_account_id").alias("account_id"), "relation_hint"
    )
    flips = flips.join(homes.select("account_id"), "account_id", "left_anti").join(shared, "account_id", "left_anti")
    flips = lookup(flips, homes.withColumnRenamed("account_id", "source_account_id"), ["source_account_id"])
    flips = flips.join(ev.human_closed(state.events), ["artist_id", "account_id"], "left_anti")
    flips = flips.join(facts.select("account_id", "platform", "followers"), "account_id")
    counts = ev.platform_counts(state.memberships, facts)
    famous = flips.filter(F.col("followers") >= policy.REVIEW_FOLLOWER_THRESHOLD)
    proof = shared_reciprocity(famous, edges, state.memberships, shared, facts)
    flips = flips.join(proof, ["artist_id", "account_id"], "left").join(counts, ["artist_id", "platform"], "left")
    flips = cut_lineage(flips.withColumn("members", F.coalesce("members", F.lit(0))))

    alternates = flips.filter("relation_hint = 'over_platform_cap'")
    alternates = first_per_key(alternates, ["account_id"], [F.col("edge_id")]).drop("members")
    alternates = slots_left(alternates, counts, [F.col("edge_id")])
    prominent = F.col("followers") >= policy.REVIEW_FOLLOWER_THRESHOLD
    proven = ~prominent | (F.coalesce("shared_links", F.lit(0)) >= policy.RECIPROCITY_SHARED_MIN)
    others = flips.filter((F.col("relation_hint") != "over_platform_cap") & (F.col("members") == 0) & proven)
    taken = alternates.select("artist_id", "platform").distinct()
    others = others.join(taken, ["artist_id", "platform"], "left_anti").join(
        alternates.select("account_id"), "account_id", "left_anti"
    )
    others = first_per_key(others, ["artist_id", "platform"], [F.col("edge_id")])
    others = first_per_key(others, ["account_id"], [F.col("edge_id")])
    attach = alternates.select("edge_id", "artist_id", "account_id", F.lit("alt_mention").alias("reason")).unionByName(
        others.select(
            "edge_id", "artist_id", "account_id",
            F.when(prominent, "shared_hub_reciprocity").otherwise("one_directional").alias("reason"),
        )
    )
    attach = cut_lineage(attach.withColumn("confidence", F.lit("strong")))
    hint = F.when(F.col("reason") == "shared_hub_reciprocity", F.col("reason"))
    restored = attach.withColumns({"claim": F.lit("same_person"), "relation_hint": hint})
    return add_members(state.with_(edges=set_edges(state.edges, restored)), attach, PIPELINE, as_of)


def settle(state: State) -> State:
    """Cut the lineage of the tables a stage rewrote, or of the rows it added; the others already stand on their own."""
    names = ("accounts", "edges", "artists", "memberships", "events", "reviews", "suppressions")
    rewritten = {n: getattr(state, n) for n in names if not is_cut(getattr(state, n))}
    return state.with_(**each_apart(cut_added, rewritten))
