"""Graph operators against brute force and small cases."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from personagraph.operators import checks, clustering, directory, evidence as ev, spread
from personagraph.operators.components import components, mutual_pairs, resolve_chains
from personagraph.plans.cluster import cluster
from personagraph.schemas import STATE_SCHEMAS, empty_state

NOW = datetime(2026, 1, 1)
as_of = F.lit(NOW).cast("timestamp")


def rows(spark, table, *dicts):
    schema = STATE_SCHEMAS[table]
    names = [f.split()[0] for f in schema.split(", ")] if "map<" not in schema else None
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


def account(i, platform="twitter", followers=100, via="twitter_list", **more):
    base = dict(
        account_id=i, platform=platform, native_id=f"n{i}", handle=f"artist{i}", display_name=f"Artist {i}", status="active",
        followers_count=followers, discovered_via=via, last_hydrated=NOW, commission_status="unknown", project=False,
    )
    return {**base, **more}


def edge(i, a, b, kind="bio_link", claim="same_person", hint=None, status="present"):
    return dict(
        edge_id=i, source_account_id=a, target_account_id=b, evidence_type=kind, evidence_snapshot_id=1, claim=claim,
        relation_hint=hint, status=status, first_seen=NOW,
    )


def artist(i, **more):
    return {**dict(artist_id=i, public_slug=f"slug-{i}", display_name=f"A{i}", region="unknown", region_source="auto",
                   language="unknown", status="active", created_at=NOW), **more}


def member(a, i, confidence="near_proof", by="clustering"):
    return dict(artist_id=a, account_id=i, confidence=confidence, added_by=by, added_at=datetime(2025, 1, 1))


def homes(state):
    return {r.account_id: r.artist_id for r in ev.live(state.memberships).collect()}


def find_roots(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_components_agree_with_union_find(spark, hot_rows):
    rng = random.Random(7)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(0, rng.randrange(120)) for _ in range(30)]
    pairs += [(i, i + 1) for i in range(200, 225)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = components(spark.createDataFrame(pairs, "low long, high long"), hot_rows=hot_rows)
    assert {r.node: r.component for r in got.collect()} == find_roots(pairs)


def test_running_agrees_with_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(rng.choice("aaaab"), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = spread.running(df, ["k"], [F.col("i").desc()], {"total": F.col("v")}).collect()
    expected = {}
    for key in "ab":
        total = 0
        for place, (_, i, v) in enumerate(sorted([r for r in data if r[0] == key], key=lambda r: -r[1]), 1):
            total += v
            expected[i] = (place, total)
    assert {r.i: (r.position, r.total) for r in got} == expected


def test_running_is_the_same_in_one_slice_and_in_many(spark, monkeypatch):
    df = spark.createDataFrame([("ab"[i % 2] if i % 5 else None, i, i % 9) for i in range(300)], "k string, i long, v int").repartition(7)
    cuts = []
    monkeypatch.setattr(spread, "cut_lineage", lambda df, cut=spread.cut_lineage: cuts.append(1) or cut(df))

    def dealt():
        cuts.clear()
        return spread.running(df, ["k"], [F.col("i")], {"total": F.col("v"), "exact": F.col("v").cast("decimal(9,2)")})

    few = dealt()
    assert len(cuts) == 1
    monkeypatch.setattr(spread, "SLICE_ROWS", 10)
    many = dealt()
    assert len(cuts) == 2
    assert [(f.name, f.dataType) for f in few.schema] == [(f.name, f.dataType) for f in many.schema]
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    assert spread.running(df.filter("i < 0"), [], [F.col("i")], {}).count() == 0


def test_settling_writes_only_the_events_that_were_added(spark):
    log = [dict(artist_id=i, event="created", actor="pipeline", created_at=NOW) for i in range(3)]
    state = clustering.settle(build(spark, events=log))
    written = set(state.events.inputFiles())
    for i in (7, 8):
        added = spark.createDataFrame([(i, 2 * i)], "artist_id long, account_id long")
        events = clustering.log_events(state.events, added, "account_added", "pipeline", as_of)
        state = clustering.settle(state.with_(events=events))
        assert written < set(state.events.inputFiles())
    assert len(state.events.inputFiles()) - len(written) <= 2
    assert sorted(r.artist_id for r in state.events.collect()) == [0, 1, 2, 7, 8]
    assert {(r.account_id, r.event) for r in state.events.filter("artist_id > 2").collect()} == {(14, "account_added"), (16, "account_added")}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_a_join(spark, how):
    facts = spark.createDataFrame([(i, i % 7 if i % 3 else 1) for i in range(300)] + [(999, None)], "id long, k long")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(6)], "k long, d string")
    hot = spread.hot_keys(facts, ["k"], 50)
    salted = spread.lookup(facts, dim, ["k"], how, hot=hot, salts=4).select("id", "k", "d")
    plain = facts.join(dim, ["k"], how).select("id", "k", "d")
    assert sorted(salted.collect(), key=str) == sorted(plain.collect(), key=str)


def test_chains_resolve(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21)], "node long, target long")
    assert {r.node: r.target for r in resolve_chains(links).collect()} == {**{i: 12 for i in range(1, 12)}, 20: 21}
    for n in (2, 3, 5):
        ring = [(k, k % n + 1) for k in range(1, n + 1)] + [(100, 101)]
        with pytest.raises(ValueError):
            resolve_chains(spark.createDataFrame(ring, "node long, target long"))


def test_chains_of_popular_keepers_resolve(spark):
    links = spark.createDataFrame([(i, 1000) for i in range(400)] + [(1000, 1001)], "node long, target long")
    assert {r.target for r in resolve_chains(links, hot_rows=50).collect()} == {1001}


def test_slugs_avoid_stored_and_new_names(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a-2"), (5, "b")], "account_id long, base string")
    taken = spark.createDataFrame([("a",), ("a-3",)], "public_slug string")
    got = {r.account_id: r.public_slug for r in clustering.unique_slugs(new, taken).collect()}
    assert len(set(got.values())) == 5 and not {"a", "a-3"} & set(got.values())
    assert got[1] == "a-2" and got[5] == "b"


def test_mutual_pairs_need_both_directions(spark):
    e = rows(spark, "edges", edge(1, 1, 2), edge(2, 2, 1), edge(3, 3, 1), edge(4, 3, 1, kind="link_hub"))
    assert [(r.low, r.high) for r in mutual_pairs(e).collect()] == [(1, 2)]


def build(spark, **tables):
    return empty_state(spark, **{n: rows(spark, n, *dicts) for n, dicts in tables.items()})


def test_clustering_cases(spark):
    """Several unrelated cases side by side in one run."""
    accounts = [
        account(1), account(2, "pixiv", 900),                                  # mutual pair
        account(11), account(12, "pixiv"), account(13, "skeb"),                # chain
        *[account(20 + i) for i in range(4)],                                  # four on one platform
        account(31), account(32, "pixiv"),                                     # two artists, mutual
        account(41), account(42, "pixiv"),                                     # the same, but a person said no
        account(51), account(52, "pixiv", 10_000, via="bio_link"),             # prominent target
        account(61), account(62, "pixiv", 20_000, via="bio_link"),             # prominent, but shares two links
        account(63, "carrd", via="bio_link"), account(64, "kofi", via="bio_link"),
        account(71), account(72), account(73, "discord", via="bio_link"),      # shared target
        account(81), account(82), account(83), account(84, via="bio_mention"), # cap reached
        account(91, "skeb", via="bio_link"), account(92),                      # verified link into an artist
        account(101), account(102, "pixiv", via="bio_link"),                   # membership whose edge was retracted
        account(111), account(112, "pixiv", via="bio_link"),                   # closed by a person
        account(121), account(122, "pixiv"), account(123), account(124, "pixiv"),  # artists that name each other
        account(131, via="portfolioday", display_name="Bob", handle="bob"),    # harvest without evidence
        account(141, via="bio_link"), account(142, "kofi", via="bio_link", display_name="Big Zine", handle="thing"),  # project pair
    ]
    edges = [
        edge(1, 1, 2), edge(2, 2, 1),
        edge(3, 11, 12), edge(4, 12, 11), edge(5, 12, 13), edge(6, 13, 12),
        edge(7, 20, 21), edge(8, 21, 20), edge(9, 21, 22), edge(10, 22, 21), edge(11, 22, 23), edge(12, 23, 22),
        edge(13, 31, 32), edge(14, 32, 31), edge(15, 41, 42), edge(16, 42, 41),
        edge(17, 51, 52),
        edge(18, 61, 62), edge(19, 61, 63), edge(20, 61, 64), edge(21, 62, 63), edge(22, 62, 64),
        edge(23, 71, 73), edge(24, 72, 73),
        edge(25, 81, 84, kind="bio_mention"),
        edge(26, 91, 92, kind="profile_field", hint="oauth"),
        edge(27, 101, 102, status="retracted"),
        edge(28, 111, 112),
        edge(29, 121, 124), edge(30, 123, 122, claim="related", hint="unreciprocated_prominent"),
        edge(31, 141, 142), edge(32, 142, 141),
    ]
    owned = {3: [31], 4: [32], 5: [41], 6: [42], 7: [51], 8: [61], 9: [71], 10: [72], 11: [81, 82, 83], 12: [92],
             13: [101, 102], 14: [111], 15: [121, 122], 16: [123, 124], 17: [131]}
    members = [member(a, i) for a, ids in owned.items() for i in ids]
    members += [member(9, 73, "strong")]
    state = build(
        spark,
        accounts=accounts,
        edges=edges,
        artists=[artist(a) for a in owned],
        memberships=[{**m, "confidence": "strong"} if m["account_id"] == 102 else m for m in members],
        events=[
            dict(artist_id=13, event="account_added", actor="pipeline", account_id=102, edge_id=27, created_at=datetime(2025, 1, 1)),
            dict(artist_id=14, event="account_removed", actor="admin:x", account_id=112, created_at=datetime(2025, 1, 1)),
        ],
        reviews=[dict(item_id=1, kind="cluster_merge", review_key="5,6", artist_id=5, other_artist_id=6, status="rejected", created_at=NOW)],
    )
    done = cluster(state, NOW)
    at = homes(done)
    hints = {r.edge_id: (r.claim, r.relation_hint) for r in done.edges.collect()}
    asked = {(r.kind, r.reason) for r in done.reviews.collect()}
    events = {(r.event, r.account_id, r.reason) for r in done.events.collect()}

    assert at[1] == at[2] and at[11] == at[12] == at[13]
    assert ("other", "giant_component") in asked
    assert at[31] == at[32] == 3 and at[41] == 5 and at[42] == 6
    assert 52 not in at and hints[17] == ("related", "unreciprocated_prominent")
    assert at[62] == 8 and at[63] == 8 and at[64] == 8
    assert 73 not in at and ("account_removed", 73, "shared_target") in events
    assert 84 not in at and hints[25] == ("related", "over_platform_cap")
    assert at[91] == 12
    assert 102 not in at and ("account_removed", 102, "evidence_retracted") in events
    assert 112 not in at
    assert at[121] == at[124] == 15 and hints[30] == ("same_person", "artist_reciprocity")
    assert {r.artist_id: r.merged_into for r in done.artists.filter("merged_into is not null").collect()} == {4: 3, 16: 15}
    assert {r.artist_id for r in done.artists.filter("status = 'needs_review'").collect()} == {17}
    assert 142 not in at
    assert {r.violations for r in checks.state_violations(done).collect()} == {0}

    # A second run, with rows in another order, finds nothing more to do.
    again = cluster(done.with_(edges=done.edges.orderBy(F.col("edge_id").desc())), NOW)
    assert homes(again) == at
    assert again.reviews.count() == done.reviews.count()


def test_directory_on_the_smoke_fixture(spark):
    state = build(
        spark,
        accounts=[
            account(1, followers=52000, handle="seawitch", display_name="Sea Witch"),
            account(2, "pixiv", 30000, handle="seawitch_px", display_name="海の魔女", via="pixiv_ranking"),
            account(3, "instagram", None, handle="seawitch.ig", display_name=None, status="unknown", via="bio_link"),
            account(4, followers=90000, handle="brushlord"),
        ],
        artists=[artist(1, public_slug="seawitch", region="eastern"), artist(2, public_slug="brushlord")],
        memberships=[member(1, 1), member(1, 2), member(1, 3, "strong"), member(2, 4)],
        snapshots=[dict(snapshot_id=1, account_id=1, captured_at=NOW, bio_text="#NoAI", fetch_source="x:users/by")],
        attestations=[dict(account_id=1, signal="bio_tag", matched_text="#NoAI", evidence_snapshot_id=1, active=True)],
        flags=[dict(account_id=2, flag="nsfw", signal="bio_marker", matched_text="R-18", evidence_snapshot_id=1, active=True)],
        suppressions=[dict(artist_id=2, reason="opt_out", created_at=NOW)],
    )
    shown = directory.directory(state, as_of).collect()
    assert [(r.public_slug, r.no_ai_attested, r.nsfw, r.display_name) for r in shown] == [("seawitch", True, True, "Sea Witch")]
    assert shown[0].sources == ["pixiv", "twitter"] and shown[0].dormant is False
    named = [r.platform for r in directory.directory_accounts(state).orderBy("position").collect()]
    assert named == ["twitter", "pixiv", "instagram"]

    hidden = rows(spark, "suppressions", dict(artist_id=2, reason="opt_out", created_at=NOW), dict(account_id=3, reason="impersonation", created_at=NOW))
    later = state.with_(suppressions=hidden)
    assert directory.directory(later, as_of).count() == 1
    left = [r.platform for r in directory.directory_accounts(later).orderBy("position").collect()]
    assert left == ["twitter", "pixiv"]
    nested = directory.nest_accounts(directory.directory_accounts(state), per_part=2).orderBy("part").collect()
    assert [len(r.accounts) for r in nested] == [2, 1]


def test_a_path_of_artists_merges_in_few_rounds(spark):
    """Each round merges the picked pairs; pairs of merged artists are renamed to the keeper."""
    left = [(k, k + 1) for k in range(1, 100)]
    for taken in range(1, 20):
        picked = {tuple(r) for r in clustering.pick_merges(spark.createDataFrame(left, "low long, high long")).collect()}
        used = [x for pair in picked for x in pair]
        assert picked <= set(left) and len(used) == len(set(used)) and picked
        keeper = {high: low for low, high in picked}
        renamed = {tuple(sorted((keeper.get(a, a), keeper.get(b, b)))) for a, b in left}
        left = sorted((a, b) for a, b in renamed if a != b)
        if not left:
            break
    assert taken <= 10 and not left


def test_pages_by_cursor_are_those_by_number(spark):
    from personagraph.operators import search

    rng = random.Random(4)
    data = [(k, f"slug-{k:03}", rng.choice([None, 1, 2, 3, 50, 50, 50])) for k in range(43)]
    rows = spark.createDataFrame(data, "artist_id long, public_slug string, followers long").coalesce(2)
    for up in (True, False):
        value = lambda r: (r[2] is None, (r[2] or 0) if up else -(r[2] or 0), r[1])
        cursor, seen = None, []
        while got := search.page_after(rows, cursor, "followers", up, 10).collect():
            seen += [r.artist_id for r in got]
            cursor = got[-1]
        assert seen == [r[0] for r in sorted(data, key=value)]
        assert [r.artist_id for r in search.page(rows, "followers", up, 99, 10).collect()] == seen[40:]
    assert search.page(rows.filter("false"), number=5).collect() == []


def test_hot_keys_are_few_however_many_rows(spark, monkeypatch):
    facts = spark.range(1000).selectExpr("id % 50 AS k").unionByName(spark.range(900).selectExpr("cast(7 as long) AS k"))
    assert sorted(r.k for r in spread.hot_keys(facts, ["k"], 20).collect()) == list(range(50))
    monkeypatch.setattr(spread, "MOST_HOT", 4)
    assert [r.k for r in spread.hot_keys(facts, ["k"], 20).collect()] == [7]
