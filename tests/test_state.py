"""State changes: identity, upserts, decisions, the re-read job, streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from personagraph.operators import checks, decisions, ledger, reports, upsert as up
from personagraph.operators.counters import Counters
from personagraph.plans import hydrate
from personagraph.plans.reextract import reextract
from personagraph.schemas import API_USAGE, SNAPSHOTS
from personagraph.session import cut_lineage
from personagraph.sources import common as c
from personagraph.sources import hubs
from personagraph.streaming import dormancy, snapshots as st, spend

from .test_graph import NOW, account, artist, as_of, build, edge, homes, member, rows


def refs(spark, *items):
    names = [f.split()[0] for f in up.ACCOUNT_REFS.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], up.ACCOUNT_REFS)


def ref(seq, handle, native=None, **more):
    return {**dict(seq=seq, platform="twitter", native_id=native, handle=handle, status="active", discovered_via="bio_link", hydrated=False), **more}


def test_account_identity(spark):
    stored = rows(
        spark, "accounts",
        account(1, handle="Known"), account(2, native_id=None, handle="OpenRow", status="unknown"), account(3, handle="shy", status="hidden"),
    )
    made, resolved = up.upsert_accounts(
        stored,
        refs(
            spark, ref(1, "renamed", "n1", display_name=None), ref(2, "openrow", "new9"), ref(3, "SHY", "n3"), ref(4, "KNOWN2"), ref(5, "known2"),
            ref(6, "fresh", "n77", hydrated=True), ref(7, "Fresh"),
        ),
        as_of,
    )
    got = {r.account_id: r for r in made.collect()}
    assert len(got) == 5
    assert got[1].handle == "renamed" and got[1].display_name == "Artist 1"
    assert got[2].native_id == "new9" and got[2].status == "active"
    assert got[3].status == "hidden"
    ids = {r.seq: r.account_id for r in resolved.collect()}
    assert ids[1] == 1 and ids[2] == 2 and ids[3] == 3 and ids[4] == ids[5] and ids[6] == ids[7]
    assert got[ids[6]].last_hydrated is not None and got[ids[4]].last_hydrated is None

    again, _ = up.upsert_accounts(made, refs(spark, ref(4, "known2"), ref(6, "fresh", "n77")), as_of)
    assert again.count() == 5


def test_dismissed_edges_stay_dismissed(spark):
    stored = rows(spark, "edges", edge(1, 1, 2, status="dismissed"), edge(2, 1, 3, status="retracted"))
    new = spark.createDataFrame(
        [(1, 1, 2, "bio_link", 5, None, None, "same_person", None), (2, 1, 3, "bio_link", 5, None, None, "related", "x"),
         (3, 1, 4, "bio_link", 5, None, None, "same_person", None), (4, 1, 1, "bio_link", 5, None, None, "same_person", None)],
        "seq long, source_account_id long, target_account_id long, evidence_type string, evidence_snapshot_id long, "
        "evidence_url string, matched_text string, claim string, relation_hint string",
    )
    got = {r.target_account_id: (r.status, r.claim) for r in up.upsert_edges(stored, new, as_of).collect()}
    assert got == {2: ("dismissed", "same_person"), 3: ("present", "related"), 4: ("present", "same_person")}


def test_reread_is_idempotent_and_repairs(spark):
    state = build(
        spark,
        accounts=[account(1, handle="me"), account(2, "pixiv", native_id="5", handle="5"), account(3, "kofi", native_id=None, handle="old", status="unknown")],
        edges=[edge(1, 1, 3)],
        artists=[artist(1)],
        memberships=[member(1, 1), member(1, 3, "strong")],
        events=[dict(artist_id=1, event="account_added", actor="pipeline", account_id=3, edge_id=1, created_at=NOW)],
        snapshots=[
            dict(snapshot_id=1, account_id=1, captured_at=datetime(2025, 1, 1), bio_text="ko-fi.com/old", raw="{}", fetch_source="x:a"),
            dict(snapshot_id=2, account_id=1, captured_at=datetime(2025, 2, 1), bio_text="pixiv.net/users/5 x.com/me alt: @other #NoAI",
                 raw='{"location":"comms open","entities":{"url":{"urls":[{"expanded_url":"https://skeb.jp/@me"}]}}}', fetch_source="x:a"),
        ],
        attestations=[dict(account_id=1, signal="bio_tag", matched_text="#noai_old", evidence_snapshot_id=1, active=True)],
    )
    done = reextract(state, NOW)
    edges = {(r.evidence_type, r.target_account_id): r.status for r in done.edges.collect()}
    names = {r.account_id: (r.platform, r.handle) for r in done.accounts.collect()}
    assert edges[("bio_link", 3)] == "retracted" and edges[("bio_link", 2)] == "present"
    assert sorted(names.values()) == [("kofi", "old"), ("pixiv", "5"), ("skeb", "me"), ("twitter", "me"), ("twitter", "other")]
    assert 3 not in homes(done)
    assert {(r.matched_text, r.active) for r in done.attestations.collect()} == {("#noai_old", False), ("#NoAI", True)}
    assert done.accounts.filter("account_id = 1").first().commission_status == "open"
    again = reextract(done, NOW)
    assert again.accounts.count() == done.accounts.count()
    assert sorted(map(str, again.edges.drop("last_verified").collect())) == sorted(map(str, done.edges.drop("last_verified").collect()))
    assert again.events.count() == done.events.count()


def made(spark, *items):
    schema = "decision_id long, kind string, artist_id long, account_id long, item_id long, payload string, actor string, at timestamp"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple({"decision_id": n, **i}.get(x) for x in names) for n, i in enumerate(items)], schema)


def test_decisions(spark):
    state = build(
        spark,
        accounts=[account(1), account(2, "pixiv"), account(3, "kofi"), account(4, "skeb"), account(5, "tumblr"), account(6, "vgen"),
                  account(7, native_id=None, handle="tagme", via="bio_link", status="deleted", last_hydrated=None)],
        edges=[edge(1, 1, 2), edge(2, 1, 3, claim="related"), edge(3, 1, 5, claim="related"), edge(4, 6, 4, claim="related")],
        artists=[artist(1), artist(2), artist(3, status="needs_review")],
        memberships=[member(1, 1), member(1, 2), member(2, 4)],
        reviews=[
            dict(item_id=1, kind="cluster_merge", review_key="1,2", artist_id=1, other_artist_id=2, status="pending", created_at=NOW),
            dict(item_id=2, kind="singleton_gate", review_key="6", account_id=6, status="pending", created_at=NOW),
        ],
    )
    batch = made(
        spark,
        dict(kind="detach", artist_id=1, account_id=2), dict(kind="confirm", artist_id=1, account_id=3), dict(kind="dismiss", artist_id=1, account_id=5),
        dict(kind="add_account", artist_id=1, payload="https://www.inprnt.com/gallery/me/"), dict(kind="restore", artist_id=3),
        dict(kind="approve", item_id=1), dict(kind="approve", item_id=2), dict(kind="tag", payload="@TagMe "),
    )
    done = decisions.apply_decisions(state, batch, as_of)
    at = homes(done)
    assert 2 not in at and at[3] == 1 and at[4] == 1 and 5 not in at and 6 in at
    hints = {r.edge_id: (r.status, r.claim, r.relation_hint) for r in done.edges.collect()}
    assert hints[1] == ("present", "related", "manual_detach")
    assert hints[2] == ("present", "same_person", "manual_confirm")
    assert hints[3][0] == "dismissed"
    printed = done.accounts.filter("platform = 'inprnt'").first()
    assert printed.handle == "me" and at[printed.account_id] == 1
    assert done.artists.filter("artist_id = 3").first().status == "active"
    assert done.artists.filter("artist_id = 2").first().merged_into == 1
    assert {r.status for r in done.reviews.collect()} == {"approved"}
    tagged = done.accounts.filter("account_id = 7").first()
    assert (tagged.discovered_via, tagged.status) == ("manual_tag", "unknown")
    assert {r.violations for r in checks.state_violations(done).collect()} == {0}


def test_request_size_is_an_error_not_a_cut(spark):
    asked = spark.createDataFrame([(f"h{i}",) for i in range(12)], "handle string")
    with pytest.raises(ValueError):
        reports.check_request(asked, limit=10)
    reports.check_request(asked, limit=12)
    assert reports.clean_handles(asked).count() == 12


def test_budget(spark):
    usage = spark.createDataFrame([("x_api", "u", 10, 9000, NOW, None)], API_USAGE)
    ledger.ensure_budget(usage, 1000)
    with pytest.raises(ledger.BudgetExceeded):
        ledger.ensure_budget(usage, 1001)


def test_hub_crawl(spark):
    state = build(
        spark,
        accounts=[account(1, "potofu", handle="hub", profile_url="https://potofu.me/hub", status="unknown", last_hydrated=None),
                  account(2, "potofu", handle="lost", profile_url="https://potofu.me/lost")],
        edges=[edge(1, 1, 2, kind="link_hub")],
    )
    body = (
        '<meta property="og:title" content="Me | POTOFU | POTOFU"><meta property="og:description" content="#NoAI">'
        '<a href="https:\\/\\/x.com\\/me"></a><a href="https://x.com/potofu_me"></a><a href="https://me.example.org/"></a>'
    )
    landed = spark.createDataFrame(
        [("hub:page", "https://potofu.me/hub", NOW, 200, body), ("hub:page", "https://potofu.me/lost", NOW, 404, None)],
        "source string, key string, fetched_at timestamp, status_code int, body string",
    )
    done = hubs.crawl(state, landed, as_of)
    accounts = {r.account_id: r for r in done.accounts.collect()}
    assert accounts[1].display_name == "Me" and accounts[1].status == "active" and accounts[2].status == "deleted"
    edges = {(r.target_account_id): (r.status, r.claim) for r in done.edges.collect()}
    assert edges.pop(2) == ("retracted", "same_person")
    assert sorted(edges.values()) == [("present", "related"), ("present", "same_person")]
    assert [r.signal for r in done.attestations.collect()] == ["bio_tag"]


def test_payload_helpers(spark):
    landed = spark.createDataFrame(
        [("s", "a", datetime(2025, 1, 1), 200, "old"), ("s", "a", datetime(2025, 1, 2), 200, "new"), ("s", "b", NOW, 404, None)],
        "source string, key string, fetched_at timestamp, status_code int, body string",
    )
    assert [r.body for r in c.bodies(landed, "s").collect()] == ["new"]
    assert [r.key for r in c.gone(landed, "s").collect()] == ["b"]


def test_newest_snapshots_as_keyed_state(spark, tmp_path):
    """Out of order, repeated, and an account that falls dormant and wakes up."""
    data = [(n, n % 5, datetime(2025, 1, 1 + (n * 7) % 10), f"bio {n}", None, None, None, "{}", "x:a") for n in range(40)]
    data += [(100, 2, datetime(2025, 2, 20), "back", None, None, None, "{}", "x:a"), (101, 9, datetime(2025, 3, 30), "", None, None, None, "{}", "x:a")]
    df = spark.createDataFrame(data, SNAPSHOTS)
    first = F.col("snapshot_id") < 40
    for part in (first & (F.col("snapshot_id") % 2 == 1), first, F.col("snapshot_id") == 100, F.col("snapshot_id") == 101):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    dormancy.run_available(spark, dormancy.newest_changes(stream, "10 days", timedelta(days=30)), str(tmp_path / "out"))
    changes = spark.read.schema(dormancy.CHANGES).parquet(str(tmp_path / "out" / "rows"))
    got = dormancy.standing(changes).collect()
    from personagraph.operators.evidence import latest_snapshots

    assert sorted((r.account_id, r.snapshot_id) for r in got) == sorted((r.account_id, r.snapshot_id) for r in latest_snapshots(df).collect())
    assert {r.account_id for r in got if r.dormant} == {0, 1, 3, 4}
    told = [r for r in changes.collect() if r.account_id == 2]
    assert [r.dormant for r in sorted(told, key=lambda r: r.version)][-1] is False


def test_spend_stream(spark, tmp_path):
    def land(*rows):
        spark.createDataFrame(rows, spend.BOOKINGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def booked(k, cents, *at):
        return k, "x_api", "u", 1, cents, datetime(2025, 1, *at), None

    land(booked(1, 100, 1, 3, 10), booked(2, 50, 1, 3, 50), booked(2, 50, 1, 3, 50))
    land(booked(1, 100, 1, 3, 10), booked(3, 9, 1, 3, 20), booked(4, 1, 1, 9, 0))  # one again, one late but in time
    land(booked(7, 4, 1, 9, 30))
    land(booked(5, 1000, 1, 3, 30), booked(6, 7, 3, 3, 50))  # too late by the watermark of the batch before
    windows = spend.spend_per_window(spend.usage_stream(spark, str(tmp_path / "in"), 1))
    spend.run_available(windows, str(tmp_path / "out"))
    told = spark.read.parquet(str(tmp_path / "out" / "rows"))
    assert sorted(r.cents for r in told.collect()) == [5, 159]  # the last window is still open
    assert [r.cents for r in spend.over_cap(told, 100).collect()] == [159]


def x_page(spark, found, missing):
    body = json.dumps({"data": [{"id": i, "username": u, "name": u} for i, u in found], "errors": [{"parameter": "usernames", "value": h} for h in missing]})
    return spark.createDataFrame([("x:lookup", "1", NOW, 200, body)], "source string, key string, fetched_at timestamp, status_code int, body string")


def test_flush_outcome(spark):
    state = build(
        spark,
        accounts=[account(1, handle="Ann", native_id=None, status="unknown", last_hydrated=None), account(2, handle="gone", native_id=None, status="unknown"),
                  account(3, handle="kept", native_id="n3"), account(4, "pixiv", handle="gone", native_id=None)],
    )
    queue = spark.createDataFrame([("Ann",), ("ann",), ("GONE",), ("kept",), (None,)], "handle string")
    pages = x_page(spark, [("77", "ann")], ["gone", "kept", "stranger"])
    usage = spark.createDataFrame([], API_USAGE)
    with pytest.raises(ledger.BudgetExceeded):
        hydrate.flush(state, usage, queue, pages, as_of, cap=2)
    done, booked = hydrate.flush(state, usage, queue, pages, as_of, cap=3)
    got = {r.account_id: r for r in done.accounts.collect()}
    assert got[1].native_id == "77" and got[1].status == "active" and got[1].last_hydrated is not None
    assert got[2].status == "deleted" and got[3].status == "active" and got[4].status == "active" and len(got) == 4
    assert [(r.units, r.est_cost_cents) for r in booked.collect()] == [(3, 3)]
    same, none = hydrate.flush(state, usage, queue.filter("false"), pages, as_of, cap=0)
    assert same is state and none is usage


def test_counters_need_no_job_of_their_own(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("n"))

    def jobs(counted):
        spark.sparkContext.setJobGroup(f"counted-{counted}", "")
        frame = counters.watch(rows, "rows", even=F.count_if(F.col("n") % 2 == 0), none=F.sum(F.lit(None).cast("int"))) if counted else rows
        cut_lineage(frame)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"counted-{counted}"))

    counters = Counters("r")
    assert jobs(True) == jobs(False) > 0
    assert sorted(tuple(r) for r in counters.table(spark).collect()) == [("r", "rows", "even", 57), ("r", "rows", "none", 0), ("r", "rows", "rows", 100)]


@pytest.mark.parametrize(
    "said", [[(1, 2), (2, 3), (3, 1)], [(1, 3), (2, 3)], [(2, 1), (3, 2)], [(1, 2), (2, 1)]], ids=["ring", "competing", "chain", "crossed"]
)
def test_confirmations_of_one_batch_all_count(spark, said):
    state = build(
        spark,
        accounts=[account(k, p) for k, p in [(1, "twitter"), (2, "pixiv"), (3, "kofi")]],
        edges=[edge(k, k, k % 3 + 1, claim="related") for k in (1, 2, 3)],
        artists=[artist(1), artist(2), artist(3)],
        memberships=[member(k, k) for k in (1, 2, 3)],
    )
    done = decisions.confirm(state, made(spark, *[dict(kind="confirm", artist_id=a, account_id=b) for a, b in said]), as_of)
    at = homes(done)
    linked = {k for pair in said for k in pair}
    keeper = 3 if said == [(2, 1), (3, 2)] else 1
    assert {at[k] for k in linked} == {keeper}
    merged = {r.artist_id: r.merged_into for r in done.artists.collect()}
    assert all(merged[k] == (None if k == keeper else keeper) for k in linked)


def test_misfiled_websites_move(spark):
    from personagraph.operators import hygiene

    sites = rows(
        spark, "accounts",
        account(1, "website", native_id=None, handle="weibo.com/SomeName"),
        account(2, "website", native_id=None, handle="weibo.com/u/1234567"),
        account(3, "website", native_id=None, handle="facebook.com/some.one"),
        account(4, "website", native_id=None, handle="facebook.com/groups/x12345"),
        account(5, "website", native_id=None, handle="old", profile_url="https://twpf.jp/newer"),
    )
    got = {r.account_id: (r.platform, r.handle, r.native_id) for r in hygiene.reclassify_websites(sites).collect()}
    assert got == {
        1: ("weibo", "SomeName", None), 2: ("weibo", "1234567", "1234567"), 3: ("facebook", "some.one", None),
        4: ("website", "facebook.com/groups/x12345", None), 5: ("twpf", "newer", None),
    }
