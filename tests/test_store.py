"""Bucketed state: merges touch their buckets only, streams fold into it once."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from personagraph.operators import store as s
from personagraph.operators import upsert as up
from personagraph.plans.reextract import reextract
from personagraph.schemas import SNAPSHOTS, STATE_SCHEMAS
from personagraph.streaming import reextract as stream_re
from personagraph.streaming import snapshots as st

from .test_graph import account, as_of, build, edge
from .test_state import ref, refs

EDGE_ROWS = (
    "seq long, source_account_id long, target_account_id long, evidence_type string, evidence_snapshot_id long, "
    "evidence_url string, matched_text string, claim string, relation_hint string"
)


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def made(spark, *pairs):
    return spark.createDataFrame([(k, a, b, "bio_link", 9, None, None, "same_person", None) for k, (a, b) in enumerate(pairs)], EDGE_ROWS)


def test_edge_merge_leaves_other_buckets_alone(spark, tmp_path):
    state = build(spark, edges=[edge(k, k, k + 1) for k in range(1, 60)])
    store = s.Store(spark, str(tmp_path), buckets=16).create(state)
    before = files(tmp_path / "edges")
    produced = made(spark, (3, 4), (3, 50), (77, 1), (5, 5))
    store.merge_edges(produced, as_of)
    after = files(tmp_path / "edges")
    among = store.tables["edges"].touched(produced.select("source_account_id"))
    mine = lambda f: int(f.split("/")[0].removeprefix("bucket=")) in among
    assert {f: t for f, t in before.items() if not mine(f)} == {f: t for f, t in after.items() if not mine(f)}
    assert not set(filter(mine, before)) & set(filter(mine, after))
    whole = up.upsert_edges(state.edges, produced, as_of)
    assert sorted(map(str, store.edges.collect())) == sorted(map(str, whole.collect()))
    store.merge_edges(produced, as_of)  # run again
    assert sorted(map(str, store.edges.collect())) == sorted(map(str, whole.collect()))


def test_account_merge_is_that_of_the_whole_table(spark, tmp_path):
    state = build(spark, accounts=[account(k, handle=f"h{k}", native_id=f"n{k}" if k % 3 else None) for k in range(1, 80)])
    store = s.Store(spark, str(tmp_path), buckets=16).create(state)
    before = files(tmp_path / "accounts")
    said = refs(
        spark, ref(1, "renamed", "n1"), ref(2, "H3", "claims"), ref(3, "h3"), ref(4, "fresh"), ref(5, "Fresh"), ref(6, "new", "n900"),
        ref(7, "h9", None), ref(8, "renamed"), ref(9, "new"),
    )
    whole, want = up.upsert_accounts(state.accounts, said, as_of)
    resolved = store.merge_accounts(said, as_of)
    assert sorted(map(str, store.accounts.collect())) == sorted(map(str, whole.collect()))
    assert {r.seq: r.account_id for r in resolved.collect()} == {r.seq: r.account_id for r in want.collect()}
    kept = set(before) & set(files(tmp_path / "accounts"))
    assert len(kept) >= 8  # three old accounts, and new rows that go to files of their own
    store.merge_accounts(said, as_of)
    assert store.accounts.count() == whole.count()


def test_empty_store_and_empty_changes(spark, tmp_path):
    store = s.Store(spark, str(tmp_path), buckets=4).create(build(spark))
    assert store.edges.count() == 0 and store.latest.read().count() == 0
    store.merge_edges(made(spark), as_of)
    assert store.merge_accounts(refs(spark), as_of).count() == 0
    store.merge_edges(made(spark, (1, 2)), as_of)
    assert [tuple(r)[:4] for r in store.edges.collect()] == [(1, 1, 2, "bio_link")]


TEXTS = [
    "illustrator #NoAI https://skeb.jp/@ann commissions open", "art account nsfw 18+ https://www.pixiv.net/users/7", "comms closed",
    "my zine https://skeb.jp/@bob and @carol", "#NoAI #NoAI mail me@example.org", "",
]


def snapshots(spark, n=60):
    start = datetime(2025, 1, 1)
    data = [
        (k, k * 7 % 12, start + timedelta(hours=(k * 37) % 90), TEXTS[k * 5 % 6], None, None, None, "{}", "x:hydration" if k % 11 else "x:entity")
        for k in range(n)
    ]
    return spark.createDataFrame(data, SNAPSHOTS)


def told(accounts, edges, attestations, flags):
    """What both ways must agree on: live signals and edges by the names of their ends."""
    names = {r.account_id: (r.platform, r.handle.lower()) for r in accounts.collect()}
    return (
        sorted(names.values()),
        sorted((names[r.source_account_id], names[r.target_account_id], r.evidence_type, r.evidence_snapshot_id) for r in edges.collect() if r.status == "present"),
        sorted((r.account_id, r.signal, r.matched_text, r.evidence_snapshot_id) for r in attestations.collect() if r.active),
        sorted((r.account_id, r.signal, r.matched_text, r.evidence_snapshot_id) for r in flags.collect() if r.active),
    )


def test_stream_with_replayed_and_broken_batches_equals_the_batch_job(spark, tmp_path, monkeypatch):
    accounts = [account(k, handle=f"h{k}") for k in range(12)]
    rows = snapshots(spark)
    for part in range(3):
        rows.filter(F.col("snapshot_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = s.Store(spark, str(tmp_path / "store"), buckets=4).create(build(spark, accounts=accounts))
    fold = stream_re.fold_batch(store, "profiles")

    def twice(batch, number):
        if number == 1:
            with monkeypatch.context() as m:  # everything is done but not booked, as if the driver had gone
                m.setattr(stream_re, "book", lambda *a: None)
                fold(batch, number)
        fold(batch, number)
        files_now = files(tmp_path / "store")
        fold(batch, number)  # booked: nothing is written
        assert files(tmp_path / "store") == files_now

    st.run_available(st.snapshot_stream(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "ckpt"), twice)
    assert sorted((r.query, r.batch) for r in stream_re.book_of(store).collect()) == [("profiles", 0), ("profiles", 1), ("profiles", 2)]
    batch = reextract(build(spark, accounts=accounts, snapshots=[r.asDict() for r in rows.collect()]), datetime(2025, 2, 1))
    streamed = told(store.accounts, store.edges, store.attestations, store.flags)
    whole = told(batch.accounts, batch.edges, batch.attestations, batch.flags)
    assert streamed[1:] == whole[1:] and all(streamed[1:])
    assert set(whole[0]) <= set(streamed[0])  # the stream also met accounts that only older texts named
    assert set(STATE_SCHEMAS) >= set(store.tables)
