"""Queries over keys and groups as large copies of the samples have them."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from personagraph import catalog
from personagraph.catalog import streams, world
from personagraph.sources import patreon

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def landed(spark, folder, **tables):
    """Sample tables of the given (rows, schema) as files."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_blogs_updated_after_2038(spark, tmp_path):
    keys = (7, 90_000, 900_000)
    d = landed(
        spark, tmp_path,
        customer=([(k, "c", 1, 1.0, "BUILDING") for k in keys], CUSTOMER), part=([(k, "hot bolt", "Brand#1", "SMALL", 3, 1.0) for k in keys], PART),
    )
    days = {r["handle"]: r["last_day"] for r in catalog.QUERIES["blogs"](spark, d).collect()}
    assert days == {"b7": "2001-09-16", "b90000": "2248-02-07", "b900000": "4465-10-21"}


def test_snowflake_times_of_any_order(spark, tmp_path):
    rows = [(k, 1, "O", 1.0, None, "5-LOW") for k in (5, 8_999_999, 9_300_000)]
    times = catalog.QUERIES["snowflake_times"](spark, landed(spark, tmp_path, orders=(rows, ORDERS)))
    # The last id does not fit into 64 bits, so it is none.
    assert dict(times.collect()) == {5: "2010-11-04 02:02:46", 8_999_999: "2078-11-02 08:05:48", 9_300_000: None}


def test_only_the_tables_a_query_asks_for_are_derived(spark, tmp_path):
    d = str(tmp_path / "samples")
    shutil.copytree("/root/testdata/sf0.001", d)
    catalog.QUERIES["facet_counts"](spark, d).collect()
    assert {name for _, folder, name in world._STORED if folder == d} == {"accounts", "memberships"}
    catalog.QUERIES["review_queue"](spark, d).collect()
    assert {name for _, folder, name in world._STORED if folder == d} == {"accounts", "memberships", "edges"}


def test_no_task_holds_a_whole_slice_of_a_stream(spark, tmp_path):
    rows = spark.range(4000).select("id", (F.lit(1_704_067_200) + F.col("id") * 864).cast("timestamp").alias("at"))
    streams._landed_slices([rows], F.col("at"), 3600, str(tmp_path / "in"))
    per_file = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per_file) == 4000
    assert max(r["count"] for r in per_file) <= 4000 / 4 / streams.SLICE_FILES + streams.SLICE_FILES


def test_dormancy_calls_no_python_per_account(spark, tmp_path):
    """Also: an account that comes when its silence is over is dormant, and a snapshot that comes twice changes nothing."""
    from datetime import datetime, timedelta

    from personagraph.schemas import SNAPSHOTS
    from personagraph.streaming import dormancy, snapshots as st

    def land(*seen):
        rows = [(n, a, at, None, None, None, None, "{}", "x:a") for n, a, at in seen]
        spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    land((1, 1, datetime(2025, 1, 1)), (2, 2, datetime(2025, 1, 1)))
    land((3, 2, datetime(2025, 3, 1)), (2, 2, datetime(2025, 1, 1)))
    land((4, 3, datetime(2025, 1, 1)), (5, 4, datetime(2025, 3, 2)))
    changes = dormancy.newest_changes(st.snapshot_stream(spark, str(tmp_path / "in"), 1), "10 days", timedelta(days=30))
    assert "Python" not in changes._jdf.queryExecution().analyzed().toString() and "InPandas" not in changes._jdf.queryExecution().analyzed().toString()
    dormancy.run_available(spark, changes, str(tmp_path / "out"))
    told = dormancy.standing(spark.read.schema(dormancy.CHANGES).parquet(str(tmp_path / "out" / "rows"))).collect()
    assert sorted((r.account_id, r.snapshot_id, r.dormant) for r in told) == [(1, 1, True), (2, 3, False), (3, 4, True), (4, 5, False)]


def test_text_facts_are_dealt_over_all_partitions(spark):
    from datetime import datetime

    from personagraph.functions import patterns as P
    from personagraph.functions.text import looks_like_artist
    from personagraph.operators.evidence import account_facts
    from personagraph.schemas import SNAPSHOTS, empty_state

    accounts = spark.range(400).select(F.col("id").alias("account_id"), F.lit("twitter").alias("platform"), F.concat(F.lit("h"), "id").alias("handle"))
    state = empty_state(spark)
    accounts = state.accounts.unionByName(accounts, allowMissingColumns=True)
    snaps = spark.createDataFrame([(n, n, datetime(2025, 1, 1), "plain text", None, None, None, "{}", "x:a") for n in range(400)], SNAPSHOTS)
    facts = account_facts(accounts, snaps).select("artist_like", F.spark_partition_id().alias("p"))
    assert facts.select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))

    odd = ["Art", "arts", "start", "ſkeb", "SKetch", "İllustrator", "ıllustrat", "oc", "ocean", "落書き", "", None, "x\nDRAW", "comms", "command"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = F.coalesce(F.col("t").rlike(P.ARTIST_HINTS), F.lit(False))
    assert [r for r in rows.select("t", looks_like_artist(F.col("t")).alias("a"), plain.alias("b")).collect() if r.a != r.b] == []


def _ranked(name, earnings=None, members=None):
    cells = "" if earnings is None else f'<td class="earnings-value"> ${earnings:,}</td>'
    cells += "" if members is None else f'<td class="paid-members-value">{members}</td>'
    return f'<tr>{cells}<td class="creator-column"><a href="/creator/{name}">x</a></td></tr>'


def test_long_ranking_lists_cost_each_token_once(spark):
    """Cells belong to the next creator; a cell that no creator follows to nobody; the later link of a creator counts."""
    rows = [_ranked(f"c{k}", k * 1000, k) for k in range(1, 301)] + [_ranked("bare"), _ranked("c7", 5000)]
    body = "\n".join(rows) + '<td class="paid-members-value">99</td>'
    stats = patreon.list_stats(spark.createDataFrame([(1, body), (2, _ranked("c1", 3))], "page bigint, body string"))
    expected = {(1, f"c{k}", "monthly_earnings_usd", k * 1000) for k in range(1, 301) if k != 7}
    expected |= {(1, f"c{k}", "paid_members", k) for k in range(1, 301)}
    expected |= {(1, "c7", "monthly_earnings_usd", 5000), (2, "c1", "monthly_earnings_usd", 3)}
    assert sorted(map(tuple, stats.collect())) == sorted(expected)
    assert "unboundedfollowing" not in stats._jdf.queryExecution().optimizedPlan().toString().lower()
