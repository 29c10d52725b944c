"""Queries that run as streams over files of whole tables, and the state they leave."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import upsert as up
from ..operators.store import Store
from ..schemas import SNAPSHOTS, empty_state
from ..session import shared_folder
from ..streaming import dormancy, snapshots as st, spend
from ..streaming.reextract import fold_batch
from . import world as w
from .registry import query, stamp
from .world import oracle

DAY = 86400
FIRST_ORDER = "1995-01-01"


#: Files of a slice of a stream: one batch reads as many, each in tasks of its own.
SLICE_FILES = 16


def _land(rows, folder):
    """Append rows as SLICE_FILES files, none of them empty unless the rows are few."""
    rows.repartition(SLICE_FILES).write.mode("append").parquet(folder)


def _landed_slices(frames, moment, disorder, folder, slices=4, span=10 * DAY, first="2024-01-01"):
    """Rows as files by time, each row up to ``disorder`` seconds late, a frame after the other within a slice; the last
    slice holds all that follows."""
    start = F.unix_seconds(F.lit(first).cast("timestamp"))
    for k in range(slices):
        for salt, rows in enumerate(frames):
            arrival = F.unix_seconds(moment) + F.pmod(F.xxhash64(*rows.columns, F.lit(salt)), F.lit(disorder))
            number = F.least(F.floor((arrival - start) / span), F.lit(slices - 1))
            _land(rows.filter(number == k), folder)


@w.stored
def snapshots_told(spark, d):
    """All snapshots arrive as files, up to two days out of order; what the keyed state tells of every account."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _landed_slices([w.snapshots(spark, d)], F.col("captured_at"), 2 * DAY, f"{base}/in")
    changes = dormancy.newest_changes(st.snapshot_stream(spark, f"{base}/in", SLICE_FILES), "2 days", timedelta(days=7))
    dormancy.run_available(spark, changes, base)
    return dormancy.standing(spark.read.schema(dormancy.CHANGES).parquet(f"{base}/rows"))


NEWEST = "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snapshots"


@query("snapshot_stream", oracle(f"""
SELECT account_id, snapshot_id FROM ({NEWEST}) WHERE rn = 1"""))
def snapshot_stream(spark, d):
    return snapshots_told(spark, d).select("account_id", "snapshot_id")


@query("dormant_by_timer", """
WITH seen AS (SELECT o_custkey AS account_id, max(o_orderdate)::TIMESTAMP AS last_seen FROM orders GROUP BY 1)
SELECT account_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM seen
WHERE last_seen + INTERVAL 180 DAY <= (SELECT max(o_orderdate)::TIMESTAMP - INTERVAL 30 DAY FROM orders)""")
def dormant_by_timer(spark, d):
    """Every order is a sighting of its customer, up to a month out of order; who the timer told to be dormant and nothing woke."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    seen = w.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("timestamp").alias("captured_at")
    )
    seen = up.align(seen, spark.createDataFrame([], SNAPSHOTS))
    _landed_slices([seen], F.col("captured_at"), 30 * DAY, f"{base}/in", slices=5, span=500 * DAY, first=FIRST_ORDER)
    changes = dormancy.newest_changes(st.snapshot_stream(spark, f"{base}/in", SLICE_FILES), "30 days", timedelta(days=180))
    dormancy.run_available(spark, changes, base)
    told = dormancy.standing(spark.read.schema(dormancy.CHANGES).parquet(f"{base}/rows"))
    return told.filter("dormant").select("account_id", stamp("captured_at").alias("last_seen"))


@query("stream_signals", oracle("""
, read AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events e),
newest AS (SELECT user_id AS account_id, event_id, event_type FROM read JOIN accounts a ON a.account_id = user_id JOIN platforms p USING (platform) WHERE rn = 1 AND kind <> 'link_hub')
SELECT 'attestations' AS told, account_id, 'bio_tag' AS signal, '#NoAI' AS matched_text, event_id AS evidence_snapshot_id FROM newest WHERE event_type = 'click'
UNION ALL SELECT 'flags', account_id, 'bio_marker', m, event_id FROM newest, (VALUES ('18+'), ('nsfw')) t(m) WHERE event_type = 'purchase'"""))
def stream_signals(spark, d):
    """Profiles seen in the events, read as a stream into bucketed state, the second batch delivered twice."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = w.snapshots(spark, d).filter("fetch_source <> 'x:hydration'")
    for k in range(3):
        _land(events.filter(F.col("snapshot_id") % 3 == k), f"{base}/in")
    store = Store(spark, f"{base}/state", buckets=8).create(empty_state(spark, accounts=w.accounts(spark, d)))
    fold = fold_batch(store, "profiles")

    def step(batch, number):
        fold(batch, number)
        if number == 1:
            fold(batch, number)

    st.run_available(st.snapshot_stream(spark, f"{base}/in", SLICE_FILES), f"{base}/checkpoint", step)
    live = [getattr(store, name).filter("active").select(F.lit(name).alias("told"), "account_id", "signal", "matched_text", "evidence_snapshot_id") for name in ("attestations", "flags")]
    return live[0].unionByName(live[1])


@query("spend_windows", oracle("""
SELECT service, strftime(date_trunc('hour', occurred_at), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(est_cost_cents) AS BIGINT) AS cents, CAST(sum(units) AS BIGINT) AS units FROM usage GROUP BY service, date_trunc('hour', occurred_at)"""))
def spend_windows(spark, d):
    rows = spend.spend_per_window(w.usage(spark, d))
    return rows.select("service", stamp("window_start").alias("window_start"), "cents", "units")


@w.stored
def spend_told(spark, d):
    """Bookings arrive up to an hour late and every third one twice; a booking of the first days comes last of all."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    numbered = w.bookings(spark, d)
    again = numbered.filter(F.col("booking_id") % 3 == 0)
    _landed_slices([numbered, again], F.col("occurred_at"), 3600, f"{base}/in", slices=3)
    late = numbered.filter("occurred_at < timestamp '2024-01-03'").withColumn("booking_id", -F.col("booking_id") - 1)
    _land(late, f"{base}/in")
    windows = spend.spend_per_window(spend.usage_stream(spark, f"{base}/in", SLICE_FILES))
    spend.run_available(windows, base)
    return spark.read.schema("service string, window_start timestamp, cents bigint, units bigint").parquet(f"{base}/rows")


SPENT = """
, told AS (SELECT service, date_trunc('hour', occurred_at) AS hour, CAST(sum(est_cost_cents) AS BIGINT) AS cents, CAST(sum(units) AS BIGINT) AS units FROM usage GROUP BY ALL),
shut AS (SELECT * FROM told WHERE hour + INTERVAL 1 HOUR <= (SELECT max(occurred_at) - INTERVAL 2 HOUR FROM usage))"""


@query("spend_stream", oracle(SPENT + """
SELECT service, strftime(hour, '%Y-%m-%d %H:%M:%S') AS window_start, cents, units FROM shut"""))
def spend_stream(spark, d):
    """Windows that the watermark has passed, each told once."""
    return spend_told(spark, d).select("service", stamp("window_start").alias("window_start"), "cents", "units")


@query("spend_alerts", oracle(SPENT + """
SELECT service, strftime(hour, '%Y-%m-%d %H:%M:%S') AS window_start, cents FROM shut WHERE cents > 300"""))
def spend_alerts(spark, d):
    return spend.over_cap(spend_told(spark, d), 300).select("service", stamp("window_start").alias("window_start"), "cents")
