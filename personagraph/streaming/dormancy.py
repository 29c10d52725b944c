"""The newest snapshot of every account from a stream, and the accounts that fall silent.

An account's snapshots form a session that ends when nothing was seen of it for a while. Open sessions are the state, kept
by the JVM's own operators; the watermark is the timer that closes them. Nothing is called per account.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import spend

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream tells: ``version`` orders by time what was said of an account; ``dormant`` rows come from closed sessions.
CHANGES = "account_id bigint, version bigint, snapshot_id bigint, captured_at timestamp, dormant boolean"


def newest_changes(snapshots: DataFrame, delay: str, silence: timedelta) -> DataFrame:
    """The stream of CHANGES of a stream of snapshots, which may come out of order and repeatedly.

    Every snapshot is told as it comes. When the watermark (``delay`` behind the newest of all) passes the newest snapshot
    of a session by ``silence``, that snapshot is told again as dormant. A later one ends dormancy. A snapshot that comes
    when its silence is over already opens no session; ``standing`` knows it by what was closed.
    """
    rows = snapshots.filter("account_id is not null and captured_at is not null").select("account_id", "snapshot_id", "captured_at")
    gap = f"{int(silence.total_seconds() * 1000)} milliseconds"
    newest = F.max(F.struct("captured_at", "snapshot_id")).alias("n")
    silent = rows.withWatermark("captured_at", delay).groupBy("account_id", F.session_window("captured_at", gap)).agg(newest)
    return _told(rows, False).unionByName(_told(silent.select("account_id", "n.*"), True))


def _told(rows: DataFrame, dormant: bool) -> DataFrame:
    version = F.unix_micros("captured_at") * 2 + int(dormant)
    return rows.select("account_id", version.alias("version"), "snapshot_id", "captured_at", F.lit(dormant).alias("dormant"))


def run_available(spark: SparkSession, changes: DataFrame, folder: str) -> StreamingQuery:
    """Append the changes of everything that is there to files in ``folder``, then stop."""
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return spend.run_available(changes, folder)
    finally:
        spark.conf.set(PROVIDER, held)


def standing(changes: DataFrame) -> DataFrame:
    """What was last told of every account; of snapshots of one time the larger id is the newest.

    All sessions up to the last closed one are closed, so who was seen no later than that is dormant as well.
    """
    last = F.max(F.struct("captured_at", "snapshot_id", "dormant")).alias("s")
    shut = changes.filter("dormant").agg(F.max("captured_at").alias("_shut"))
    newest = changes.groupBy("account_id").agg(last).join(F.broadcast(shut))
    dormant = F.col("s.dormant") | F.coalesce(F.col("s.captured_at") <= F.col("_shut"), F.lit(False))
    return newest.select("account_id", "s.snapshot_id", "s.captured_at", dormant.alias("dormant"))
