"""State tables laid out in buckets, and merges that rewrite the touched buckets alone.

A table is partitioned by a bucket number worked out from its key. A merge finds the buckets that the changes touch,
reads those, and overwrites those (dynamic partition overwrite); files of all other buckets stay as they are. Each
merge leaves what it changed the same when it is run again, so a job that fails between two of them is run again whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATE_SCHEMAS, State
from ..session import cut_lineage
from . import upsert as up

BUCKET = "bucket"
BUCKETS = 256
LATEST = "account_id bigint, snapshot_id bigint, captured_at timestamp"


def bucket_of(key: str | Column, buckets: int) -> Column:
    """Bucket number of a key: from its MD5, which other engines work out alike."""
    text = F.md5((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary"))
    return (F.conv(F.substring(text, 1, 7), 16, 10).cast("bigint") % buckets).cast("int")


@dataclass(frozen=True)
class Buckets:
    """A table in a folder, partitioned by the bucket of ``key``."""

    spark: SparkSession
    folder: str
    schema: str
    key: str
    buckets: int = BUCKETS

    def _write(self, placed: DataFrame, mode: str) -> None:
        """Rows go to files by bucket; a bucket that is far larger than others is dealt over several tasks."""
        out = placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).mode(mode)
        out.option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def create(self, rows: DataFrame) -> None:
        self._write(up.align(rows, self.empty()).withColumn(BUCKET, bucket_of(self.key, self.buckets)), "errorifexists")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, among: list[int] | None = None) -> DataFrame:
        """The table, or the buckets named. What was read before a `put` is not to be used after it."""
        stored = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.folder)
        return (stored if among is None else stored.filter(F.col(BUCKET).isin(among))).drop(BUCKET)

    def touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the buckets of the keys (the first column): no more than there are buckets."""
        numbers = keys.select(bucket_of(F.col(keys.columns[0]), self.buckets).alias(BUCKET)).distinct()
        return sorted(r[0] for r in numbers.collect() if r[0] is not None)

    def put(self, rows: DataFrame, among: list[int]) -> None:
        """Store ``rows``: all rows of the buckets ``among``, and new rows of any others. No bucket gets empty."""
        placed = cut_lineage(up.align(rows, self.empty()).withColumn(BUCKET, bucket_of(self.key, self.buckets)))
        mine = F.col(BUCKET).isin(among)
        if among:
            self._write(placed.filter(mine), "overwrite")
        if not placed.filter(~mine).isEmpty():
            self._write(placed.filter(~mine), "append")


class Store:
    """The state tables that batches of profiles change, below one folder."""

    KEYS = {"accounts": "account_id", "edges": "source_account_id", "attestations": "account_id", "flags": "account_id"}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root
        self.tables = {n: Buckets(spark, f"{root}/{n}", STATE_SCHEMAS[n], k, buckets) for n, k in self.KEYS.items()}
        #: The snapshot that each account was last read from.
        self.latest = Buckets(spark, f"{root}/latest", LATEST, "account_id", buckets)

    def create(self, state: State) -> "Store":
        for name, table in self.tables.items():
            table.create(getattr(state, name))
        self.latest.create(self.latest.empty())
        none = self.spark.createDataFrame([], "rows_read bigint, query string, batch bigint")
        none.write.partitionBy("query", "batch").parquet(f"{self.root}/booked")
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in Store.KEYS:
            return self.tables[name].read()
        raise AttributeError(name)

    def merge_accounts(self, refs: DataFrame, as_of: Column) -> DataFrame:
        """Refresh or create the accounts that ``refs`` name (U01, U02); returns the references with account_id."""
        table = self.tables["accounts"]
        names = table.read().select("account_id", "platform", "native_id", F.lower("handle").alias("_low"))
        natives = refs.select("platform", "native_id").filter("native_id is not null").distinct()
        handles = refs.select("platform", F.lower("handle").alias("_low")).distinct()
        met = names.join(natives, ["platform", "native_id"], "left_semi").select("account_id")
        met = met.unionByName(names.join(handles, ["platform", "_low"], "left_semi").select("account_id"))
        among = table.touched(met)
        accounts, resolved = up.upsert_accounts(table.read(among), refs, as_of, ids=names)
        resolved = cut_lineage(resolved)
        table.put(accounts, among)
        return resolved

    def change_accounts(self, changes: DataFrame, change) -> None:
        """Rewrite the buckets of the accounts in ``changes`` with what ``change`` (accounts) returns."""
        table = self.tables["accounts"]
        among = table.touched(changes.select("account_id"))
        table.put(change(table.read(among)), among)

    def merge_edges(self, produced: DataFrame, as_of: Column, scanned: DataFrame | None = None) -> None:
        """Refresh or add the produced edges; with ``scanned`` also retract present links and mentions of these accounts
        that were not produced again (U07)."""
        table = self.tables["edges"]
        sources = produced.select(F.col("source_account_id").alias("account_id"))
        among = table.touched(sources if scanned is None else sources.unionByName(scanned.select("account_id")))
        edges = up.upsert_edges(table.read(among), produced, as_of, ids=table.read().select("edge_id"))
        if scanned is not None:
            edges, _ = up.retract_missing(edges, produced, scanned, ["bio_link"], keep=up.short_link_evidence())
            edges, _ = up.retract_missing(edges, produced, scanned, ["bio_mention"])
        table.put(edges, among)

    def merge_signals(self, name: str, produced: DataFrame, scanned: DataFrame, signals: list[str], as_of: Column) -> None:
        """Signals that a re-read text yields are active (U03); those of ``signals`` that it does not yield are not (U05)."""
        keys = ["account_id", "signal"] if name == "attestations" else ["account_id", "flag", "signal"]
        table = self.tables[name]
        both = produced.select("account_id").unionByName(scanned.select("account_id"))
        among = table.touched(both)
        merged = up.upsert_signals(table.read(among), produced, keys, as_of)
        table.put(up.deactivate_missing(merged, produced, scanned, signals, keys), among)

    def note_latest(self, rows: DataFrame) -> None:
        """Remember the snapshots that accounts were read from; an older one never replaces a newer."""
        among = self.latest.touched(rows.select("account_id"))
        all_rows = self.latest.read(among).unionByName(rows.select("account_id", "snapshot_id", "captured_at"))
        newest = F.max(F.struct("captured_at", "snapshot_id")).alias("n")
        self.latest.put(all_rows.groupBy("account_id").agg(newest).select("account_id", "n.snapshot_id", "n.captured_at"), among)

    def fresh(self, snapshots: DataFrame) -> DataFrame:
        """Of ``snapshots`` those that are not older than what their account was last read from."""
        held = self.latest.read(self.latest.touched(snapshots.select("account_id")))
        held = held.select("account_id", F.struct("captured_at", "snapshot_id").alias("_held"))
        joined = snapshots.join(held, "account_id", "left")
        mine = F.struct("captured_at", "snapshot_id")
        return joined.filter(F.col("_held").isNull() | (mine >= F.col("_held"))).drop("_held")
