"""The re-read job as a stream: every micro batch changes the buckets of the accounts it names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..operators.evidence import latest_snapshots
from ..operators.store import Store
from ..plans import reextract as re
from ..session import cut_lineage

BOOKED = "rows_read bigint, query string, batch bigint"


def book_of(store: Store) -> DataFrame:
    """query, batch and rows_read of all batches that are done."""
    return store.spark.read.schema(BOOKED).parquet(f"{store.root}/booked")


def booked(store: Store, query: str, number: int) -> bool:
    return not book_of(store).filter((F.col("query") == query) & (F.col("batch") == number)).isEmpty()


def book(store: Store, query: str, number: int, rows: int) -> None:
    """Write down that the batch is done; written again, it is the same."""
    row = store.spark.range(1).select(F.lit(rows).cast("bigint").alias("rows_read"), F.lit(query).alias("query"), F.lit(number).cast("bigint").alias("batch"))
    writer = row.write.partitionBy("query", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{store.root}/booked")


def fold_batch(store: Store, query: str) -> Callable[[DataFrame, int], None]:
    """A batch step that brings the store in line with the snapshots of a batch.

    Snapshots of an account may come in any order: one older than what the account was read from changes nothing.
    A batch that is booked is passed over. One that failed on the way is run again: its time is that of its newest
    snapshot, every merge finds what it wrote before, and the same snapshots are fresh again, so nothing comes twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if booked(store, query, number):
            return
        whole = cut_lineage(re.whole_profiles(batch))
        rows, newest = whole.agg(F.count("*"), F.max("captured_at")).first()
        if rows:
            _change(store, cut_lineage(store.fresh(latest_snapshots(whole))), F.lit(newest).cast("timestamp"))
        book(store, query, number, rows)

    return apply


def _change(store: Store, snapshots: DataFrame, now: Column) -> None:
    read = cut_lineage(re.read_signals(re.readable(store.accounts, snapshots)))
    resolved = store.merge_accounts(re.as_account_refs(re.all_references(read)), now)
    made = cut_lineage(re.produced_edges(resolved))
    store.merge_edges(made, now, scanned=read)
    store.merge_signals("attestations", re.statements_of(read), read, policy.REEXTRACTABLE_ATTESTATIONS, now)
    store.merge_signals("flags", re.markers_of(read), read, policy.REEXTRACTABLE_FLAGS, now)
    store.change_accounts(read, lambda accounts: re.with_contact(accounts, read))
    store.note_latest(read)
