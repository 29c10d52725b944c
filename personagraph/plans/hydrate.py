"""The outcome of a paid look-up of queued X handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..operators import ledger
from ..operators import upsert as up
from ..schemas import State
from ..session import cut_lineage
from ..sources import common as c
from ..sources import twitter

#: Handles that one paid request asks for.
BATCH = 100


def planned_cents(queued: int) -> float:
    return queued * policy.USER_READ_CENTS


def flush(
    state: State, usage: DataFrame, queue: DataFrame, pages: DataFrame, as_of: Column, cap: int = policy.DEFAULT_CAP_CENTS
) -> tuple[State, DataFrame]:
    """Store what the look-up of the handles in ``queue`` (handle) brought; returns the state and the ledger.

    The budget comes first: beyond the cap nothing changes (BudgetExceeded). Found users are stored like any profile;
    handles that the platform does not know are deleted, unless an account under that handle has a native id. Every
    request of up to 100 handles is booked. An empty queue changes nothing.
    """
    handles = cut_lineage(queue.select(F.lower("handle").alias("handle")).filter("handle is not null").distinct())
    queued = handles.count()
    if not queued:
        return state, usage
    ledger.ensure_budget(usage, planned_cents(queued), cap)
    found, missing = twitter.lookup_results(pages, "usernames")
    rows, links = twitter.normalize(found)
    state = c.ingest(state, rows, links, as_of)
    gone = missing.select(F.lower("key").alias("handle")).join(handles, "handle", "left_semi")
    open_rows = state.accounts.filter("platform = 'twitter' and native_id is null")
    lost = open_rows.select("account_id", F.lower("handle").alias("handle")).join(gone, "handle", "left_semi")
    state = state.with_(accounts=cut_lineage(up.mark_deleted(state.accounts, lost, as_of)))
    requests = handles.sparkSession.range(-(-queued // BATCH)).select(
        F.lit("x_api").alias("service"), F.lit("users/by").alias("endpoint"),
        F.least(F.lit(BATCH), F.lit(queued) - F.col("id") * BATCH).cast("int").alias("units"), F.lit("x-tag flush").alias("note"),
    )
    return state, up.append(usage, ledger.bill(requests, policy.USER_READ_CENTS, as_of))
