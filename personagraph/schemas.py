"""Schemas of the state tables, as DDL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from types import FunctionType

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS = (
    "account_id bigint, platform string, native_id string, handle string, display_name string, "
    "profile_url string, status string, followers_count bigint, discovered_via string, "
    "discovery_details map<string,string>, first_seen timestamp, last_hydrated timestamp, "
    "last_post_at timestamp, contact_email string, commission_status string, "
    "commission_confidence double, commission_detail string, commission_checked_at timestamp, "
    "link_checked_at timestamp, platform_stats map<string,string>, avatar_url string, project boolean"
)
SNAPSHOTS = (
    "snapshot_id bigint, account_id bigint, captured_at timestamp, bio_text string, "
    "display_name string, followers_count bigint, following_count bigint, raw string, fetch_source string"
)
EDGES = (
    "edge_id bigint, source_account_id bigint, target_account_id bigint, evidence_type string, "
    "evidence_snapshot_id bigint, evidence_url string, matched_text string, claim string, "
    "relation_hint string, status string, first_seen timestamp, last_verified timestamp"
)
ARTISTS = (
    "artist_id bigint, public_slug string, display_name string, region string, "
    "region_confidence double, region_source string, language string, primary_account_id bigint, "
    "status string, merged_into bigint, created_at timestamp, updated_at timestamp"
)
MEMBERSHIPS = (
    "artist_id bigint, account_id bigint, confidence string, added_by string, "
    "added_at timestamp, removed_at timestamp"
)
EVENTS = (
    "artist_id bigint, event string, actor string, account_id bigint, edge_id bigint, "
    "reason string, into_artist_id bigint, created_at timestamp"
)
ATTESTATIONS = (
    "account_id bigint, signal string, matched_text string, evidence_snapshot_id bigint, "
    "first_seen timestamp, last_seen timestamp, active boolean"
)
FLAGS = (
    "account_id bigint, flag string, signal string, matched_text string, "
    "evidence_snapshot_id bigint, first_seen timestamp, last_seen timestamp, active boolean"
)
REVIEWS = (
    "item_id bigint, kind string, reason string, review_key string, artist_id bigint, "
    "other_artist_id bigint, account_id bigint, edge_id bigint, status string, "
    "created_at timestamp, resolved_at timestamp, decided_by string, resolution_note string"
)
SUPPRESSIONS = (
    "artist_id bigint, account_id bigint, reason string, note string, requested_by string, "
    "created_at timestamp, lifted_at timestamp"
)
API_USAGE = (
    "service string, endpoint string, units int, est_cost_cents int, occurred_at timestamp, note string"
)
RESOLVED_LINKS = "short_url string, final_url string, resolved_at timestamp"
HINTS = (
    "hint_id bigint, source string, platform string, hinted_handle string, status string, "
    "created_at timestamp"
)
DECISIONS = (
    "decision_id bigint, kind string, artist_id bigint, account_id bigint, item_id bigint, "
    "payload string, actor string, at timestamp"
)
PAYLOADS = "source string, key string, fetched_at timestamp, status_code int, body string"


@dataclass(frozen=True)
class State:
    """One version of the state tables; operators return a new version.

    A table may be given as a function, which is called when the table is first looked at.
    """

    accounts: DataFrame
    snapshots: DataFrame
    edges: DataFrame
    artists: DataFrame
    memberships: DataFrame
    events: DataFrame
    attestations: DataFrame
    flags: DataFrame
    reviews: DataFrame
    suppressions: DataFrame

    def __getattribute__(self, name: str):
        held = object.__getattribute__(self, name)
        if isinstance(held, FunctionType | partial):
            held = held()
            object.__setattr__(self, name, held)
        return held

    def with_(self, **frames: DataFrame) -> "State":
        return State(**(vars(self) | frames))


STATE_SCHEMAS = {
    "accounts": ACCOUNTS,
    "snapshots": SNAPSHOTS,
    "edges": EDGES,
    "artists": ARTISTS,
    "memberships": MEMBERSHIPS,
    "events": EVENTS,
    "attestations": ATTESTATIONS,
    "flags": FLAGS,
    "reviews": REVIEWS,
    "suppressions": SUPPRESSIONS,
}


def empty_state(spark: SparkSession, **frames: DataFrame) -> State:
    made = {n: frames.get(n, spark.createDataFrame([], s)) for n, s in STATE_SCHEMAS.items()}
    return State(**made)


def read_state(spark: SparkSession, root: str) -> State:
    return State(**{n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in STATE_SCHEMAS.items()})


def write_state(state: State, root: str) -> None:
    """A new version goes to a new folder; the caller then points readers at it."""
    for name in STATE_SCHEMAS:
        writer = getattr(state, name).write.mode("errorifexists")
        writer.parquet(f"{root}/{name}")
