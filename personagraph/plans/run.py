"""Everything after new snapshots landed: re-read, cull, cluster, classify, publish."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import apply_classes, classify_artists
from ..operators.decisions import apply_decisions
from ..operators.directory import directory
from ..operators.hygiene import cull_low_followers
from ..schemas import State
from ..session import cut_lineage
from .cluster import cluster
from .reextract import reextract


def refresh(state: State, as_of: datetime, decisions: DataFrame | None = None) -> State:
    """The next version of the state. Running it again on its own result changes nothing."""
    now = F.lit(as_of).cast("timestamp")
    if decisions is not None:
        state = apply_decisions(state, decisions, now)
    state = reextract(state, as_of)
    state = state.with_(accounts=cut_lineage(cull_low_followers(state.accounts)))
    state = cluster(state, as_of)
    classes = classify_artists(state)
    return state.with_(artists=cut_lineage(apply_classes(state.artists, classes, now)))


def published(state: State, as_of: datetime) -> DataFrame:
    return directory(state, F.lit(as_of).cast("timestamp"))
