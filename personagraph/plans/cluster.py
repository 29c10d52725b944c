"""The clustering run: one version of the state to the next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import clustering as c
from ..operators import evidence as ev
from ..operators import hygiene
from ..operators.anomalies import flag_anomalies
from ..schemas import State
from ..session import cut_lineage


def cluster(state: State, as_of: datetime) -> State:
    """Heal, sweep, build components, attach, merge, ask, flag."""
    now = F.lit(as_of).cast("timestamp")
    state = c.settle(c.heal_memberships(state, now))
    state = hygiene.purge_junk(state, now)
    state = hygiene.drop_duplicate_channels(state, now)
    state = c.settle(hygiene.flag_projects(state, now))

    facts = cut_lineage(ev.account_facts(state.accounts, state.snapshots))
    edges = cut_lineage(ev.strong_edges(state.edges, state.accounts))
    state = c.settle(c.build_components(state, facts, edges, now))
    state = c.settle(c.reverse_attach(state, facts, edges, now))
    state = c.settle(c.singletons(state, facts, edges, now))
    state = c.settle(c.demote_without_evidence(state, facts, edges, now))

    shared = cut_lineage(c.shared_targets(edges, state.memberships))
    state = c.settle(c.detach_shared(state, shared, now))
    state = attach_one_directional(state, facts, shared, now)
    state = c.merge_reciprocal_artists(state, facts, shared, now)
    state = c.settle(c.ask_conflicts(state, shared, now))
    state = c.settle(c.restore_flipped(state, facts, edges, shared, now))
    return c.settle(flag_anomalies(state, now))


def attach_one_directional(state: State, facts, shared, now) -> State:
    """Rounds of the ladder: an account attached in one round may name accounts in the next.

    Every round but the last attaches someone, and the per-platform cap bounds how many an artist takes.
    """
    while True:
        edges = ev.strong_edges(state.edges, state.accounts)
        decisions = cut_lineage(c.one_directional_ladder(edges, state, facts, shared))
        state = c.settle(c.apply_ladder(state, decisions, now))
        if decisions.filter("decision = 'attach'").isEmpty():
            return state
