"""From landed payloads to profiles and links, and from those into the state.

A payload is one fetched body: (source, key, fetched_at, status_code, body). Every source turns its
bodies into profile rows and link rows of one shape; storing them is the same for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.links import explode_links, with_links, with_platform_links, with_website_links
from ..functions.text import COMMISSION, SIGNALS
from ..operators import evidence as ev
from ..operators import upsert as up
from ..operators.counters import Counters, watched
from ..operators.spread import first_per_key
from ..schemas import State
from ..session import cut_lineage

PROFILE = {
    "platform": "string",
    "native_id": "string",
    "handle": "string",
    "display_name": "string",
    "profile_url": "string",
    "followers_count": "bigint",
    "following_count": "bigint",
    "last_post_at": "timestamp",
    "bio_text": "string",
    "avatar_url": "string",
    "raw": "string",
    "fetch_source": "string",
    "discovered_via": "string",
    "discovery_details": "map<string,string>",
    "fetched_at": "timestamp",
    "hydrated": "boolean",
    "stats": "map<string,string>",
    "platform_commission": COMMISSION,
    "extra_flags": SIGNALS,
    "email_text": "string",
    "commission_text": "string",
    "flag_text": "string",
}



def bodies(payloads: DataFrame, source: str) -> DataFrame:
    """Usable payloads of one source, the newest per key."""
    rows = payloads.filter((F.col("source") == source) & (F.col("status_code") == 200) & F.col("body").isNotNull())
    return first_per_key(rows, ["key"], [F.col("fetched_at").desc(), F.col("body")])


def gone(payloads: DataFrame, source: str) -> DataFrame:
    """Keys whose newest answer says the page does not exist."""
    rows = payloads.filter(F.col("source") == source)
    newest = first_per_key(rows, ["key"], [F.col("fetched_at").desc(), F.col("status_code")])
    return newest.filter(F.col("status_code").isin(404, 410)).select("key", "fetched_at")


def missing_keys(requested: DataFrame, found: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Requested keys that neither came back nor failed for now."""
    out = requested.select("key").distinct().join(found.select("key"), "key", "left_anti")
    return out if failed is None else out.join(failed.select("key"), "key", "left_anti")


def stats_map(**values: Column) -> Column:
    """Stat values as text; unknown ones are left out."""
    pairs = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def flag(test: Column, signal: str, text: Column | str) -> Column:
    """A one-element signal list where the test holds."""
    text = F.lit(text) if isinstance(text, str) else text
    item = F.array(F.struct(F.lit(signal).alias("signal"), text.alias("matched_text")))
    return F.when(F.coalesce(test, F.lit(False)), item).otherwise(F.array().cast(SIGNALS))


def reading(test: Column, status: str, confidence: float, detail: str) -> Column:
    """A commission reading where the test holds."""
    value = F.struct(
        F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(detail).alias("detail")
    )
    return F.when(F.coalesce(test, F.lit(False)), value)


def profiles(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Profile rows with every column of the common shape; texts default to the bio."""
    given = {n: c.cast(PROFILE[n]) for n, c in columns.items()}
    out = df.select(
        *(keep or []),
        *[given.get(n, F.lit(None).cast(t)).alias(n) for n, t in PROFILE.items()],
    )
    for name in ("email_text", "commission_text", "flag_text"):
        if name not in columns:
            out = out.withColumn(name, F.col("bio_text"))
    return out.withColumns(
        {
            "hydrated": F.coalesce("hydrated", F.lit(True)),
            "extra_flags": F.coalesce("extra_flags", F.array().cast(SIGNALS)),
        }
    )


def with_signals(rows: DataFrame) -> DataFrame:
    """Read e-mail, commission, statements and adult markers out of the texts of profile rows."""
    return rows.withColumns(
        {
            "email": T.email(F.col("email_text")),
            "commission": F.coalesce("platform_commission", T.commission_status(F.col("commission_text"))),
            "attestations": T.attestations(F.col("bio_text")),
            "flags": F.array_distinct(F.concat(T.adult_markers(F.coalesce("flag_text", F.lit(""))), "extra_flags")),
        }
    ).drop("email_text", "commission_text", "flag_text", "platform_commission", "extra_flags")


def text_links(
    rows: DataFrame, text: str, evidence: str, order: int, websites: bool = True, platforms: bool = True
) -> DataFrame:
    """Link rows of one text column; ``order`` says which evidence wins for a target found twice."""
    base = rows.select(
        F.col("platform").alias("own_platform"),
        F.col("native_id").alias("own_native_id"),
        F.col("handle").alias("own_handle"),
        text,
    )
    if websites and platforms:
        found = with_links(base, text)
    elif platforms:
        found = with_platform_links(base, text, "links")
    else:
        found = with_website_links(base, text, "links")
    links = explode_links(found.drop(text) if text != "links" else found)
    links = up.edge_claims(links, evidence)
    return links.withColumns(
        {"emit_order": F.lit(order), "evidence_url": F.col("url"), "matched_text": F.lit(None).cast("string")}
    )


def mention_links(rows: DataFrame, order: int = 9) -> DataFrame:
    """Mentions in the bio as link rows to accounts of the same platform."""
    own = rows.select(
        F.col("platform").alias("own_platform"),
        F.col("native_id").alias("own_native_id"),
        F.col("handle").alias("own_handle"),
        "platform",
        "bio_text",
    )
    said = T.explode_rows(own, T.mentions(F.col("bio_text"), F.col("platform")), "m", "link_pos")
    address = {"twitter": "https://x.com/", "bluesky": "https://bsky.app/profile/"}
    prefix = F.create_map(*[F.lit(x) for pair in address.items() for x in pair])[F.col("platform")]
    none = F.lit(None).cast("string")
    return said.select(
        "own_platform", "own_native_id", "own_handle", "link_pos", "platform",
        F.col("m.handle").alias("handle"), none.alias("native_id"), F.concat(prefix, "m.handle").alias("url"),
        F.lit("bio_mention").alias("evidence_type"), "m.claim", "m.relation_hint",
        F.lit(order).alias("emit_order"), none.alias("evidence_url"), "m.matched_text",
    )


def emitted(links: DataFrame) -> DataFrame:
    """Own and repeated targets dropped: one row per source and target."""
    return up.emit_once(links, ["own_platform", "own_native_id", "own_handle"])


def account_refs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.struct("fetched_at", "platform", "native_id", "handle").alias("seq"),
        "platform", "native_id", "handle", "display_name", "profile_url",
        F.lit("active").alias("status"),
        "followers_count", "last_post_at", "discovered_via", "discovery_details", "hydrated",
    )


def ingest(state: State, rows: DataFrame, links: DataFrame, as_of: Column, counters: Counters | None = None) -> State:
    """Store profiles and links: accounts, snapshots, signals, referenced accounts and edges.

    Suppressed accounts keep their account row fresh but get no snapshot, signal or edge.
    """
    rows = cut_lineage(
        watched(
            counters, with_signals(rows), "profiles", emails=F.count("email"), commissions=F.count("commission"),
            statements=F.sum(F.size("attestations")), markers=F.sum(F.size("flags")),
        )
    )
    accounts, resolved = up.upsert_accounts(state.accounts, account_refs(rows), as_of)
    accounts = cut_lineage(accounts)
    barred = ev.suppressed_accounts(state.suppressions, state.memberships)
    ids = resolved.select("account_id", "platform", "native_id", "handle").distinct()
    same = [rows[c].eqNullSafe(ids[c]) for c in ("platform", "native_id", "handle")]
    known = rows.join(ids, same[0] & same[1] & same[2]).select(rows["*"], ids["account_id"])
    known = cut_lineage(known.join(barred, "account_id", "left_anti"))

    snaps = known.select(
        "account_id", F.col("fetched_at").alias("captured_at"), "bio_text", "display_name", "followers_count",
        "following_count", "raw", "fetch_source",
    )
    snaps = cut_lineage(watched(counters, up.next_ids(snaps, state.snapshots, "snapshot_id", [F.col("account_id"), F.col("captured_at")]), "snapshots"))
    snapshots = up.append(state.snapshots, snaps)
    newest = snaps.groupBy("account_id").agg(F.max("snapshot_id").alias("evidence_snapshot_id"))
    known = known.join(newest, "account_id")

    statements = known.select("account_id", "evidence_snapshot_id", F.explode("attestations").alias("s")).select(
        "account_id", "evidence_snapshot_id", "s.*"
    )
    markers = known.select("account_id", "evidence_snapshot_id", F.explode("flags").alias("s")).select(
        "account_id", "evidence_snapshot_id", F.lit("nsfw").alias("flag"), "s.*"
    )
    state = state.with_(
        accounts=cut_lineage(refresh_details(accounts, known, as_of)),
        snapshots=snapshots,
        attestations=up.upsert_attestations(state.attestations, statements, as_of),
        flags=up.upsert_flags(state.flags, markers, as_of),
    )
    sources = known.select(
        F.col("platform").alias("own_platform"), F.col("native_id").alias("own_native_id"),
        F.col("handle").alias("own_handle"), F.col("account_id").alias("source_account_id"), "evidence_snapshot_id",
    )
    return store_links(state, links, sources, as_of, counters)


def store_links(state: State, links: DataFrame, sources: DataFrame, as_of: Column, counters: Counters | None = None) -> State:
    """Referenced accounts and edges of link rows whose source account is known."""
    own = ("own_platform", "own_native_id", "own_handle")
    match = None
    for c in own:
        test = links[c].eqNullSafe(sources[c])
        match = test if match is None else match & test
    joined = links.join(sources, match).select(links["*"], sources["source_account_id"], sources["evidence_snapshot_id"])
    hub = F.col("evidence_type") == "link_hub"
    mention = F.col("evidence_type") == "bio_mention"
    refs = joined.withColumns(
        {
            "seq": F.struct("source_account_id", "emit_order", "link_pos"),
            "handle": F.coalesce("handle", "native_id"),
            "display_name": F.lit(None).cast("string"),
            "profile_url": F.col("url"),
            "status": F.lit("unknown"),
            "followers_count": F.lit(None).cast("bigint"),
            "last_post_at": F.lit(None).cast("timestamp"),
            "discovered_via": F.when(hub, "link_hub").when(mention, "bio_mention").otherwise("bio_link"),
            "discovery_details": F.create_map(F.lit("source_account_id"), F.col("source_account_id").cast("string")),
            "hydrated": F.lit(False),
        }
    )
    refs = cut_lineage(refs)
    accounts, resolved = up.upsert_accounts(state.accounts, refs, as_of)
    made = resolved.select(
        "seq", "source_account_id", F.col("account_id").alias("target_account_id"), "evidence_type",
        "evidence_snapshot_id", "evidence_url", "matched_text", "claim", "relation_hint",
    )
    accounts = watched(counters, accounts, "accounts", hydrated=F.count("last_hydrated"))
    edges = up.upsert_edges(state.edges, made, as_of)
    edges = watched(counters, edges, "edges", present=F.count_if(F.col("status") == "present"))
    return state.with_(accounts=cut_lineage(accounts), edges=cut_lineage(edges))


def refresh_details(accounts: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """Avatar, stats, e-mail and commission of hydrated accounts; nothing known is wiped."""
    newest = F.struct("fetched_at", "evidence_snapshot_id")
    per = known.groupBy("account_id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(f"_{c}")
            for c in ("avatar_url", "stats", "email", "commission")
        ]
    )
    joined = accounts.join(per, "account_id", "left")
    hit = F.col("_commission").isNotNull()
    return joined.withColumns(
        {
            "avatar_url": F.coalesce("_avatar_url", "avatar_url"),
            "contact_email": F.coalesce("_email", "contact_email"),
            "platform_stats": F.when(
                F.col("_stats").isNotNull(), up.merge_stats(F.col("platform_stats"), F.col("_stats"))
            ).otherwise(F.col("platform_stats")),
            "commission_status": F.coalesce("_commission.status", "commission_status"),
            "commission_confidence": F.coalesce("_commission.confidence", "commission_confidence"),
            "commission_detail": F.coalesce("_commission.detail", "commission_detail"),
            "commission_checked_at": F.when(hit, as_of).otherwise(F.col("commission_checked_at")),
        }
    ).select(*accounts.columns)
