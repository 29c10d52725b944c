"""Re-read the newest snapshot of every account and bring the state in line with it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..functions import patterns as P
from ..functions import text as T
from ..functions.links import explode_links, with_links
from ..operators import evidence as ev
from ..operators import upsert as up
from ..schemas import State
from ..session import cut_lineage
from ..sources import skeb


def whole_profiles(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(~F.col("fetch_source").isin(policy.PARTIAL_SNAPSHOT_SOURCES))


def readable(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Newest whole-profile snapshot per account; hub pages and partial rows never drive retraction."""
    kinds = F.broadcast(policy.platforms(accounts.sparkSession).select("platform", "kind"))
    whole = whole_profiles(snapshots)
    accounts = accounts.select("account_id", "platform", "handle", F.col("display_name").alias("name"))
    accounts = accounts.join(kinds, "platform").filter("kind <> 'link_hub'").drop("kind")
    newest = ev.latest_snapshots(whole).select("account_id", "snapshot_id", "captured_at", "bio_text", "raw")
    return newest.join(accounts, "account_id")


def location() -> Column:
    """X profiles park links and mail addresses in the location field."""
    return F.when(F.col("platform") == "twitter", F.get_json_object("raw", "$.location"))


def expanded_urls() -> Column:
    """The expanded addresses an X profile carries next to its shortened ones."""
    schema = "array<struct<expanded_url:string>>"
    lists = [
        F.from_json(F.get_json_object("raw", f"$.entities.{part}.urls"), schema) for part in ("url", "description")
    ]
    urls = F.concat(*[F.coalesce(u["expanded_url"], F.array().cast("array<string>")) for u in lists])
    return F.when(F.col("platform") == "twitter", F.array_join(F.array_compact(urls), "\n"))


def read_signals(rows: DataFrame) -> DataFrame:
    """All signals of a text in one projection."""
    bio = F.coalesce("bio_text", F.lit(""))
    return rows.select(
        "account_id",
        "snapshot_id",
        "captured_at",
        "platform",
        "handle",
        "raw",
        T.email(F.concat_ws("\n", bio, location())).alias("email"),
        T.commission_status(F.concat_ws("\n", bio, "name", location())).alias("text_commission"),
        T.attestations(bio).alias("attestations"),
        T.adult_markers(bio).alias("flags"),
        T.mentions(bio, F.col("platform")).alias("mentions"),
        F.concat_ws("\n", bio, location(), expanded_urls()).alias("link_text"),
    )


def platform_commission() -> Column:
    """What the platform itself says: Skeb's acceptance, pixiv's request flag."""
    accepts = F.get_json_object("raw", "$.acceptable")
    said = F.col("raw").rlike('"acceptable"')
    pixiv = F.get_json_object("raw", "$.commission.acceptRequest") == "true"

    def reading(status: str, confidence: float, detail: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(detail).alias("detail")
        )

    return (
        F.when((F.col("platform") == "skeb") & said & (accepts == "true"), reading("open", 0.95, "skeb:acceptable"))
        .when((F.col("platform") == "skeb") & said, reading("closed", 0.95, "skeb:not accepting"))
        .when((F.col("platform") == "pixiv") & pixiv, reading("open", 0.9, "pixiv:accept_request"))
    )


def self_labels(rows: DataFrame) -> DataFrame:
    """Adult labels a Bluesky account declared on itself."""
    schema = "struct<did:string,labels:array<struct<val:string,src:string>>>"
    parsed = rows.filter("platform = 'bluesky'").withColumn("_p", F.from_json("raw", schema))
    labels = parsed.select("account_id", "snapshot_id", F.col("_p.did").alias("did"), F.explode("_p.labels").alias("l"))
    own = labels.filter(F.col("l.val").isin(P.BLUESKY_ADULT_LABELS) & (F.col("l.src") == F.col("did")))
    return own.select("account_id", "snapshot_id", F.lit("self_label").alias("signal"), F.col("l.val").alias("matched_text"))


def signal_rows(read: DataFrame, column: str) -> DataFrame:
    rows = read.select("account_id", "snapshot_id", F.explode(column).alias("s"))
    return rows.select("account_id", "snapshot_id", "s.signal", "s.matched_text")


FOUND = [
    "source_account_id", "snapshot_id", "link_pos", "platform", "native_id", "handle", "url", "discovered_via",
    "evidence_type", "claim", "relation_hint", "evidence_url", "matched_text",
]


def found_references(read: DataFrame) -> DataFrame:
    """Links and mentions of every text as (source, reference, edge) rows."""
    none = F.lit(None).cast("string")
    texts = read.select(
        F.col("account_id").alias("source_account_id"),
        "snapshot_id",
        F.col("platform").alias("own_platform"),
        F.col("handle").alias("own_handle"),
        "link_text",
    )
    links = explode_links(with_links(texts, "link_text").drop("link_text"))
    own = (F.col("platform") == F.col("own_platform")) & (F.lower("handle") == F.lower("own_handle"))
    links = up.edge_claims(links.filter(~F.coalesce(own, F.lit(False)))).withColumns(
        {"discovered_via": F.lit("bio_link"), "evidence_url": F.col("url"), "matched_text": none}
    )
    said = read.select(
        F.col("account_id").alias("source_account_id"),
        "snapshot_id",
        "platform",
        F.col("handle").alias("own_handle"),
        F.posexplode("mentions").alias("link_pos", "m"),
    )
    said = said.filter(F.lower("m.handle") != F.lower("own_handle")).select("*", "m.*").withColumns(
        {
            "native_id": none,
            "url": none,
            "discovered_via": F.lit("bio_mention"),
            "evidence_type": F.lit("bio_mention"),
            "evidence_url": none,
        }
    )
    return links.select(FOUND).unionByName(said.select(FOUND))


def as_account_refs(found: DataFrame) -> DataFrame:
    """Found references in the form the account upsert takes; the edge columns ride along."""
    return found.withColumns(
        {
            "seq": F.struct("source_account_id", "evidence_type", "link_pos"),
            "handle": F.coalesce("handle", "native_id"),
            "display_name": F.lit(None).cast("string"),
            "profile_url": F.col("url"),
            "status": F.lit("unknown"),
            "followers_count": F.lit(None).cast("bigint"),
            "last_post_at": F.lit(None).cast("timestamp"),
            "discovery_details": F.create_map(F.lit("source_account_id"), F.col("source_account_id").cast("string")),
            "hydrated": F.lit(False),
        }
    )


def produced_edges(resolved: DataFrame) -> DataFrame:
    """Edges of references whose account is known by now."""
    return resolved.select(
        "seq",
        "source_account_id",
        F.col("account_id").alias("target_account_id"),
        "evidence_type",
        F.col("snapshot_id").alias("evidence_snapshot_id"),
        "evidence_url",
        "matched_text",
        "claim",
        "relation_hint",
    )


def all_references(read: DataFrame) -> DataFrame:
    """References of the texts and of the structured fields that are stored with them."""
    registered = skeb.stored_links(read.filter("platform = 'skeb'"))
    return cut_lineage(found_references(read).unionByName(registered.select(FOUND)))


def statements_of(read: DataFrame) -> DataFrame:
    return signal_rows(read, "attestations").withColumnRenamed("snapshot_id", "evidence_snapshot_id")


def markers_of(read: DataFrame) -> DataFrame:
    rows = signal_rows(read, "flags").unionByName(self_labels(read))
    return rows.withColumnRenamed("snapshot_id", "evidence_snapshot_id").withColumn("flag", F.lit("nsfw"))


def reextract(state: State, as_of: datetime, repair: bool = True) -> State:
    """Whole job: newest texts, references to accounts, edges, signals, retractions and their repair."""
    now = F.lit(as_of).cast("timestamp")
    read = cut_lineage(read_signals(readable(state.accounts, state.snapshots)))
    found = all_references(read)
    accounts, resolved = up.upsert_accounts(state.accounts, as_account_refs(found), now)
    accounts = cut_lineage(accounts)
    made = cut_lineage(produced_edges(resolved))
    edges = up.upsert_edges(state.edges, made, now)
    edges, gone_links = up.retract_missing(edges, made, read, ["bio_link"], keep=up.short_link_evidence())
    edges, gone_mentions = up.retract_missing(edges, made, read, ["bio_mention"])
    edges = cut_lineage(edges)
    gone = cut_lineage(state.edges.filter("status = 'present'").select("edge_id").join(
        edges.filter("status = 'retracted'").select("edge_id"), "edge_id", "left_semi"))

    statements, markers = statements_of(read), markers_of(read)
    attestations = up.upsert_attestations(state.attestations, statements, now)
    attestations = up.deactivate_missing(
        attestations, statements, read, policy.REEXTRACTABLE_ATTESTATIONS, ["account_id", "signal"]
    )
    flags = up.upsert_flags(state.flags, markers, now)
    flags = up.deactivate_missing(flags, markers, read, policy.REEXTRACTABLE_FLAGS, ["account_id", "flag", "signal"])

    state = state.with_(
        accounts=with_contact(accounts, read), edges=edges, attestations=attestations, flags=flags
    )
    if repair:
        members, events, reviews = up.repair_downstream(state.memberships, state.events, state.reviews, gone, now)
        state = state.with_(memberships=members, events=events, reviews=reviews)
    return state


def with_contact(accounts: DataFrame, read: DataFrame) -> DataFrame:
    """E-mail and commission of the newest text; a text without them changes nothing."""
    found = read.select(
        "account_id",
        F.col("email").alias("_email"),
        F.coalesce(platform_commission(), F.col("text_commission")).alias("_c"),
        F.col("captured_at").alias("_at"),
    )
    joined = accounts.join(found, "account_id", "left")
    hit = F.col("_c").isNotNull()
    return joined.withColumns(
        {
            "contact_email": up.fill(F.col("_email"), F.col("contact_email")),
            "commission_status": F.coalesce("_c.status", "commission_status"),
            "commission_confidence": F.when(hit, F.col("_c.confidence")).otherwise(F.col("commission_confidence")),
            "commission_detail": F.when(hit, F.col("_c.detail")).otherwise(F.col("commission_detail")),
            "commission_checked_at": F.when(hit, F.col("_at")).otherwise(F.col("commission_checked_at")),
        }
    ).select(*accounts.columns)
