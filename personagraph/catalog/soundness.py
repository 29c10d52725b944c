"""Integrity checks and one-off repairs over tables in which some rows break the rule on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, hygiene, ranking
from ..sources import twitter
from . import world as w
from .registry import query
from .world import oracle


@query("evidence_missing", oracle("""
SELECT 'edges' AS table_name, count(*) AS n FROM edges WHERE evidence_type = 'link_hub'
UNION ALL SELECT 'attestations', 0 UNION ALL SELECT 'flags', count(*) FROM flags WHERE NOT active"""))
def evidence_missing(spark, d):
    """Hub edges and inactive flags without their snapshot."""
    none = F.lit(None).cast("bigint")
    edges = w.edges(spark, d).withColumn("evidence_snapshot_id", F.when(F.col("evidence_type") == "link_hub", none).otherwise(F.col("evidence_snapshot_id")))
    flags = w.flags(spark, d).withColumn("evidence_snapshot_id", F.when(F.col("active"), F.col("evidence_snapshot_id")))
    return checks.evidence_missing(edges, w.attestations(spark, d), flags).select(F.col("table").alias("table_name"), "n")


@query("suppressed_listed", oracle("SELECT artist_id FROM artists WHERE artist_id IN (SELECT artist_id FROM out_artists)"))
def suppressed_listed(spark, d):
    """A directory of all artists lists the suppressed ones."""
    return checks.suppressed_but_listed(w.artists(spark, d).select("artist_id"), w.state(spark, d))


@query("suppressed_shown", oracle("SELECT platform, handle FROM accounts WHERE account_id IN (SELECT account_id FROM out_accounts)"))
def suppressed_shown(spark, d):
    """A directory of all accounts shows the suppressed ones."""
    return checks.suppressed_account_shown(w.accounts(spark, d).select("platform", "handle"), w.state(spark, d))


@query("badges_missing", oracle("""
SELECT DISTINCT artist_id, 'badge' AS missing FROM visible WHERE account_id IN (SELECT account_id FROM attestations WHERE active)
UNION ALL SELECT DISTINCT artist_id, 'nsfw' FROM visible WHERE account_id IN (SELECT account_id FROM flags WHERE active AND flag = 'nsfw')"""))
def badges_missing(spark, d):
    """A directory that shows no badge and no mark at all."""
    bare = w.artists(spark, d).select("artist_id", F.lit(False).alias("no_ai_attested"), F.lit(False).alias("nsfw"))
    return checks.badge_missing(bare, w.state(spark, d))


@query("mention_dumps_retracted", oracle("""
, dumps AS (SELECT src FROM edges JOIN accounts ON account_id = src WHERE platform = 'twitter' GROUP BY src HAVING count(DISTINCT tgt) > 5)
SELECT edge_id FROM edges WHERE src IN (SELECT src FROM dumps)"""))
def mention_dumps_retracted(spark, d):
    """All links read as present mentions of the own platform."""
    named = w.edges(spark, d).withColumns({"status": F.lit("present"), "relation_hint": F.lit("same_platform_mention")})
    return hygiene.retract_mention_dumps(named, w.accounts(spark, d), "twitter").filter("status = 'retracted'").select("edge_id")


@query("old_thresholds", oracle("""
SELECT item_id, decided_by FROM (
  SELECT item_id, 'pipeline:threshold_raise' AS decided_by FROM reviews
  WHERE reason = 'anomaly' AND account_id IS NULL AND status = 'pending' AND artist_id NOT IN (SELECT artist_id FROM artists WHERE artist_id % 2 = 0))"""))
def old_thresholds(spark, d):
    """Anomalies are measured again for every second artist only."""
    measured = w.artists(spark, d).filter("artist_id % 2 = 0").select("artist_id")
    done = hygiene.resolve_old_thresholds(w.reviews(spark, d), measured, w.as_of())
    return done.filter("decided_by is not null").select("item_id", "decided_by")


@query("corrections_resolved", """
SELECT o_orderkey AS correction_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status,
  o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS now FROM orders""")
def corrections_resolved(spark, d):
    orders = w.table(spark, d, "orders")
    open_ = F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
    corrections = orders.select(F.col("o_orderkey").alias("correction_id"), open_.alias("status"), F.lit(None).cast("timestamp").alias("resolved_at"))
    said = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("correction_id"), F.lit("accepted").alias("outcome"))
    done = ranking.resolve_corrections(corrections, said, w.as_of())
    return done.select("correction_id", "status", F.col("resolved_at").isNotNull().alias("now"))


@query("top_authors", """
SELECT key FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(floor(c_acctbal) AS BIGINT) AS n FROM customer) ORDER BY n DESC NULLS LAST, key LIMIT 50""")
def top_authors(spark, d):
    """The 50 most followed, a report of that many rows."""
    body = F.to_json(F.struct(F.struct(F.floor("c_acctbal").alias("followers_count")).alias("public_metrics")))
    authors = w.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), body.alias("body"))
    return twitter.top_authors(authors, 50).select("key")


@query("avatars_backfilled", oracle("""
, told AS (SELECT account_id, arg_max(snapshot_id, (captured_at, snapshot_id)) AS s FROM snapshots WHERE snapshot_id % 2 = 0 GROUP BY account_id)
SELECT account_id, coalesce(avatar_url, 'https://img.example/s' || s) AS avatar_url FROM accounts LEFT JOIN told USING (account_id)"""))
def avatars_backfilled(spark, d):
    """Every second snapshot states an avatar; accounts without one take the newest."""
    url = F.concat(F.lit("https://img.example/s"), F.col("snapshot_id").cast("string"))
    raw = F.when(F.col("snapshot_id") % 2 == 0, F.to_json(F.struct(url.alias("profile_image_url"))))
    told = w.snapshots(spark, d).withColumn("raw", raw)
    return hygiene.backfill_from_snapshots(w.accounts(spark, d), told).select("account_id", "avatar_url")
