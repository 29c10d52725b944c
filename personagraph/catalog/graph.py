"""Queries over the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..operators import anomalies, checks, clustering, evidence as ev, reports, vouching
from ..operators.components import components, mutual_pairs, resolve_chains
from ..session import cut_lineage
from . import world as w
from .registry import NORMAL_SQL, query, similarity_sql, stamp
from .world import oracle


def _facts(s) -> DataFrame:
    return ev.account_facts(s.accounts, s.snapshots)


def _strong(spark, d) -> DataFrame:
    return ev.strong_edges(w.edges(spark, d), w.accounts(spark, d))


@query("latest_snapshot_per_user", oracle("""
SELECT account_id, snapshot_id, followers_count, fetch_source, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1"""))
def latest_snapshot_per_user(spark, d):
    rows = ev.latest_snapshots(w.snapshots(spark, d).drop("bio_text", "raw"))
    return rows.select("account_id", "snapshot_id", "followers_count", "fetch_source", stamp("captured_at").alias("captured_at"))


@query("latest_adds", oracle("""
SELECT artist_id, account_id, edge_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, account_id ORDER BY created_at DESC, edge_id DESC) AS rn FROM artist_events WHERE event = 'account_added') WHERE rn = 1"""))
def latest_adds(spark, d):
    rows = ev.latest_adds(w.artist_events(spark, d))
    return rows.select("artist_id", "account_id", "edge_id", stamp("created_at").alias("created_at"))


@query("strong_edges", oracle("SELECT edge_id, src AS source_account_id, tgt AS target_account_id, evidence_type FROM strong"))
def strong_edges(spark, d):
    return _strong(spark, d).select("edge_id", "source_account_id", "target_account_id", "evidence_type")


@query("mutual_pairs", oracle("SELECT low, high FROM mutual"))
def mutual(spark, d):
    return mutual_pairs(_strong(spark, d))


@query("event_mutual_pairs", """
WITH e AS (SELECT DISTINCT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS tgt FROM events)
SELECT DISTINCT least(a.src, a.tgt) AS low, greatest(a.src, a.tgt) AS high FROM e a JOIN e b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src <> a.tgt""")
def event_mutual_pairs(spark, d):
    rows = w.table(spark, d, "events").select(
        F.col("user_id").alias("source_account_id"), F.get_json_object("props", "$.k").cast("bigint").alias("target_account_id")
    )
    return mutual_pairs(rows)


@query("components", oracle("SELECT node, component FROM component"))
def connected(spark, d):
    return components(mutual_pairs(_strong(spark, d)))


@query("event_components", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS tgt FROM events),
m AS (SELECT DISTINCT least(a.src, a.tgt) AS low, greatest(a.src, a.tgt) AS high FROM e a JOIN e b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src <> a.tgt),
both_ways AS (SELECT low AS a, high AS b FROM m UNION SELECT high, low FROM m),
reach(node, reached) AS (SELECT a, a FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.reached)
SELECT node, min(reached) AS component FROM reach GROUP BY node""")
def event_components(spark, d):
    return components(event_mutual_pairs(spark, d))


@query("component_facts", oracle("""
, member AS (
  SELECT c.component, a.account_id, a.platform, coalesce(a.followers_count, 0) AS f, m.artist_id
  FROM component c JOIN accounts a ON a.account_id = c.node LEFT JOIN memberships m ON m.account_id = c.node),
fullest AS (SELECT component, max(n) AS fullest FROM (SELECT component, platform, count(*) AS n FROM member GROUP BY ALL) GROUP BY 1)
SELECT component, count(*) AS size, max(fullest) AS fullest, count(DISTINCT artist_id) AS artists, min(artist_id) AS low, max(artist_id) AS high,
  first(account_id ORDER BY f DESC, account_id) AS anchor_id
FROM member JOIN fullest USING (component) GROUP BY component"""))
def component_facts(spark, d):
    s = w.state(spark, d)
    parts = components(mutual_pairs(ev.strong_edges(s.edges, s.accounts)))
    rows = clustering.component_facts(parts, _facts(s), s.memberships)
    return rows.select("component", "size", "fullest", "artists", "low", "high", "anchor_id")


@query("giant_component_guard", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS tgt FROM events),
m AS (SELECT DISTINCT least(a.src, a.tgt) AS low, greatest(a.src, a.tgt) AS high FROM e a JOIN e b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src <> a.tgt),
both_ways AS (SELECT low AS a, high AS b FROM m UNION SELECT high, low FROM m),
reach(node, reached) AS (SELECT a, a FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM reach GROUP BY node),
k AS (SELECT component, c_mktsegment AS platform, count(*) AS n FROM c JOIN customer ON c_custkey = node GROUP BY ALL)
SELECT component, CAST(sum(n) AS BIGINT) AS size, max(n) AS fullest FROM k GROUP BY component HAVING max(n) > 3""")
def giant_component_guard(spark, d):
    parts = components(event_mutual_pairs(spark, d))
    kinds = w.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("platform"))
    counts = parts.join(kinds, "node").groupBy("component", "platform").agg(F.count("*").alias("n"))
    whole = counts.groupBy("component").agg(F.sum("n").alias("size"), F.max("n").alias("fullest"))
    return whole.filter(F.col("fullest") > policy.MAX_SAME_PLATFORM)


ONE_WAY = """
, one_way AS (SELECT s.* FROM strong s WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.low = least(s.src, s.tgt) AND m.high = greatest(s.src, s.tgt))),
shared AS (SELECT tgt AS account_id FROM one_way JOIN memberships m ON m.account_id = src GROUP BY tgt HAVING count(DISTINCT m.artist_id) >= 2)"""


@query("shared_targets", oracle(ONE_WAY + " SELECT account_id FROM shared"))
def shared_targets(spark, d):
    return clustering.shared_targets(_strong(spark, d), w.memberships(spark, d))


@query("detach_shared", oracle(ONE_WAY + """
SELECT artist_id, account_id FROM memberships JOIN shared USING (account_id) WHERE added_by = 'clustering' AND confidence = 'strong'"""))
def detach_shared(spark, d):
    s = w.state(spark, d)
    shared = clustering.shared_targets(ev.strong_edges(s.edges, s.accounts), s.memberships)
    done = clustering.detach_shared(s, shared, w.as_of())
    return done.events.filter("reason = 'shared_target'").select("artist_id", "account_id")


RECIPROCITY = ONE_WAY + """
, out_links AS (
  SELECT DISTINCT src AS account_id, tgt AS link_id FROM strong
  WHERE tgt NOT IN (SELECT account_id FROM shared)
    AND tgt IN (SELECT account_id FROM accounts WHERE coalesce(followers_count, 0) < 10000)),
by_artist AS (SELECT DISTINCT m.artist_id, link_id FROM out_links JOIN memberships m USING (account_id))"""


@query("shared_reciprocity", oracle(RECIPROCITY + """
, candidate AS (SELECT DISTINCT m.artist_id, tgt AS account_id FROM one_way JOIN memberships m ON m.account_id = src WHERE tgt NOT IN (SELECT account_id FROM memberships WHERE artist_id = m.artist_id))
SELECT c.artist_id, c.account_id, count(DISTINCT o.link_id) AS shared_links
FROM candidate c JOIN out_links o ON o.account_id = c.account_id JOIN by_artist b ON b.artist_id = c.artist_id AND b.link_id = o.link_id GROUP BY ALL"""))
def shared_reciprocity(spark, d):
    s = w.state(spark, d)
    facts, edges = _facts(s), ev.strong_edges(s.edges, s.accounts)
    shared = clustering.shared_targets(edges, s.memberships)
    homes = s.memberships.select("account_id", "artist_id")
    links = clustering.one_way(edges).join(homes.withColumnRenamed("account_id", "source_account_id"), "source_account_id")
    candidates = links.select("artist_id", F.col("target_account_id").alias("account_id")).join(
        homes, ["artist_id", "account_id"], "left_anti"
    )
    return clustering.shared_reciprocity(candidates, edges, s.memberships, shared, facts)


LADDER = RECIPROCITY + """
, closed_pair AS (SELECT DISTINCT artist_id, account_id FROM artist_events WHERE event = 'account_removed' AND actor LIKE 'admin%'),
barred AS (SELECT account_id FROM out_accounts UNION SELECT account_id FROM memberships WHERE artist_id IN (SELECT artist_id FROM out_artists)),
link AS (
  SELECT l.edge_id, m.artist_id, l.tgt AS account_id, a.platform, coalesce(a.followers_count, 0) AS followers,
    CASE WHEN l.evidence_type = 'profile_field' AND l.relation_hint = 'oauth' THEN 0 WHEN l.evidence_type = 'bio_mention' THEN 1 ELSE 2 END AS tier,
    EXISTS (SELECT 1 FROM closed_pair c WHERE c.artist_id = m.artist_id AND c.account_id = l.tgt) AS closed
  FROM one_way l JOIN memberships m ON m.account_id = l.src JOIN accounts a ON a.account_id = l.tgt
  WHERE l.tgt NOT IN (SELECT account_id FROM memberships) AND l.tgt NOT IN (SELECT account_id FROM barred)),
open_link AS (SELECT * FROM link WHERE tier = 0 OR account_id NOT IN (SELECT account_id FROM shared)),
tally AS (SELECT artist_id, platform, count(*) AS members FROM memberships JOIN accounts USING (account_id) GROUP BY ALL),
strong1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY tier, edge_id) AS rn FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, account_id ORDER BY tier, edge_id) AS r0 FROM open_link WHERE tier < 2 AND NOT closed) WHERE r0 = 1)) WHERE rn = 1),
taken AS (SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, platform ORDER BY tier, edge_id) AS slot FROM strong1) s
  LEFT JOIN tally t USING (artist_id, platform) WHERE slot + coalesce(members, 0) <= 3),
used AS (SELECT artist_id, platform FROM tally UNION SELECT artist_id, platform FROM taken),
proof AS (
  SELECT l.artist_id, l.account_id, count(DISTINCT o.link_id) AS n FROM (SELECT DISTINCT artist_id, account_id FROM open_link WHERE tier = 2 AND NOT closed AND followers >= 10000) l
  JOIN out_links o ON o.account_id = l.account_id JOIN by_artist b ON b.artist_id = l.artist_id AND b.link_id = o.link_id GROUP BY ALL),
eligible AS (
  SELECT l.* FROM open_link l LEFT JOIN proof p USING (artist_id, account_id) LEFT JOIN used u USING (artist_id, platform)
  WHERE tier = 2 AND NOT closed AND l.account_id NOT IN (SELECT account_id FROM taken) AND u.artist_id IS NULL AND (followers < 10000 OR coalesce(p.n, 0) >= 2)),
winner AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY edge_id) AS r2 FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, platform ORDER BY edge_id) AS r1 FROM eligible) WHERE r1 = 1)) WHERE r2 = 1),
pick AS (SELECT edge_id, account_id, artist_id, platform FROM taken UNION ALL SELECT edge_id, account_id, artist_id, platform FROM winner),
full_slot AS (SELECT artist_id, platform FROM used UNION SELECT artist_id, platform FROM winner),
judged AS (
  SELECT l.*, p.edge_id IS NOT NULL AS attach,
    p.edge_id IS NULL AND l.account_id IN (SELECT account_id FROM pick) AS moot, f.artist_id IS NOT NULL AS is_full
  FROM open_link l LEFT JOIN pick p USING (edge_id) LEFT JOIN full_slot f ON f.artist_id = l.artist_id AND f.platform = l.platform),
verdict AS (
  SELECT *, NOT attach AND NOT moot AND (tier = 1 OR (tier = 2 AND (followers >= 10000 OR NOT closed OR is_full))) AS flip FROM judged)
SELECT edge_id, artist_id, account_id, CASE WHEN attach THEN 'attach' WHEN flip THEN 'flip' ELSE 'none' END AS decision,
  CASE WHEN attach THEN CASE WHEN tier = 0 THEN 'near_proof' ELSE 'strong' END END AS confidence,
  CASE WHEN attach THEN CASE WHEN tier = 0 THEN 'platform_verified_link' WHEN tier = 1 THEN 'alt_mention' WHEN followers >= 10000 THEN 'shared_hub_reciprocity' ELSE 'one_directional' END END AS reason,
  CASE WHEN flip THEN CASE WHEN tier = 1 THEN 'over_platform_cap' WHEN followers >= 10000 THEN 'unreciprocated_prominent' ELSE 'secondary_link' END END AS relation_hint
FROM verdict"""


@query("one_directional_ladder", oracle(LADDER))
def one_directional_ladder(spark, d):
    s = w.state(spark, d)
    edges = ev.strong_edges(s.edges, s.accounts)
    shared = clustering.shared_targets(edges, s.memberships)
    return clustering.one_directional_ladder(edges, s, _facts(s), shared)


@query("reverse_attach", oracle("""
, barred AS (SELECT account_id FROM out_accounts UNION SELECT account_id FROM memberships WHERE artist_id IN (SELECT artist_id FROM out_artists)),
closed_pair AS (SELECT DISTINCT artist_id, account_id FROM artist_events WHERE event = 'account_removed' AND actor LIKE 'admin%'),
tally AS (SELECT artist_id, platform, count(*) AS members FROM memberships JOIN accounts USING (account_id) GROUP BY ALL),
cand AS (
  SELECT e.edge_id, e.src AS account_id, m.artist_id, a.platform FROM strong e JOIN memberships m ON m.account_id = e.tgt JOIN accounts a ON a.account_id = e.src
  WHERE e.evidence_type = 'profile_field' AND e.relation_hint = 'oauth' AND e.src NOT IN (SELECT account_id FROM memberships) AND e.src NOT IN (SELECT account_id FROM barred)
    AND NOT EXISTS (SELECT 1 FROM closed_pair c WHERE c.artist_id = m.artist_id AND c.account_id = e.src)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY edge_id) AS rn FROM cand) WHERE rn = 1)
SELECT artist_id, account_id, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, platform ORDER BY edge_id) AS slot FROM one) LEFT JOIN tally USING (artist_id, platform)
WHERE slot + coalesce(members, 0) <= 3"""))
def reverse_attach(spark, d):
    s = w.state(spark, d)
    done = clustering.reverse_attach(s, _facts(s), ev.strong_edges(s.edges, s.accounts), w.as_of())
    return done.events.filter("reason = 'platform_verified_link'").select("artist_id", "account_id", "edge_id")


@query("healed_memberships", oracle("""
, adds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, account_id ORDER BY created_at DESC, edge_id DESC) AS rn FROM artist_events WHERE event = 'account_added') WHERE rn = 1)
SELECT DISTINCT a.artist_id, a.account_id, a.edge_id FROM adds a JOIN edges e USING (edge_id) JOIN memberships m ON m.artist_id = a.artist_id AND m.account_id = a.account_id AND m.added_by = 'clustering'
WHERE e.status = 'retracted' OR e.claim = 'related'"""))
def healed_memberships(spark, d):
    done = clustering.heal_memberships(w.state(spark, d), w.as_of())
    return done.events.filter("reason = 'evidence_retracted'").select("artist_id", "account_id", "edge_id")


@query("artist_claims", oracle("""
SELECT s.edge_id, f.artist_id AS from_artist, t.artist_id AS to_artist FROM strong s JOIN memberships f ON f.account_id = s.src JOIN memberships t ON t.account_id = s.tgt WHERE f.artist_id <> t.artist_id"""))
def artist_claims(spark, d):
    return clustering.artist_claims(_strong(spark, d), w.memberships(spark, d)).select("edge_id", "from_artist", "to_artist")


@query("reciprocal_artists", oracle("""
, usable AS (
  SELECT * FROM edges WHERE status = 'present' AND (claim = 'same_person' OR relation_hint IN ('unreciprocated_prominent', 'secondary_link', 'over_platform_cap'))
    AND src NOT IN (SELECT account_id FROM accounts WHERE project) AND tgt NOT IN (SELECT account_id FROM accounts WHERE project)),
claim AS (SELECT DISTINCT f.artist_id AS a, t.artist_id AS b FROM usable s JOIN memberships f ON f.account_id = s.src JOIN memberships t ON t.account_id = s.tgt WHERE f.artist_id <> t.artist_id)
SELECT x.a AS low, x.b AS high FROM claim x JOIN claim y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"""))
def reciprocal_artists(spark, d):
    edges, accounts = w.edges(spark, d), w.accounts(spark, d)
    both = ev.strong_edges(edges, accounts).unionByName(ev.flipped_edges(edges, accounts))
    return clustering.reciprocal_artists(clustering.artist_claims(both, w.memberships(spark, d)))


@query("combined_cap", oracle("""
, claim AS (SELECT DISTINCT least(f.artist_id, t.artist_id) AS low, greatest(f.artist_id, t.artist_id) AS high FROM strong s JOIN memberships f ON f.account_id = s.src JOIN memberships t ON t.account_id = s.tgt WHERE f.artist_id <> t.artist_id),
tally AS (SELECT artist_id, platform, count(*) AS members FROM memberships JOIN accounts USING (account_id) GROUP BY ALL),
side AS (SELECT low, high, platform, members FROM claim JOIN tally ON artist_id = low UNION ALL SELECT low, high, platform, members FROM claim JOIN tally ON artist_id = high)
SELECT low, high, CAST(max(n) AS BIGINT) AS fullest FROM (SELECT low, high, platform, sum(members) AS n FROM side GROUP BY ALL) GROUP BY ALL"""))
def combined_cap(spark, d):
    s = w.state(spark, d)
    claims = clustering.artist_claims(ev.strong_edges(s.edges, s.accounts), s.memberships)
    pairs = claims.select(F.least("from_artist", "to_artist").alias("low"), F.greatest("from_artist", "to_artist").alias("high")).distinct()
    return clustering.combined_fullest(pairs, ev.platform_counts(s.memberships, s.accounts))


@query("merge_questions", oracle(ONE_WAY + """
, claim AS (
  SELECT DISTINCT least(f.artist_id, t.artist_id) AS artist_id, greatest(f.artist_id, t.artist_id) AS other_artist_id FROM one_way s
  JOIN memberships f ON f.account_id = s.src JOIN memberships t ON t.account_id = s.tgt
  WHERE f.artist_id <> t.artist_id AND (s.tgt NOT IN (SELECT account_id FROM shared) OR s.relation_hint = 'oauth'))
SELECT artist_id || ',' || other_artist_id AS review_key, artist_id, other_artist_id FROM claim
WHERE artist_id || ',' || other_artist_id NOT IN (SELECT review_key FROM reviews WHERE kind = 'cluster_merge')"""))
def merge_questions(spark, d):
    s = w.state(spark, d)
    shared = clustering.shared_targets(ev.strong_edges(s.edges, s.accounts), s.memberships)
    done = clustering.ask_conflicts(s, shared, w.as_of())
    return done.reviews.filter("reason = 'cross_artist_link'").select("review_key", "artist_id", "other_artist_id")


@query("demoted_singles", oracle("""
, touched AS (SELECT DISTINCT artist_id FROM artist_events WHERE actor LIKE 'admin%'),
single AS (SELECT artist_id, min(account_id) AS account_id FROM memberships WHERE artist_id IN (SELECT artist_id FROM artists WHERE status = 'active' AND merged_into IS NULL) AND artist_id NOT IN (SELECT artist_id FROM touched) GROUP BY 1 HAVING count(*) = 1)
SELECT s.artist_id, s.account_id FROM single s JOIN accounts a USING (account_id) LEFT JOIN latest_bio b USING (account_id)
WHERE a.discovered_via IN ('portfolioday', 'portfolioday_mention') AND a.account_id NOT IN (SELECT src FROM strong)
  AND NOT regexp_matches(coalesce(b.bio, '') || chr(10) || coalesce(a.display_name, ''), '(?i)illustrat|artist|art\\b|draw|paint|sketch|doodle|fanart|commission|comm\\b|comms\\b|oc\\b|vtuber|design|animat|pixiv|skeb|vgen|絵|イラスト|落書き|らくがき|依頼|創作|同人')"""))
def demoted_singles(spark, d):
    s = w.state(spark, d)
    done = clustering.demote_without_evidence(s, _facts(s), ev.strong_edges(s.edges, s.accounts), w.as_of())
    return done.events.filter("reason = 'no_artist_evidence'").select("artist_id", "account_id")


@query("singleton_artists", oracle("""
, barred AS (SELECT account_id FROM out_accounts UNION SELECT account_id FROM memberships WHERE artist_id IN (SELECT artist_id FROM out_artists)),
alone AS (
  SELECT a.* FROM accounts a JOIN platforms p USING (platform)
  WHERE a.discovered_via IN ('bsky_feed','bsky_starter_pack','bsky_list','portfolioday','portfolioday_mention','twitter_list','skeb_ranking','pixiv_ranking','pixiv_tag_search','patreon_ranking','artstation_ranking','deviantart_popular','vgen_marketplace','convention_list','platform_roster','manual_tag')
    AND p.kind <> 'link_hub' AND a.status IN ('active', 'unknown') AND NOT (a.discovered_via = 'manual_tag' AND a.last_hydrated IS NULL)
    AND a.account_id NOT IN (SELECT account_id FROM memberships) AND a.account_id NOT IN (SELECT account_id FROM barred)),
doubt AS (
  SELECT a.account_id FROM accounts a LEFT JOIN latest_bio b USING (account_id) WHERE a.discovered_via IN ('portfolioday', 'portfolioday_mention') AND a.account_id NOT IN (SELECT src FROM strong)
    AND NOT regexp_matches(coalesce(b.bio, '') || chr(10) || coalesce(a.display_name, ''), '(?i)illustrat|artist|art\\b|draw|paint|sketch|doodle|fanart|commission|comm\\b|comms\\b|oc\\b|vtuber|design|animat|pixiv|skeb|vgen|絵|イラスト|落書き|らくがき|依頼|創作|同人'))
SELECT account_id, CASE WHEN account_id IN (SELECT account_id FROM doubt) THEN 'asked' ELSE 'created' END AS outcome FROM alone
WHERE account_id NOT IN (SELECT account_id FROM doubt) OR CAST(account_id AS VARCHAR) NOT IN (SELECT review_key FROM reviews WHERE kind = 'singleton_gate')"""))
def singleton_artists(spark, d):
    s = w.state(spark, d)
    # Asked several times, and without the texts.
    facts = cut_lineage(_facts(s))
    done = clustering.singletons(s, facts, ev.strong_edges(s.edges, s.accounts), w.as_of())
    made = done.events.filter("event = 'created'").select("account_id", F.lit("created").alias("outcome"))
    known = s.reviews.select("item_id")
    asked = done.reviews.join(known, "item_id", "left_anti").select("account_id", F.lit("asked").alias("outcome"))
    return made.unionByName(asked)


@query("hub_fanout", oracle("""
SELECT artist_id, max(n) AS hub_fanout FROM (SELECT src AS account_id, count(*) AS n FROM edges WHERE status = 'present' GROUP BY 1)
JOIN memberships USING (account_id) JOIN accounts USING (account_id) JOIN platforms USING (platform) WHERE kind = 'link_hub' GROUP BY 1"""))
def hub_fanout(spark, d):
    return anomalies.hub_fanout(w.edges(spark, d), w.accounts(spark, d), w.memberships(spark, d))


@query("hub_attached", oracle("""
SELECT artist_id, count(*) AS hub_attached FROM memberships JOIN accounts USING (account_id) WHERE discovered_via = 'link_hub' GROUP BY 1"""))
def hub_attached(spark, d):
    return anomalies.hub_attached(w.accounts(spark, d), w.memberships(spark, d))


@query("related_connections", oracle("""
SELECT m.artist_id, count(DISTINCT e.edge_id) AS related_connections FROM edges e JOIN memberships m ON m.account_id IN (e.src, e.tgt) WHERE e.claim = 'related' AND e.status = 'present' GROUP BY 1"""))
def related_connections(spark, d):
    return anomalies.related_connections(w.edges(spark, d), w.memberships(spark, d))


@query("artist_anomalies", oracle("""
, m AS (
SELECT ar.artist_id, ar.public_slug,
  (SELECT max(n) FROM (SELECT e.src, count(*) AS n FROM edges e JOIN memberships h ON h.account_id = e.src JOIN accounts a ON a.account_id = e.src JOIN platforms p USING (platform) WHERE h.artist_id = ar.artist_id AND p.kind = 'link_hub' AND e.status = 'present' GROUP BY 1)) AS hub_fanout,
  (SELECT count(*) FROM memberships h JOIN accounts a USING (account_id) WHERE h.artist_id = ar.artist_id AND a.discovered_via = 'link_hub') AS hub_attached,
  (SELECT count(DISTINCT e.edge_id) FROM edges e JOIN memberships h ON h.account_id IN (e.src, e.tgt) WHERE h.artist_id = ar.artist_id AND e.claim = 'related' AND e.status = 'present') AS related_connections
FROM artists ar WHERE ar.status = 'active' AND ar.merged_into IS NULL)
SELECT artist_id, public_slug, CASE WHEN hub_fanout >= 25 THEN hub_fanout END AS hub_fanout, CASE WHEN hub_attached >= 20 THEN hub_attached END AS hub_attached,
  CASE WHEN related_connections >= 15 THEN related_connections END AS related_connections
FROM m WHERE hub_fanout >= 25 OR hub_attached >= 20 OR related_connections >= 15"""))
def artist_anomalies(spark, d):
    rows = anomalies.artist_anomalies(w.state(spark, d))
    return rows.select("artist_id", "public_slug", "hub_fanout", "hub_attached", "related_connections")


CROSS = """
, ends AS (SELECT src AS account_id, tgt AS other_id FROM edges WHERE status = 'present' UNION SELECT tgt, src FROM edges WHERE status = 'present'),
crossing AS (
  SELECT DISTINCT m.artist_id, m.account_id, o.artist_id AS other_artist FROM ends JOIN memberships m USING (account_id) JOIN memberships o ON o.account_id = ends.other_id
  JOIN artists ar ON ar.artist_id = m.artist_id AND ar.status = 'active' AND ar.merged_into IS NULL WHERE o.artist_id <> m.artist_id),
flagged AS (SELECT artist_id, account_id, count(*) AS other_artists FROM crossing GROUP BY ALL HAVING count(*) >= 3)"""


@query("cross_artist_refs", oracle(CROSS + " SELECT * FROM flagged"))
def cross_artist_refs(spark, d):
    return anomalies.cross_references(w.edges(spark, d), w.memberships(spark, d), w.artists(spark, d))


@query("referencing_slugs", oracle(CROSS + """
 SELECT c.artist_id, c.account_id, a.public_slug AS other_slug FROM crossing c JOIN flagged f ON f.artist_id = c.artist_id AND f.account_id = c.account_id JOIN artists a ON a.artist_id = c.other_artist"""))
def referencing_slugs(spark, d):
    rows = anomalies.referencing_slugs(w.edges(spark, d), w.memberships(spark, d), w.artists(spark, d))
    return rows.select("artist_id", "account_id", "other_slug")


@query("anomaly_healing", oracle(CROSS + """
, rel AS (SELECT m.artist_id, count(DISTINCT e.edge_id) AS n FROM edges e JOIN memberships m ON m.account_id IN (e.src, e.tgt) WHERE e.claim = 'related' AND e.status = 'present' GROUP BY 1),
hub AS (SELECT artist_id, max(n) AS n FROM (SELECT src AS account_id, count(*) AS n FROM edges WHERE status = 'present' GROUP BY 1) JOIN memberships USING (account_id) JOIN accounts USING (account_id) JOIN platforms USING (platform) WHERE kind = 'link_hub' GROUP BY 1),
att AS (SELECT artist_id, count(*) AS n FROM memberships JOIN accounts USING (account_id) WHERE discovered_via = 'link_hub' GROUP BY 1),
crowded AS (SELECT artist_id FROM artists LEFT JOIN rel USING (artist_id) LEFT JOIN hub USING (artist_id) LEFT JOIN att USING (artist_id) WHERE status = 'active' AND merged_into IS NULL AND (rel.n >= 15 OR hub.n >= 25 OR att.n >= 20))
SELECT item_id FROM reviews WHERE kind = 'other' AND reason = 'anomaly' AND status = 'pending' AND artist_id NOT IN (SELECT artist_id FROM crowded)"""))
def anomaly_healing(spark, d):
    done = anomalies.flag_anomalies(w.state(spark, d), w.as_of())
    return done.reviews.filter("decided_by = 'pipeline:anomaly_cleared'").select("item_id")


@query("incident_edges", oracle("""
SELECT account_id, count(*) AS edges, count(DISTINCT other_id) AS others, CAST(sum(outgoing) AS BIGINT) AS outgoing FROM (
  SELECT src AS account_id, tgt AS other_id, 1 AS outgoing FROM edges UNION ALL SELECT tgt, src, 0 FROM edges) GROUP BY 1"""))
def incident_edges(spark, d):
    return ev.endpoints(w.edges(spark, d)).groupBy("account_id").agg(
        F.count("*").alias("edges"), F.countDistinct("other_id").alias("others"),
        F.count_if(F.col("direction") == "outgoing").alias("outgoing"),
    )


@query("two_hop_vouching", oracle("""
, hints AS (SELECT '(?i)illustrat|artist|art\\b|draw|paint|sketch|doodle|fanart|commission|comm\\b|comms\\b|oc\\b|vtuber|design|animat|pixiv|skeb|vgen|絵|イラスト|落書き|らくがき|依頼|創作|同人' AS artist,
  '(?i)\\b(?:fan)?zines?\\b|\\bbig\\s?bangs?\\b|antholog|合同誌|アンソロ|\\bcharity\\s+(?:project|event|zine)\\b|\\bfan\\s?events?\\b|\\bart\\s+servers?\\b|\\bcollab\\s+(?:server|group)\\b' AS project),
roster AS (SELECT unnest(['bsky_feed','bsky_starter_pack','bsky_list','portfolioday','portfolioday_mention','twitter_list','skeb_ranking','pixiv_ranking','pixiv_tag_search','patreon_ranking','artstation_ranking','deviantart_popular','vgen_marketplace','convention_list','platform_roster','manual_tag']) AS via),
member AS (SELECT DISTINCT account_id FROM memberships JOIN artists USING (artist_id) WHERE status = 'active' AND merged_into IS NULL),
words AS (SELECT account_id, project, discovered_via, concat_ws(' ', handle, display_name, bio) AS t FROM accounts LEFT JOIN latest_bio USING (account_id)),
says AS (SELECT account_id FROM words, hints WHERE NOT words.project AND NOT regexp_matches(t, hints.project)
  AND (account_id IN (SELECT account_id FROM member) OR discovered_via IN (SELECT via FROM roster) OR regexp_matches(t, hints.artist))),
links AS (SELECT DISTINCT src, tgt FROM edges WHERE status = 'present'),
hubs AS (SELECT account_id FROM accounts JOIN platforms USING (platform) WHERE kind = 'link_hub'),
passed AS (SELECT tgt AS account_id FROM links WHERE src IN (SELECT account_id FROM says)
  UNION SELECT b.tgt FROM links a JOIN links b ON a.tgt = b.src WHERE b.src IN (SELECT account_id FROM hubs) AND a.src IN (SELECT account_id FROM says))
SELECT a.account_id, a.handle, a.discovered_via IN (SELECT via FROM roster) OR regexp_matches(a.handle, (SELECT artist FROM hints)) OR a.account_id IN (SELECT account_id FROM passed) AS vouched
FROM accounts a WHERE platform = 'twitter' AND native_id IS NULL AND last_hydrated IS NULL AND status = 'unknown' AND discovered_via <> 'bio_mention' AND NOT project"""))
def two_hop_vouching(spark, d):
    return vouching.gated_backlog(w.state(spark, d))


@query("chain_collapse", oracle("""
, chain(artist_id, root) AS (SELECT artist_id, merged_into FROM artists WHERE merged_into IS NOT NULL
  UNION SELECT c.artist_id, a.merged_into FROM chain c JOIN artists a ON a.artist_id = c.root WHERE a.merged_into IS NOT NULL)
SELECT artist_id, max(root) AS merged_into FROM chain GROUP BY 1""".replace(", chain(", ", chain(")))
def chain_collapse(spark, d):
    pointers = w.artists(spark, d).filter("merged_into is not null").select("artist_id", "merged_into")
    return resolve_chains(pointers, "artist_id", "merged_into")


@query("merge_mapping", oracle("""
, moved AS (SELECT m.account_id, m.artist_id AS loser, a.merged_into AS keeper, m.confidence FROM memberships m JOIN artists a USING (artist_id) WHERE a.merged_into IS NOT NULL),
chain(artist_id, root) AS (SELECT artist_id, merged_into FROM artists WHERE merged_into IS NOT NULL
  UNION SELECT c.artist_id, a.merged_into FROM chain c JOIN artists a ON a.artist_id = c.root WHERE a.merged_into IS NOT NULL),
root AS (SELECT artist_id AS loser, max(root) AS root FROM chain GROUP BY 1)
SELECT moved.account_id, root.root AS artist_id, confidence FROM moved JOIN root USING (loser)
WHERE NOT EXISTS (SELECT 1 FROM artist_events e WHERE e.event = 'account_removed' AND e.actor LIKE 'admin%' AND e.artist_id = root.root AND e.account_id = moved.account_id)"""))
def merge_mapping(spark, d):
    s = w.state(spark, d)
    mapping = s.artists.filter("merged_into is not null").select(F.col("artist_id").alias("loser"), F.col("merged_into").alias("keeper"))
    done = clustering.merge_artists(s, mapping, "pipeline", w.as_of())
    return done.memberships.filter(F.col("added_at") == w.as_of()).select("account_id", "artist_id", "confidence")


@query("unique_slug", """
WITH b AS (SELECT p_partkey, replace(p_name, ' ', '-') AS base FROM part)
SELECT p_partkey AS account_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS public_slug
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)""")
def unique_slug(spark, d):
    part = w.table(spark, d, "part").select(
        F.col("p_partkey").alias("account_id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("base")
    )
    none = spark.createDataFrame([], "public_slug string")
    return clustering.unique_slugs(part, none).select("account_id", "public_slug")


@query("platform_tally", oracle("SELECT artist_id, platform, count(*) AS members FROM memberships JOIN accounts USING (account_id) GROUP BY ALL"))
def platform_tally(spark, d):
    return ev.platform_counts(w.memberships(spark, d), w.accounts(spark, d))


@query("suppression_scopes", oracle("""
SELECT account_id FROM out_accounts UNION SELECT account_id FROM memberships WHERE artist_id IN (SELECT artist_id FROM out_artists)"""))
def suppression_scopes(spark, d):
    return ev.suppressed_accounts(w.suppressions(spark, d), w.memberships(spark, d))


@query("human_closed_pairs", oracle("SELECT DISTINCT artist_id, account_id FROM artist_events WHERE event = 'account_removed' AND actor LIKE 'admin%'"))
def human_closed_pairs(spark, d):
    return ev.human_closed(w.artist_events(spark, d))


CONNECTED = """
, ends AS (SELECT edge_id, claim, relation_hint, src AS account_id, tgt AS other_id, 'outgoing' AS direction FROM edges WHERE status = 'present'
  UNION ALL SELECT edge_id, claim, relation_hint, tgt, src, 'incoming' FROM edges WHERE status = 'present'),
conn AS (
  SELECT * FROM (SELECT m.artist_id, e.*, row_number() OVER (PARTITION BY m.artist_id, e.other_id ORDER BY e.claim DESC, e.edge_id) AS rn
    FROM ends e JOIN memberships m USING (account_id) WHERE NOT EXISTS (SELECT 1 FROM memberships i WHERE i.artist_id = m.artist_id AND i.account_id = e.other_id))
  WHERE rn = 1 AND other_id IN (SELECT account_id FROM accounts WHERE NOT project)),
home AS (SELECT m.account_id AS other_id, m.artist_id AS other_artist FROM memberships m JOIN artists a USING (artist_id) WHERE a.merged_into IS NULL)"""


@query("connections", oracle(CONNECTED + """
SELECT c.artist_id, c.other_id, c.edge_id, c.claim, c.relation_hint, h.other_artist FROM conn c LEFT JOIN home h USING (other_id)"""))
def connections(spark, d):
    rows = reports.connections(w.state(spark, d))
    return rows.select("artist_id", "other_id", "edge_id", "claim", "relation_hint", "other_artist")


@query("tiered_connections", oracle(CONNECTED + f"""
, names AS (SELECT DISTINCT account_id, n AS name FROM (SELECT account_id, unnest([{NORMAL_SQL.format("handle")}, {NORMAL_SQL.format("display_name")}]) AS n FROM accounts) WHERE n <> ''),
met AS (
  SELECT DISTINCT c.artist_id, c.other_id, o.name AS a, m.name AS b FROM conn c JOIN names o ON o.account_id = c.other_id
  JOIN memberships h ON h.artist_id = c.artist_id JOIN names m ON m.account_id = h.account_id),{similarity_sql("met")},
best AS (SELECT artist_id, other_id, max(score) AS score FROM met JOIN scored USING (a, b) GROUP BY ALL)
SELECT c.artist_id, c.other_id, round(coalesce(score, 0), 4) AS name_score, CASE WHEN coalesce(score, 0) >= {policy.NAME_MATCH_MIN} THEN 0 WHEN c.claim = 'same_person' THEN 1
  WHEN coalesce(c.relation_hint, '') NOT IN ('same_platform_mention', 'hub_credits', 'website') THEN 2 ELSE 3 END AS tier
FROM conn c LEFT JOIN best USING (artist_id, other_id)"""))
def tiered_connections(spark, d):
    rows = reports.tiered_connections(w.state(spark, d))
    return rows.select("artist_id", "other_id", F.round("name_score", 4).alias("name_score"), "tier")


@query("merge_evidence", oracle("""
, present AS (SELECT * FROM edges WHERE status = 'present'),
pair AS (SELECT DISTINCT artist_id AS low, other_artist_id AS high FROM reviews WHERE kind = 'cluster_merge'),
crossing AS (
  SELECT least(f.artist_id, t.artist_id) AS low, greatest(f.artist_id, t.artist_id) AS high, e.edge_id,
    EXISTS (SELECT 1 FROM present r WHERE r.src = e.tgt AND r.tgt = e.src) AS mutual
  FROM present e JOIN memberships f ON f.account_id = e.src JOIN memberships t ON t.account_id = e.tgt WHERE f.artist_id <> t.artist_id)
SELECT low, high, edge_id, mutual, shown FROM (SELECT c.*, row_number() OVER (PARTITION BY low, high ORDER BY mutual DESC, edge_id) AS shown FROM crossing c JOIN pair USING (low, high)) WHERE shown <= 8"""))
def merge_evidence(spark, d):
    s = w.state(spark, d)
    pairs = s.reviews.filter("kind = 'cluster_merge'").select(F.col("artist_id").alias("low"), F.col("other_artist_id").alias("high"))
    return reports.merge_evidence(s, pairs).select("low", "high", "edge_id", "mutual", "shown")


@query("artist_merge_evidence", oracle("""
, present AS (SELECT * FROM edges WHERE status = 'present'),
crossing AS (
  SELECT least(f.artist_id, t.artist_id) AS low, greatest(f.artist_id, t.artist_id) AS high, e.edge_id,
    EXISTS (SELECT 1 FROM present r WHERE r.src = e.tgt AND r.tgt = e.src) AS mutual
  FROM present e JOIN memberships f ON f.account_id = e.src JOIN memberships t ON t.account_id = e.tgt WHERE f.artist_id <> t.artist_id)
SELECT low, high, edge_id, mutual, shown FROM (SELECT c.*, row_number() OVER (PARTITION BY low, high ORDER BY mutual DESC, edge_id) AS shown FROM crossing c) WHERE shown <= 8"""))
def artist_merge_evidence(spark, d):
    s = w.state(spark, d)
    claims = clustering.artist_claims(anomalies.present(s.edges), s.memberships)
    pairs = claims.select(F.least("from_artist", "to_artist").alias("low"), F.greatest("from_artist", "to_artist").alias("high"))
    return reports.merge_evidence(s, pairs).select("low", "high", "edge_id", "mutual", "shown")


@query("integrity", oracle("""
SELECT 'merge_chains' AS rule, count(*) AS violations FROM artists a JOIN artists b ON a.merged_into = b.artist_id WHERE b.merged_into IS NOT NULL
UNION ALL SELECT 'double_members', count(*) FROM (SELECT account_id FROM memberships GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_edges', count(*) FROM (SELECT 1 FROM edges GROUP BY src, tgt, evidence_type HAVING count(*) > 1)
UNION ALL SELECT 'self_loops', count(*) FROM edges WHERE src = tgt
UNION ALL SELECT 'double_suppressions', count(*) FROM (SELECT 1 FROM suppressions WHERE NOT lifted GROUP BY artist_id, account_id, reason HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_attestations', count(*) FROM (SELECT 1 FROM attestations GROUP BY account_id, signal, matched_text HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_flags', count(*) FROM (SELECT 1 FROM flags GROUP BY account_id, flag, signal, matched_text HAVING count(*) > 1)
UNION ALL SELECT 'unknown_values', 0"""))
def integrity(spark, d):
    return checks.state_violations(w.state(spark, d))


@query("clustered_state")
def clustered_state(spark, d):
    """The whole clustering run; its invariants are tested, SQL cannot restate the rounds."""
    from ..plans.cluster import cluster

    s = w.state(spark, d)
    s = s.with_(edges=checks_dedupe(s.edges))
    done = cluster(s, w.AS_OF)
    return ev.live(done.memberships).select("artist_id", "account_id", "confidence", "added_by")


def checks_dedupe(edges: DataFrame) -> DataFrame:
    from ..operators.spread import first_per_key
    from ..operators.upsert import EDGE_KEY

    return first_per_key(edges, EDGE_KEY, [F.col("edge_id")])
