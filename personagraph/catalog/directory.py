"""Queries over the published directory, reports, state changes and reading order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import policy
from ..operators import checks, classify, decisions as dec, directory as dr, evidence as ev, hygiene, ledger, ranking, reports, search, upsert as up, vouching
from ..operators.spread import first_per_key, running, top_per_key
from ..operators.store import Store
from ..session import cut_lineage, shared_folder
from . import world as w
from .registry import query, stamp
from .world import oracle

ORDER = "display_rank, coalesce(-followers_count, 1), platform, lower(handle), account_id"
DIRECTORY = f"""
, seen AS (SELECT account_id, max(captured_at) AS seen FROM snapshots GROUP BY 1),
signed AS (SELECT DISTINCT account_id FROM attestations WHERE active), adult AS (SELECT DISTINCT account_id FROM flags WHERE active),
v AS (
  SELECT visible.*, seen.seen, visible.account_id IN (SELECT account_id FROM signed) AS is_signed, visible.account_id IN (SELECT account_id FROM adult) AS is_adult,
    coalesce(starts_with(commission_detail, 'skeb:'), false) AS from_skeb, coalesce(starts_with(commission_detail, 'pixiv:'), false) AS from_pixiv,
    CASE WHEN discovered_via = 'skeb_ranking' THEN 'skeb' WHEN discovered_via LIKE 'bsky!_%' ESCAPE '!' THEN 'bluesky'
      WHEN discovered_via IN ('portfolioday','portfolioday_mention','twitter_list') THEN 'twitter' WHEN discovered_via IN ('pixiv_ranking','pixiv_tag_search') THEN 'pixiv'
      WHEN discovered_via = 'patreon_ranking' THEN 'patreon' WHEN discovered_via = 'artstation_ranking' THEN 'artstation' WHEN discovered_via = 'deviantart_popular' THEN 'deviantart'
      WHEN discovered_via = 'vgen_marketplace' THEN 'vgen' WHEN discovered_via = 'manual_tag' THEN 'tagged' END AS source
  FROM visible LEFT JOIN seen USING (account_id)),
de AS (
  SELECT artist_id, public_slug, region, language,
    coalesce(first(coalesce(nullif(display_name, ''), handle) ORDER BY {ORDER}), first(stored_name)) AS display_name,
    bool_or(is_signed) AS no_ai_attested, bool_or(is_adult) AS nsfw, max(last_post_at) AS last_active_at,
    coalesce(max(last_post_at) < TIMESTAMP '2001-12-01' - INTERVAL 180 DAY, false) AS dormant,
    bool_or(platform = 'skeb' AND commission_status = 'open' AND from_skeb) FILTER (WHERE commission_status <> 'unknown') AS skeb_open,
    bool_or(platform = 'pixiv' AND commission_status = 'open' AND from_pixiv) FILTER (WHERE commission_status <> 'unknown') AS pixiv_open,
    first(commission_status ORDER BY commission_checked_at DESC NULLS LAST, commission_confidence DESC NULLS LAST, account_id) FILTER (WHERE commission_status <> 'unknown' AND NOT from_skeb AND NOT from_pixiv) AS bio_status,
    max(commission_checked_at) FILTER (WHERE commission_status <> 'unknown') AS checked_at,
    first(avatar_url ORDER BY display_rank, coalesce(-followers_count, 1), platform, account_id) FILTER (WHERE avatar_url IS NOT NULL) AS avatar_url,
    array_to_string(list_sort(list_distinct(list(source) FILTER (WHERE source IS NOT NULL))), ',') AS sources,
    coalesce(max(seen) FILTER (WHERE platform = 'twitter'), max(seen)) AS hydrated_at,
    max(followers_count) AS followers, count(*) AS account_count
  FROM v GROUP BY artist_id, public_slug, region, language)"""


@query("directory_view", oracle(DIRECTORY + """
SELECT artist_id, public_slug, display_name, region, language, no_ai_attested, nsfw, strftime(last_active_at, '%Y-%m-%d %H:%M:%S') AS last_active_at, dormant,
  skeb_open, pixiv_open, bio_status, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, avatar_url, coalesce(sources, '') AS sources,
  strftime(hydrated_at, '%Y-%m-%d %H:%M:%S') AS hydrated_at, followers, account_count FROM de"""))
def directory_view(spark, d):
    rows = dr.directory(w.state(spark, d), w.as_of())
    return rows.select(
        "artist_id", "public_slug", "display_name", "region", "language", "no_ai_attested", "nsfw",
        stamp("last_active_at").alias("last_active_at"), "dormant", "commissions.skeb_open", "commissions.pixiv_open",
        "commissions.bio_status", stamp("commissions.checked_at").alias("checked_at"), "avatar_url",
        F.array_join("sources", ",").alias("sources"), stamp("hydrated_at").alias("hydrated_at"), "followers", "account_count",
    )


@query("directory_accounts", oracle(f"""
SELECT artist_id, row_number() OVER (PARTITION BY artist_id ORDER BY {ORDER}) AS position, platform, handle, display_name, confidence, nullif(commission_status, 'unknown') AS commission_status FROM visible"""))
def directory_accounts(spark, d):
    rows = dr.directory_accounts(w.state(spark, d))
    return rows.select("artist_id", "position", "platform", "handle", "display_name", "confidence", "commission_status")


@query("directory_nested", oracle(f"""
SELECT artist_id, 0 AS part, string_agg(platform || ':' || handle, ' ' ORDER BY {ORDER}) AS accounts FROM visible GROUP BY 1"""))
def directory_nested(spark, d):
    rows = dr.nest_accounts(dr.directory_accounts(w.state(spark, d)))
    return rows.select(
        "artist_id", "part", F.array_join(F.transform("accounts", lambda a: F.concat_ws(":", a["platform"], a["handle"])), " ").alias("accounts")
    )


def _searched(spark, d, filters):
    s = w.state(spark, d)
    return search.search(dr.directory(s, w.as_of()), dr.visible_members(s), s, filters)


@query("directory_search", oracle(DIRECTORY + """
SELECT artist_id, public_slug, followers FROM de WHERE NOT nsfw AND (contains(lower(public_slug), 'ring') OR contains(lower(display_name), 'ring')
  OR artist_id IN (SELECT artist_id FROM memberships JOIN accounts USING (account_id) WHERE contains(lower(handle), 'ring')))"""))
def directory_search(spark, d):
    return _searched(spark, d, search.Filters(text="Ring")).select("artist_id", "public_slug", "followers")


@query("directory_facets", oracle(DIRECTORY + """
SELECT artist_id, public_slug FROM de WHERE language IN ('ja', 'en') AND dormant
  AND (SELECT count(DISTINCT platform) FROM visible x WHERE x.artist_id = de.artist_id AND platform IN ('twitter')) = 1
  AND len(list_intersect(string_split(sources, ','), ['twitter', 'pixiv', 'bluesky'])) > 0"""))
def directory_facets(spark, d):
    f = search.Filters(platforms=["twitter"], languages=["ja", "en"], sources=["twitter", "pixiv", "bluesky"], flags=["dormant"], show_adult=True)
    return _searched(spark, d, f).select("artist_id", "public_slug")


@query("directory_open_commissions", oracle(DIRECTORY + """
SELECT artist_id, public_slug FROM de WHERE NOT nsfw AND artist_id IN (SELECT artist_id FROM memberships JOIN accounts USING (account_id)
  WHERE commission_status = 'open' AND NOT starts_with(commission_detail, 'skeb:') AND NOT starts_with(commission_detail, 'pixiv:'))
  AND artist_id NOT IN (SELECT artist_id FROM memberships JOIN accounts USING (account_id) WHERE platform IN ('twitter', 'bluesky'))"""))
def directory_open_commissions(spark, d):
    return _searched(spark, d, search.Filters(flags=["no_pkey"], commissions=["bio"])).select("artist_id", "public_slug")


@query("directory_page", oracle(DIRECTORY + """
SELECT artist_id, public_slug, followers FROM de WHERE NOT nsfw ORDER BY followers DESC NULLS LAST, public_slug LIMIT 50 OFFSET 50"""))
def directory_page(spark, d):
    return search.page(_searched(spark, d, search.Filters()), "followers", number=2).select("artist_id", "public_slug", "followers")


@query("directory_last_page", oracle(DIRECTORY + """
SELECT artist_id, public_slug FROM de WHERE NOT nsfw ORDER BY followers NULLS LAST, public_slug LIMIT 50
OFFSET (SELECT 50 * (greatest(1, CAST(ceil(count(*) / 50) AS BIGINT)) - 1) FROM de WHERE NOT nsfw)"""))
def directory_last_page(spark, d):
    """A page number beyond the last one."""
    return search.page(_searched(spark, d, search.Filters()), "followers", True, number=10**9).select("artist_id", "public_slug")


@query("directory_keyset", oracle(DIRECTORY + """
SELECT artist_id, public_slug, followers FROM de WHERE NOT nsfw ORDER BY followers DESC NULLS LAST, public_slug LIMIT 7 OFFSET 21"""))
def directory_keyset(spark, d):
    """The fourth page of seven rows, each page found from the last row of the one before."""
    rows = cut_lineage(_searched(spark, d, search.Filters()))
    cursor = None
    for _ in range(3):
        cursor = search.page_after(rows, cursor, size=7).tail(1)[0]
    return search.page_after(rows, cursor, size=7).select("artist_id", "public_slug", "followers")


@query("page_count", oracle(DIRECTORY + " SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM de WHERE NOT nsfw"))
def page_count(spark, d):
    return search.page_count(_searched(spark, d, search.Filters()))


@query("facet_counts", oracle("""
SELECT platform, count(*) AS n, display_rank FROM visible WHERE platform <> 'website' GROUP BY platform, display_rank"""))
def facet_counts(spark, d):
    return search.platform_facets(dr.visible_members(w.state(spark, d))).select("platform", "n", "display_rank")


@query("language_options", oracle("SELECT DISTINCT language FROM visible"))
def language_options(spark, d):
    return search.language_options(dr.directory(w.state(spark, d), w.as_of()))


@query("headline", oracle(DIRECTORY + """
SELECT (SELECT count(*) FROM de) AS artists, (SELECT count(*) FROM de WHERE nsfw) AS nsfw, (SELECT count(*) FROM accounts) AS accounts,
  (SELECT count(DISTINCT artist_id) FROM suppressions WHERE NOT lifted) AS suppressed"""))
def headline(spark, d):
    s = w.state(spark, d)
    return search.headline(dr.directory(s, w.as_of()), s)


@query("demoted_artists", oracle("""
, mem AS (SELECT artist_id, max(followers_count) AS followers, array_to_string(list_sort(list_distinct(list(platform))), ', ') AS platforms FROM memberships JOIN accounts USING (account_id) GROUP BY 1),
newest AS (SELECT artist_id, first(bio_text ORDER BY captured_at DESC, snapshot_id DESC) AS bio FROM snapshots JOIN memberships USING (account_id) GROUP BY 1)
SELECT artist_id, public_slug, followers, platforms, length(bio) AS bio_length FROM artists LEFT JOIN mem USING (artist_id) LEFT JOIN newest USING (artist_id) WHERE status = 'needs_review'"""))
def demoted_artists(spark, d):
    return reports.demoted(w.state(spark, d)).select("artist_id", "public_slug", "followers", "platforms", F.length("bio").alias("bio_length"))


@query("suppressed_artists", oracle("SELECT artist_id, reason, public_slug FROM suppressions JOIN artists USING (artist_id) WHERE NOT lifted"))
def suppressed_artists(spark, d):
    return reports.suppressed_list(w.state(spark, d)).select("artist_id", "reason", "public_slug")


@query("suppressed_accounts", oracle("""
SELECT s.account_id, s.reason, a.platform, a.handle, m.artist_id FROM suppressions s JOIN accounts a ON a.account_id = s.account_id LEFT JOIN memberships m ON m.account_id = s.account_id WHERE NOT lifted"""))
def suppressed_accounts(spark, d):
    return reports.suppressed_account_list(w.state(spark, d)).select("account_id", "reason", "platform", "handle", "artist_id")


@query("hidden_accounts", oracle("""
SELECT account_id, platform, handle, followers_count, artist_id FROM accounts LEFT JOIN memberships USING (account_id)
WHERE status = 'hidden' AND platform <> 'website' ORDER BY followers_count DESC NULLS LAST, account_id LIMIT 500"""))
def hidden_accounts(spark, d):
    return reports.hidden_list(w.state(spark, d)).select("account_id", "platform", "handle", "followers_count", "artist_id")


@query("invisible_artists", oracle("""
SELECT m.artist_id, m.account_id, a.status FROM memberships m JOIN accounts a USING (account_id) JOIN artists ar ON ar.artist_id = m.artist_id
WHERE ar.status = 'active' AND ar.merged_into IS NULL AND m.artist_id NOT IN (SELECT artist_id FROM visible) AND m.artist_id NOT IN (SELECT artist_id FROM out_artists)"""))
def invisible_artists(spark, d):
    return reports.invisible_accounts(w.state(spark, d)).select("artist_id", "account_id", "status")


@query("source_report", oracle("""
, c AS (SELECT discovered_via AS source, count(DISTINCT account_id) AS accounts, count(DISTINCT artist_id) AS artists FROM accounts LEFT JOIN memberships USING (account_id) GROUP BY 1)
SELECT source, accounts, artists, CAST(greatest(1, round_even(100 * artists / (SELECT greatest(max(artists), 1) FROM c), 0)) AS INT) AS pct FROM c"""))
def source_report(spark, d):
    return reports.source_report(w.accounts(spark, d), w.memberships(spark, d))


@query("source_breakdown", oracle("""
, c AS (SELECT discovered_via AS source, commission_detail AS label, count(*) AS n FROM accounts WHERE commission_detail IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS rk FROM c)
SELECT source, label, n, 1 AS labels FROM r WHERE rk <= 14 UNION ALL SELECT source, NULL, CAST(sum(n) AS BIGINT), count(*) FROM r WHERE rk > 14 GROUP BY source"""))
def source_breakdown(spark, d):
    rows = w.accounts(spark, d).filter("commission_detail is not null").select(
        F.col("discovered_via").alias("source"), F.col("commission_detail").alias("label")
    )
    return reports.breakdown(rows, "source", "label")


@query("rule_counters", oracle("""
SELECT (SELECT count(*) FROM edges WHERE status = 'present' AND claim = 'same_person') AS same_edges,
  (SELECT count(*) FROM edges WHERE status = 'present' AND claim = 'related' AND relation_hint IN ('unreciprocated_prominent', 'secondary_link', 'over_platform_cap')) AS flipped,
  (SELECT count(*) FROM edges WHERE status = 'present' AND claim = 'related' AND relation_hint = 'unreciprocated_prominent') AS flip_prominent,
  (SELECT count(*) FROM edges WHERE status = 'present' AND claim = 'related' AND relation_hint = 'secondary_link') AS flip_secondary,
  (SELECT count(*) FROM reviews WHERE status = 'pending') AS pending, 0 AS anomalies_healed,
  (SELECT count(*) FROM accounts WHERE status = 'hidden' AND platform = 'website') AS junk_hidden, (SELECT count(*) FROM accounts WHERE project) AS project_flagged,
  (SELECT count(DISTINCT artist_id) FROM suppressions WHERE NOT lifted) AS suppressed, (SELECT CAST(sum(est_cost_cents) AS BIGINT) FROM usage WHERE service = 'x_api') AS spent"""))
def rule_counters(spark, d):
    return reports.rule_counters(w.state(spark, d), w.usage(spark, d))


@query("signals_union", oracle("""
SELECT artist_id, account_id, kind, signal, matched_text FROM (SELECT account_id, 'attestation' AS kind, signal, matched_text FROM attestations WHERE active
  UNION ALL SELECT account_id, 'content_flag', signal, matched_text FROM flags WHERE active) JOIN memberships USING (account_id)"""))
def signals_union(spark, d):
    return reports.signals(w.state(spark, d)).select("artist_id", "account_id", "kind", "signal", "matched_text")


@query("pending_items", oracle("""
SELECT DISTINCT item_id, kind, artist_id FROM (
  SELECT item_id, kind, unnest([artist_id, other_artist_id]) AS artist_id FROM reviews WHERE status = 'pending' AND kind <> 'singleton_gate'
  UNION ALL SELECT r.item_id, r.kind, m.artist_id FROM reviews r JOIN memberships m ON m.account_id = r.account_id WHERE r.status = 'pending' AND r.kind = 'singleton_gate') WHERE artist_id IS NOT NULL"""))
def pending_items(spark, d):
    return reports.pending_for_artists(w.state(spark, d))


@query("review_queue", oracle("""
SELECT r.item_id, r.kind, a.handle, e.evidence_type, x.public_slug, y.public_slug AS other_slug, length(b.bio) AS bio_length
FROM reviews r LEFT JOIN accounts a ON a.account_id = r.account_id LEFT JOIN edges e ON e.edge_id = r.edge_id LEFT JOIN latest_bio b ON b.account_id = r.account_id
LEFT JOIN artists x ON x.artist_id = r.artist_id LEFT JOIN artists y ON y.artist_id = r.other_artist_id WHERE r.status = 'pending'"""))
def review_queue(spark, d):
    return reports.review_queue(w.state(spark, d)).select(
        "item_id", "kind", "handle", "evidence_type", "public_slug", "other_slug", F.length("bio").alias("bio_length")
    )


@query("state_lookup", oracle("""
, asked AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS handle FROM part WHERE regexp_full_match(lower(replace(p_name, ' ', '_')) || '_' || p_partkey, '[a-z0-9_]{1,15}')),
judged AS (
  SELECT lower(a.handle) AS handle, a.account_id, m.artist_id, m.public_slug,
    CASE WHEN a.account_id IN (SELECT account_id FROM out_accounts) OR m.artist_id IN (SELECT artist_id FROM out_artists) THEN 'removed' WHEN a.status IN ('hidden', 'deleted') THEN 'removed'
      WHEN a.discovered_via = 'manual_tag' AND a.last_hydrated IS NULL THEN 'queued' WHEN m.artist_id IN (SELECT artist_id FROM visible) THEN 'listed'
      WHEN a.discovered_via = 'manual_tag' THEN 'tagged' ELSE 'tracked' END AS state
  FROM accounts a LEFT JOIN (SELECT mm.account_id, ar.artist_id, ar.public_slug FROM memberships mm JOIN artists ar USING (artist_id) WHERE ar.merged_into IS NULL) m USING (account_id) WHERE a.platform = 'twitter')
SELECT asked.handle, coalesce(j.state, 'untracked') AS state, j.artist_id, j.public_slug FROM asked LEFT JOIN judged j USING (handle)"""))
def state_lookup(spark, d):
    names = w.table(spark, d, "part").select(
        F.concat(F.lit(" @"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("handle")
    )
    requested = reports.clean_handles(names)
    return reports.handle_states(requested, w.state(spark, d)).select("handle", "state", "artist_id", "public_slug")


@query("tag_queue", oracle("""
SELECT count(*) AS queued, count(*) AS est_cents, (SELECT CAST(sum(est_cost_cents) AS BIGINT) FROM usage WHERE service = 'x_api') AS spent_cents, 10000 AS cap_cents
FROM accounts WHERE platform = 'twitter' AND discovered_via = 'manual_tag' AND last_hydrated IS NULL AND native_id IS NULL AND status = 'unknown'"""))
def tag_queue(spark, d):
    return reports.tag_queue_cost(w.accounts(spark, d), w.usage(spark, d))


@query("tag_counts", oracle("""
SELECT count(DISTINCT account_id) AS tagged, count(DISTINCT account_id) FILTER (WHERE last_hydrated IS NULL AND status = 'unknown') AS queued,
  count(DISTINCT account_id) FILTER (WHERE last_hydrated IS NOT NULL AND status NOT IN ('hidden', 'deleted')) AS hydrated, count(DISTINCT artist_id) AS artists,
  count(DISTINCT account_id) FILTER (WHERE status IN ('hidden', 'deleted')) AS removed
FROM accounts LEFT JOIN memberships USING (account_id) WHERE platform = 'twitter' AND discovered_via = 'manual_tag'"""))
def tag_counts(spark, d):
    return reports.tag_counts(w.state(spark, d))


@query("tag_dashboard", oracle("""
SELECT account_id, handle, artist_id IN (SELECT artist_id FROM visible) AND artist_id IS NOT NULL AS listed FROM accounts
LEFT JOIN (SELECT account_id, artist_id FROM memberships JOIN artists USING (artist_id) WHERE merged_into IS NULL) USING (account_id)
WHERE platform = 'twitter' AND discovered_via = 'manual_tag' ORDER BY account_id DESC LIMIT 100"""))
def tag_dashboard(spark, d):
    return reports.tag_dashboard(w.state(spark, d)).select("account_id", "handle", "listed")


@query("link_check_queue", oracle("""
SELECT account_id, platform, account_id IN (SELECT account_id FROM memberships JOIN artists USING (artist_id) WHERE artists.status = 'active') AS listed FROM accounts
WHERE status <> 'deleted' AND (link_checked_at IS NULL OR link_checked_at < TIMESTAMP '2001-12-01' - INTERVAL 30 DAY) AND platform NOT IN ('twitter', 'instagram', 'bluesky', 'discord', 'telegram')
ORDER BY 3 DESC, link_checked_at ASC NULLS FIRST, account_id LIMIT 300"""))
def link_check_queue(spark, d):
    return reports.link_check_queue(w.state(spark, d), w.as_of()).select("account_id", "platform", "listed")


@query("hydration_queue", oracle("""
SELECT account_id, handle FROM accounts WHERE platform = 'pixiv' AND status <> 'deleted' ORDER BY last_hydrated ASC NULLS FIRST, account_id LIMIT 200"""))
def hydration_queue(spark, d):
    return reports.hydration_queue(w.accounts(spark, d), "pixiv", 200).select("account_id", "handle")


# --- classification, ranking, ledger ---


@query("region_classes", oracle("""
, t AS (SELECT m.artist_id, a.platform, coalesce(b.bio, '') || ' ' || coalesce(a.display_name, '') AS txt FROM memberships m JOIN accounts a USING (account_id) LEFT JOIN latest_bio b USING (account_id)
  WHERE m.artist_id IN (SELECT artist_id FROM artists WHERE region_source = 'auto' AND merged_into IS NULL)),
g AS (SELECT artist_id, string_agg(txt, ' ') AS txt,
  count(DISTINCT platform) FILTER (WHERE platform IN ('skeb','pixiv','fanbox','fantia','booth','dlsite','nijie','skima','coconala','mihuashi','xfolio','litlink','potofu','profcard','twpf','tsunagu')) AS east_n,
  count(DISTINCT platform) FILTER (WHERE platform IN ('artstation','furaffinity','inprnt','deviantart')) AS west_n FROM t GROUP BY 1),
l AS (SELECT *, CASE WHEN regexp_matches(txt, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(txt, '[가-힯]') THEN 'ko' WHEN regexp_matches(txt, '[一-鿿]') THEN 'zh' WHEN regexp_matches(txt, '[ก-๛]{2}') THEN 'th'
  WHEN regexp_matches(txt, '[Ѐ-ӿ]{4,}') THEN 'ru' WHEN regexp_matches(txt, '[؀-ۿ]{2}') THEN 'ar' WHEN regexp_matches(txt, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM g),
s AS (SELECT artist_id, language, CASE WHEN language IN ('ja', 'ko') THEN 2.0 WHEN language = 'zh' THEN 1.5 ELSE 0 END + least(east_n, 3) AS e, CASE WHEN language = 'en' THEN 1.0 ELSE 0 END + least(west_n, 3) AS w FROM l)
SELECT artist_id, language, CASE WHEN abs(e - w) < 0.75 THEN 'unknown' WHEN e > w THEN 'eastern' ELSE 'western' END AS region,
  CAST(CASE WHEN abs(e - w) < 0.75 THEN 0 ELSE round(least(abs(e - w) / 4, 1.0), 2) END AS DOUBLE) AS confidence FROM s"""))
def region_classes(spark, d):
    return classify.classify_artists(w.state(spark, d))


@query("stratified_rank", """
SELECT n_regionkey, c_mktsegment, c_custkey, c_acctbal, rank, rank <= 20 AS included, abs(rank - 20) <= 5 AS border
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def stratified_rank(spark, d):
    rows = w.table(spark, d, "customer").join(
        F.broadcast(w.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return ranking.stratified_rank(rows, ["n_regionkey", "c_mktsegment"], "c_acctbal", "c_custkey", 20, 5)


@query("hint_verification", oracle("""
, seen AS (SELECT DISTINCT platform, lower(handle) AS h FROM accounts JOIN edges ON tgt = account_id WHERE edges.status = 'present' AND claim = 'same_person')
SELECT account_id AS hint_id, CASE WHEN (platform, lower(handle)) IN (SELECT (platform, h) FROM seen) THEN 'verified'
  WHEN last_post_at < TIMESTAMP '2001-12-01' - INTERVAL 300 DAY THEN 'expired' ELSE 'pending' END AS status FROM accounts"""))
def hint_verification(spark, d):
    accounts = w.accounts(spark, d)
    hints = accounts.select(
        F.col("account_id").alias("hint_id"), F.lit("booru").alias("source"), "platform", F.col("handle").alias("hinted_handle"),
        F.lit("pending").alias("status"), F.col("last_post_at").alias("created_at"),
    )
    linked = w.edges(spark, d).filter("status = 'present' and claim = 'same_person'").select(F.col("target_account_id").alias("account_id"))
    published = accounts.join(linked, "account_id", "left_semi").select("platform", "handle")
    return ranking.verify_hints(hints, published, w.as_of(), 300).select("hint_id", "status")


@query("run_comparison", """
SELECT c_mktsegment, count(*) AS before, count(*) FILTER (WHERE o_custkey IS NULL) AS dropped, round(count(*) FILTER (WHERE o_custkey IS NULL) / count(*), 4) AS dropped_share
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice >= 450000) ON o_custkey = c_custkey GROUP BY 1""")
def run_comparison(spark, d):
    before = w.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    after = w.table(spark, d, "orders").filter("o_totalprice >= 450000").select(F.col("o_custkey").alias("k"))
    return ranking.compare_runs(before, after, "k", "c_mktsegment")


@query("spend_ledger", oracle("SELECT service, CAST(sum(est_cost_cents) AS BIGINT) AS cents FROM usage GROUP BY 1"))
def spend_ledger(spark, d):
    return ledger.spend_by_service(w.usage(spark, d))


@query("recent_spend", oracle("""
SELECT strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, CAST(sum(units) AS BIGINT) AS units, CAST(sum(est_cost_cents) AS BIGINT) AS cents
FROM usage WHERE service = 'x_api' AND note = 'tag flush' GROUP BY usage.occurred_at ORDER BY usage.occurred_at DESC LIMIT 8"""))
def recent_spend(spark, d):
    rows = ledger.recent_spend(w.usage(spark, d), "x_api", "tag flush")
    return rows.select(stamp("occurred_at").alias("occurred_at"), "units", "cents")


@query("billing", """
SELECT event_id, CAST(ceil(floor(value) * 0.5) AS INT) AS est_cost_cents FROM events WHERE floor(value) > 0""")
def billing(spark, d):
    batches = w.table(spark, d, "events").select(
        F.lit("x_api").alias("service"), F.col("event_id").cast("string").alias("endpoint"), F.floor("value").cast("int").alias("units"),
        F.lit(None).cast("string").alias("note"),
    )
    billed = ledger.bill(batches, policy.POST_READ_CENTS, w.as_of())
    return billed.select(F.col("endpoint").cast("bigint").alias("event_id"), "est_cost_cents")


@query("budget_cut", """
SELECT event_id, event_type, running_cents FROM (SELECT event_id, event_type, CAST(sum(floor(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS running_cents FROM events) WHERE running_cents <= 10000""")
def budget_cut(spark, d):
    rows = w.table(spark, d, "events").withColumn("cents", F.floor("value"))
    kept = ledger.within_budget(rows, [F.col("ts"), F.col("event_id")], F.col("cents"), ["event_type"], F.lit(policy.DEFAULT_CAP_CENTS))
    return kept.select("event_id", "event_type", "running_cents")


@query("new_cap_running", """
SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END) OVER (ORDER BY value DESC, event_id) AS n FROM events) WHERE event_type = 'signup' OR n <= 500""")
def new_cap_running(spark, d):
    rows = w.table(spark, d, "events")
    kept = ledger.cap_new(rows, F.col("event_type") == "signup", [F.col("value").desc(), F.col("event_id")], 500)
    return kept.select("user_id", "event_id")


@query("hydration_backlog_cost", oracle("""
SELECT count(*) AS rows_waiting FROM accounts WHERE platform = 'twitter' AND native_id IS NULL AND last_hydrated IS NULL AND status = 'unknown' AND discovered_via <> 'bio_mention' AND NOT project"""))
def hydration_backlog_cost(spark, d):
    return vouching.backlog_report(w.state(spark, d)).select((F.col("vouched") + F.col("skipped")).alias("rows_waiting"))


# --- reading order ---


@query("first_seen_roster", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_seen_roster(spark, d):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    rows = w.table(spark, d, "events")
    return first_per_key(rows, ["user_id"], [rank, F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("latest_event_by_type", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_event_by_type(spark, d):
    rows = w.table(spark, d, "events")
    return first_per_key(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("top_per_source", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_per_source(spark, d):
    rows = w.table(spark, d, "orders")
    return top_per_key(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, "rank").select("o_custkey", "o_orderkey", "rank")


@query("cap_slots", oracle("""
, tally AS (SELECT artist_id, platform, count(*) AS members FROM memberships JOIN accounts USING (account_id) GROUP BY ALL),
c AS (SELECT m.artist_id, a.platform, e.tgt AS account_id, min(e.edge_id) AS edge_id FROM edges e JOIN memberships m ON m.account_id = e.src JOIN accounts a ON a.account_id = e.tgt WHERE e.status = 'present' GROUP BY ALL)
SELECT artist_id, platform, account_id, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY artist_id, platform ORDER BY edge_id) AS slot FROM c) LEFT JOIN tally USING (artist_id, platform) WHERE slot + coalesce(members, 0) <= 3"""))
def cap_slots(spark, d):
    from ..operators.clustering import slots_left

    accounts, members = w.accounts(spark, d), w.memberships(spark, d)
    homes = members.select(F.col("account_id").alias("source_account_id"), "artist_id")
    links = w.edges(spark, d).filter("status = 'present'").join(homes, "source_account_id")
    rows = links.join(accounts.select(F.col("account_id").alias("target_account_id"), "platform"), "target_account_id")
    one = rows.groupBy("artist_id", "platform", F.col("target_account_id").alias("account_id")).agg(F.min("edge_id").alias("edge_id"))
    return slots_left(one, ev.platform_counts(members, accounts), [F.col("edge_id")])


@query("running_positions", """
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS position,
  CAST(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_quantity FROM lineitem""")
def running_positions(spark, d):
    rows = w.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    return running(rows, ["l_suppkey"], order, {"running_quantity": F.col("l_quantity").cast("bigint")}).drop("l_shipdate")


# --- state changes ---


@query("dormant_accounts", oracle("""
SELECT account_id, coalesce(last_post_at < TIMESTAMP '2001-12-01' - INTERVAL 180 DAY, false) AS dormant FROM accounts"""))
def dormant_accounts(spark, d):
    old = F.col("last_post_at") < w.as_of() - F.expr("interval 180 days")
    return w.accounts(spark, d).select("account_id", F.coalesce(old, F.lit(False)).alias("dormant"))


@query("low_follower_cull", oracle("""
SELECT account_id, CASE WHEN platform IN ('twitter', 'bluesky') AND status = 'active' AND followers_count < 50 AND discovered_via <> 'manual_tag' THEN 'hidden' ELSE status END AS status FROM accounts"""))
def low_follower_cull(spark, d):
    return hygiene.cull_low_followers(w.accounts(spark, d)).select("account_id", "status")


@query("status_fold", oracle("""
, obs AS (SELECT user_id AS account_id, first(CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 200 WHEN 'click' THEN 410 ELSE 503 END ORDER BY ts DESC) AS code FROM events GROUP BY 1)
SELECT account_id, CASE WHEN code IN (404, 410) THEN 'deleted' WHEN code = 200 AND status <> 'hidden' THEN 'active' ELSE status END AS status FROM accounts LEFT JOIN obs USING (account_id)"""))
def status_fold(spark, d):
    kind = F.col("event_type")
    code = F.when(kind == "error", 404).when(kind == "view", 200).when(kind == "click", 410).otherwise(503)
    seen = w.table(spark, d, "events").select(F.col("user_id").alias("account_id"), code.alias("status_code"), F.col("ts").cast("timestamp").alias("checked_at"))
    return up.fold_status(w.accounts(spark, d), seen).select("account_id", "status")


def _reread(spark, d):
    """Edges read again: the urgent and medium orders' links, as if their texts had been parsed anew."""
    links = w.edges(spark, d)
    return links.filter("evidence_type in ('bio_link', 'profile_field') and claim = 'same_person'").select(
        F.col("edge_id").alias("seq"), "source_account_id", "target_account_id", "evidence_type", "evidence_snapshot_id",
        "evidence_url", "matched_text", F.lit("same_person").alias("claim"), F.lit("reread").alias("relation_hint"),
    )


REREAD = """
, made AS (SELECT src, tgt, evidence_type, max(edge_id) AS seq FROM edges WHERE evidence_type IN ('bio_link', 'profile_field') AND claim = 'same_person' GROUP BY ALL)"""


@query("edge_upsert", oracle(REREAD + """
SELECT e.edge_id, CASE WHEN m.seq IS NOT NULL AND e.status <> 'dismissed' THEN 'present' ELSE e.status END AS status,
  CASE WHEN m.seq IS NOT NULL AND e.status <> 'dismissed' THEN 'reread' ELSE e.relation_hint END AS relation_hint FROM edges e LEFT JOIN made m USING (src, tgt, evidence_type)"""))
def edge_upsert(spark, d):
    return up.upsert_edges(w.edges(spark, d), _reread(spark, d), w.as_of()).select("edge_id", "status", "relation_hint")


BUCKETS = 256
BUCKET_SQL = f"CAST(('0x' || substr(md5(CAST({{key}} AS VARCHAR)), 1, 7)) AS BIGINT) % {BUCKETS}"
SPANISH = "SELECT doc_id FROM documents WHERE lang = 'es'"


def _spanish(spark, d):
    return w.table(spark, d, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("account_id"))


def _with_rewritten(table, change):
    """The table after a change, and whether each row stands in a file that the change wrote."""
    files = lambda: table.spark.read.schema(f"{table.schema}, bucket int").parquet(table.folder).withColumn("file", F.col("_metadata.file_path"))
    before = cut_lineage(files().select("file").distinct())
    change()
    known = before.withColumn("rewritten", F.lit(False))
    return files().join(known, "file", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))


@query("edge_buckets", oracle(REREAD.replace("claim = 'same_person'", f"claim = 'same_person' AND src IN ({SPANISH})") + f"""
SELECT e.edge_id, CASE WHEN m.seq IS NOT NULL AND e.status <> 'dismissed' THEN 'present' ELSE e.status END AS status,
  CASE WHEN m.seq IS NOT NULL AND e.status <> 'dismissed' THEN 'reread' ELSE e.relation_hint END AS relation_hint,
  {BUCKET_SQL.format(key='e.src')} IN (SELECT {BUCKET_SQL.format(key='src')} FROM made) AS rewritten
FROM edges e LEFT JOIN made m USING (src, tgt, evidence_type)"""))
def edge_buckets(spark, d):
    """Edges of the accounts with Spanish texts read again and merged into the stored table."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    table = store.tables["edges"]
    table.create(w.edges(spark, d))
    made = _reread(spark, d).join(_spanish(spark, d).withColumnRenamed("account_id", "source_account_id"), "source_account_id", "left_semi")
    rows = _with_rewritten(table, lambda: store.merge_edges(made, w.as_of()))
    return rows.select("edge_id", "status", "relation_hint", "rewritten")


@query("account_buckets", oracle(f"""
, said AS (SELECT account_id FROM accounts WHERE account_id IN ({SPANISH}))
SELECT account_id, CASE WHEN s.account_id IS NOT NULL AND status <> 'hidden' THEN 'active' ELSE status END AS status,
  coalesce(native_id, CASE WHEN s.account_id IS NOT NULL THEN CAST(account_id + 100000 AS VARCHAR) END) AS native_id, handle,
  {BUCKET_SQL.format(key='account_id')} IN (SELECT {BUCKET_SQL.format(key='account_id')} FROM said) AS rewritten
FROM accounts LEFT JOIN said s USING (account_id)"""))
def account_buckets(spark, d):
    """Accounts with Spanish texts are named again by native id; the others' files stay."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    table, accounts = store.tables["accounts"], w.accounts(spark, d)
    table.create(accounts)
    none = F.lit(None)
    refs = accounts.join(_spanish(spark, d), "account_id", "left_semi").select(
        F.col("account_id").alias("seq"), "platform", (F.col("account_id") + 100000).cast("string").alias("native_id"), "handle",
        none.cast("string").alias("display_name"), none.cast("string").alias("profile_url"), F.lit("active").alias("status"),
        none.cast("bigint").alias("followers_count"), none.cast("timestamp").alias("last_post_at"), F.lit("bio_link").alias("discovered_via"),
        none.cast("map<string,string>").alias("discovery_details"), F.lit(False).alias("hydrated"),
    )
    rows = _with_rewritten(table, lambda: store.merge_accounts(refs, w.as_of()))
    return rows.select("account_id", "status", "native_id", "handle", "rewritten")


@query("retract_missing", oracle(REREAD + """
SELECT edge_id FROM edges e WHERE status = 'present' AND evidence_type = 'bio_link' AND src IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM made m WHERE m.src = e.src AND m.tgt = e.tgt AND m.evidence_type = e.evidence_type)"""))
def retract_missing(spark, d):
    read = w.table(spark, d, "documents").select(F.col("doc_id").alias("account_id"))
    return up.retract_missing(w.edges(spark, d), _reread(spark, d), read, ["bio_link"])[1]


@query("deactivate_stale", oracle("""
SELECT a.account_id, a.active AND a.account_id IN (SELECT doc_id FROM documents WHERE n_chars >= 500) OR (a.active AND a.account_id NOT IN (SELECT doc_id FROM documents)) AS active FROM attestations a"""))
def deactivate_stale(spark, d):
    documents = w.table(spark, d, "documents")
    made = documents.filter("n_chars >= 500").select(
        F.col("doc_id").alias("account_id"), F.lit("bio_tag").alias("signal"), F.lit("#NoAI").alias("matched_text")
    )
    read = documents.select(F.col("doc_id").alias("account_id"))
    rows = up.deactivate_missing(w.attestations(spark, d), made, read, policy.REEXTRACTABLE_ATTESTATIONS, ["account_id", "signal"])
    return rows.select("account_id", "active")


@query("signal_upsert", oracle("""
SELECT coalesce(f.account_id, n.account_id) AS account_id, coalesce(f.active, false) OR n.account_id IS NOT NULL AS active
FROM flags f FULL JOIN (SELECT doc_id AS account_id FROM documents WHERE lang = 'de') n ON n.account_id = f.account_id"""))
def signal_upsert(spark, d):
    made = w.table(spark, d, "documents").filter("lang = 'de'").select(
        F.col("doc_id").alias("account_id"), F.lit("nsfw").alias("flag"), F.lit("bio_marker").alias("signal"),
        F.lit("R-18").alias("matched_text"), F.col("doc_id").alias("evidence_snapshot_id"),
    )
    return up.upsert_flags(w.flags(spark, d), made, w.as_of()).select("account_id", "active")


@query("stats_merge", """
WITH a AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS v, max(value) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1),
b AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'click') + 1 AS c, max(value) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
SELECT a.user_id, CAST(floor(a.v) AS BIGINT) AS views, CAST(floor(coalesce(b.c, a.c)) AS BIGINT) AS clicks, CAST(floor(b.e) AS BIGINT) AS errors FROM a JOIN b USING (user_id)""")
def stats_merge(spark, d):
    events = w.table(spark, d, "events")

    def best(kind):
        return F.max(F.when(F.col("event_type") == kind, F.col("value")))

    def known(**values):
        pairs = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.floor(v).cast("string"))])
        return F.map_filter(pairs, lambda k, v: v.isNotNull())

    rows = events.groupBy("user_id").agg(best("view").alias("v"), best("click").alias("c"), best("error").alias("e"))
    merged = rows.select("user_id", up.merge_stats(known(views=F.col("v"), clicks=F.col("c")), known(clicks=F.col("c") + 1, errors=F.col("e"))).alias("m"))
    return merged.select("user_id", *[F.try_element_at("m", F.lit(k)).cast("bigint").alias(k) for k in ("views", "clicks", "errors")])


@query("account_upsert", oracle("""
, refs AS (SELECT o_orderkey AS seq, o_custkey, o_totalprice, o_orderstatus FROM orders),
nat AS (SELECT o_custkey, max(seq) FILTER (WHERE o_orderstatus = 'F') AS last_f FROM refs GROUP BY 1)
SELECT account_id, CASE WHEN n.last_f IS NOT NULL AND status <> 'hidden' THEN 'active' ELSE status END AS status, coalesce(native_id, CASE WHEN n.last_f IS NOT NULL THEN CAST(account_id + 100000 AS VARCHAR) END) AS native_id, handle
FROM accounts LEFT JOIN nat n ON n.o_custkey = account_id"""))
def account_upsert(spark, d):
    """Every order mentions its customer's account: finished ones by native id, the others by handle."""
    accounts = w.accounts(spark, d)
    refs = w.table(spark, d, "orders").join(accounts.select("account_id", "platform", "handle"), F.col("o_custkey") == F.col("account_id"))
    none = F.lit(None)
    refs = refs.select(
        F.col("o_orderkey").alias("seq"), "platform",
        F.when(F.col("o_orderstatus") == "F", (F.col("account_id") + 100000).cast("string")).alias("native_id"), "handle",
        none.cast("string").alias("display_name"), none.cast("string").alias("profile_url"), F.lit("active").alias("status"),
        none.cast("bigint").alias("followers_count"), none.cast("timestamp").alias("last_post_at"), F.lit("bio_link").alias("discovered_via"),
        none.cast("map<string,string>").alias("discovery_details"), F.lit(False).alias("hydrated"),
    )
    done, _ = up.upsert_accounts(accounts, refs, w.as_of())
    return done.select("account_id", "status", "native_id", "handle")


@query("repair_downstream", oracle("""
, dead AS (SELECT edge_id FROM edges WHERE status = 'retracted'),
closing AS (SELECT DISTINCT e.artist_id, e.account_id FROM artist_events e JOIN dead USING (edge_id) JOIN memberships m ON m.artist_id = e.artist_id AND m.account_id = e.account_id WHERE e.event = 'account_added')
SELECT 'membership' AS what, artist_id AS id, account_id AS other FROM closing UNION ALL SELECT 'review', item_id, edge_id FROM reviews JOIN dead USING (edge_id) WHERE status = 'pending'"""))
def repair_downstream(spark, d):
    s = w.state(spark, d)
    dead = s.edges.filter("status = 'retracted'").select("edge_id")
    members, _, reviews = up.repair_downstream(s.memberships, s.events, s.reviews, dead, w.as_of())
    closed = members.filter("removed_at is not null").select(F.lit("membership").alias("what"), F.col("artist_id").alias("id"), F.col("account_id").alias("other"))
    asked = reviews.filter("decided_by = 'pipeline'").select(F.lit("review").alias("what"), F.col("item_id").alias("id"), F.col("edge_id").alias("other"))
    return closed.unionByName(asked)


@query("project_accounts", oracle("""
SELECT account_id, project OR (account_id NOT IN (SELECT account_id FROM memberships WHERE added_by = 'human')
  AND (regexp_matches(handle, '(?i)zines?$|bangs?$') OR regexp_matches(coalesce(display_name, ''), '(?i)\\b(?:fan)?zines?\\b|\\bbig\\s?bangs?\\b|antholog')
    OR regexp_matches(coalesce(bio, ''), '(?i)\\b(?:a|an|the|this|our)\\s+(?:[\\w''!:&.~+-]+\\s+){0,6}?(?:(?:fan)?zines?|(?:big|mini|reverse)\\s?bangs?|bang\\s+events?|antholog\\w+|fan\\s?events?)\\b'))) AS project
FROM accounts LEFT JOIN latest_bio USING (account_id)"""))
def project_accounts(spark, d):
    return hygiene.flag_projects(w.state(spark, d), w.as_of()).accounts.select("account_id", "project")


@query("duplicate_channels", oracle("""
, tube AS (SELECT m.artist_id, a.account_id, a.c_mktsegment = 'BUILDING' AS is_id FROM memberships m JOIN accounts a USING (account_id) WHERE platform IN ('youtube', 'twitter') AND status IN ('active', 'unknown'))
SELECT DISTINCT account_id FROM tube WHERE is_id AND artist_id IN (SELECT artist_id FROM tube WHERE NOT is_id)"""))
def duplicate_channels(spark, d):
    """Building customers on the two video-like platforms get a channel id in place of their handle."""
    accounts = w.accounts(spark, d)
    building = F.col("display_name").endswith(" illustration")
    channel = F.rpad(F.concat(F.lit("UC"), F.col("account_id").cast("string")), 24, "x")
    renamed = accounts.filter("platform in ('youtube', 'twitter')").withColumns(
        {"platform": F.lit("youtube"), "handle": F.when(building, channel).otherwise(F.col("handle"))}
    )
    return hygiene.duplicate_channels(renamed, w.memberships(spark, d))


@query("reclassified_accounts", oracle("""
, site AS (SELECT account_id, CASE WHEN platform = 'website' THEN 'misskey.io/@' || replace(display_name, ' ', '_') ELSE handle END AS handle, platform FROM accounts),
cand AS (SELECT account_id, regexp_extract(handle, '(?i)misskey\\.(?:io|design|art)/@([A-Za-z0-9_]+)', 1) AS k FROM site WHERE platform = 'website' AND handle IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY account_id) AS rn FROM cand WHERE k <> '') WHERE rn = 1 AND lower(k) NOT IN (SELECT lower(handle) FROM site WHERE platform = 'misskey'))
SELECT account_id, k AS handle FROM one"""))
def reclassified_accounts(spark, d):
    accounts = w.accounts(spark, d)
    misfiled = F.concat(F.lit("misskey.io/@"), F.replace("display_name", F.lit(" "), F.lit("_")))
    sites = accounts.withColumn("handle", F.when(F.col("platform") == "website", misfiled).otherwise(F.col("handle")))
    was = accounts.filter("platform = 'website'").select("account_id")
    done = hygiene.reclassify_websites(sites).filter("platform = 'misskey'")
    return done.join(was, "account_id", "left_semi").select("account_id", "handle")


@query("lower_handles", """
WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) || '_' || doc_id ELSE source || '_' || (doc_id + 1) END AS handle FROM documents)
SELECT doc_id AS account_id, CASE WHEN handle <> lower(handle) AND lower(handle) NOT IN (SELECT handle FROM a WHERE handle = lower(handle)) THEN lower(handle) ELSE handle END AS handle FROM a""")
def lower_handles(spark, d):
    key = F.col("doc_id")
    handle = F.when(F.col("lang") == "en", F.concat(F.upper("source"), F.lit("_"), key.cast("string"))).otherwise(
        F.concat("source", F.lit("_"), (key + 1).cast("string"))
    )
    rows = w.table(spark, d, "documents").select(
        key.alias("account_id"), F.lit("bluesky").alias("platform"), handle.alias("handle"), F.lit(None).cast("timestamp").alias("last_hydrated")
    )
    return up.lower_handles(rows, "bluesky").select("account_id", "handle")


@query("pinned_native_ids", oracle("""
, wanted AS (SELECT doc_id AS account_id, CAST(n_chars + 100000 AS VARCHAR) AS native FROM documents),
free AS (SELECT a.account_id, a.platform, w.native FROM wanted w JOIN accounts a USING (account_id) WHERE a.native_id IS NULL),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, native ORDER BY account_id) AS rn FROM free) WHERE rn = 1)
SELECT account_id, native AS native_id FROM won WHERE (platform, native) NOT IN (SELECT (platform, native_id) FROM accounts WHERE native_id IS NOT NULL)"""))
def pinned_native_ids(spark, d):
    accounts = w.accounts(spark, d)
    found = w.table(spark, d, "documents").select(F.col("doc_id").alias("account_id"), (F.col("n_chars") + 100000).cast("string").alias("native_id"))
    held = accounts.filter("native_id is null").select("account_id")
    done = up.pin_native_ids(accounts, found).filter("native_id is not null")
    return done.join(held, "account_id", "left_semi").select("account_id", "native_id")


# --- decisions: line items returned by customers act as the recorded decisions ---


def _decisions(spark, d, kind):
    rows = w.history(spark, d).filter("l_returnflag = 'R' and l_quantity = 50")
    return rows.select("artist_id", "account_id").distinct().withColumns(
        {"decision_id": F.xxhash64("artist_id", "account_id"), "kind": F.lit(kind), "item_id": F.lit(None).cast("bigint"),
         "payload": F.lit("opt_out"), "actor": F.lit("admin:review"), "at": w.as_of()}
    )


DECIDED = """
, decided AS (SELECT DISTINCT artist_id, account_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50),
wire AS (
  SELECT DISTINCT e.edge_id FROM edges e JOIN decided d ON d.account_id IN (e.src, e.tgt)
  JOIN memberships m ON m.artist_id = d.artist_id AND m.account_id = CASE WHEN d.account_id = e.src THEN e.tgt ELSE e.src END"""


@query("decision_detach", oracle(DECIDED + """ AND NOT EXISTS (SELECT 1 FROM decided x WHERE x.artist_id = m.artist_id AND x.account_id = m.account_id))
SELECT 'closed' AS what, account_id AS id FROM memberships JOIN decided USING (artist_id, account_id)
UNION ALL SELECT 'edge', edge_id FROM edges JOIN wire USING (edge_id) WHERE claim = 'same_person' AND status = 'present'"""))
def decision_detach(spark, d):
    s = w.state(spark, d)
    done = dec.detach(s, _decisions(spark, d, "detach"), w.as_of())
    closed = done.memberships.filter("removed_at is not null").select(F.lit("closed").alias("what"), F.col("account_id").alias("id"))
    flipped = done.edges.filter("relation_hint = 'manual_detach'").select(F.lit("edge").alias("what"), F.col("edge_id").alias("id"))
    return closed.unionByName(flipped)


@query("decision_dismiss", oracle(DECIDED + """)
SELECT edge_id FROM edges JOIN wire USING (edge_id) WHERE status = 'present'"""))
def decision_dismiss(spark, d):
    done = dec.dismiss(w.state(spark, d), _decisions(spark, d, "dismiss"), w.as_of())
    return done.edges.filter("relation_hint = 'manual_dismiss' and status = 'dismissed'").select("edge_id")


@query("decision_suppress", oracle("""
, decided AS (SELECT DISTINCT artist_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50)
SELECT artist_id FROM decided WHERE artist_id NOT IN (SELECT artist_id FROM suppressions WHERE NOT lifted AND reason = 'opt_out' AND artist_id IS NOT NULL)"""))
def decision_suppress(spark, d):
    s = w.state(spark, d)
    done = dec.suppress(s, _decisions(spark, d, "suppress"), w.as_of())
    return done.suppressions.filter("requested_by is not null").select("artist_id")


@query("decision_unsuppress", oracle("""
SELECT artist_id, account_id, lifted OR (artist_id IS NOT NULL AND artist_id IN (SELECT artist_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50)) AS lifted FROM suppressions"""))
def decision_unsuppress(spark, d):
    done = dec.unsuppress(w.state(spark, d), _decisions(spark, d, "unsuppress"), w.as_of())
    return done.suppressions.select("artist_id", "account_id", F.col("lifted_at").isNotNull().alias("lifted"))


@query("decision_restore", oracle("""
SELECT artist_id, CASE WHEN artist_id IN (SELECT artist_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50) THEN 'active' ELSE status END AS status FROM artists"""))
def decision_restore(spark, d):
    return dec.restore(w.state(spark, d), _decisions(spark, d, "restore"), w.as_of()).artists.select("artist_id", "status")


@query("decision_unhide", oracle("""
SELECT account_id, CASE WHEN status = 'hidden' AND account_id IN (SELECT account_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50) THEN 'active' ELSE status END AS status FROM accounts"""))
def decision_unhide(spark, d):
    return dec.unhide(w.state(spark, d), _decisions(spark, d, "unhide")).accounts.select("account_id", "status")


@query("decision_confirm", oracle("""
, decided AS (SELECT DISTINCT artist_id, account_id FROM history WHERE l_returnflag = 'R' AND l_quantity = 50),
linked AS (SELECT DISTINCT d.artist_id AS a, m.artist_id AS b FROM decided d JOIN memberships m USING (account_id) WHERE d.artist_id <> m.artist_id),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
joined(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT j.node, l.b FROM joined j JOIN both_ways l ON l.a = j.seen),
part_of AS (SELECT node, min(seen) AS part FROM joined GROUP BY node),
keeper AS (
  SELECT part, coalesce(min(node) FILTER (node NOT IN (SELECT b FROM linked)), min(node)) AS artist_id FROM part_of GROUP BY part),
mapped AS (SELECT node, artist_id AS into_id FROM part_of JOIN keeper USING (part) WHERE node <> artist_id),
free AS (SELECT min(artist_id) AS artist_id, account_id FROM decided WHERE account_id NOT IN (SELECT account_id FROM memberships) GROUP BY account_id)
SELECT coalesce(into_id, m.artist_id) AS artist_id, account_id, CASE WHEN into_id IS NULL THEN added_by ELSE 'human' END AS added_by
FROM memberships m LEFT JOIN mapped ON node = m.artist_id
UNION ALL SELECT coalesce(into_id, f.artist_id), account_id, 'human' FROM free f LEFT JOIN mapped ON node = f.artist_id"""))
def decision_confirm(spark, d):
    """Confirmed contacts: merges, also of several artists at once, and attachments."""
    done = dec.confirm(w.state(spark, d), _decisions(spark, d, "confirm"), w.as_of())
    return done.memberships.filter("removed_at is null").select("artist_id", "account_id", "added_by")


@query("decision_untag", oracle("""
, asked AS (SELECT DISTINCT lower(handle) AS handle FROM accounts WHERE platform = 'twitter' AND c_mktsegment = 'BUILDING' AND regexp_full_match(lower(handle), '[a-z0-9_]{1,15}')),
j AS (SELECT lower(a.handle) AS handle, a.account_id, m.artist_id, a.status,
    CASE WHEN a.account_id IN (SELECT account_id FROM out_accounts) OR m.artist_id IN (SELECT artist_id FROM out_artists) OR a.status IN ('hidden', 'deleted') THEN 'removed' WHEN a.discovered_via = 'manual_tag' AND a.last_hydrated IS NULL THEN 'queued'
      WHEN m.artist_id IN (SELECT artist_id FROM visible) THEN 'listed' ELSE 'tracked' END AS state
  FROM accounts a JOIN asked ON asked.handle = lower(a.handle) LEFT JOIN (SELECT mm.account_id, ar.artist_id FROM memberships mm JOIN artists ar USING (artist_id) WHERE ar.merged_into IS NULL) m USING (account_id) WHERE a.platform = 'twitter'),
used AS (SELECT account_id FROM snapshots UNION SELECT src FROM edges UNION SELECT tgt FROM edges UNION SELECT account_id FROM memberships)
SELECT 'suppressed' AS what, artist_id AS id FROM j WHERE state = 'listed'
UNION SELECT 'hidden', account_id FROM accounts WHERE status = 'hidden' AND account_id NOT IN (SELECT account_id FROM j)
UNION SELECT 'hidden', j.account_id FROM j JOIN accounts a USING (account_id) WHERE j.status = 'hidden' OR (state = 'tracked' AND NOT (a.discovered_via = 'manual_tag' AND j.account_id NOT IN (SELECT account_id FROM used)))"""))
def decision_untag(spark, d):
    s = w.state(spark, d)
    mine = s.accounts.filter("platform = 'twitter'").filter(F.col("display_name").endswith(" illustration"))
    done = dec.untag(s, reports.clean_handles(mine), w.as_of())
    out = done.suppressions.filter("note = 'tag removal'").select(F.lit("suppressed").alias("what"), F.col("artist_id").alias("id"))
    return out.unionByName(done.accounts.filter("status = 'hidden'").select(F.lit("hidden").alias("what"), F.col("account_id").alias("id")))


@query("decision_tag", oracle("""
, asked AS (SELECT DISTINCT lower(handle) AS handle FROM accounts WHERE platform = 'twitter' AND c_mktsegment = 'AUTOMOBILE' AND regexp_full_match(lower(handle), '[a-z0-9_]{1,15}')),
j AS (SELECT a.account_id, a.status, a.discovered_via, a.last_hydrated,
    CASE WHEN a.account_id IN (SELECT account_id FROM out_accounts) OR m.artist_id IN (SELECT artist_id FROM out_artists) THEN 'suppressed' WHEN a.status IN ('hidden', 'deleted') THEN 'due'
      WHEN a.discovered_via = 'manual_tag' THEN 'idle' WHEN m.artist_id IN (SELECT artist_id FROM visible) THEN 'idle' ELSE 'due' END AS state
  FROM accounts a JOIN asked ON asked.handle = lower(a.handle) LEFT JOIN (SELECT mm.account_id, ar.artist_id FROM memberships mm JOIN artists ar USING (artist_id) WHERE ar.merged_into IS NULL) m USING (account_id) WHERE a.platform = 'twitter')
SELECT account_id, CASE WHEN state = 'due' AND discovered_via IN ('bio_link', 'bio_mention', 'link_hub', 'hydration') THEN 'manual_tag' ELSE discovered_via END AS discovered_via,
  CASE WHEN state = 'due' AND status IN ('hidden', 'deleted') THEN CASE WHEN last_hydrated IS NULL THEN 'unknown' ELSE 'active' END ELSE status END AS status FROM j"""))
def decision_tag(spark, d):
    s = w.state(spark, d)
    cars = w.table(spark, d, "customer").filter("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_custkey").alias("account_id"))
    mine = s.accounts.filter("platform = 'twitter'").join(cars, "account_id", "left_semi")
    asked = reports.clean_handles(mine)
    done = dec.tag(s, asked, w.as_of())
    rows = done.accounts.filter("platform = 'twitter'").withColumn("h", F.lower("handle"))
    return rows.join(asked.withColumnRenamed("handle", "h"), "h", "left_semi").select("account_id", "discovered_via", "status")


@query("decided_reviews", oracle("""
SELECT item_id, CASE WHEN status = 'pending' THEN CASE WHEN kind = 'other' THEN 'rejected' ELSE 'approved' END ELSE status END AS status FROM reviews"""))
def decided_reviews(spark, d):
    s = w.state(spark, d)
    verdict = F.when(F.col("kind") == "other", "reject").otherwise("approve")
    rows = s.reviews.select(
        F.col("item_id").alias("decision_id"), verdict.alias("kind"), "item_id", F.lit(None).cast("string").alias("payload")
    )
    return dec.decide(s, rows, w.as_of()).reviews.select("item_id", "status")


@query("unknown_values", oracle("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1"))
def unknown_values(spark, d):
    return checks.unknown_values(w.table(spark, d, "events"), "event_type", ["view", "click"])


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return checks.duplicates(w.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
