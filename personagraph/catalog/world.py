"""The sample star schema read as state tables.

The sample tables hold no creator accounts, so every state table is derived from whole sample tables by
column rules: customers are accounts, parts are artists, consecutive orders are links between the
accounts that placed them, line items are the membership history, events and documents are snapshots,
labels are statements and flags, suppliers are suppressions and review items. ``WORLD_SQL`` states the
same rules for the oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import STATE_SCHEMAS, API_USAGE, State
from ..operators.upsert import align
from ..session import shared_folder

AS_OF = datetime(2001, 12, 1)
AS_OF_SQL = "TIMESTAMP '2001-12-01'"

BRAND_PLATFORMS = [
    "twitter", "bluesky", "pixiv", "skeb", "website", "youtube", "linktree", "carrd", "instagram", "tumblr",
    "patreon", "twitter", "twitter", "bluesky", "pixiv", "deviantart", "artstation", "vgen", "potofu", "kofi",
    "fanbox", "twitter", "twitter", "bluesky", "misskey",
]
NATION_SOURCES = [
    "bsky_feed", "portfolioday", "portfolioday_mention", "twitter_list", "skeb_ranking", "pixiv_ranking",
    "pixiv_tag_search", "patreon_ranking", "artstation_ranking", "deviantart_popular", "vgen_marketplace",
    "convention_list", "platform_roster", "manual_tag", "bio_link", "bio_link", "bio_link", "link_hub", "link_hub",
    "bio_mention", "manual", "hydration", "bio_link", "link_hub", "portfolioday",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Derive a state table once per application and folder of samples; later uses read what was written."""

    @wraps(build)
    def run(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, build.__name__)
        if key not in _STORED:
            path = f"{shared_folder(spark)}/{key[0]}/world-{uuid.uuid4().hex}"
            df = build(spark, d)
            df.write.parquet(path)
            _STORED[key] = path, df.schema
        path, schema = _STORED[key]
        df = spark.read.schema(schema).parquet(path)
        df.is_cut = True
        return df

    return run


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _listed(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int"))


def _shape(df: DataFrame, schema: str) -> DataFrame:
    return align(df, df.sparkSession.createDataFrame([], schema))


@stored
def accounts(spark: SparkSession, d: str) -> DataFrame:
    customer, part, orders = (table(spark, d, t) for t in ("customer", "part", "orders"))
    dates = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_o"), F.min("o_orderdate").alias("first_o"))
    rows = customer.join(part, F.col("c_custkey") == F.col("p_partkey")).join(
        dates, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    key = F.col("c_custkey").cast("string")
    platform = _listed(BRAND_PLATFORMS, F.substring_index("p_brand", "#", -1))
    dashed = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key, F.lit(".bsky.social"))
    plain = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key)
    handle = F.when(platform == "bluesky", dashed).otherwise(plain)
    segment, kind, size = F.col("c_mktsegment"), F.col("p_type"), F.col("p_size")
    commission = (
        F.when(kind.isin("SMALL", "ECONOMY"), "open").when(kind == "MEDIUM", "closed").when(kind == "PROMO", "waitlist")
    ).otherwise("unknown")
    known = commission != "unknown"
    bal = F.col("c_acctbal")
    return _shape(
        rows.select(
            F.col("c_custkey").alias("account_id"),
            platform.alias("platform"),
            F.when(segment != "MACHINERY", (F.col("c_custkey") + 100000).cast("string")).alias("native_id"),
            handle.alias("handle"),
            F.when(segment == "HOUSEHOLD", F.upper("p_name"))
            .when(segment == "BUILDING", F.concat("p_name", F.lit(" illustration")))
            .when(segment == "FURNITURE", F.lit(""))
            .when(segment == "AUTOMOBILE", F.concat_ws(" ", "p_name", "p_type"))
            .alias("display_name"),
            F.concat(F.lit("https://example.org/"), handle).alias("profile_url"),
            F.when(size >= 49, "deleted").when(size >= 47, "hidden").when(segment == "MACHINERY", "unknown")
            .otherwise("active").alias("status"),
            F.when(bal >= 0, F.floor(bal * bal / 8000)).alias("followers_count"),
            _listed(NATION_SOURCES, F.col("c_nationkey") + 1).alias("discovered_via"),
            F.lit("2000-01-01").cast("timestamp").alias("first_seen"),
            F.when(segment != "MACHINERY", F.date_add(F.lit("2001-01-01").cast("date"), size).cast("timestamp")).alias(
                "last_hydrated"
            ),
            F.col("last_o").alias("last_post_at"),
            commission.alias("commission_status"),
            F.when(known, F.when(kind == "SMALL", 0.95).otherwise(0.85)).alias("commission_confidence"),
            F.when(kind == "SMALL", F.concat(platform, F.lit(":accept"))).when(
                known, F.concat(F.lit("comms "), commission)
            ).alias("commission_detail"),
            F.when(known, F.col("first_o")).alias("commission_checked_at"),
            F.when(segment == "AUTOMOBILE", F.col("first_o")).alias("link_checked_at"),
            F.when(size > 10, F.concat(F.lit("https://img.example/"), key)).alias("avatar_url"),
            (size == 1).alias("project"),
        ),
        STATE_SCHEMAS["accounts"],
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    events, documents = table(spark, d, "events"), table(spark, d, "documents")
    kind = F.col("event_type")
    bio = (
        F.when(kind == "view", "illustrator, commissions open")
        .when(kind == "click", "comms closed #NoAI")
        .when(kind == "signup", "this is our fanzine")
        .when(kind == "purchase", "art account. nsfw 18+")
    )
    older = events.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("captured_at"),
        bio.alias("bio_text"),
        F.floor("value").alias("followers_count"),
        F.col("props").alias("raw"),
        F.concat(F.lit("x:"), kind).alias("fetch_source"),
    )
    newer = documents.select(
        (F.col("doc_id") + 1_000_000_000).alias("snapshot_id"),
        F.col("doc_id").alias("account_id"),
        F.lit("2024-02-15").cast("timestamp").alias("captured_at"),
        F.col("text").alias("bio_text"),
        F.col("n_chars").alias("followers_count"),
        F.lit("{}").alias("raw"),
        F.lit("x:hydration").alias("fetch_source"),
    )
    schema = STATE_SCHEMAS["snapshots"]
    return _shape(older, schema).unionByName(_shape(newer, schema))


@stored
def edges(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    onward = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next_cust"))
    rows = orders.join(onward, "o_orderkey").filter("o_custkey <> next_cust")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    related = F.col("o_orderstatus") == "O"

    def by_priority(*values: str) -> Column:
        out = F.lit(values[-1])
        names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
        for name, value in reversed(list(zip(names, values))):
            out = F.when(priority == name, value).otherwise(out)
        return out

    forward = rows.select(
        (F.col("o_orderkey") * 2).alias("edge_id"),
        F.col("o_custkey").alias("source_account_id"),
        F.col("next_cust").alias("target_account_id"),
        by_priority("bio_link", "link_hub", "profile_field", "bio_mention", "bio_link").alias("evidence_type"),
        F.col("o_orderkey").alias("evidence_snapshot_id"),
        F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")).alias("evidence_url"),
        F.when(related, "related").otherwise("same_person").alias("claim"),
        F.when(related, by_priority("unreciprocated_prominent", "hub_credits", "secondary_link", "over_platform_cap", "website"))
        .when((priority == "3-MEDIUM") & (price >= 450000), "oauth").alias("relation_hint"),
        F.when(price >= 400000, "present").when(price >= 395000, "dismissed").otherwise("retracted").alias("status"),
        F.col("o_orderdate").alias("first_seen"),
    )
    back = rows.filter((priority == "5-LOW") & (F.col("o_orderstatus") == "F") & (price >= 400000)).select(
        (F.col("o_orderkey") * 2 + 1).alias("edge_id"),
        F.col("next_cust").alias("source_account_id"),
        F.col("o_custkey").alias("target_account_id"),
        F.lit("bio_link").alias("evidence_type"),
        F.col("o_orderkey").alias("evidence_snapshot_id"),
        F.lit("same_person").alias("claim"),
        F.lit("present").alias("status"),
        F.col("o_orderdate").alias("first_seen"),
    )
    schema = STATE_SCHEMAS["edges"]
    return _shape(forward, schema).unionByName(_shape(back, schema))


def artists(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    size = F.col("p_size")
    return _shape(
        part.select(
            F.col("p_partkey").alias("artist_id"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("public_slug"),
            F.col("p_name").alias("display_name"),
            F.lit("unknown").alias("region"),
            F.when(F.col("p_type") == "PROMO", "manual").otherwise("auto").alias("region_source"),
            F.when(F.col("p_type") == "LARGE", "ja").when(F.col("p_type") == "PROMO", "ko").otherwise("en").alias("language"),
            F.when(size == 46, "needs_review").when(size == 45, "suppressed").otherwise("active").alias("status"),
            F.when(size == 44, F.col("p_partkey") + 1).alias("merged_into"),
            F.lit("2000-01-01").cast("timestamp").alias("created_at"),
        ),
        STATE_SCHEMAS["artists"],
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """Line items as (artist, account) contacts over time."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns(
        {"artist_id": F.floor(F.col("l_partkey") / 4), "account_id": F.col("o_custkey")}
    )


@stored
def memberships(spark: SparkSession, d: str) -> DataFrame:
    """Only the newest contact of an account is live, and household customers belong to nobody."""
    joined = table(spark, d, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_custkey").alias("account_id"))
    # The newest line of every order, then of every account: most lines never move to their account.
    rest = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", *rest)).alias("n"))
    per_order = per_order.select("l_orderkey", "n.*")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id"))
    newest = per_order.join(orders, "l_orderkey").groupBy("account_id").agg(F.max(F.struct("l_shipdate", "l_orderkey", *rest)).alias("n"))
    rows = newest.join(joined, "account_id").select("account_id", "n.*").withColumn("artist_id", F.floor(F.col("l_partkey") / 4))
    return _shape(
        rows.select(
            "artist_id",
            "account_id",
            F.when(F.col("l_returnflag") == "A", "near_proof").otherwise("strong").alias("confidence"),
            F.when(F.col("l_linestatus") == "F", "clustering").otherwise("human").alias("added_by"),
            F.col("l_shipdate").alias("added_at"),
        ),
        STATE_SCHEMAS["memberships"],
    )


def artist_events(spark: SparkSession, d: str) -> DataFrame:
    """Not stored: most queries look at few of its rows, or only add some."""
    admin = (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 50) & (F.col("l_tax") >= 0.08)
    return _shape(
        history(spark, d).select(
            "artist_id",
            F.when(F.col("l_returnflag") == "R", "account_removed").otherwise("account_added").alias("event"),
            F.when(admin, "admin:review").otherwise("pipeline").alias("actor"),
            "account_id",
            (F.col("l_orderkey") * 2).alias("edge_id"),
            F.col("o_orderpriority").alias("reason"),
            F.col("l_shipdate").alias("created_at"),
        ),
        STATE_SCHEMAS["events"],
    )


def attestations(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return _shape(
        labels.filter("quality = 1").select(
            F.col("doc_id").alias("account_id"),
            F.lit("bio_tag").alias("signal"),
            F.lit("#NoAI").alias("matched_text"),
            (F.col("doc_id") + 1_000_000_000).alias("evidence_snapshot_id"),
            (F.col("toxic") == 0).alias("active"),
        ),
        STATE_SCHEMAS["attestations"],
    )


def flags(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return _shape(
        labels.filter("toxic = 1 or quality = 0").select(
            F.col("doc_id").alias("account_id"),
            F.lit("nsfw").alias("flag"),
            F.lit("bio_marker").alias("signal"),
            F.lit("R-18").alias("matched_text"),
            (F.col("doc_id") + 1_000_000_000).alias("evidence_snapshot_id"),
            (F.col("toxic") == 1).alias("active"),
        ),
        STATE_SCHEMAS["flags"],
    )


def suppressions(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    bal = F.col("s_acctbal")
    return _shape(
        supplier.filter((bal < 1500) | (bal >= 8000)).select(
            F.when(bal < 1500, F.col("s_suppkey")).alias("artist_id"),
            F.when(bal >= 8000, F.col("s_suppkey")).alias("account_id"),
            F.when(F.col("s_nationkey") < 8, "opt_out").otherwise("impersonation").alias("reason"),
            F.lit("2001-06-01").cast("timestamp").alias("created_at"),
            F.when(F.col("s_nationkey") >= 15, F.lit("2001-07-01").cast("timestamp")).alias("lifted_at"),
        ),
        STATE_SCHEMAS["suppressions"],
    )


def reviews(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    kind = F.when(nation < 10, "cluster_merge").when(nation < 18, "other").otherwise("singleton_gate")
    pair = F.concat_ws(",", key.cast("string"), (key + 1).cast("string"))
    return _shape(
        supplier.select(
            key.alias("item_id"),
            kind.alias("kind"),
            F.when(kind == "other", "anomaly").alias("reason"),
            F.when(kind == "cluster_merge", pair)
            .when(kind == "other", F.concat(F.lit("artist:"), key.cast("string")))
            .otherwise(key.cast("string"))
            .alias("review_key"),
            F.when(kind != "singleton_gate", key).alias("artist_id"),
            F.when(kind == "cluster_merge", key + 1).alias("other_artist_id"),
            F.when(kind == "singleton_gate", key).alias("account_id"),
            F.when(kind == "cluster_merge", key * 2).alias("edge_id"),
            F.when(F.col("s_acctbal") < 3000, "rejected").otherwise("pending").alias("status"),
            F.lit("2001-06-01").cast("timestamp").alias("created_at"),
        ),
        STATE_SCHEMAS["reviews"],
    )


def bookings(spark: SparkSession, d: str) -> DataFrame:
    """Usage with the id of each booking."""
    events = table(spark, d, "events")
    kind = F.col("event_type")
    return _shape(
        events.select(
            F.col("event_id").alias("booking_id"),
            F.when(kind.isin("purchase", "view"), "x_api").otherwise("graphtreon").alias("service"),
            kind.alias("endpoint"),
            F.floor("value").alias("units"),
            F.ceil(F.floor("value") * 0.5).alias("est_cost_cents"),
            F.date_trunc("hour", "ts").alias("occurred_at"),
            F.when(kind == "purchase", "tag flush").alias("note"),
        ),
        f"booking_id bigint, {API_USAGE}",
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    return bookings(spark, d).drop("booking_id")


def state(spark: SparkSession, d: str) -> State:
    """The tables of the state, each derived when a query first asks for it."""
    derived = {
        "accounts": accounts, "snapshots": snapshots, "edges": edges, "artists": artists, "memberships": memberships,
        "events": artist_events, "attestations": attestations, "flags": flags, "reviews": reviews, "suppressions": suppressions,
    }
    return State(**{name: partial(build, spark, d) for name, build in derived.items()})


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_platforms() -> str:
    from .. import policy

    rows = ", ".join(f"('{p[0]}', '{p[2]}', {p[5]})" for p in policy.PLATFORMS)
    return f"SELECT * FROM (VALUES {rows}) t(platform, kind, display_rank)"


WORLD_SQL = f"""WITH RECURSIVE platforms AS ({_sql_platforms()}),
accounts AS (
  SELECT *, CASE WHEN commission_status <> 'unknown' THEN CASE WHEN p_type = 'SMALL' THEN 0.95 ELSE 0.85 END END AS commission_confidence,
    CASE WHEN p_type = 'SMALL' THEN platform || ':accept' WHEN commission_status <> 'unknown' THEN 'comms ' || commission_status END AS commission_detail,
    CASE WHEN commission_status <> 'unknown' THEN first_o END AS commission_checked_at,
    'https://example.org/' || handle AS profile_url
  FROM (
  SELECT c_custkey AS account_id, platform, p_type, first_o, c_mktsegment,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey + 100000 AS VARCHAR) END AS native_id,
    CASE WHEN platform = 'bluesky' THEN replace(p_name, ' ', '-') || '-' || c_custkey || '.bsky.social'
         ELSE replace(p_name, ' ', '_') || '_' || c_custkey END AS handle,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN upper(p_name) WHEN 'BUILDING' THEN p_name || ' illustration'
      WHEN 'FURNITURE' THEN '' WHEN 'AUTOMOBILE' THEN p_name || ' ' || p_type END AS display_name,
    CASE WHEN p_size >= 49 THEN 'deleted' WHEN p_size >= 47 THEN 'hidden' WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE 'active' END AS status,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal * c_acctbal / 8000) AS BIGINT) END AS followers_count,
    ({_sql_list(NATION_SOURCES)})[c_nationkey + 1] AS discovered_via,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN TIMESTAMP '2001-01-01' + to_days(p_size) END AS last_hydrated,
    last_o AS last_post_at,
    CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'open' WHEN p_type = 'MEDIUM' THEN 'closed' WHEN p_type = 'PROMO' THEN 'waitlist' ELSE 'unknown' END AS commission_status,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN first_o END AS link_checked_at,
    CASE WHEN p_size > 10 THEN 'https://img.example/' || c_custkey END AS avatar_url,
    p_size = 1 AS project
  FROM customer
  JOIN (SELECT *, ({_sql_list(BRAND_PLATFORMS)})[CAST(split_part(p_brand, '#', 2) AS INT)] AS platform FROM part) p ON p_partkey = c_custkey
  LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_o, min(o_orderdate) AS first_o FROM orders GROUP BY 1) o ON o_custkey = c_custkey)),
snapshots AS (
  SELECT event_id AS snapshot_id, user_id AS account_id, ts AS captured_at,
    CASE event_type WHEN 'view' THEN 'illustrator, commissions open' WHEN 'click' THEN 'comms closed #NoAI'
      WHEN 'signup' THEN 'this is our fanzine' WHEN 'purchase' THEN 'art account. nsfw 18+' END AS bio_text,
    CAST(floor(value) AS BIGINT) AS followers_count, 'x:' || event_type AS fetch_source
  FROM events
  UNION ALL
  SELECT doc_id + 1000000000, doc_id, TIMESTAMP '2024-02-15', text, n_chars, 'x:hydration' FROM documents),
latest_bio AS (
  SELECT account_id, bio_text AS bio FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1),
order_links AS (SELECT a.*, b.o_custkey AS next_cust FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
edges AS (
  SELECT o_orderkey * 2 AS edge_id, o_custkey AS src, next_cust AS tgt,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'bio_link' WHEN '2-HIGH' THEN 'link_hub' WHEN '3-MEDIUM' THEN 'profile_field' WHEN '4-NOT SPECIFIED' THEN 'bio_mention' ELSE 'bio_link' END AS evidence_type,
    o_orderkey AS evidence_snapshot_id, 'https://example.org/' || o_orderkey AS evidence_url,
    CASE WHEN o_orderstatus = 'O' THEN 'related' ELSE 'same_person' END AS claim,
    CASE WHEN o_orderstatus = 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'unreciprocated_prominent' WHEN '2-HIGH' THEN 'hub_credits' WHEN '3-MEDIUM' THEN 'secondary_link' WHEN '4-NOT SPECIFIED' THEN 'over_platform_cap' ELSE 'website' END
      WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice >= 450000 THEN 'oauth' END AS relation_hint,
    CASE WHEN o_totalprice >= 400000 THEN 'present' WHEN o_totalprice >= 395000 THEN 'dismissed' ELSE 'retracted' END AS status
  FROM order_links
  UNION ALL
  SELECT o_orderkey * 2 + 1, next_cust, o_custkey, 'bio_link', o_orderkey, NULL, 'same_person', NULL, 'present'
  FROM order_links WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_totalprice >= 400000),
artists AS (
  SELECT p_partkey AS artist_id, replace(p_name, ' ', '-') || '-' || p_partkey AS public_slug, p_name AS display_name,
    'unknown' AS region, CASE WHEN p_type = 'PROMO' THEN 'manual' ELSE 'auto' END AS region_source,
    CASE p_type WHEN 'LARGE' THEN 'ja' WHEN 'PROMO' THEN 'ko' ELSE 'en' END AS language,
    CASE p_size WHEN 46 THEN 'needs_review' WHEN 45 THEN 'suppressed' ELSE 'active' END AS status,
    CASE WHEN p_size = 44 THEN p_partkey + 1 END AS merged_into
  FROM part),
history AS (
  SELECT CAST(floor(l_partkey / 4) AS BIGINT) AS artist_id, o_custkey AS account_id, lineitem.*, orders.o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
memberships AS (
  SELECT artist_id, account_id, CASE WHEN l_returnflag = 'A' THEN 'near_proof' ELSE 'strong' END AS confidence,
    CASE WHEN l_linestatus = 'F' THEN 'clustering' ELSE 'human' END AS added_by, l_shipdate AS added_at
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM history)
  WHERE rn = 1 AND account_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')),
artist_events AS (
  SELECT artist_id, CASE WHEN l_returnflag = 'R' THEN 'account_removed' ELSE 'account_added' END AS event,
    CASE WHEN l_linestatus = 'O' AND l_quantity = 50 AND l_tax >= 0.08 THEN 'admin:review' ELSE 'pipeline' END AS actor,
    account_id, l_orderkey * 2 AS edge_id, o_orderpriority AS reason, l_shipdate AS created_at
  FROM history),
attestations AS (SELECT doc_id AS account_id, 'bio_tag' AS signal, '#NoAI' AS matched_text, toxic = 0 AS active FROM labels WHERE quality = 1),
flags AS (SELECT doc_id AS account_id, 'nsfw' AS flag, 'bio_marker' AS signal, 'R-18' AS matched_text, toxic = 1 AS active FROM labels WHERE toxic = 1 OR quality = 0),
suppressions AS (
  SELECT CASE WHEN s_acctbal < 1500 THEN s_suppkey END AS artist_id, CASE WHEN s_acctbal >= 8000 THEN s_suppkey END AS account_id,
    CASE WHEN s_nationkey < 8 THEN 'opt_out' ELSE 'impersonation' END AS reason, s_nationkey >= 15 AS lifted
  FROM supplier WHERE s_acctbal < 1500 OR s_acctbal >= 8000),
out_artists AS (SELECT DISTINCT artist_id FROM suppressions WHERE NOT lifted AND artist_id IS NOT NULL),
out_accounts AS (SELECT DISTINCT account_id FROM suppressions WHERE NOT lifted AND account_id IS NOT NULL),
reviews AS (
  SELECT s_suppkey AS item_id, kind, CASE WHEN kind = 'other' THEN 'anomaly' END AS reason,
    CASE kind WHEN 'cluster_merge' THEN s_suppkey || ',' || (s_suppkey + 1) WHEN 'other' THEN 'artist:' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS review_key,
    CASE WHEN kind <> 'singleton_gate' THEN s_suppkey END AS artist_id, CASE WHEN kind = 'cluster_merge' THEN s_suppkey + 1 END AS other_artist_id,
    CASE WHEN kind = 'singleton_gate' THEN s_suppkey END AS account_id, CASE WHEN kind = 'cluster_merge' THEN s_suppkey * 2 END AS edge_id,
    CASE WHEN s_acctbal < 3000 THEN 'rejected' ELSE 'pending' END AS status
  FROM (SELECT *, CASE WHEN s_nationkey < 10 THEN 'cluster_merge' WHEN s_nationkey < 18 THEN 'other' ELSE 'singleton_gate' END AS kind FROM supplier)),
usage AS (
  SELECT CASE WHEN event_type IN ('purchase', 'view') THEN 'x_api' ELSE 'graphtreon' END AS service, event_type AS endpoint,
    CAST(floor(value) AS INT) AS units, CAST(ceil(floor(value) * 0.5) AS INT) AS est_cost_cents,
    date_trunc('hour', ts) AS occurred_at, CASE WHEN event_type = 'purchase' THEN 'tag flush' END AS note
  FROM events),
strong AS (
  SELECT * FROM edges WHERE status = 'present' AND claim = 'same_person'
    AND src NOT IN (SELECT account_id FROM accounts WHERE project) AND tgt NOT IN (SELECT account_id FROM accounts WHERE project)),
mutual AS (
  SELECT DISTINCT least(a.src, a.tgt) AS low, greatest(a.src, a.tgt) AS high FROM strong a JOIN strong b ON a.src = b.tgt AND a.tgt = b.src),
reach(node, reached) AS (
  SELECT low, low FROM mutual UNION SELECT high, high FROM mutual
  UNION SELECT r.node, CASE WHEN m.low = r.reached THEN m.high ELSE m.low END FROM reach r JOIN mutual m ON r.reached IN (m.low, m.high)),
component AS (SELECT node, min(reached) AS component FROM reach GROUP BY node),
visible AS (
  SELECT m.artist_id, a.*, p.display_rank, ar.public_slug, ar.display_name AS stored_name, ar.region, ar.language, m.confidence
  FROM memberships m JOIN accounts a USING (account_id) JOIN platforms p USING (platform) JOIN artists ar ON ar.artist_id = m.artist_id
  WHERE a.status IN ('active', 'unknown') AND a.account_id NOT IN (SELECT account_id FROM out_accounts)
    AND ar.status = 'active' AND ar.merged_into IS NULL AND ar.artist_id NOT IN (SELECT artist_id FROM out_artists))
"""


def oracle(body: str) -> str:
    return WORLD_SQL + body
