"""Thresholds, source names and the platform list. They decide results, so they are data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- thresholds ---
REVIEW_FOLLOWER_THRESHOLD = 10_000
RECIPROCITY_SHARED_MIN = 2
MAX_SAME_PLATFORM = 3
ANOMALY_HUB_FANOUT = 25
ANOMALY_HUB_ATTACHED = 20
ANOMALY_RELATED_CONNECTIONS = 15
ANOMALY_CROSS_ARTIST_REFS = 3
CULL_MIN_FOLLOWERS = 50
DORMANT_AFTER_DAYS = 180
HUB_CREDITS_MIN = 3
HUB_MAX_WEBSITES = 5
MAX_MENTIONS_PER_PAGE = 5
NAME_MATCH_MIN = 0.75
HUB_COMMISSION_MULTIPLIER = 0.65
POST_READ_CENTS = 0.5
USER_READ_CENTS = 1.0
DEFAULT_CAP_CENTS = 10_000
USERS_PER_REQUEST = 100
MAX_HANDLES_PER_REQUEST = 20_000
DIRECTORY_PAGE_SIZE = 50
TAG_PAGE_SIZE = 100
REMOVED_LIST_SIZE = 500
BREAKDOWN_SHOWN = 14
MERGE_EVIDENCE_SHOWN = 8

# --- source names ---
HARVEST_NEEDS_EVIDENCE = ["portfolioday", "portfolioday_mention"]
ROSTER_SOURCES = [
    "bsky_feed", "bsky_starter_pack", "bsky_list", "portfolioday", "portfolioday_mention",
    "twitter_list", "skeb_ranking", "pixiv_ranking", "pixiv_tag_search", "patreon_ranking",
    "artstation_ranking", "deviantart_popular", "vgen_marketplace", "convention_list",
    "platform_roster", "manual_tag",
]
INCIDENTAL_SOURCES = ["bio_link", "bio_mention", "link_hub", "hydration"]

# --- edges ---
STRONG_EVIDENCE = ["bio_link", "link_hub", "profile_field", "pinned_post", "bio_mention"]
FLIP_HINTS = ["unreciprocated_prominent", "secondary_link", "over_platform_cap"]
LOW_SIGNAL_HINTS = ["same_platform_mention", "hub_credits", "website"]
REEXTRACTABLE_ATTESTATIONS = ["bio_tag", "glaze_mention", "nightshade_mention"]
REEXTRACTABLE_FLAGS = ["bio_marker", "self_label"]
PARTIAL_SNAPSHOT_SOURCES = [
    "hub_crawl", "graphtreon:ranking", "artstation:trending", "deviantart:rss", "deviantart:about",
]

# --- enumerated values of the state tables ---
ACCOUNT_STATUSES = ["active", "suspended", "deleted", "deactivated", "unknown", "hidden"]
VISIBLE_STATUSES = ["active", "unknown"]
EVIDENCE_TYPES = ["bio_link", "link_hub", "profile_field", "pinned_post", "same_handle", "bio_mention"]
EDGE_STATUSES = ["present", "stale", "retracted", "dismissed"]
CLAIMS = ["same_person", "related"]
CONFIDENCES = ["near_proof", "strong", "weak"]

NEVER_PROBED = ["twitter", "instagram", "bluesky", "discord", "telegram"]

# --- region ---
EAST_PLATFORMS = [
    "skeb", "pixiv", "fanbox", "fantia", "booth", "dlsite", "nijie", "skima", "coconala",
    "mihuashi", "xfolio", "litlink", "potofu", "profcard", "twpf", "tsunagu",
]
WEST_PLATFORMS = ["artstation", "furaffinity", "inprnt", "deviantart"]

# --- never-an-artist pairs ---
HUB_PLATFORMS = ["linktree", "carrd", "potofu", "litlink", "biosite", "profcard", "twpf", "tsunagu"]
HUB_SERVICE_ACCOUNTS = [
    ("twitter", "tsunagu_cloud"), ("tsunagu", "test_account"), ("twitter", "linktr_ee"),
    ("twitter", "carrd"), ("twitter", "potofu_me"), ("twitter", "twpf"),
    ("twitter", "profcard_info"), ("twitter", "lit_link"),
]
PATREON_SERVICE_HANDLES = [
    ("twitter", "patreon"), ("instagram", "patreon"), ("youtube", "patreon"),
    ("facebook", "patreon"), ("twitch", "patreon"),
]
SKEB_FIELD_VALUE_BLOCKLIST = [("youtube", "UCQEN3LsNnqottC2mXx3tAjA"), ("fanbox", "www")]

# --- platforms: slug, name, kind, display only, profile address, display rank ---
PLATFORMS = [
    ("twitter", "Twitter/X", "social", False, "https://x.com/{handle}", 0),
    ("bluesky", "Bluesky", "social", False, "https://bsky.app/profile/{handle}", 1),
    ("pixiv", "Pixiv", "portfolio", False, "https://www.pixiv.net/users/{native_id}", 4),
    ("skeb", "Skeb", "commission", False, "https://skeb.jp/@{handle}", 3),
    ("artstation", "ArtStation", "portfolio", False, "https://www.artstation.com/{handle}", 10),
    ("patreon", "Patreon", "support", False, "https://www.patreon.com/{handle}", 10),
    ("vgen", "VGen", "commission", False, "https://vgen.co/{handle}", 10),
    ("cara", "Cara", "portfolio", False, "https://cara.app/{handle}", 10),
    ("xfolio", "XFolio", "portfolio", False, "https://xfolio.jp/portfolio/{handle}", 10),
    ("kofi", "Ko-fi", "support", False, "https://ko-fi.com/{handle}", 10),
    ("deviantart", "DeviantArt", "portfolio", False, "https://www.deviantart.com/{handle}", 10),
    ("tumblr", "Tumblr", "social", False, "https://{handle}.tumblr.com", 10),
    ("gumroad", "Gumroad", "support", False, "https://{handle}.gumroad.com", 10),
    ("inprnt", "INPRNT", "support", False, "https://www.inprnt.com/gallery/{handle}/", 10),
    ("instagram", "Instagram", "social", True, "https://www.instagram.com/{handle}", 10),
    ("linktree", "Linktree", "link_hub", False, "https://linktr.ee/{handle}", 2),
    ("carrd", "Carrd", "link_hub", False, "https://{handle}.carrd.co", 2),
    ("potofu", "potofu.me", "link_hub", False, "https://potofu.me/{handle}", 2),
    ("litlink", "lit.link", "link_hub", False, "https://lit.link/{handle}", 2),
    ("mihuashi", "米画师 Mihuashi", "commission", False, "https://www.mihuashi.com/users/{handle}", 10),
    ("youtube", "YouTube", "social", False, "https://www.youtube.com/@{handle}", 10),
    ("discord", "Discord", "social", False, None, 10),
    ("telegram", "Telegram", "social", False, "https://t.me/{handle}", 10),
    ("twitch", "Twitch", "social", False, "https://www.twitch.tv/{handle}", 10),
    ("website", "Personal site", "portfolio", False, None, 20),
    ("furaffinity", "Fur Affinity", "portfolio", False, "https://www.furaffinity.net/user/{handle}", 10),
    ("behance", "Behance", "portfolio", False, "https://www.behance.net/{handle}", 10),
    ("boosty", "Boosty", "support", False, "https://boosty.to/{handle}", 10),
    ("artfight", "Art Fight", "portfolio", False, "https://artfight.net/~{handle}", 10),
    ("biosite", "Bio Site", "link_hub", False, "https://bio.site/{handle}", 2),
    ("coloso", "Coloso", "support", False, None, 10),
    ("fanbox", "pixiv FANBOX", "support", False, "https://{handle}.fanbox.cc", 10),
    ("fantia", "Fantia", "support", False, "https://fantia.jp/fanclubs/{handle}", 10),
    ("booth", "BOOTH", "support", False, "https://{handle}.booth.pm", 10),
    ("dlsite", "DLsite", "support", False, None, 10),
    ("nijie", "nijie", "portfolio", False, "https://nijie.info/members.php?id={handle}", 10),
    ("skima", "SKIMA", "commission", False, "https://skima.jp/profile?id={handle}", 10),
    ("coconala", "coconala", "commission", False, "https://coconala.com/users/{handle}", 10),
    ("misskey", "Misskey", "social", False, "https://misskey.io/@{handle}", 10),
    ("weibo", "Weibo", "social", True, "https://weibo.com/u/{native_id}", 10),
    ("facebook", "Facebook", "social", True, "https://www.facebook.com/{handle}", 10),
    ("profcard", "Profcard", "link_hub", False, "https://profcard.info/u/{handle}", 15),
    ("twpf", "Twpf", "link_hub", False, "https://twpf.jp/{handle}", 15),
    ("tsunagu", "TSUNAGU", "link_hub", False, "https://tsunagu.cloud/users/{handle}", 15),
    ("tiktok", "TikTok", "social", True, "https://www.tiktok.com/@{handle}", 10),
    ("threads", "Threads", "social", True, "https://www.threads.net/@{handle}", 10),
    ("bilibili", "Bilibili", "social", True, "https://space.bilibili.com/{native_id}", 10),
]
PLATFORM_SCHEMA = (
    "platform string, platform_name string, kind string, display_only boolean, "
    "profile_url_template string, display_rank int"
)


def platforms(spark: SparkSession) -> DataFrame:
    """The platform dimension: 47 fixed rows, so a broadcast is always safe."""
    return spark.createDataFrame(PLATFORMS, PLATFORM_SCHEMA)
