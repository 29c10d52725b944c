"""Fixed values of text extraction: patterns, word lists and host lists.

Results must agree on these to the letter, so they are written out plainly. Patterns are Java regular
expressions; ``U`` makes ``\\w``, ``\\b`` and case folding follow Unicode.
"""

from __future__ import annotations

IC = "(?iU)"
CS = "(?U)"

# --- no-AI statements ---
NOAI_HASHTAG = IC + r"#no[_-]?(?:gen)?[_-]?ai\w*"
NOAI_PHRASES = [
    "無断AI学習禁止", "AI学習禁止", "AI使用禁止", "AI生成禁止", "生成AI禁止", "生成AI不使用", "AI学習・利用禁止",
]
GLAZE = IC + r"\bglazed?\b"
NIGHTSHADE = IC + r"\bnightshaded?\b"

# --- adult markers ---
ADULT_MARKERS = ["🔞", r"\br-?18g?\b", r"\b18\+", r"\bnsfw\b", r"\bmdni\b|minors\s+dni"]
NEGATION_WINDOW = 12
BLUESKY_ADULT_LABELS = ["porn", "sexual", "nudity"]

# --- short links ---
SHORTENER_DOMAINS = [
    "t.co", "bit.ly", "tinyurl.com", "goo.gl", "x.gd", "onl.tw", "onl.sc", "buly.kr", "pixiv.me",
    "vm.tiktok.com", "vt.tiktok.com",
]

# --- e-mail ---
EMAIL = (
    IC + r"[A-Za-z0-9][\w.+-]*@[\w-]+(?:\.[\w-]+)*?"
    r"\.(?:co\.jp|ne\.jp|or\.jp|co\.uk|com|net|org|jp|io|me|art|xyz|moe|cc|"
    r"dev|info|gg|us|uk|ca|de|fr|es|it|nl|br|tw|kr|studio|design|online|"
    r"site|email|pro|club)"
)

# --- commissions: pattern, status, confidence ---
COMMISSIONS = [
    (IC + r"comm?(?:ission)?s?\s*(?:status)?\s*(?:are|:|-|–|—)?\s*open", "open", 0.9),
    (IC + r"open\s+(?:for\s+)?comm?(?:ission)?s", "open", 0.85),
    (IC + r"taking\s+comm?(?:ission)?s", "open", 0.8),
    (IC + r"comm?(?:ission)?s?\s*(?:status)?\s*(?:are|:|-|–|—)?\s*closed?\b", "closed", 0.9),
    (IC + r"closed?\s+(?:for\s+)?comm?(?:ission)?s", "closed", 0.85),
    (IC + r"not\s+taking\s+comm?(?:ission)?s", "closed", 0.85),
    (IC + r"comm?(?:ission)?s?\s*(?::|-|–|—)?\s*waitlist", "waitlist", 0.8),
    (CS + r"依頼\s*受付中|コミッション\s*(?:受付中|募集中)|お仕事(?:依頼)?\s*受付中", "open", 0.85),
    (CS + r"依頼\s*(?:停止中|受付停止|募集停止)|コミッション\s*(?:停止|休止)中?", "closed", 0.85),
    (IC + r"skeb\s*(?:募集中|受付中)", "open", 0.7),
]

#: Every commission pattern needs one of these, in lower case.
COMMISSION_SIGNS = ["com", "keb", "依頼", "コミッション", "仕事"]

# --- person and project evidence ---
ARTIST_HINTS = (
    IC + r"illustrat|artist|art\b|draw|paint|sketch|doodle|fanart|commission|comm\b|comms\b"
    r"|oc\b|vtuber|design|animat|pixiv|skeb|vgen|絵|イラスト|絵描き|絵師|落書き|らくがき"
    r"|お絵描き|依頼|創作|同人"
)
#: Every hint starts with one of these.
ARTIST_STARTS = "iadpsfcovg絵イ落らお依創同"
PROJECT_HINTS = (
    IC + r"\b(?:fan)?zines?\b|\bbig\s?bangs?\b|antholog|合同誌|アンソロ"
    r"|\bcharity\s+(?:project|event|zine)\b|\bfan\s?events?\b"
    r"|\bart\s+servers?\b|\bcollab\s+(?:server|group)\b"
)
PROJECT_HANDLE = IC + r"(?<!maga)zines?$|bangs?$"
PROJECT_NAME = (
    IC + r"\b(?:fan)?zines?\b|\bbig\s?bangs?\b|antholog|(?:合同誌|アンソロジー?)\s*(?:告知|公式|【)"
)
PROJECT_SELF = (
    IC + r"\b(?:a|an|the|this|our)\s+(?:[\w'!:&.~+-]+\s+){0,6}?"
    r"(?:(?:fan)?zines?|(?:big|mini|reverse)\s?bangs?|bang\s+events?"
    r"|antholog\w+|fan\s?events?)\b"
    r"|(?:合同誌|アンソロジー?)(?:です|の?公式|企画)"
)

# --- mentions ---
MENTION_CONTEXT = 24
MENTIONS = {
    "twitter": CS + r"(?<![\w.@/])@([A-Za-z0-9_]{2,15})\b",
    "bluesky": IC + r"(?<![\w.@/])@([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)+)",
}
ALT_TOKENS = [
    "alt", "main", "side", "backup", "moved", "sub acc", "subacc", "2nd acc", "second acc",
    "other acc", "aka",
    "旧アカ", "新アカ", "別アカ", "サブ垢", "サブアカ", "別垢", "本垢", "裏垢", "新垢", "旧垢", "メイン垢", "移転",
    "移行先", "避難先", "支店", "本店",
    "부계", "본계", "小号", "大号", "主号", "备用号",
]
RELATED_TOKENS = [
    "pfp", "icon", "banner", "header", "art by", "artist", "partner", "bf", "gf", "wife",
    "husband", "friend", "絵師", "アイコン",
]

# --- platform links: platform, captured field, a literal every match contains, pattern ---
PLATFORM_LINKS = [
    ("twitter", "handle", ".com/",
     IC + r"(?:https?://)?(?:www\.)?(?:x|twitter)\.com/@?"
     r"(?!i/|home\b|search\b|hashtag/|intent/|share\b|widgets\b|messages\b"
     r"|notifications\b|settings\b|explore\b|login\b|logout\b|signup\b"
     r"|tos\b|privacy\b|about\b|download\b|account\b|help\b|jobs\b|compose/)"
     r"([A-Za-z0-9_]{1,15})\b"),
    ("bluesky", "native_id", "bsky.app/profile/", IC + r"bsky\.app/profile/(did:(?:plc|web):[A-Za-z0-9._%:-]+)"),
    ("bluesky", "handle", "bsky.app/profile/", IC + r"bsky\.app/profile/(?!did:)([A-Za-z0-9.-]+)"),
    ("bluesky", "handle", ".bsky.social", IC + r"(?<![\w.-])([A-Za-z0-9][A-Za-z0-9-]*\.bsky\.social)\b"),
    ("pixiv", "native_id", "pixiv.net/", IC + r"pixiv\.net/(?:en/)?(?:users/|member\.php\?id=)(\d+)"),
    ("skeb", "handle", "skeb.jp/@", IC + r"skeb\.jp/@([\w.-]+)"),
    ("artstation", "handle", "artstation.com/",
     IC + r"artstation\.com/(?:artist/)?(?!marketplace\b|learning\b|artwork\b"
     r"|blogs\b|prints\b|challenges\b|jobs\b|artist\b|search\b|contests\b"
     r"|schools\b|studios\b|guides\b|about\b)([A-Za-z0-9_-]+)"),
    ("patreon", "handle", "patreon.com/",
     IC + r"patreon\.com/(?:c/|cw/)?(?!posts\b|join\b|checkout\b|user\b|c\b|cw\b"
     r"|creation\b|collections?\b|home\b|login\b|signup\b|search\b|messages\b"
     r"|settings\b|explore\b|about\b|apps\b|pricing\b|policy\b|policies\b"
     r"|brand\b|hc\b|products?\b|create\b|dashboard\b|mobile\b|bePatron\b"
     r"|oauth2\b|m\b|api\b)([A-Za-z0-9_-]+)"),
    ("kofi", "handle", "ko-fi.com/", IC + r"ko-fi\.com/([A-Za-z0-9_]+)"),
    ("vgen", "handle", "vgen.co/", IC + r"vgen\.co/([A-Za-z0-9_-]+)"),
    ("cara", "handle", "cara.app/", IC + r"cara\.app/([A-Za-z0-9._-]+)"),
    ("xfolio", "handle", "xfolio.jp/", IC + r"xfolio\.jp/(?:en/)?portfolio/([\w-]+)"),
    ("deviantart", "handle", "deviantart.com/", IC + r"deviantart\.com/(?!tag\b|art\b)([A-Za-z0-9-]+)"),
    ("deviantart", "handle", ".deviantart.com", IC + r"(?<![\w.-])([A-Za-z0-9-]+)\.deviantart\.com"),
    ("tumblr", "handle", ".tumblr.com", IC + r"(?<![\w.-])([A-Za-z0-9-]+)\.tumblr\.com"),
    ("tumblr", "handle", "tumblr.com/",
     IC + r"tumblr\.com/(?!tagged\b|search\b|blog\b|post\b|share\b|app\b|apps\b|explore\b|dashboard\b"
     r"|reblog\b|liked\b|likes\b|settings\b|login\b|register\b|about\b|policy\b|download\b|contact\b"
     r"|support\b|help\b|terms\b|privacy\b|jobs\b|press\b|themes\b|communities\b|security\b)([A-Za-z0-9-]+)"),
    ("gumroad", "handle", ".gumroad.com", IC + r"(?<![\w.-])([A-Za-z0-9]+)\.gumroad\.com"),
    ("inprnt", "handle", "inprnt.com/", IC + r"inprnt\.com/gallery/(\w+)"),
    ("instagram", "handle", "instagram.com/",
     IC + r"instagram\.com/(?!p/|reels?\b|stories\b|explore\b|accounts\b|direct\b|tv\b|share\b|about\b"
     r"|legal\b|developer\b)([A-Za-z0-9._]{1,30})"),
    ("tiktok", "handle", "tiktok.com/@", IC + r"tiktok\.com/@([A-Za-z0-9_.]{2,24})"),
    ("mihuashi", "handle", "mihuashi.com/", IC + r"mihuashi\.com/(?:users|painters)/([^/\s?#\"']+)"),
    ("youtube", "handle", "youtube.com/@", IC + r"youtube\.com/@([\w.-]+)"),
    ("youtube", "handle", "youtube.com/", IC + r"youtube\.com/(?:c/|user/)([\w.-]+)"),
    ("youtube", "native_id", "youtube.com/channel/", IC + r"youtube\.com/channel/(UC[\w-]{10,})"),
    ("discord", "handle", "discord", IC + r"(?:discord\.gg|discord(?:app)?\.com/invite)/([A-Za-z0-9-]+)"),
    ("telegram", "handle", "t.me/", IC + r"\bt\.me/([A-Za-z0-9_]{4,32})"),
    ("twitch", "handle", "twitch.tv/",
     IC + r"twitch\.tv/(?!videos\b|directory\b|collections\b|settings\b|downloads\b|subscriptions\b|drops\b"
     r"|wallet\b|friends\b|jobs\b|store\b|p\b)([A-Za-z0-9_]{3,25})"),
    ("furaffinity", "handle", "furaffinity.net/", IC + r"furaffinity\.net/user/([\w.~-]+)"),
    ("behance", "handle", ".net/", IC + r"(?:behance\.net|be\.net)/(?!gallery\b)([A-Za-z0-9_-]+)"),
    ("boosty", "handle", "boosty.to/", IC + r"boosty\.to/([A-Za-z0-9_.-]+)"),
    ("artfight", "handle", "artfight.net/", IC + r"artfight\.net/~([\w.-]+)"),
    ("biosite", "handle", "bio.site/", IC + r"bio\.site/([\w.-]+)"),
    ("coloso", "handle", "coloso.", IC + r"coloso\.(?:us|global|jp|co\.kr)/(?:[a-z]{2}/)?(?:products/)?([\w-]+)"),
    ("fanbox", "handle", ".fanbox.cc", IC + r"(?<![\w.-])([\w-]+)\.fanbox\.cc"),
    ("fanbox", "handle", "fanbox.cc/@", IC + r"fanbox\.cc/@([\w-]+)"),
    ("fantia", "native_id", "fantia.jp/", IC + r"fantia\.jp/fanclubs/(\d+)"),
    ("booth", "handle", ".booth.pm", IC + r"(?<![\w.-])([\w-]+)\.booth\.pm"),
    ("dlsite", "handle", "dlsite.com/", IC + r"dlsite\.com/\S*maker_id/([A-Z]{2}\d+)"),
    ("nijie", "native_id", "nijie.info/", IC + r"nijie\.info/members\.php\?id=(\d+)"),
    ("skima", "native_id", "skima.jp/", IC + r"skima\.jp/profile\?id=(\d+)"),
    ("coconala", "native_id", "coconala.com/", IC + r"coconala\.com/users/(\d+)"),
    ("linktree", "handle", "linktr.ee/", IC + r"linktr\.ee/([\w.]+)"),
    ("linktree", "handle", "tr.ee/", IC + r"(?<![\w.-])tr\.ee/([\w.]+)"),
    ("carrd", "handle", ".carrd.co", IC + r"(?<![\w.-])([A-Za-z0-9-]+)\.carrd\.co"),
    ("misskey", "handle", "misskey.", IC + r"misskey\.(?:io|design|art)/@([A-Za-z0-9_]+)"),
    ("weibo", "native_id", "weibo.", IC + r"weibo\.(?:com|cn)/(?:u/)?(\d{6,})"),
    ("weibo", "handle", "weibo.",
     IC + r"weibo\.(?:com|cn)/(?!u/|n/|p/|tv/|hot/|search|login|signup)([A-Za-z][A-Za-z0-9_-]{2,29})\b"),
    ("threads", "handle", "threads.", IC + r"threads\.(?:net|com)/@([A-Za-z0-9._]{1,30})"),
    ("bilibili", "native_id", "space.bilibili.com/", IC + r"space\.bilibili\.com/(\d+)"),
    ("facebook", "native_id", "facebook.com/", IC + r"facebook\.com/profile\.php\?id=(\d+)"),
    ("facebook", "handle", "facebook.com/",
     IC + r"facebook\.com/(?!profile\.php|sharer?\b|groups\b|pages\b|events\b|watch\b|marketplace\b|photos?\b"
     r"|permalink|story|hashtag|login\b|people\b|reel|gaming\b|help\b|policies)([A-Za-z0-9.]{5,50})"),
    ("potofu", "handle", "potofu.me/", IC + r"potofu\.me/([\w.-]+)"),
    ("litlink", "handle", "lit.link/", IC + r"lit\.link/(?:en/|ja/)?(\w+)"),
    ("profcard", "handle", "profcard.info/u/", CS + r"profcard\.info/u/([A-Za-z0-9]+)"),
    ("twpf", "handle", "twpf.jp/", IC + r"twpf\.jp/([A-Za-z0-9_]{1,15})\b"),
    ("tsunagu", "handle", "tsunagu.cloud/", IC + r"tsunagu\.cloud/users/([\w.-]+)"),
]

RESERVED_HANDLES = [
    "www", "blog", "shop", "app", "apps", "help", "about", "support", "at", "media", "assets",
    "static", "embed", "api", "cdn", "px", "mail", "link", "redirect", "status", "docs",
    "https", "http", "profile", "share", "home", "index", "search", "login", "signup", "account",
    "accounts", "explore", "watch", "null", "undefined",
    "user", "users", "uploads", "production", "store", "files", "images", "img", "content",
    "downloads", "photos", "storage", "sites", "pages", "news", "category", "wiki", "tag", "tags",
    "post", "posts", "public",
    "stash", "journal", "journals", "favourites", "deviations", "daily-deviations", "groups",
]
HEX_JUNK = r"(?i)^[0-9a-f]{16,}$"
ELLIPSIS = r"…|\.\.\.|‥"

# --- websites ---
GENERIC_URL = r"(?i)(?:https?://|www\.)[A-Za-z0-9.\-_~:/?#@!$&*+,;=%']+"
DOMAIN_OF = r"(?i)^(?:https?://)?(?:www\.)?([A-Za-z0-9.-]+)"
PLATFORM_DOMAINS = [
    "x.com", "twitter.com", "bsky.app", "bsky.social", "pixiv.net", "skeb.jp", "weibo.com",
    "weibo.cn", "facebook.com", "fb.com", "artstation.com", "patreon.com", "ko-fi.com", "vgen.co",
    "cara.app", "xfolio.jp", "deviantart.com", "tumblr.com", "gumroad.com", "inprnt.com",
    "instagram.com", "tiktok.com", "linktr.ee", "tr.ee", "carrd.co", "potofu.me", "lit.link",
    "misskey.io", "misskey.design", "misskey.art", "threads.net", "threads.com",
    "space.bilibili.com", "mihuashi.com", "youtube.com", "youtu.be", "discord.gg", "discord.com",
    "discordapp.com", "t.me", "telegram.me", "twitch.tv", "furaffinity.net", "behance.net",
    "be.net", "boosty.to", "artfight.net", "bio.site", "coloso.us", "coloso.global", "coloso.jp",
    "coloso.co.kr", "fanbox.cc", "fantia.jp", "booth.pm", "dlsite.com", "nijie.info", "skima.jp",
    "coconala.com", "profcard.info", "twpf.jp", "tsunagu.cloud",
]
OTHER_NON_WEBSITES = [
    "google.com", "forms.gle", "docs.google.com", "drive.google.com", "open.spotify.com",
    "spotify.com", "amazon.com", "amazon.co.jp", "amzn.to", "amzn.asia", "apple.com", "paypal.me",
    "paypal.com", "cash.app", "streamlabs.com", "throne.com", "thron.ee", "throne.me",
    "donmai.us", "gelbooru.com", "e621.net", "rule34.xxx", "safebooru.org", "yande.re",
    "konachan.com", "sankakucomplex.com", "gmail.com", "amazon.jp", "melonbooks.co.jp",
    "youtube.jp", "dmm.co.jp", "toranoana.jp", "piccoma.com", "bilibili.com", "googleapis.com",
    "gstatic.com", "googletagmanager.com", "google-analytics.com", "jsdelivr.net", "unpkg.com",
    "cloudflare.com", "cdnjs.com", "typekit.net", "fontawesome.com", "bootstrapcdn.com",
    "gravatar.com", "wp.com", "wixstatic.com", "squarespace-cdn.com", "googlesyndication.com",
    "doubleclick.net", "googleadservices.com", "deviantart.net", "wixmp.com", "usrfiles.com",
    "filesusr.com", "fav.me", "sta.sh",
]
NON_WEBSITE_DOMAINS = PLATFORM_DOMAINS + SHORTENER_DOMAINS + OTHER_NON_WEBSITES
ASSET_PATH = (
    r"(?i)\.(?:js|mjs|css|json|xml|png|jpe?g|gif|webp|avif|svg|ico|bmp"
    r"|woff2?|ttf|otf|eot|mp[34]|webm|mov|wav|ogg|pdf|zip|rar|7z)$"
)

# --- scripts, in the order they are tested ---
LANGUAGE_SCRIPTS = [
    ("ja", r"[぀-ヿ]"),
    ("ko", r"[가-힯]"),
    ("zh", r"[一-鿿]"),
    ("th", r"[ก-๛]{2}"),
    ("ru", r"[Ѐ-ӿ]{4,}"),
    ("ar", r"[؀-ۿ]{2}"),
    ("en", r"[A-Za-z]"),
]

# --- names ---
HOST_SUFFIXES = ["bsky.social", "carrd.co", "tumblr.com", "fanbox.cc", "booth.pm"]
X_HANDLE = r"^[a-z0-9_]{1,15}$"
YOUTUBE_CHANNEL_ID = r"^UC[A-Za-z0-9_-]{20,}$"
TWEET_EPOCH_MS = 1288834974657

# --- html ---
TAGS = r"<[^>]+>"
TAGS_WITH_SCRIPTS = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]+>"
ANCHOR_HREF = r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
LINKED_URL = r"(?i)(?:href\s*=|\"url\"\s*:)\s*[\"'](https?://[^\"']+)[\"']"
OG_PROPERTY_FIRST = (
    r"(?i)<meta[^>]+property=[\"']og:(title|image|description)[\"'][^>]+content=[\"']([^\"']*)[\"']"
)
OG_CONTENT_FIRST = (
    r"(?i)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+property=[\"']og:(title|image|description)[\"']"
)
