"""Rule tables of the link policy.

Everything here is a fixed value: results are only right if these lists hold
exactly these words.  They are data, kept apart from the expressions that use
them, and an operator's own block rules go through ``blocklist_anti_join``.
"""

from __future__ import annotations

# File extensions of assets that are never crawled.
ASSET_EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "css", "json", "xml", "csv", "yaml", "yml",
    "pdf", "zip", "tar", "gz", "rar", "7z",
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico",
    "mp3", "mp4", "wav", "ogg", "avi", "mov", "webm",
    "woff", "woff2", "ttf", "eot",
)

# Query keys that mark a MediaWiki action page.
WIKI_ACTION_KEYS = (
    "action", "veaction", "mobileaction", "diff", "oldid",
    "printable", "useparsoid", "redlink", "bookcmd", "returnto",
)

# Query keys dropped by canonicalisation (tracking, then locale).
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "source", "icid", "ocid", "wt.mc_id", "s_cid", "cid",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
    "l", "lang", "language", "locale",
)

# Blocked registered domains by category.  A rule covers the
# domain and all its subdomains.  "microsoft.com/store" holds a slash, so it
# can match no host; it is kept because it is part of the published list.
BLOCKED_DOMAINS = {
    "encyclopaedias": (
        "wikipedia.org", "wikidata.org", "wikimedia.org", "wikisource.org",
        "wikibooks.org", "wikinews.org", "wikiquote.org", "wikivoyage.org",
        "wiktionary.org", "wikiversity.org", "mediawiki.org", "wmflabs.org",
        "wmcloud.org",
    ),
    "social_networks": (
        "twitter.com", "x.com", "facebook.com", "instagram.com",
        "linkedin.com", "reddit.com", "pinterest.com", "tumblr.com",
        "tiktok.com", "snapchat.com", "threads.net", "bsky.app",
        "mastodon.social", "vk.com", "weibo.com", "discord.com",
        "discord.gg", "slack.com", "telegram.org", "t.me",
    ),
    "job_boards": (
        "linkedin.com", "indeed.com", "glassdoor.com", "monster.com",
        "ziprecruiter.com", "simplyhired.com", "careerbuilder.com",
        "dice.com", "lever.co", "greenhouse.io", "workday.com",
        "jobs.apple.com", "careers.google.com",
    ),
    "video_streaming": (
        "youtube.com", "youtu.be", "vimeo.com", "twitch.tv",
        "dailymotion.com", "netflix.com", "primevideo.com",
        "disneyplus.com", "hulu.com", "spotify.com", "soundcloud.com",
    ),
    "app_stores": (
        "apps.apple.com", "play.google.com", "appgallery.huawei.com",
        "microsoft.com/store", "galaxy.store",
    ),
    "code_hosting": (
        "github.com", "gitlab.com", "bitbucket.org", "sourceforge.net",
        "codepen.io", "jsfiddle.net", "replit.com",
    ),
    "ecommerce": (
        "amazon.com", "amazon.co.uk", "ebay.com", "etsy.com", "shopify.com",
        "alibaba.com", "aliexpress.com", "walmart.com",
    ),
    "ad_networks": (
        "doubleclick.net", "googlesyndication.com", "googleadservices.com",
        "adnxs.com", "outbrain.com", "taboola.com", "criteo.com",
        "scorecardresearch.com", "quantserve.com", "moatads.com",
    ),
    "infrastructure": (
        "cloudflare.com", "fastly.net", "akamaihd.net", "akamai.net",
        "googleusercontent.com", "gstatic.com", "googleapis.com",
        "bootstrapcdn.com", "cloudfront.net", "cdn.jsdelivr.net",
        "unpkg.com",
    ),
    "search_engines": (
        "google.com", "google.co.uk", "bing.com", "yahoo.com",
        "duckduckgo.com", "baidu.com", "yandex.com", "yandex.ru",
    ),
    "url_shorteners": (
        "bit.ly", "tinyurl.com", "t.co", "ow.ly", "buff.ly", "rebrand.ly",
        "short.io", "is.gd", "cutt.ly",
    ),
    "archive_services": (
        "web.archive.org", "webcitation.org", "archive.ph",
        "archive.today", "cachedview.nl",
    ),
}

# Labels that block a host wherever they stand in it, and
# labels that block it only as the last one.
BLOCKED_LABELS = ("gov", "mil")
BLOCKED_FINAL_LABELS = ("onion",)


def blocked_domain_set() -> list[str]:
    """All distinct blocked domains, sorted."""
    return sorted({d for rules in BLOCKED_DOMAINS.values() for d in rules})
