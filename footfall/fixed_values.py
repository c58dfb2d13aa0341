"""Results only match when these are exactly so."""

# --- fixed values: sessions and rate limits -------------------------------------------------
SESSION_SECONDS = 1800
RATE_LIMIT = 60
RATE_TTL_SECONDS = 60
MAX_BODY_BYTES = 8192
MEDIA_TYPES = ["text/plain", "application/json"]

# --- fixed values: search engines, tested in this order as substrings of the domain ----------
SEARCH_ENGINES = {
    "google": "Google",
    "bing": "Bing",
    "duckduckgo": "DuckDuckGo",
    "yahoo": "Yahoo",
    "baidu": "Baidu",
    "yandex": "Yandex",
    "ecosia": "Ecosia",
    "brave": "Brave",
    "startpage": "Startpage",
    "qwant": "Qwant",
    "sogou": "Sogou",
    "naver": "Naver",
}

# --- fixed values: social platforms, tested in this order after the search engines -----------
SOCIAL_PLATFORMS = {
    "facebook": "Facebook",
    "fb.com": "Facebook",
    "twitter": "Twitter/X",
    "x.com": "Twitter/X",
    "t.co": "Twitter/X",
    "linkedin": "LinkedIn",
    "reddit": "Reddit",
    "pinterest": "Pinterest",
    "instagram": "Instagram",
    "youtube": "YouTube",
    "tiktok": "TikTok",
    "mastodon": "Mastodon",
    "threads": "Threads",
    "tumblr": "Tumblr",
    "discord": "Discord",
    "slack": "Slack",
    "telegram": "Telegram",
    "whatsapp": "WhatsApp",
}

# --- fixed values: webmail hosts (the host itself or a sub-domain) ---------------------------
EMAIL_DOMAINS = [
    "mail.google.com",
    "outlook.live.com",
    "outlook.office.com",
    "mail.yahoo.com",
    "mail.aol.com",
]

# --- fixed values: utm_medium to channel ------------------------------------------------------
UTM_MEDIUM_CHANNELS = {
    "cpc": "Paid Search",
    "ppc": "Paid Search",
    "paidsearch": "Paid Search",
    "paid_search": "Paid Search",
    "cpm": "Paid Social",
    "paid_social": "Paid Social",
    "social": "Social Media",
    "email": "Email",
    "e-mail": "Email",
    "newsletter": "Email",
}

UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]

# --- fixed values: referrer spam domains ------------------------------------------------------
SPAM_DOMAINS = [
    "semalt.com",
    "buttons-for-website.com",
    "darodar.com",
    "econom.co",
    "ilovevitaly.com",
    "priceg.com",
    "savetubevideo.com",
    "kambasoft.com",
    "lomb.co",
    "cop.su",
    "hulfingtonpost.com",
    "best-seo-offer.com",
    "best-seo-solution.com",
    "buy-cheap-online.info",
    "7makemoneyonline.com",
    "o-o-6-o-o.com",
    "cenoval.ru",
    "seoanalyses.com",
    "ranksonic.info",
    "cyber-monday.ga",
    "simple-share-buttons.com",
    "social-buttons.com",
    "free-social-buttons.com",
    "event-tracking.com",
    "get-free-traffic-now.com",
    "traffic2money.com",
    "makemoneyonline.com",
    "trafficmonetizer.org",
    "web-revenue.xyz",
    "claim-your-bonus.com",
]

# --- fixed values: user-agent fragments of bots -----------------------------------------------
BOT_FRAGMENTS = [
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot", "sogou", "exabot",
    "ia_archiver",
    "gptbot", "chatgpt-user", "claude-web", "anthropic-ai", "cohere-ai", "perplexitybot", "youbot",
    "facebookexternalhit", "twitterbot", "linkedinbot", "pinterestbot", "telegrambot", "whatsapp",
    "discordbot", "slackbot",
    "semrushbot", "ahrefsbot", "mj12bot", "dotbot", "rogerbot", "screaming frog", "seokicks",
    "feedfetcher", "feedly", "newsblur",
    "uptimerobot", "pingdom", "statuscake", "site24x7", "newrelicpinger",
    "curl/", "wget/", "python-requests", "python-urllib", "java/", "apache-httpclient",
    "go-http-client", "node-fetch", "axios/", "libwww-perl",
    "headlesschrome", "phantomjs", "slimerjs",
    "bot/", "spider/", "crawler/", "scraper/", "http_request",
]

# --- fixed values: reason by user-agent fragment, first match wins ----------------------------
BOT_REASONS = {
    "search_crawler": ["googlebot", "bingbot", "yandexbot"],
    "ai_bot": ["gptbot", "chatgpt", "claude", "anthropic"],
    "cli_tool": ["curl", "wget", "python", "java/"],
}

# --- fixed values: browser name to the pattern capturing its version, first match wins --------
BROWSER_PATTERNS = {
    "Edge": r"Edg(?:e|A|iOS)?/(\d+[.\d]*)",
    "Firefox": r"Firefox/(\d+[.\d]*)",
    "Opera": r"(?:OPR|Opera)/(\d+[.\d]*)",
    "Chrome": r"Chrome/(\d+[.\d]*)",
    "Safari": r"Version/(\d+[.\d]*).*Safari",
}

# --- fixed values: operating system to user-agent words, first match wins ---------------------
OS_WORDS = {
    "Windows": ["Windows"],
    "Android": ["Android"],
    "iOS": ["iPhone", "iPad", "iPod"],
    "Mac": ["Macintosh", "Mac OS"],
    "GNU/Linux": ["Linux"],
}

# --- fixed values: detector device names to report names --------------------------------------
DEVICE_NAMES = {
    "desktop": "Desktop",
    "smartphone": "Mobile",
    "tablet": "Tablet",
    "feature phone": "Mobile",
    "phablet": "Mobile",
    "console": "Console",
    "tv": "TV",
    "car browser": "Other",
    "smart display": "Other",
    "smart speaker": "Other",
    "camera": "Camera",
    "portable media player": "Other",
    "wearable": "Wearable",
}

# --- fixed values: file endings that make a click a download ----------------------------------
DOWNLOAD_ENDINGS = "pdf|zip|xlsx?|docx?|pptx?|rar|7z|csv|mp3|mp4|wav|avi|mov|dmg|exe|msi|apk|iso"

# --- fixed values: URL parts that mark an analytics script (add your own site's script) -------
TRACKER_URL_PARTS = [
    "wp-statistics", "tracker.js", "koko-analytics", "burst", "wp-slimstat", "slimstat", "iawp",
    "jetpack", "gtag", "google-analytics", "analytics.js",
]

# --- fixed values: private and reserved address blocks ----------------------------------------
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "240.0.0.0/4",
]
PRIVATE_V6 = [
    "::/128", "::1/128", "::ffff:0:0/96", "2001:10::/28", "2001:db8::/32", "3ff3::/16", "5f00::/8",
    "fc00::/7", "fe80::/10",
]

# --- fixed values: page-speed score ------------------------------------------------------------
VITALS = ["ttfb", "fcp", "lcp", "cls", "inp"]
SCORE_WEIGHTS = {"ttfb": 0.25, "lcp": 0.30, "fcp": 0.20, "cls": 0.15, "inp": 0.10}
SCORE_SCALES = {"cls": 0.1, "inp": 200.0}
NOISE_BANDS = [(50.0, "small"), (200.0, "medium"), (500.0, "large")]
