"""Fixed values that results depend on: class sets, word lists, patterns, weights, seeds. All can be replaced by arguments."""

from __future__ import annotations

# Listing classes that can be cloned outright, and after a review.
AUTO_CLASSES = (
    "Match", "Hyper-Casual", "Idle", "Board & Card Games", "Photo & Video", "Productivity & Tools", "Lifestyle",
    "Education", "Health & Fitness", "Graphic & Design", "Party & Words", "Books & Writing", "Puzzle",
)
REVIEW_CLASSES = ("Simulation", "Casino")
# Markets of the shortlist, and those that can be supported.
SEA_MARKETS = ("id", "vn", "th", "my", "bd")
SUPPORTED_MARKETS = ("id", "vn", "th", "my", "bd", "us", "gb", "ca", "au", "fr", "de")
# What a market's listings are written in; markets of several languages are left out.
MARKET_LANGUAGE = {
    "us": "en", "gb": "en", "au": "en", "ca": "en", "ie": "en", "nz": "en", "za": "en",
    "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uy": "es", "ve": "es",
    "br": "pt", "pt": "pt", "it": "it", "de": "de", "at": "de", "nl": "nl", "pl": "pl", "ru": "ru",
    "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "tr": "tr", "gr": "el", "sa": "ar", "ae": "ar", "eg": "ar", "il": "he",
}
# Scripts that decide a language, in this order, and stop words of the others.
SCRIPTS = (
    ("ja", r"[\x{3040}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7AF}]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("el", r"[\x{0370}-\x{03FF}]"),
    ("ar", r"[\x{0600}-\x{06FF}]"), ("he", r"[\x{0590}-\x{05FF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"),
)
STOP_WORDS = {
    "en": "the and you your with this that for are is have of to a an or if can be by in on at we",
    "fr": "le la les et est vous pour avec votre des une dans ce sont ou du au",
    "de": "der die das und ist sie für mit ihre ein eine einem einer dem den zum zur deine deinen",
    "es": "el los las y es con su este esta una un tus sus que",
    "pt": "o os as é com sua seu uma um no na do da dos das",
    "it": "il lo gli è per tuo questa della delle degli che una",
    "nl": "het een en voor met uw deze van te op niet naar is",
    "pl": "i w z na do jest się od po dla to że są ale",
    "tr": "ve bir bu ile için siz sizin olan daha çok kadar",
}
# What a description says of its paywall.
SUBSCRIPTION = r"\b(subscription|subscribe|monthly|yearly|annual)\b|/(?:month|mo|year|yr)\b|per\s+(?:month|year)"
TRIAL = r"\b(free trial|trial period|\d+[- ]day(?: free)? trial|try (it )?free)\b"
LIFETIME = r"\b(lifetime|one[- ]?time|forever|permanent purchase)\b"
TIER = r"\b(pro|premium|plus|elite|ultimate|gold|platinum)\b"
# Revenue weight of a market by business model, and that of other markets.
MARKET_WEIGHTS = {
    "subscription": {
        "us": 5.5, "jp": 3.5, "ca": 3.2, "au": 3.2, "gb": 3.0, "ch": 3.0, "de": 2.2, "fr": 2.0, "nl": 2.0, "it": 1.8, "es": 1.6, "ie": 2.0, "be": 1.9,
        "at": 2.0, "dk": 2.1, "fi": 1.9, "no": 2.1, "se": 2.0, "nz": 2.5, "kr": 2.0, "sg": 2.0, "hk": 1.8, "tw": 1.2, "pl": 0.9, "cz": 0.95, "hu": 0.85,
        "ro": 0.7, "pt": 1.3, "gr": 1.0, "sa": 1.5, "ae": 1.8, "il": 1.7, "br": 0.25, "mx": 0.25, "ar": 0.2, "cl": 0.3, "co": 0.2, "tr": 0.2, "ru": 0.25,
        "th": 0.18, "my": 0.25, "in": 0.08, "id": 0.08, "ph": 0.08, "vn": 0.08, "za": 0.25, "ng": 0.05, "eg": 0.1,
    },
    "games": {
        "jp": 6.0, "kr": 4.5, "us": 4.5, "ca": 2.8, "au": 2.8, "gb": 2.6, "de": 2.0, "fr": 1.8, "it": 1.5, "es": 1.4, "nl": 1.6, "ch": 2.4, "tw": 2.0,
        "hk": 2.0, "sg": 1.6, "ru": 0.6, "pl": 0.7, "br": 0.5, "mx": 0.4, "tr": 0.3, "sa": 1.0, "ae": 1.2, "il": 1.0, "th": 0.45, "my": 0.4, "id": 0.3,
        "ph": 0.25, "vn": 0.3, "bd": 0.1, "in": 0.15, "za": 0.2, "ng": 0.05, "eg": 0.1,
    },
    "ads": {
        "us": 3.5, "ca": 2.8, "au": 2.6, "gb": 2.6, "jp": 2.4, "ch": 2.5, "de": 1.8, "fr": 1.6, "nl": 1.6, "it": 1.3, "es": 1.3, "kr": 1.6, "sg": 1.4,
        "hk": 1.3, "tw": 1.0, "nz": 2.0, "ie": 1.6, "pl": 0.65, "pt": 1.0, "ae": 1.4, "sa": 1.2, "il": 1.3, "br": 0.55, "mx": 0.5, "ar": 0.4, "cl": 0.55,
        "co": 0.4, "tr": 0.45, "ru": 0.5, "th": 0.4, "my": 0.5, "id": 0.35, "ph": 0.3, "vn": 0.3, "bd": 0.15, "in": 0.2, "za": 0.4, "ng": 0.1, "eg": 0.2,
    },
}
OTHER_WEIGHT = {"subscription": 0.25, "games": 0.25, "ads": 0.3}
# Categories in whose place a category's estimate is taken, in this order.
CATEGORY_FAMILY = {
    "health": ("lifestyle", "productivity"), "productivity": ("health",), "finance": ("productivity",), "lifestyle": ("health",), "social": ("lifestyle",),
    "utilities": ("productivity", "lifestyle"), "education": ("productivity", "health"), "entertainment": ("lifestyle", "social"),
    "shopping": ("lifestyle", "finance"), "games": ("social", "lifestyle"),
}
# Fixed values: (market, category, lowest and highest cost of an install, lowest and highest value of one).
ECONOMICS_SEED = (
    ("id", "health", 0.3, 0.8, 3.5, 8.0), ("id", "productivity", 0.4, 1.0, 4.0, 9.0), ("id", "finance", 0.6, 1.5, 6.0, 18.0), ("id", "lifestyle", 0.25, 0.7, 2.5, 6.5), ("id", "social", 0.35, 0.9, 1.2, 4.0),
    ("vn", "health", 0.25, 0.7, 3.0, 7.5), ("vn", "productivity", 0.35, 0.9, 3.5, 8.5), ("vn", "finance", 0.55, 1.4, 5.5, 16.0), ("vn", "lifestyle", 0.2, 0.6, 2.2, 5.5), ("vn", "social", 0.3, 0.8, 1.0, 3.5),
    ("th", "health", 0.4, 1.0, 4.5, 9.5), ("th", "productivity", 0.5, 1.2, 5.0, 11.0), ("th", "finance", 0.7, 1.8, 7.5, 20.0), ("th", "lifestyle", 0.3, 0.85, 3.0, 7.5), ("th", "social", 0.45, 1.1, 1.5, 4.5),
    ("my", "health", 0.45, 1.1, 5.0, 10.5), ("my", "productivity", 0.55, 1.3, 5.5, 12.0), ("my", "finance", 0.8, 2.0, 8.5, 22.0), ("my", "lifestyle", 0.35, 0.95, 3.5, 8.0), ("my", "social", 0.5, 1.2, 1.8, 5.0),
    ("ph", "health", 0.3, 0.8, 3.0, 7.0), ("ph", "productivity", 0.35, 0.95, 3.5, 8.0), ("ph", "finance", 0.5, 1.3, 5.0, 14.0), ("ph", "lifestyle", 0.22, 0.65, 2.2, 5.5), ("ph", "social", 0.3, 0.8, 1.1, 3.5),
    ("bd", "health", 0.18, 0.55, 2.0, 5.5), ("bd", "productivity", 0.22, 0.65, 2.5, 6.0), ("bd", "finance", 0.4, 1.1, 4.5, 13.0), ("bd", "lifestyle", 0.15, 0.5, 1.8, 4.5), ("bd", "social", 0.25, 0.7, 0.9, 3.0),
)
# How stored signals name the cell or the market that they are of, around {market} and {store}.
CELL_TAG = ("pathc-v3-", "-", "-tg")
MARKET_TAG = "v1.0.0-apptweak-"
# What an opportunity may name.
OPPORTUNITY_MARKETS = ("us", "jp", "kr", "de", "fr", "br", "es", "mx", "id", "vn", "th", "my", "ph", "bd")
OPPORTUNITY_CATEGORIES = ("health", "productivity", "games", "lifestyle", "social", "utilities", "education", "finance", "shopping", "entertainment")
