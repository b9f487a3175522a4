"""Fixed values of the domain. Operators take them as parameter defaults."""

from __future__ import annotations

# --- fixed values: date formats and texts that mean "no date" ---
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMMM yyyy",
    "MMM yyyy",
)
DATE_SENTINELS = ("", "not released", "not_released", "coming soon", "coming_soon", "unknown")
UNRELEASED = ("not released", "coming soon")

# --- fixed values: allowed languages ---
LANGUAGES = (
    "afrikaans",
    "albanian",
    "amharic",
    "arabic",
    "armenian",
    "assamese",
    "azerbaijani",
    "bangla",
    "basque",
    "belarusian",
    "bosnian",
    "bulgarian",
    "catalan",
    "cherokee",
    "chinese_simplified",
    "chinese_traditional",
    "croatian",
    "czech",
    "danish",
    "dari",
    "dutch",
    "english",
    "estonian",
    "filipino",
    "finnish",
    "french",
    "galician",
    "georgian",
    "german",
    "greek",
    "gujarati",
    "hausa",
    "hebrew",
    "hindi",
    "hungarian",
    "icelandic",
    "igbo",
    "indonesian",
    "irish",
    "italian",
    "japanese",
    "kannada",
    "kazakh",
    "khmer",
    "kinyarwanda",
    "konkani",
    "korean",
    "kyrgyz",
    "latvian",
    "lithuanian",
    "luxembourgish",
    "macedonian",
    "malay",
    "malayalam",
    "maltese",
    "maori",
    "marathi",
    "mongolian",
    "nepali",
    "norwegian",
    "odia",
    "persian",
    "polish",
    "portuguese_brazil",
    "portuguese_portugal",
    "punjabi_gurmukhi",
    "punjabi_shahmukhi",
    "quechua",
    "romanian",
    "russian",
    "scots",
    "serbian",
    "sindhi",
    "sinhala",
    "slovak",
    "slovenian",
    "sorani",
    "sotho",
    "spanish_latin_america",
    "spanish_spain",
    "swahili",
    "swedish",
    "tajik",
    "tamil",
    "tatar",
    "telugu",
    "thai",
    "tigrinya",
    "tswana",
    "turkish",
    "turkmen",
    "ukrainian",
    "urdu",
    "uyghur",
    "uzbek",
    "valencian",
    "vietnamese",
    "welsh",
    "wolof",
    "xhosa",
    "yoruba",
    "zulu",
)

# --- fixed values: tag spellings ---
TAG_FIXES = {
    "base building": "base-building",
    "dystopian ": "dystopian",
    "parody ": "parody",
    "puzzle-platformer": "puzzle platformer",
    "rogue-like": "roguelike",
    "rogue-lite": "roguelite",
}

# --- fixed values: owner estimate ---
OWNERS_PER_REVIEW = 80
LARGE_REVIEWS = 100_000
LARGE_REVIEWS_FACTOR = 0.75
REVIEW_INFLATION = {2013: 79, 2014: 72, 2015: 62, 2016: 52, 2017: 43, 2018: 38, 2019: 36}  # out of 80
REVIEW_INFLATION_AFTER_2020 = 31
COMMITMENT = (1.0, 2.0, 0.2)  # a + b * exp(-c * price)

# --- fixed values: revenue per user ---
DISCOUNT = (0.5, 0.3)  # a * exp(-dislike^2 * age) + b
DISCOUNT_WITHOUT_AGE = (0.8, 0.3)  # a - b * dislike^2
FREE_TO_PLAY_CURVE = (1.25, 0.6, 0.74, 2.0)  # a + (b - a) / (1 + (age / c)^d)
TAG_DECAY = 0.25
TAG_VALUES = {
    "battle royale": 3.0,
    "card battler": 3.0,
    "card game": 3.0,
    "casual": -0.5,
    "character action game": 0.5,
    "character customization": 1.0,
    "competitive": 2.0,
    "cozy": -0.5,
    "deckbuilding": 0.5,
    "e-sports": 3.0,
    "esports": 3.0,
    "gambling": 4.0,
    "games workshop": -0.25,
    "indie": -0.25,
    "loot": 0.5,
    "looter shooter": 0.5,
    "massively multiplayer": 3.0,
    "mmorpg": 3.0,
    "moba": 3.0,
    "mod": -0.25,
    "moddable": -0.25,
    "multiplayer": 1.5,
    "puzzle": 0.5,
    "pvp": 3.0,
    "rpg": 0.5,
}

# --- fixed values: ordinal codes and labels ---
DIFFICULTY_CODES = {
    "simple": 0,
    "simple-easy": 1,
    "easy": 2,
    "easy-just right": 3,
    "just right": 4,
    "just right-tough": 5,
    "tough": 6,
    "tough-unforgiving": 7,
    "unforgiving": 8,
}
CONTROLLER_CODES = {"full": 1.0, "partial": 0.5, "none": 0.0}
CONTROLLER_LABELS = {"unknown": "unknown", "partial": "2. Partial", "full": "3. Full", "none": "1. None"}

# --- fixed values: bins ---
REVIEW_BIN_EDGES = (float("-inf"), 50, 100, 250, 500, 1000, 2500, 5000, float("inf"))
PRICE_BRACKETS = (("Free", None), ("<10", 5), ("5-10", 10), ("10-20", 20), ("20-40", 40), ("40-60", 60), ("60-80", 80), ("80+", None))
PRICE_RATIO_EDGES = (-0.001, 0.001, 1, 5, 10, 20, 30, 45, 60, float("inf"))
PRICE_RATIO_LABELS = ("0", "0.01-1", "1-5", "5-10", "10-20", "20-30", "30-45", "45-60", "60+")
COMMON_PRICE_SEGMENTS = ((0.0, 2.0, 0.1), (2.0, 5.0, 0.25), (5.0, 15.0, 0.5))  # (from, to, width); width 1 after
STEP_ROUNDING = ((100, 10), (500, 50), (1000, 100), (2000, 250), (5000, 500), (10000, 1000), (float("inf"), 5000))

# --- fixed values: significance thresholds ---
P_LEVELS = ((0.05, "significant"), (0.1, "potentially significant"))
ETA_LEVELS = ((0.14, "strong"), (0.06, "moderate"), (0.01, "weak"))
F2_LEVELS = ((0.35, "large"), (0.15, "moderate"), (0.02, "small"))
R2_STRICT_LEVELS = ((0.5, "strong"), (0.25, "moderate"), (0.05, "weak"))

# --- fixed values: columns unknown before release, dropped before modelling ---
LEAKAGE = (
    "achievements_count",
    "appid",
    "average_non_steam_review_score",
    "developers",
    "dlc_count",
    "estimated_gross_revenue_boxleiter",
    "estimated_ltarpu",
    "estimated_owners_boxleiter",
    "name",
    "peak_ccu",
    "playtime_avg",
    "playtime_avg_2_weeks",
    "playtime_median",
    "playtime_median_2_weeks",
    "price_latest",
    "publishers",
    "recommendations",
    "steam_negative_reviews",
    "steam_positive_review_ratio",
    "steam_positive_reviews",
    "steam_total_reviews",
    "~tag_masterpiece",
    "~tag_cult classic",
)
