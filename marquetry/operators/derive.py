"""Business metrics derived from merged records, and the whole cleaning step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions import metrics as M
from marquetry.functions import parsing as P
from marquetry.operators.mapping import enforce_schema


def review_totals(df: DataFrame, pos: str, neg: str, total: str, ratio: str) -> DataFrame:
    t, r = M.total_and_ratio(pos, neg)
    return df.withColumns({total: t, ratio: r})


def backfill_max(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Where ``target`` is null or 0: the largest of all prices of the row."""
    t = P.to_double(target)
    return df.withColumn(target, F.when(t.isNull() | (t == 0), P.row_max(*cols)).otherwise(t))


def free_flags(
    df: DataFrame,
    genres: str = "genres",
    tags: str = "tags",
    free: str = "is_free",
    original: str = "price_original",
    latest: str = "price_latest",
    token: str = "free to play",
) -> DataFrame:
    """Settle ``is_free`` / ``is_f2p`` and zero the prices of free-to-play titles, in that order."""
    f2p = F.array_contains(genres, token) | F.array_contains(tags, token)
    f2p = F.coalesce(f2p, F.lit(False))
    priced = F.coalesce((F.col(original) > 0) & (F.col(latest) > 0), F.lit(False))
    settled = F.when(~f2p & priced, F.lit(False)).otherwise(F.col(free))
    step = df.withColumns({free: settled, "is_f2p": f2p & ~F.coalesce(settled, F.lit(False))})
    return step.withColumns({p: F.when(F.col("is_f2p"), F.lit(0.0)).otherwise(F.col(p)) for p in (latest, original)})


def date_parts(df: DataFrame, col: str, prefix: str = "release_") -> DataFrame:
    return df.withColumns(
        {f"{prefix}year": F.year(col), f"{prefix}month": F.month(col), f"{prefix}day_of_month": F.dayofmonth(col)}
    )


def estimate_revenue(
    df: DataFrame,
    as_of: date,
    reviews: str = "steam_total_reviews",
    negative: str = "steam_negative_reviews",
    year: str = "release_year",
    released: str = "release_date",
    price: str = "price_original",
    model: str = "monetization_model",
    tags: str = "tags",
    tag_values: Mapping[str, float] = K.TAG_VALUES,
) -> DataFrame:
    """Owner estimate, lifetime revenue per user and gross revenue; one projection, no shuffle."""
    owners = M.estimate_owners(F.col(reviews), F.col(year), F.col(price))
    age = M.years_since(released, as_of)
    discount = M.discount_factor(M.dislike_squared(F.col(negative), F.col(reviews)), age)
    per_user = M.revenue_per_user(F.col(model), F.col(price), discount, age, M.decayed_score(F.col(tags), tag_values))
    step = df.withColumns({"estimated_owners_boxleiter": owners, "estimated_ltarpu": per_user})
    gross = F.bround(F.col("estimated_owners_boxleiter") * F.col("estimated_ltarpu")).cast("bigint")
    return step.withColumn("estimated_gross_revenue_boxleiter", gross)


def require(df: DataFrame, all_of: Sequence[str] = (), any_of_groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Rows with every column of ``all_of`` and at least one column of each group."""
    for c in all_of:
        df = df.where(F.col(c).isNotNull())
    for group in any_of_groups:
        df = df.where(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in group]).isNotNull())
    return df


# --- fixed values: renames, averaged groups and price recency of the merged catalog ---
RENAMES = {
    "achievements": "achievements_count",
    "average_playtime_forever": "playtime_avg",
    "average_playtime_2weeks": "playtime_avg_2_weeks",
    "median_playtime_forever": "playtime_median",
    "median_playtime_2weeks": "playtime_median_2_weeks",
    "supported_languages": "languages_supported",
    "full_audio_languages": "languages_with_full_audio",
    "linux": "runs_on_linux",
    "mac": "runs_on_mac",
    "windows": "runs_on_windows",
    "steam_deck": "runs_on_steam_deck",
    "screenshots": "steam_store_screenshot_count",
    "movies": "steam_store_movie_count",
    "negative": "steam_negative_reviews",
    "positive": "steam_positive_reviews",
}
DURATION_COLUMNS = (
    "gamefaqs_game_length",
    "hltb_single",
    "hltb_complete",
    "igdb_complete",
    "igdb_single",
    "hltb_main_story",
    "hltb_main_plus_extras",
    "hltb_completionist",
)
RATING_SCALES = {"gamefaqs_review_score": 5, "igdb_review_score": 100, "metacritic_score": 100}
DATED_PRICES = ("price_2024_09", "price_2024_08", "price_2024_05", "price_2023_11", "price_2019_06")
UNUSED = (
    "num_reviews_recent",
    "num_reviews_total",
    "pct_pos_recent",
    "pct_pos_total",
    "estimated_owners",
    "steam_spy_estimated_owners",
)

_LISTS = ("categories", "developers", "genres", "publishers", "tags")
_LANGUAGE_LISTS = ("languages_supported", "languages_with_full_audio")
_LONGS = (
    "achievements_count",
    "dlc_count",
    "estimated_owners_boxleiter",
    "estimated_gross_revenue_boxleiter",
    "peak_ccu",
    "recommendations",
    "release_year",
    "required_age",
    "steam_negative_reviews",
    "steam_positive_reviews",
    "steam_total_reviews",
    "steam_store_movie_count",
    "steam_store_screenshot_count",
)
_DOUBLES = (
    "average_non_steam_review_score",
    "average_time_to_beat",
    "estimated_ltarpu",
    "playtime_avg",
    "playtime_avg_2_weeks",
    "playtime_median",
    "playtime_median_2_weeks",
    "price_latest",
    "price_original",
    "steam_positive_review_ratio",
)
_BOOLEANS = (
    "early_access",
    "has_demos",
    "has_drm",
    "runs_on_linux",
    "runs_on_mac",
    "runs_on_steam_deck",
    "runs_on_windows",
    "vr_only",
    "vr_supported",
)
_TEXTS = ("controller_support", "gamefaqs_difficulty_rating", "monetization_model", "name")


def catalog_contract(list_text: Sequence[str] = ()) -> dict:
    """Coercer per catalog column; ``list_text`` names list columns still held as text."""
    contract: dict = {}
    for c in _LISTS:
        contract[c] = lambda col, t=c in list_text: P.normalize_list(col, is_text=t)
    for c in _LANGUAGE_LISTS:
        contract[c] = lambda col, t=c in list_text: P.normalize_vocab(col, is_text=t)
    contract.update({c: P.to_long for c in _LONGS})
    contract.update({c: P.to_double for c in _DOUBLES})
    contract.update({c: P.to_bool for c in _BOOLEANS})
    contract.update({c: P.to_text for c in _TEXTS})
    contract["release_date"] = P.to_date
    return dict(sorted(contract.items()))


def _text_lists(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [c for c in cols if types.get(c) == "string"]


def preprocess(df: DataFrame, as_of: date, on_bad_date: str = "raise") -> tuple[DataFrame, dict[str, list[str]]]:
    """Merged catalog -> typed, cleaned records with derived metrics, before duplicates are collapsed.

    All of it is narrow: one scan, no shuffle. Columns a source did not bring are skipped.
    """
    have = set(df.columns)
    df = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in have})
    durations = [c for c in DURATION_COLUMNS if c in have]
    ratings = {c: k for c, k in RATING_SCALES.items() if c in have}
    if durations:
        df = df.withColumn("average_time_to_beat", P.row_mean(*durations)).drop(*durations)
    if ratings:
        scaled = [P.to_double(c) / F.lit(float(k)) for c, k in ratings.items()]
        df = df.withColumn("average_non_steam_review_score", P.row_mean(*scaled)).drop(*ratings)
    df = df.drop(*UNUSED)

    dated = [c for c in DATED_PRICES if c in have]
    df = df.withColumns({c: P.to_double(c) for c in [*dated, "price_original"]})
    df = backfill_max(df, "price_original", [*dated, "price_original"])
    df = df.withColumn("price_latest", P.first_non_null(*dated, "price_original")).drop(*dated)

    text = _text_lists(df, ("genres", "tags"))
    df = df.withColumns({c: P.normalize_list(c, is_text=c in text) for c in ("genres", "tags")})
    df = df.withColumn("is_free", P.to_bool("is_free")) if "is_free" in have else df.withColumn("is_free", F.lit(None).cast("boolean"))
    df = free_flags(df)
    latest, original = P.cross_fill("price_latest", "price_original")
    df = df.withColumns({"price_latest": latest, "price_original": original})
    df = df.withColumn("tags", P.replace_in_list("tags", K.TAG_FIXES))

    df = df.withColumn("release_date", P.parse_date("release_date", on_error=on_bad_date))
    df = df.withColumn("release_year", F.year("release_date"))
    df = df.withColumns({c: P.to_long(c) for c in ("steam_positive_reviews", "steam_negative_reviews")})
    df = review_totals(
        df, "steam_positive_reviews", "steam_negative_reviews", "steam_total_reviews", "steam_positive_review_ratio"
    )
    model = M.monetization_model(F.col("is_f2p"), F.col("is_free"), F.col("price_original"), F.col("price_latest"))
    df = df.withColumn("monetization_model", model).drop("is_free", "is_f2p")
    df = estimate_revenue(df, as_of)
    return enforce_schema(df, catalog_contract(_text_lists(df, _LISTS + _LANGUAGE_LISTS)))


def dense(df: DataFrame) -> DataFrame:
    """The catalog's dense variant: reviews known, some price information, some platform information."""
    return require(
        df,
        ["steam_positive_reviews"],
        [
            ["price_original", "price_latest", "monetization_model"],
            ["runs_on_linux", "runs_on_mac", "runs_on_steam_deck", "runs_on_windows"],
        ],
    )
