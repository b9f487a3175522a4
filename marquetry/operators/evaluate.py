"""Splits, scaling, blending and scoring of predictions, and what-if candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions.metrics import estimate_owners
from marquetry.functions.parsing import step_round
from marquetry.operators.filters import drop_top_k
from marquetry.operators.fuzzy import fuzzy_lookup
from marquetry.plans.quantiles import exact_quantiles
from marquetry.plans.skew import attach_group_stats, hash_fraction, scalar_row, with_scalars

# -- splits and samples -------------------------------------------------------------


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark rows ``is_test`` by a hash of the key: the same row always lands on the same side."""
    return df.withColumn("is_test", hash_fraction(seed, F.col(key)) < test)


def equal_width_stratum(df: DataFrame, col: str, bins: int = 10) -> Column:
    """Right-closed equal-width bin 0..bins-1 of ``col`` over its observed range."""
    s = scalar_row(df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    position = F.try_divide((F.col(col) - s["lo"]) * bins, s["hi"] - s["lo"])
    return F.greatest(F.least(F.ceil(position) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")


def _with_threshold(df: DataFrame, stratum: Column, key: str, p: float, bins: int, seed: int) -> DataFrame:
    rows = df.withColumn("_stratum", stratum).withColumns({"_h": hash_fraction(seed, F.col(key))})
    limits = exact_quantiles(rows, "_h", {"_limit": p}, ["_stratum"], max_groups=bins + 1, count_as="_w")
    return attach_group_stats(rows, limits, ["_stratum"], "_w", max_groups=bins + 1)


def stratified_split(df: DataFrame, stratum: Column, key: str, test: float = 0.2, seed: int = 42, bins: int = 10) -> DataFrame:
    """Mark ``is_test`` so that every stratum gives the same exact share.

    The cut is the exact quantile of a key hash per stratum, so no stratum is ranked in one task.
    """
    cut = _with_threshold(df, stratum, key, 1 - test, bins, seed)
    return cut.withColumn("is_test", F.col("_h") > F.col("_limit")).select(*df.columns, "is_test")


def stratified_sample(df: DataFrame, col: str, key: str, frac: float, seed: int = 42, bins: int = 10) -> DataFrame:
    """The share ``frac`` of every equal-width bin of ``col``."""
    cut = _with_threshold(df, equal_width_stratum(df, col, bins), key, frac, bins, seed)
    return cut.where(F.col("_h") <= F.col("_limit")).select(*df.columns)


def drop_extremes(df: DataFrame, col: str, key: str, above: float = 1, top_k: int = 25) -> DataFrame:
    return drop_top_k(df.where(F.col(col) > above), col, top_k, key)


# -- scaling ------------------------------------------------------------------------


def quantile_uniform(df: DataFrame, cols: Sequence[str], n: int = 1000, exact: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Map columns to [0, 1] by linear interpolation between ``n`` quantiles; ties take the middle.

    ``exact`` computes the landmarks exactly, which pays for small ``n``; otherwise they come from a
    sketch with relative rank error ``1 / accuracy``.
    """
    levels = [i / (n - 1) for i in range(n)]
    out = {}
    for c in cols:
        if exact:
            q = exact_quantiles(df, c, {f"q{i}": p for i, p in enumerate(levels)})
            marks = q.select(F.array(*[f"q{i}" for i in range(n)]).alias("q")).scalar()
        else:
            marks = df.agg(F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(p) for p in levels]), F.lit(accuracy)).alias("q")).scalar()
        df = df.withColumn(f"_q_{c}", marks)
        q, x = F.col(f"_q_{c}"), F.col(c).cast("double")
        lower = F.size(F.filter(q, lambda v: v < x))
        upper = F.size(F.filter(q, lambda v: v <= x))
        left, right = F.get(q, lower - 1), F.get(q, lower)
        between = lower - 1 + F.try_divide(x - left, right - left)
        position = F.when(lower == upper, between).otherwise((lower + upper - 1) / 2.0)
        unit = F.when(x <= F.get(q, F.lit(0)), 0.0).when(x >= F.get(q, F.lit(n - 1)), 1.0).otherwise(position / F.lit(n - 1.0))
        out[c] = unit
    return df.withColumns(out).drop(*[f"_q_{c}" for c in cols])


def standardize(train: DataFrame, valid: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Zero mean and unit deviation, both taken from ``train``."""
    moments = train.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("sd"))
    scaled = (F.col(col) - F.col("_s.m")) / F.when(F.col("_s.sd") > 0, F.col("_s.sd")).otherwise(1.0)
    return tuple(with_scalars(df, moments).withColumn(col, scaled).drop("_s") for df in (train, valid))


# -- scores -------------------------------------------------------------------------


def qwk_column(label: Column, pred: Column) -> Column:
    """Quadratic weighted kappa as one aggregate.

    With quadratic weights the observed and expected disagreement reduce to moments:
    1 - E[(l - p)^2] / (E[l^2] + E[p^2] - 2 E[l] E[p]).
    """
    l, p = label.cast("double"), pred.cast("double")
    expected = F.avg(l * l) + F.avg(p * p) - F.avg(l) * F.avg(p) * 2
    return F.lit(1.0) - F.try_divide(F.avg((l - p) * (l - p)), expected)


def qwk(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    return rows.groupBy(*by).agg(qwk_column(F.col(label), F.col(pred)).alias("qwk"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("count"))


def r2_column(label: Column, pred: Column) -> Column:
    e = label - pred
    return F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(label))


# -- blending -----------------------------------------------------------------------

EPSILON = 1e-12


def _sum(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _percentile(values: Sequence[Column], p: float) -> Column:
    """Linear-interpolated percentile of a fixed number of columns of one row."""
    ordered = F.array_sort(F.array(*values))
    position = p * (len(values) - 1)
    lo = int(position)
    hi = min(lo + 1, len(values) - 1)
    a, b = F.get(ordered, F.lit(lo)), F.get(ordered, F.lit(hi))
    return a + (b - a) * F.lit(position - lo)


def _blend(values: Sequence[Column], how: str, weights: Sequence[float] | None) -> Column:
    n = len(values)
    if how == "mean":
        return _sum(values) / n
    if how == "weighted":
        return _sum([v * F.lit(float(w)) for v, w in zip(values, weights)]) / F.lit(float(sum(weights)))
    if how == "median":
        return _percentile(values, 0.5)
    if how == "max":
        return F.greatest(*values)
    if how.startswith("p"):
        return _percentile(values, int(how[1:]) / 100)
    if how == "geometric":
        return F.exp(_sum([F.ln(v + EPSILON) for v in values]) / n)
    if how == "harmonic":
        return F.lit(float(n)) / _sum([F.lit(1.0) / (v + EPSILON) for v in values])
    if how == "trimmed":
        cut = n // 10
        kept = F.slice(F.array_sort(F.array(*values)), cut + 1, n - 2 * cut) if cut * 2 < n else F.array(*values)
        return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)
    raise ValueError(f"unknown blend {how!r}")


CLASS_BLENDS = ("mean", "weighted", "median", "p25", "p75", "geometric", "harmonic", "trimmed")
VALUE_BLENDS = ("mean", "median", "max", "p60", "p40")


def blend(df: DataFrame, prob_cols: Sequence[str], classes: int, how: str = "mean", weights: Sequence[float] | None = None, out: str = "blend") -> DataFrame:
    """Blend per-model probability arrays class by class, within the row; adds ``out`` and ``out_class``."""
    per_class = [
        _blend([F.get(F.col(c), F.lit(i)).cast("double") for c in prob_cols], how, weights) for i in range(classes)
    ]
    return df.withColumn(out, F.array(*per_class)).withColumn(f"{out}_class", argmax(F.col(out)))


def argmax(probabilities: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def normalized(probabilities: Column) -> Column:
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, v: a + v)
    return F.transform(probabilities, lambda v: F.try_divide(v, total))


def blend_values(df: DataFrame, pred_cols: Sequence[str], how: str = "mean", out: str = "blend") -> DataFrame:
    return df.withColumn(out, _blend([F.col(c).cast("double") for c in pred_cols], how, None))


def _subsets(models: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for r in range(2, len(models)) for c in combinations(models, r)]


def score_combinations(df: DataFrame, prob_cols: Sequence[str], classes: int, label: str, top: int = 10) -> DataFrame:
    """Kappa of the mean blend of every model subset of size 2..n-1, best first.

    Each row yields one predicted class per subset, and the kappa is a moment aggregate, so the shuffle
    carries one partial row per subset and task.
    """
    subsets = [
        F.struct(F.lit(" + ".join(names)).alias("models"), *[F.lit(1.0 if c in names else 0.0).alias(c) for c in prob_cols])
        for names in _subsets(prob_cols)
    ]
    # sums instead of means: the argmax of a subset is the same
    per_class = [_sum([F.get(F.col(c), F.lit(i)).cast("double") * F.col(f"_u.{c}") for c in prob_cols]) for i in range(classes)]
    long = df.select(label, *prob_cols, F.explode(F.array(*subsets)).alias("_u"))
    long = long.select(label, "_u.models", F.array(*per_class).alias("_sum"))
    long = long.select(label, "models", argmax(F.col("_sum")).alias("pred"))
    return qwk(long, label, "pred", ["models"]).orderBy(F.desc("qwk"), "models").limit(top)


def score_value_combinations(df: DataFrame, pred_cols: Sequence[str], label: str, top: int = 10) -> DataFrame:
    """R squared of the mean and median blend of every regressor subset of size 2..n-1, best first."""
    scored = []
    for names in _subsets(pred_cols):
        values = [F.col(c).cast("double") for c in names]
        for how in ("mean", "median"):
            scored.append(F.struct(F.lit(f"{how}: " + " + ".join(names)).alias("models"), _blend(values, how, None).alias("pred")))
    long = df.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*scored)).alias("_c"))
    result = long.groupBy("_c.models").agg(r2_column(F.col("y"), F.col("_c.pred")).alias("r2"))
    return result.orderBy(F.desc("r2"), "models").limit(top)


def expected_class(probabilities: Column) -> Column:
    weighted = F.transform(probabilities, lambda p, i: p * i)
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def class_labels(df: DataFrame, year: str, price: str, edges: Sequence[int] = (0, 50, 100, 250, 500, 1000, 2500, 5000), out: str = "labels") -> DataFrame:
    """Class labels in estimated owners for each row's year and price, e.g. ``4k - 8k``."""
    marks = F.array(*[F.lit(e) for e in edges])
    owners = F.transform(marks, lambda e: estimate_owners(e, F.col(year), F.col(price), open_start=True, min_reviews=0))
    rounded = F.transform(F.col("_owners"), lambda o: step_round(o, K.STEP_ROUNDING))
    df = df.withColumn("_owners", owners).withColumn("_owners", rounded)
    thousands = F.transform("_owners", lambda o: F.concat(F.bround(o / 1000.0).cast("bigint").cast("string"), F.lit("k")))
    df = df.withColumn("_k", thousands)
    last = len(edges) - 1

    def text(i: int) -> Column:
        lower = F.get("_k", F.lit(i))
        if i == last:
            return F.concat(F.lit(">= "), lower)
        upper = F.get("_k", F.lit(i + 1))
        return F.when(F.get("_owners", F.lit(i)) == 0, F.concat(F.lit("< "), upper)).otherwise(F.concat(lower, F.lit(" - "), upper))

    return df.withColumn(out, F.array(*[text(i) for i in range(len(edges))])).drop("_owners", "_k")


# -- candidates and what-if ---------------------------------------------------------


def parse_candidates(df: DataFrame, candidate: str, text: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``feature=value`` lines -> (valid settings, rejected settings with a reason).

    Flags (``~...``) must be 0 or 1, other values numbers, features known; the last line wins.
    """
    lines = df.select(candidate, F.posexplode(F.split(F.trim(text), "\n")).alias("pos", "line")).where(F.contains("line", F.lit("=")))
    parts = F.split("line", "=", 2)
    parsed = lines.select(
        candidate, "pos", F.trim(F.get(parts, F.lit(0))).alias("feature"), F.trim(F.get(parts, F.lit(1))).alias("raw")
    )
    flag = F.startswith("feature", F.lit("~"))
    value = F.when(flag, F.when(F.col("raw").isin("0", "1"), F.col("raw").try_cast("double"))).otherwise(F.col("raw").try_cast("double"))
    reason = (
        F.when(value.isNull() & flag, "must be 0 or 1")
        .when(value.isNull(), "must be a number")
        .when(~F.col("feature").isin(*features), "unknown feature")
    )
    judged = parsed.withColumns({"value": value, "reason": reason})
    valid = judged.where("reason is null").groupBy(candidate, "feature").agg(F.max_by("value", "pos").alias("value"))
    rejected = judged.where("reason is not null").select(candidate, "feature", "raw", "reason")
    return valid, rejected


def suggest_features(rejected: DataFrame, features: Sequence[str], k: int = 1) -> DataFrame:
    """Close names for the unknown features among rejected settings."""
    return fuzzy_lookup(rejected.where("reason = 'unknown feature'"), "feature", features, k)


def overlay(df: DataFrame, candidate: str, valid: DataFrame, baseline: DataFrame) -> DataFrame:
    """One full feature row per candidate: its own settings over the baseline row."""
    wide = valid.groupBy(candidate).pivot("feature", list(baseline.columns)).agg(F.first("value"))
    rows = with_scalars(df.select(candidate).distinct().join(wide, candidate, "left"), baseline, "_base")
    base = F.col("_base")
    return rows.select(
        candidate, *[F.coalesce(F.col(f"`{c}`"), base.getField(c).cast("double")).alias(c) for c in baseline.columns]
    )


# --- fixed values: values tried per feature ---
WHAT_IF_VALUES: dict[str, list[float]] = {
    "average_time_to_beat": [0, 5, 10, 20, 50, 100],
    "categories_count": [0, 1, 2, 3, 4, 5, 10, 15, 20],
    "controller_support": [-1, 0, 1],
    "early_access": [-1, 0, 1],
    "gamefaqs_difficulty_rating": [-1, 0, 1, 2, 3, 4, 5, 6, 7, 8],
    "genres_count": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    "has_demos": [-1, 0, 1],
    "languages_supported_count": [0, 1, 2, 3, 5, 10, 20],
    "languages_with_full_audio_count": [0, 1, 2, 3, 5, 10, 20],
    "monetization_model": [-1, 0, 1, 2],
    "price_original": [0.99, 1.99, 2.99, 4.99, 9.99, 14.99, 19.99, 24.99, 29.99, 49.99, 59.99, 79.99],
    "release_day_of_month": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31],
    "release_month": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
    "required_age": [0, 12, 13, 16, 18],
    "runs_on_linux": [-1, 0, 1],
    "runs_on_mac": [-1, 0, 1],
    "runs_on_steam_deck": [-1, 0, 1],
    "runs_on_windows": [-1, 0, 1],
    "steam_store_movie_count": [0, 1, 2, 3, 4, 5, 10, 20],
    "steam_store_screenshot_count": [0, 1, 2, 3, 4, 5, 10, 20, 30, 40, 50],
    "tags_count": [0, 1, 2, 3, 4, 5, 10, 20, 30, 37],
    "vr_only": [-1, 0, 1],
    "vr_supported": [-1, 0, 1],
}


def what_if_rows(
    candidates: DataFrame, candidate: str, tests: Mapping[str, Sequence[float]] = WHAT_IF_VALUES, baseline: DataFrame | None = None
) -> DataFrame:
    """Every changed version of every candidate (``change_feature``, ``change_value``).

    Changes are made inside the row: every flag flipped, every listed value tried and, with a baseline,
    every own setting taken back. Equal changes are tried once.
    """
    features = [c for c in candidates.columns if c != candidate]

    def change(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"))

    changes = [change(c, F.when(F.col(f"`{c}`") == 0, 1.0).otherwise(0.0)) for c in features if c.startswith("~")]
    changes += [change(c, F.lit(float(v))) for c, values in tests.items() if c in features for v in values]
    listed = F.array(*changes)
    rows = candidates
    if baseline is not None:
        rows = rows.withColumn("_b", scalar_row(baseline))
        base = {c: F.col("_b").getField(c).cast("double") for c in features}
        resets = [F.when(F.col(f"`{c}`").cast("double") != base[c], change(c, base[c])) for c in features]
        listed = F.concat(listed, F.filter(F.array(*resets), lambda x: x.isNotNull()))
    rows = rows.withColumn("_change", F.explode(F.array_distinct(listed)))
    values = [F.when(F.col("_change.feature") == c, F.col("_change.value")).otherwise(F.col(f"`{c}`").cast("double")).alias(c) for c in features]
    return rows.select(candidate, F.col("_change.feature").alias("change_feature"), F.col("_change.value").alias("change_value"), *values)
