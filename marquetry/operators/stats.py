"""Significance and effect sizes from aggregated moments.

Every statistic needs only sums per group, computed in one pass with map-side combine; the closed
forms and p-values run on the handful of aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions.metrics import level
from marquetry.functions.pvalues import f_pvalue, t_pvalue
from marquetry.functions.tails import f_tail, t_two_sided
from marquetry.plans.quantiles import exact_quantiles
from marquetry.plans.skew import attach_group_stats, null_safe, with_scalars


def adjust_for_group(df: DataFrame, metric: str, group: str, out: str | None = None, max_groups: int | None = None) -> DataFrame:
    """z-score within the group, re-projected on the overall mean and deviation; sd 0 or null -> null."""
    x = F.col(metric).cast("double")
    stats = df.groupBy(group).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_sd"), F.count(F.lit(1)).alias("_w"))
    overall = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    rows = attach_group_stats(df, stats, [group], "_w", max_groups)
    z = F.try_divide(x - F.col("_m"), F.col("_sd"))
    rows = with_scalars(rows, overall, "_o")
    return rows.withColumn(out or metric, z * F.col("_o.sd") + F.col("_o.m")).drop("_m", "_sd", "_w", "_o")


# -- one-way analysis of variance ---------------------------------------------------


def anova(df: DataFrame, num: str, cat: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """F, p and eta squared of ``num`` across the categories; one row per ``by``. Needs two groups."""
    rows = df.select(*by, F.col(num).cast("double").alias("_y"), F.col(cat).alias("_c")).dropna(subset=["_y", "_c"])
    groups = rows.groupBy(*by, "_c").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.var_samp("_y").alias("v")
    )
    # between = sum n m^2 - N M^2, written around the first moments to keep digits
    first = groups.groupBy(*by).agg(
        F.sum("n").alias("_total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean")
    )
    if by:
        same = null_safe(by, "g", "f")  # a null in ``by`` is a group of its own
        joined = groups.alias("g").join(first.alias("f"), same).select("g.*", "f._total", "f._mean")
    else:
        joined = with_scalars(groups, first).select("*", "_s._total", "_s._mean")
    sums = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.first("_total").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ss_within"),
    )
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    ready = sums.where("groups >= 2")
    f_stat = F.try_divide(F.try_divide(F.col("ss_between"), df1), F.try_divide(F.col("ss_within"), df2))
    out = ready.select(
        *by, "groups", "n", "ss_between", "ss_within", f_stat.alias("f_stat"),
        F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_squared"),
    )
    if p_value:
        out = out.withColumn("p_value", f_pvalue("f_stat", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")))
    return out


# -- Welch's t-test -----------------------------------------------------------------


def welch_ttest(df: DataFrame, num: str, cat: str, p_value: bool = True) -> DataFrame:
    """Welch's t, p, r squared and Cohen's d of two groups (in label order).

    The job fails unless there are exactly two groups; fewer than two rows or no variance in a
    group give null statistics.
    """
    rows = df.select(F.col(num).cast("double").alias("y"), F.col(cat).cast("string").alias("g")).dropna()
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    count = groups.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    ends = groups.agg(
        F.min(F.struct("g", "n", "m", "v")).alias("a"), F.max(F.struct("g", "n", "m", "v")).alias("b"), F.count(F.lit(1)).alias("k")
    )
    wrong = F.raise_error(F.concat(F.lit("need exactly 2 groups, found "), count.cast("string"))).cast("boolean")
    ends = ends.where(F.when(F.col("k") == 2, F.lit(True)).otherwise(wrong))
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("a.n", "b.n", "a.m", "b.m", "a.v", "b.v"))
    sound = (n1 >= 2) & (n2 >= 2) & (F.sqrt(v1) >= 1e-10) & (F.sqrt(v2) >= 1e-10)
    e1, e2 = v1 / n1, v2 / n2
    t = (m1 - m2) / F.sqrt(e1 + e2)
    dof = F.pow(e1 + e2, 2) / (F.pow(e1, 2) / (n1 - 1) + F.pow(e2, 2) / (n2 - 1))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    out = ends.select(
        F.col("a.g").alias("group_1"), F.col("b.g").alias("group_2"),
        F.when(sound, t).alias("t_stat"), F.when(sound, dof).alias("dof"),
        F.when(sound, t * t / (t * t + n1 + n2 - 2)).alias("r_squared"), F.when(sound, (m1 - m2) / pooled).alias("cohen_d"),
    )
    return out.withColumn("p_value", t_pvalue("t_stat", "dof")) if p_value else out


# -- polynomial regression ----------------------------------------------------------


def moment_sums(x: Column, y: Column, degree: int) -> list[Column]:
    """Power sums that determine a least-squares polynomial of the given degree."""
    sums = [F.sum(F.pow(x, k)).alias(f"x{k}") for k in range(0, 2 * degree + 1)]
    sums += [F.sum(F.pow(x, k) * y).alias(f"xy{k}") for k in range(0, degree + 1)]
    return sums + [F.sum(y * y).alias("yy")]


def _solve(row: dict, degree: int) -> dict:
    """Least squares on standardised x; coefficients are returned on the original scale, constant first."""
    n = row["n"]
    gram = np.array([[row[f"x{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    rhs = np.array([row[f"xy{i}"] for i in range(degree + 1)])
    beta, *_ = np.linalg.lstsq(gram, rhs, rcond=None)
    # y is centred, so its total sum of squares is yy
    sst = row["yy"] - row["xy0"] ** 2 / n
    sse = max(float(row["yy"] - beta @ rhs), 0.0)
    r2 = 1.0 - sse / sst if sst > 0 else np.nan
    dof = n - degree - 1
    mean_x, sd_x = row["mx"], row["sx"] if row["sx"] and row["sx"] > 0 else 1.0
    # z = (x - mean) / sd expands z^k into powers of x
    expand = np.zeros((degree + 1, degree + 1))
    poly = np.array([1.0])
    for k in range(degree + 1):
        expand[: k + 1, k] = poly
        poly = np.convolve(poly, [-mean_x / sd_x, 1.0 / sd_x])
    coef = expand @ beta
    coef[0] += row["my"]
    try:
        cov = expand @ np.linalg.inv(gram) @ expand.T
        se = np.sqrt(np.clip(np.diag(cov), 0, None) * sse / dof) if dof > 0 else np.full(degree + 1, np.nan)
    except np.linalg.LinAlgError:
        se = np.full(degree + 1, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
        f_stat = (sst - sse) / degree / (sse / dof) if dof > 0 and sse > 0 else np.inf if dof > 0 else np.nan
    return {
        "n": int(n), "coefficients": coef.tolist(), "r_squared": float(r2),
        "p_values": [t_two_sided(float(v), dof) if dof > 0 else np.nan for v in t],
        "f_p_value": f_tail(float(f_stat), degree, dof) if dof > 0 else np.nan,
        "cohen_f2": float(r2 / (1 - r2)) if r2 != 1 else np.inf,
    }


def poly_regression(
    df: DataFrame, x: str, y: str, degree: int | dict[str, int] = 1, by: Sequence[str] = (), max_groups: int | None = None
) -> DataFrame:
    """Coefficients (constant first), R squared, p-values and Cohen's f squared per group.

    ``degree`` may differ by the value of the first grouping column.
    Pass 1 finds the means, pass 2 the power sums around them; the (degree + 1) x (degree + 1) system
    of each aggregated row is solved in an Arrow batch.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    rows = rows.where(~F.isnan("_x") & ~F.isnan("_y"))
    means = [F.avg("_x").alias("mx"), F.stddev_pop("_x").alias("sx"), F.avg("_y").alias("my"), F.count(F.lit(1)).alias("n")]
    if by:
        centred = attach_group_stats(rows, rows.groupBy(*by).agg(*means), by, "n", max_groups)
    else:
        centred = with_scalars(rows, rows.agg(*means)).select("_x", "_y", "_s.*")
    top = max(degree.values()) if isinstance(degree, dict) else degree
    z = (F.col("_x") - F.col("mx")) / F.when(F.col("sx") > 0, F.col("sx")).otherwise(1.0)
    sums = centred.groupBy(*by, "mx", "sx", "my", "n").agg(*moment_sums(z, F.col("_y") - F.col("my"), top))

    def solve(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            solved = [_solve(r, degree[r[by[0]]] if isinstance(degree, dict) else degree) for r in rows]
            yield pd.concat([pdf[by].reset_index(drop=True), pd.DataFrame(solved, columns=list(_RESULT))], axis=1)

    lead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    schema = ", ".join([p for p in (lead, ", ".join(f"{k} {t}" for k, t in _RESULT.items())) if p])
    return sums.mapInPandas(solve, schema)


_RESULT = {
    "n": "bigint", "coefficients": "array<double>", "r_squared": "double",
    "p_values": "array<double>", "f_p_value": "double", "cohen_f2": "double",
}


def trend(df: DataFrame, x: str, y: str, degree: int = 2) -> DataFrame:
    """Fitted value of a least-squares polynomial at every x of an aggregated series."""
    fit = poly_regression(df, x, y, degree).select("coefficients").scalar()
    value = reduce(lambda acc, k: acc + F.get(F.col("_c"), F.lit(k)) * F.pow(F.col(x).cast("double"), k), range(degree + 1), F.lit(0.0))
    return df.withColumn("_c", fit).withColumn("trend", value).drop("_c")


# -- factor analysis ----------------------------------------------------------------


@dataclass(frozen=True)
class Factor:
    """One candidate explanation of a metric.

    ``value`` is a column or expression; ``where`` keeps the rows to look at; ``trim`` cuts the factor's
    own tails by quantile (numeric factors). ``degree`` is the polynomial degree of the fit.
    """

    name: str
    value: Column
    where: Column | None = None
    degree: int = 1
    trim: tuple[float, float] | None = None
    labels: dict = field(default_factory=dict)


def _verdicts(p: Column, strength: Column) -> dict[str, Column]:
    return {"significance": level(p, K.P_LEVELS, "not significant", ascending=True), "strength": strength}


def numeric_factors(df: DataFrame, metric: str, factors: Sequence[Factor]) -> DataFrame:
    """Fit every numeric factor in long form, those of equal trims together; verdicts by p, f squared and R squared."""

    def long(chosen: Sequence[Factor]) -> DataFrame:
        """Only what is asked for is laid out: the quantiles of a trim read their rows several times."""
        items = []
        for f in chosen:
            x = f.value.cast("double")
            items.append(F.struct(F.lit(f.name).alias("factor"), (F.when(f.where, x) if f.where is not None else x).alias("x")))
        out = df.select(F.col(metric).cast("double").alias("y"), F.explode(F.array(*items)).alias("_f"))
        return out.select("y", "_f.factor", "_f.x").where(F.col("x").isNotNull() & F.col("y").isNotNull())

    parts = []
    plain = [f for f in factors if f.trim is None]
    if plain:
        parts.append(long(plain))
    for limits in sorted({f.trim for f in factors if f.trim}):
        own = [f for f in factors if f.trim == limits]
        chosen = long(own)
        bounds = exact_quantiles(chosen, "x", {"lo": limits[0], "hi": limits[1]}, ["factor"], len(own), count_as="_w")
        kept = attach_group_stats(chosen, bounds, ["factor"], "_w", len(own)).where(F.col("x").between(F.col("lo"), F.col("hi")))
        parts.append(kept.select("y", "factor", "x"))
    rows = reduce(DataFrame.unionByName, parts)
    result = poly_regression(rows, "x", "y", {f.name: f.degree for f in factors}, ["factor"], len(factors))
    p, r2, f2 = F.round("f_p_value", 3), F.round("r_squared", 3), F.col("cohen_f2")
    strict = (p < 0.1) & (f2 >= 0.15)
    strength = F.when(strict, level(r2, K.R2_STRICT_LEVELS, "negligible")).otherwise(level(r2, K.ETA_LEVELS, "negligible"))
    return result.select(
        "factor", "n", r2.alias("variance_explained"), p.alias("p_value"), F.lit("numeric").alias("kind"),
        level(f2, K.F2_LEVELS, "negligible").alias("effect_size"),
        *[c.alias(k) for k, c in _verdicts(p, strength).items()],
    )


def categorical_factors(
    df: DataFrame, metric: str, factors: Sequence[Factor], year: str | None = "release_year",
    dropna: bool = True, max_years: int | None = None,
) -> DataFrame:
    """Analyse every categorical factor in one long-form pass, adjusted for yearly trends if ``year``.

    ``dropna=False`` keeps rows without a category as "unknown".
    """
    items = []
    for f in factors:
        label = f.value.cast("string")
        if not dropna:
            label = F.coalesce(label, F.lit("unknown"))
        items.append(F.struct(F.lit(f.name).alias("factor"), (F.when(f.where, label) if f.where is not None else label).alias("label")))
    lead = [year] if year else []
    long = df.select(*lead, F.col(metric).cast("double").alias("y"), F.explode(F.array(*items)).alias("_f"))
    long = long.select(*lead, "y", "_f.factor", "_f.label").where(F.col("label").isNotNull() & F.col("y").isNotNull())
    if year:
        n = len(factors)
        per_year = long.groupBy("factor", year).agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_sd"), F.count(F.lit(1)).alias("_w"))
        overall = long.groupBy("factor").agg(F.avg("y").alias("_om"), F.stddev_samp("y").alias("_osd"), F.count(F.lit(1)).alias("_ow"))
        # a stated number of years per factor is checked at run time
        long = attach_group_stats(long, per_year, ["factor", year], "_w", max_years and max_years * n)
        long = attach_group_stats(long, overall, ["factor"], "_ow", n)
        z = F.try_divide(F.col("y") - F.col("_m"), F.col("_sd"))
        long = long.select("factor", "label", (z * F.col("_osd") + F.col("_om")).alias("y"))
    result = anova(long, "y", "label", ["factor"])
    p, eta = F.round("p_value", 3), F.round("eta_squared", 3)
    strength = level(eta, K.ETA_LEVELS, "negligible")
    return result.select(
        "factor", "n", eta.alias("variance_explained"), p.alias("p_value"), F.lit("categorical").alias("kind"),
        F.lit(None).cast("string").alias("effect_size"), *[c.alias(k) for k, c in _verdicts(p, strength).items()],
    )


def factor_battery(
    df: DataFrame, metric: str, numeric: Sequence[Factor], categorical: Sequence[Factor], year: str | None = "release_year"
) -> DataFrame:
    """All factors, numeric and categorical; order with ``reports.rank_factors``."""
    parts = []
    if numeric:
        parts.append(numeric_factors(df, metric, numeric))
    if categorical:
        parts.append(categorical_factors(df, metric, categorical, year))
    return reduce(DataFrame.unionByName, parts)


def catalog_factors() -> tuple[list[Factor], list[Factor]]:
    """The catalog's own battery: numeric and categorical factors with their row filters."""
    c = F.col
    rated = (c("steam_total_reviews") >= 10) & (c("steam_positive_review_ratio") > 0)
    audio, languages = F.size("languages_with_full_audio"), F.size("languages_supported")
    difficulty = {k.title(): i + 1 for i, k in enumerate(K.DIFFICULTY_CODES)}
    numbered = F.create_map(*[F.lit(v) for k, i in difficulty.items() for v in (k, f"{i}. {k}")])
    controller = F.create_map(*[F.lit(v) for pair in K.CONTROLLER_LABELS.items() for v in pair])

    def known(name: str) -> Column:
        return F.coalesce(c(name).cast("string"), F.lit("unknown"))

    numeric = [
        Factor("achievements_count", c("achievements_count"), (c("achievements_count") > 0) & (c("achievements_count") < 100), 2),
        Factor("average_time_to_beat", c("average_time_to_beat"), trim=(0.01, 0.99)),
        Factor("languages_supported_count", languages, rated & (languages < 20)),
        Factor("languages_with_full_audio_count", audio, (audio > 0) & (audio < 20), 2),
        Factor("price_original", c("price_original"), rated & (c("price_original") > 0), trim=(0.01, 0.99)),
        Factor("steam_store_movie_count", c("steam_store_movie_count"), trim=(0.01, 0.99)),
        Factor("steam_store_screenshot_count", c("steam_store_screenshot_count"), degree=2, trim=(0.0, 0.99)),
        Factor("tags_count", F.size("tags")),
    ]
    plain = ("has_demos", "runs_on_linux", "runs_on_mac", "runs_on_steam_deck", "runs_on_windows", "vr_supported")
    categorical = [
        Factor("controller_support", F.try_element_at(controller, known("controller_support"))),
        Factor("early_access", known("early_access")),
        Factor(
            "gamefaqs_difficulty_rating",
            F.coalesce(F.try_element_at(numbered, c("gamefaqs_difficulty_rating")), F.when(c("gamefaqs_difficulty_rating").isNull(), "unknown")),
        ),
        *[Factor(name, c(name)) for name in plain],
    ]
    return numeric, categorical
