"""Predictive power of every single column: boosted stumps for all columns at once.

A model of one column is a function of that column's bin. So all that boosting with squared loss ever asks of the rows is,
for each column, fold and bin, how many there are and the sums of the target and its square. One aggregate (map-side
combined, columns x folds x bins groups whatever the number of rows) gives these for all columns; the rounds of boosting and
the held-out scores are then computed from the sums, column by column in parallel, exactly as from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.plans.quantiles import melt
from marquetry.plans.skew import hash_fraction

BINS = 64


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """``column`` and ``edges``: at most ``bins - 1`` values of the column at about equal ranks, ascending."""
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    long = melt(df, cols).where("value is not null and not isnan(value)")
    return long.groupBy("column").agg(F.array_distinct(F.percentile_approx("value", points, F.lit(40 * bins))).alias("edges"))


def _bin(value: Column, edges: Column, bins: int) -> Column:
    """0 for a missing value, else 1 and the number of edges below the value, by bisection."""
    steps = [1 << i for i in reversed(range(max(bins - 1, 1).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        # get() is null beyond the end
        return F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at)

    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(below + 1)


def histograms(df: DataFrame, target: str, cols: Sequence[str], key: str, edges: DataFrame, folds: int, seed: int, bins: int) -> DataFrame:
    """``column``, ``fold``, ``bin``, ``n``, ``s``, ``q``: rows, sum of the target and of its square. Rows without a target are left out."""
    fold = F.floor(hash_fraction(seed, F.col(f"`{key}`")) * folds).cast("int")
    y = F.col(f"`{target}`").cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(fold.alias("_fold"), y.alias("_y"), *[F.col(f"`{c}`") for c in cols])
    long = melt(rows, cols, ["_fold", "_y"])
    met = long.join(F.broadcast(edges.withColumnRenamed("column", "_c")), F.col("column") == F.col("_c"), "left")
    met = met.select("column", F.col("_fold").alias("fold"), _bin(F.col("value"), F.col("edges"), bins).alias("bin"), "_y")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")]
    return met.groupBy("column", "fold", "bin").agg(*sums)


def boosted_r2(n: np.ndarray, s: np.ndarray, q: np.ndarray, rounds: int, rate: float) -> list[float]:
    """R squared on each fold of stumps boosted on the other folds; arrays of folds x bins."""
    out = []
    for fold in range(len(n)):
        rows, sums = n.sum(0) - n[fold], s.sum(0) - s[fold]
        held, spread = n[fold].sum(), q[fold].sum() - s[fold].sum() ** 2 / max(n[fold].sum(), 1)
        if not rows.sum() or held < 2 or spread <= 0:
            continue
        value = np.full(len(rows), sums.sum() / rows.sum())
        for _ in range(rounds):
            left, many = np.cumsum(sums - rows * value)[:-1], np.cumsum(rows)[:-1]
            right, others = (sums - rows * value).sum() - left, rows.sum() - many
            able = (many > 0) & (others > 0)
            if not able.any():
                break
            gain = np.where(able, left**2 / np.maximum(many, 1) + right**2 / np.maximum(others, 1), -1.0)
            at = int(np.argmax(gain))
            value[: at + 1] += rate * left[at] / many[at]
            value[at + 1 :] += rate * right[at] / others[at]
        errors = (q[fold] - 2 * value * s[fold] + value**2 * n[fold]).sum()
        out.append(1 - errors / spread)
    return out


def feature_power(
    df: DataFrame,
    target: str,
    cols: Sequence[str],
    key: str,
    max_iter: int = 10,
    folds: int = 5,
    seed: int = 42,
    bins: int = BINS,
    rate: float = 0.3,
    penalty: float = 0.1,
) -> DataFrame:
    """``feature``, ``r2`` and ``score`` (mean less ``penalty`` deviations) of boosted stumps on one column at a time, best first.

    Two aggregates over the rows, whatever the number of columns and rounds. Missing values are a bin of their own; folds
    depend on the key only. A fold with fewer than two rows or a constant target is left out; a column without a usable fold has 0.
    """
    found = histograms(df, target, cols, key, bin_edges(df, cols, bins), folds, seed, bins)

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((3, folds, bins + 1))
        sums[:, pdf["fold"], pdf["bin"]] = pdf[["n", "s", "q"]].to_numpy(dtype=float).T
        r2 = boosted_r2(*sums, max_iter, rate) or [0.0]
        mean, sd = float(np.mean(r2)), float(np.std(r2))
        return pd.DataFrame({"feature": [pdf["column"].iloc[0]], "r2": [mean], "score": [mean - penalty * sd]})

    out = found.groupBy("column").applyInPandas(scored, "feature string, r2 double, score double")
    return out.orderBy(F.desc("r2"), "feature")
