"""Row filters and the facts needed to offer them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.plans.quantiles import exact_quantiles
from marquetry.plans.skew import scalar_row, with_scalars


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Inclusive range; reaches the Parquet scan."""
    return df.where(F.col(col).between(lo, hi))


def has_item(df: DataFrame, col: str, value: str, all_token: str = "All") -> DataFrame:
    return df if value == all_token else df.where(F.array_contains(col, value))


def thresholds(df: DataFrame, at_least: dict | None = None, above: dict | None = None, at_most: dict | None = None, below: dict | None = None) -> DataFrame:
    """Conjunction of one-sided limits per column; a null fails every limit."""
    for limits, op in ((at_least, Column.__ge__), (above, Column.__gt__), (at_most, Column.__le__), (below, Column.__lt__)):
        for c, v in (limits or {}).items():
            df = df.where(op(F.col(c), F.lit(v)))
    return df


def trim_quantiles(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows within the inclusive quantile range of ``col``."""
    rows = with_scalars(df, exact_quantiles(df, col, {"lo": lo, "hi": hi}), "_q")
    return rows.where(F.col(col).between(F.col("_q.lo"), F.col("_q.hi"))).drop("_q")


def below_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    return df.where(F.col(col) < scalar_row(exact_quantiles(df, col, {"q": q}))["q"])


def above_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    return df.where(F.col(col) > scalar_row(exact_quantiles(df, col, {"q": q}))["q"])


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5, cap: bool = False) -> DataFrame:
    """Drop, or cap, values beyond ``k`` interquartile ranges. Integer columns get whole bounds."""
    dtype = df.schema[col].dataType
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"column {col!r} must be numeric")
    rows = with_scalars(df, exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75}), "_q")
    q1, q3 = F.col("_q.q1"), F.col("_q.q3")
    lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
    if isinstance(dtype, T.IntegralType):
        lo, hi = F.floor(lo), F.ceil(hi)
    if not cap:
        return rows.where(F.col(col).between(lo, hi)).drop("_q")
    capped = F.greatest(F.least(F.col(col), hi), lo)
    return rows.withColumn(col, F.when(F.col(col).isNotNull(), capped).cast(dtype)).drop("_q")


def keep_top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent categories, ties by name; at most ``n`` names are broadcast."""
    return df.join(F.broadcast(top_categories(df, col, n)), col, "left_semi")


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    return counts.orderBy(F.desc("_c"), col).limit(n).select(col)


def facet_counts(df: DataFrame, list_col: str, by_label: bool = False) -> DataFrame:
    """Filter options ``value (count)``, sorted by value or by the whole label."""
    counts = df.select(F.explode(list_col).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    labelled = counts.withColumn("label", F.format_string("%s (%d)", "value", "count"))
    return labelled.orderBy("label" if by_label else "value")


def extent(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def sample_size_level(df: DataFrame, few: int = 50, some: int = 250) -> DataFrame:
    """One row: titles in scope and how far results can be trusted."""
    n = df.agg(F.count(F.lit(1)).alias("titles"))
    verdict = F.when(F.col("titles") < few, "limited").when(F.col("titles") < some, "noisy").otherwise("ok")
    return n.withColumn("level", verdict)


def sample_warnings(df: DataFrame, group: str, min_n: int = 4, show: int = 3) -> DataFrame:
    """The first ``show`` groups with fewer than ``min_n`` rows."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") < min_n).orderBy(group).limit(show)


def drop_top_k(df: DataFrame, col: str, k: int, key: str) -> DataFrame:
    """All rows but the ``k`` largest (ties by key); ``k`` keys are broadcast."""
    top = df.orderBy(F.desc_nulls_last(col), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_anti")


def columns_minus(cols: Sequence[str], other: Sequence[str]) -> list[str]:
    return [c for c in cols if c not in set(other)]
