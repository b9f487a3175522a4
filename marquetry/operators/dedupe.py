"""Key uniqueness and collapsing of near-duplicate records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.plans.skew import attach_group_stats


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    hit = duplicate_keys(df, key).limit(1).collect()
    if hit:
        raise ValueError(f"duplicate key {key}={hit[0][0]!r}")
    return df


def with_group_size(
    df: DataFrame, keys: Sequence[str], out: str = "group_count", drop_null_keys: bool = False, max_groups: int | None = None
) -> DataFrame:
    """Number of rows sharing the keys, on every row. A row with a null key is a group of one."""
    has_keys = _has_keys(keys)
    sizes = df.where(has_keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    sized = attach_group_stats(df.where(has_keys), sizes, keys, out, max_groups)
    if drop_null_keys:
        return sized
    return sized.unionByName(df.where(~has_keys).withColumn(out, F.lit(1).cast("bigint")))


def _has_keys(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def minmax_score(col: Column, lo: Column, hi: Column) -> Column:
    """Position within [lo, hi]; 1 where the group is constant."""
    return F.when(lo == hi, F.lit(1.0)).otherwise((col - lo) / (hi - lo))


def minmax_in_group(df: DataFrame, col: str, keys: Sequence[str], out: str, max_groups: int | None = None) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(F.lit(1)).alias("_w"))
    rows = attach_group_stats(df, stats, keys, "_w", max_groups)
    return rows.withColumn(out, minmax_score(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_w")


def completeness_score(
    df: DataFrame,
    keys: Sequence[str],
    parts: Mapping[str, float],
    out: str = "total_score",
    null_part_as_zero: bool = True,
    max_groups: int | None = None,
) -> DataFrame:
    """Weighted sum of group-wise min-max scores; list columns count by their length."""
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    measure = {p: (F.size(F.col(p)) if p in arrays else F.col(p)).cast("double") for p in parts}
    # size(null) must stay null
    measure = {p: F.when(F.col(p).isNotNull(), m) for p, m in measure.items()}
    rows = df.select("*", *[m.alias(f"_m_{p}") for p, m in measure.items()])
    aggs = [F.count(F.lit(1)).alias("_w")]
    for p in parts:
        aggs += [F.min(f"_m_{p}").alias(f"_lo_{p}"), F.max(f"_m_{p}").alias(f"_hi_{p}")]
    scored = attach_group_stats(rows, rows.groupBy(*keys).agg(*aggs), keys, "_w", max_groups)
    total = F.lit(0.0)
    for p, weight in parts.items():
        s = minmax_score(F.col(f"_m_{p}"), F.col(f"_lo_{p}"), F.col(f"_hi_{p}"))
        s = F.when(F.col(f"_m_{p}").isNotNull(), s)
        total = total + (F.coalesce(s, F.lit(0.0)) if null_part_as_zero else s) * weight
    helper = [c for c in scored.columns if c.startswith(("_m_", "_lo_", "_hi_")) or c == "_w"]
    return scored.withColumn(out, total).drop(*helper)


# weights of the catalog's own duplicate score
CATALOG_SCORE = {"steam_total_reviews": 2.0, "recommendations": 1.0, "tags": 1.0, "genres": 1.0, "languages_supported": 1.0}


def collapse_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    parts: Mapping[str, float],
    id_col: str,
    null_score_wins: bool = False,
    max_groups: int | None = None,
) -> DataFrame:
    """One row per key: the best-scored row's values, gaps filled from the next best.

    A null or an empty list is a gap. Rows with a null key are kept as they are. Each column
    is a ``max_by`` over (score, id), combined map-side, so a huge group needs no big state.
    """
    has_keys = _has_keys(keys)
    scored = completeness_score(df.where(has_keys), keys, parts, "_score", not null_score_wins, max_groups)
    rank = F.coalesce(F.col("_score"), F.lit(float("inf"))) if null_score_wins else F.col("_score")
    order = F.struct(rank, F.col(id_col))
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in df.columns:
        if c in keys:
            continue
        present = F.col(f"`{c}`").isNotNull()
        empty = None
        if isinstance(types[c], T.ArrayType):
            present = present & (F.size(F.col(f"`{c}`")) > 0)
            empty = F.max(F.when(F.col(f"`{c}`").isNotNull(), F.lit(True)))
        best = F.max_by(F.col(f"`{c}`"), F.when(present, order))
        if empty is not None:
            best = F.coalesce(best, F.when(empty, F.array().cast(types[c])))
        aggs.append(best.alias(c))
    collapsed = scored.groupBy(*keys).agg(*aggs)
    return collapsed.select(df.columns).unionByName(df.where(~has_keys))
