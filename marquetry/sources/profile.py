"""First-look summaries of unfamiliar data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_distinct(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """One row: distinct non-null values of ``col``."""
    if col not in df.columns:
        raise KeyError(f"column {col!r} not in {df.columns}")
    f = F.approx_count_distinct(col) if approx else F.count_distinct(F.col(col))
    return df.agg(f.alias("distinct_count"))


def sample_n(df: DataFrame, n: int, seed: int, key: str | None = None) -> DataFrame:
    """``n`` random rows. With ``key`` the draw depends only on key and seed, not on the partitioning."""
    order = F.xxhash64(F.col(key), F.lit(seed)) if key else F.rand(seed)
    return df.orderBy(order, *([key] if key else [])).limit(n)


def _summary(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.MapType)):
        size = F.lit(len(dtype.fields)) if isinstance(dtype, T.StructType) else F.size(col)
        return F.when(col.isNotNull(), F.concat(F.lit("NestedDict["), size.cast("string"), F.lit(" keys]")))
    shown = 1 if isinstance(dtype.elementType, (T.StructType, T.MapType)) else 3
    return F.when(
        col.isNotNull(),
        F.concat(
            F.lit("List["), F.size(col).cast("string"), F.lit("]: "), F.to_json(F.slice(col, 1, shown)), F.lit("...")
        ),
    )


def flatten(df: DataFrame, max_depth: int = 1, sep: str = ".") -> DataFrame:
    """Open nested records down to ``max_depth``; what lies deeper becomes a short text."""

    def walk(col: Column, field: T.StructField, name: str, depth: int) -> list[Column]:
        if isinstance(field.dataType, T.StructType) and depth < max_depth:
            return [
                c for f in field.dataType.fields for c in walk(col.getField(f.name), f, f"{name}{sep}{f.name}", depth + 1)
            ]
        if isinstance(field.dataType, (T.StructType, T.MapType, T.ArrayType)):
            return [_summary(col, field.dataType).alias(name)]
        return [col.alias(name)]

    return df.select([c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f, f.name, 0)])
