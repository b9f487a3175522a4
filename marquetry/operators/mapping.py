"""Column mapping, projection and the schema contract."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]


def apply_mappings(
    df: DataFrame, mappings: Sequence[tuple[str, str, Transform | None]], keep_only: bool = False
) -> DataFrame:
    """Rename and transform columns by (source, target, transform); one projection."""
    missing = [src for src, _, _ in mappings if src not in df.columns]
    if missing:
        raise ValueError(f"source columns not found: {missing}")
    by_source = {src: (dst, fn) for src, dst, fn in mappings}
    out = []
    for c in df.columns:
        if c in by_source:
            dst, fn = by_source[c]
            out.append((fn(F.col(f"`{c}`")) if fn else F.col(f"`{c}`")).alias(dst))
        elif not keep_only:
            out.append(F.col(f"`{c}`"))
    return df.select(out)


def drop_columns(df: DataFrame, cols: Sequence[str], must_exist: bool = True) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing and must_exist:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_prefixed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in cols])


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in sorted(df.columns)])


def numeric_only(df: DataFrame) -> DataFrame:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select([F.col(f"`{c}`") for c, t in df.dtypes if t in numeric or t.startswith("decimal")])


def enforce_schema(df: DataFrame, contract: Mapping[str, Transform]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Apply a coercer per column. The report names contract columns that are missing and
    data columns without a rule; the latter pass through unchanged."""
    report = {
        "missing": [c for c in contract if c not in df.columns],
        "unmapped": [c for c in df.columns if c not in contract],
    }
    out = [(contract[c](F.col(f"`{c}`")) if c in contract else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(out), report
