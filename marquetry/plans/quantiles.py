"""Exact quantiles, medians and modes that stay distributed for any value count.

Spark's ``percentile`` keeps every distinct value of a group in one reducer. The plan
here brackets the wanted rank with a bounded ``percentile_approx`` sketch, counts what
lies outside the bracket, and orders only the few distinct values inside it:

1. sketch per group (map-side combined, bounded memory);
2. each row becomes "below", "above" or "inside" per requested probability and is
   counted map-side, so the shuffle carries about ``6 / accuracy`` of the values;
3. running counts turn the inside values into exact ranks, interpolated linearly.

If the sketch ever failed its error bound the job raises; it cannot return a wrong rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.plans.skew import attach_group_stats, scalar_row

ACCURACY = 100_000
# many columns at once: smaller sketches, since each column keeps one per task
WIDE_ACCURACY = 10_000


def _measured(df: DataFrame, value: str | Column, by: Sequence[str]) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias("_v"))
    return rows.where("_v is not null")


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: dict[str, float],
    by: Sequence[str] = (),
    max_groups: int | None = None,
    count_as: str | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with a double column per entry of ``probs`` ({name: probability})."""
    by = list(by)
    names, points = list(probs), list(probs.values())
    rows = _measured(df, value, by)
    slack = 2.0 / accuracy
    edges = [e for p in points for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch_cols = [
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_edges"),
    ]
    if by:
        sketch = rows.groupBy(*by).agg(*sketch_cols)
        ranked = attach_group_stats(rows, sketch, by, "_n", max_groups)
    else:
        sketch = scalar_row(rows.agg(*sketch_cols))
        ranked = rows.withColumn("_s", sketch).select("_v", F.col("_s._n").alias("_n"), F.col("_s._edges").alias("_edges"))

    brackets = [
        F.struct(F.lit(i).alias("k"), F.col("_edges")[2 * i].alias("lo"), F.col("_edges")[2 * i + 1].alias("hi"))
        for i in range(len(points))
    ]
    side = F.when(F.col("_v") < F.col("_b.lo"), -1).when(F.col("_v") > F.col("_b.hi"), 1).otherwise(0)
    placed = ranked.select(*by, "_v", "_n", F.explode(F.array(*brackets)).alias("_b"))
    placed = placed.select(*by, "_v", "_n", F.col("_b.k").alias("_k"), side.alias("_side"))
    counts = placed.groupBy(
        *by, "_n", "_k", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_in")
    ).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))

    order = Window.partitionBy(*by, "_k").orderBy("_side", "_in").rowsBetween(Window.unboundedPreceding, 0)
    located = counts.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
    located = located.withColumn("_pos", F.array(*[F.lit(p) for p in points])[F.col("_k")] * (F.col("_n") - 1))
    # grouped by the window's keys and one more: no further exchange
    ends = located.groupBy(*by, "_n", "_k", "_pos").agg(
        F.max(_value_at(F.floor("_pos"))).alias("_lo"), F.max(_value_at(F.ceil("_pos"))).alias("_hi")
    )
    missed = F.raise_error(F.lit("quantile sketch missed the rank")).cast("double")
    exact = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), missed).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    )
    values = ends.select(*by, "_n", "_k", exact.alias("_q"))
    extra = [F.col("_n").alias(count_as)] if count_as else []
    if by and len(names) == 1:
        return values.select(*by, F.col("_q").alias(names[0]), *extra)
    picks = [F.max(F.when(F.col("_k") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    if by:
        return values.groupBy(*by, "_n").agg(*picks).select(*by, *names, *extra)
    # without keys an empty input still gives one row of nulls
    return values.agg(*picks, F.max("_n").alias("_n")).select(*names, *extra)


def _value_at(rank: Column) -> Column:
    covers = (F.col("_start") <= rank) & (rank < F.col("_end"))
    return (
        F.when(covers & (F.col("_side") == 0), F.col("_in"))
        .when((F.col("_side") == -1) & (rank == F.col("_end") - 1), F.col("_max"))
        .when((F.col("_side") == 1) & (rank == F.col("_start")), F.col("_min"))
    )


def exact_median(df, value, by=(), out="median", max_groups=None, count_as=None) -> DataFrame:
    return exact_quantiles(df, value, {out: 0.5}, by, max_groups, count_as)


def melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Long form (``column``, ``value``) so one job serves any number of columns."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(dtype).alias("value")) for c in cols])
    return df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.column", "_i.value")


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column``, ``median`` for many numeric columns in one pass."""
    probs = {"median": 0.5}
    return exact_quantiles(melt(df, cols), "value", probs, ["column"], max_groups=len(cols), accuracy=WIDE_ACCURACY)


def mode_by(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties, counted before it is compared."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(out))

