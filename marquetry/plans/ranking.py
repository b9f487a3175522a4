"""Dense 0-based numbering of a whole frame without one task sorting all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.plans.skew import with_scalars
from marquetry.sources.writers import checkpoint

BUCKETS = 256
STEP = 16  # bounds passed over at a time


def dense_index(df: DataFrame, order_col: str, out: str, tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Number rows by ``order_col`` (then ``tie``).

    Rows are split at sketched boundaries into about equal buckets, each bucket is numbered
    on its own, and the bucket's offset - at most ``buckets`` values - is added.
    """
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = df.agg(F.percentile_approx(order_col, points, F.lit(10_000)).alias("all"))
    bounds = bounds.select("all", F.filter("all", lambda b, i: i % STEP == STEP - 1).alias("some"))
    below = lambda bs: F.size(F.filter(bs, lambda b: b < F.col(f"`{order_col}`")))
    # the bounds are sorted: every STEP-th is compared, then those of one step
    placed = with_scalars(df, bounds, "_bounds").withColumn("_passed", below(F.col("_bounds.some")) * STEP)
    placed = placed.withColumn("_bucket", F.col("_passed") + below(F.slice("_bounds.all", F.col("_passed") + 1, STEP)))
    placed = placed.drop("_bounds", "_passed")
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    # at most `buckets` rows from here on
    sizes = sizes.withColumn(
        "_offset",
        F.sum("_c").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select(F.col("_bucket").alias("_ob"), F.coalesce("_offset", F.lit(0)).alias("_offset"))
    order = [order_col] + ([tie] if tie else [])
    numbered = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    joined = numbered.join(F.broadcast(sizes), F.col("_bucket") == F.col("_ob"))
    return joined.withColumn(out, F.col("_offset") + F.col("_rn") - 1).drop("_bucket", "_ob", "_offset", "_rn")


def place_rows(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """``df`` in a global order with the place of each row in it (from 1), so the order outlives the frame.

    Rows are split by range of the order, sorted in each part, and offset by the parts before: no task sees all rows. End
    ``order`` with a column that settles ties; rows that tie to the end take their places in any order.
    """
    stored = checkpoint(df)  # ranges are sampled first, so the rows are read twice
    placed = checkpoint(stored.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per part from here on
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    met = placed.withColumn("_own", own).join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    met = met.withColumn(out, F.col("_before") + F.col("_own"))
    return met.select(*[f"`{c}`" for c in df.columns if c != out], out).orderBy(out)
