"""Attach per-group statistics to rows without sending a hot group to one task.

A window over ``partitionBy(group)`` ships every row of a group to one task, so a
group holding a third of the table becomes the whole job. Here the statistics are
aggregated first (map-side combine), and the rows are matched with them in two ways:

* the ``heavy`` largest groups travel by broadcast - at most ``heavy`` rows, whatever
  the input size;
* the remaining groups, each at most ``1 / heavy`` of the table, use a shuffled join, through which
  the rows of large groups pass under a salt.

When a caller knows how many groups there can be (years in a filtered range, factor
names, ...) it passes ``max_groups`` and only the broadcast remains; a run-time check
fails the job if the promise does not hold, so rows are never lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAVY_GROUPS = 10_000
SALTS = 4_096


def scalar_row(aggregate: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery; read parts with ``[name]``."""
    return aggregate.select(F.struct("*").alias("s")).scalar()


def with_scalars(df: DataFrame, aggregate: DataFrame, name: str = "_s") -> DataFrame:
    """``df`` plus a one-row aggregate as struct column ``name``.

    Use this rather than several ``scalar_row(...)[field]`` when more than one or two fields are read:
    the sub-query is then planned once, not once per reference.
    """
    return df.withColumn(name, scalar_row(aggregate))


def null_safe(keys: Sequence[str], left: str, right: str) -> Column:
    """Equality of ``keys`` between two aliased frames in which null matches null."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys],
    )


def bounded(df: DataFrame, limit: int, what: str = "groups") -> DataFrame:
    """``df`` with a run-time check that it has at most ``limit`` rows, fit to broadcast."""
    capped = df.limit(limit + 1)
    size = capped.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    message = F.lit(f"more than {limit} {what}; pass max_groups=None to use the shuffled plan")
    return capped.where(F.when(size > limit, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def attach_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    weight: str,
    max_groups: int | None = None,
    heavy: int = HEAVY_GROUPS,
) -> DataFrame:
    """Inner-join ``rows`` with ``stats`` (one row per ``keys``; ``weight`` = its row count)."""
    keys = list(keys)
    added = [c for c in stats.columns if c not in keys]

    if max_groups is not None:
        few = F.broadcast(bounded(stats, max_groups)).alias("r")
        met = rows.alias("l").join(few, null_safe(keys, "l", "r"))
        return met.select("l.*", *[F.col(f"r.`{c}`") for c in added])
    # one pass: rows of heavy groups are settled by broadcast; they go through the shuffled join under a salt, where nothing
    # waits for them, so that no task receives a heavy group and the rows are read once; adaptive execution splits what a
    # row repeated very often brings into one salt
    top = stats.orderBy(F.desc(weight), *keys).limit(heavy).withColumn("_heavy", F.lit(True))
    first = rows.alias("l").join(F.broadcast(top).alias("r"), null_safe(keys, "l", "r"), "left")
    first = first.select("l.*", "r._heavy", *[F.col(f"r.`{c}`").alias(f"_h_{c}") for c in added])
    first = first.withColumn("_salt", F.when(F.col("_heavy"), salt_of(rows, SALTS) + 1).otherwise(F.lit(0)).cast("bigint"))
    light = stats.withColumn("_salt", F.lit(0).cast("bigint")).withColumn("_light", F.lit(True))
    met = null_safe([*keys, "_salt"], "l", "r")
    joined = first.alias("l").join(light.alias("r"), met, "left").where("l._heavy or r._light")
    values = [F.when(F.col("l._heavy"), F.col(f"l.`_h_{c}`")).otherwise(F.col(f"r.`{c}`")).alias(c) for c in added]
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], *values)


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, table_key: str, heavy: int = HEAVY_GROUPS, counts: DataFrame | None = None
) -> DataFrame:
    """Left join of ``rows`` with a table of one row per ``table_key``, safe for hot and null keys.

    Rows of the ``heavy`` most frequent keys meet their match by broadcast, whether it exists or not;
    rows without a key need none; only the others are shuffled. A caller that has counted the rows of each key passes
    ``counts`` (``_k`` and ``_w``), and they are not counted again.
    """
    payload = [c for c in table.columns if c != table_key]
    known = rows.where(F.col(key).isNotNull())
    if counts is None:
        counts = known.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_w"))
    top = counts.orderBy(F.desc("_w"), "_k").limit(heavy).select("_k")
    table = table.select(F.col(table_key).alias("_t"), *payload)
    matched = table.join(F.broadcast(top), F.col("_t") == F.col("_k"), "left_semi")
    hot = top.join(F.broadcast(matched), F.col("_k") == F.col("_t"), "left").drop("_t")
    by_broadcast = known.join(F.broadcast(hot), F.col(key) == F.col("_k")).drop("_k")
    others = known.join(F.broadcast(top), F.col(key) == F.col("_k"), "left_anti")
    by_shuffle = others.join(table, F.col(key) == F.col("_t"), "left").drop("_t")
    unkeyed = rows.where(F.col(key).isNull())
    return by_broadcast.unionByName(by_shuffle).unionByName(unkeyed, allowMissingColumns=True)


def salt_of(df: DataFrame, salts: int | Column) -> Column:
    """A number below ``salts`` from the content of a row of ``df``.

    It does not depend on the order in which rows arrive, so a task that runs again after an executor was lost deals its rows as
    before. Rows that are alike get the same number.
    """

    def hashable(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        return F.to_json(F.struct(col)) if "map<" in field.dataType.simpleString() else col

    return F.pmod(F.xxhash64(*[hashable(f) for f in df.schema.fields]), salts if isinstance(salts, Column) else F.lit(salts))


def hash_fraction(seed: int, *cols: Column) -> Column:
    """Uniform [0, 1) value that depends only on the given columns and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
