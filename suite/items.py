"""The ``items`` view: one row per order with the roles an analysis needs, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if given, its SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LAYERS: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived layer, written once per application and read back as Parquet.

    Reports are many and scan their input two or three times (quantiles), so they share one stored
    layer instead of deriving it again in every branch.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LAYERS:
        _LAYERS[key] = writers.checkpoint(build())
    return _LAYERS[key]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "items", lambda: derive_items(spark, sf_dir))


def derive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are aggregated per order in one shuffle; the keyword state is a set of distinct names, whose words follow from it."""
    orders, lines, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    named = lines.join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    per_order = named.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("owners"),
        F.count_if(F.col("l_returnflag") == "A").alias("pos"),
        F.count_if(F.col("l_returnflag") != "A").alias("neg"),
        F.collect_set("p_name").alias("_names"),
    )
    # joined by what parts the words, so one split gives the words of all names; no name is not an empty one
    words = F.split(F.array_join("_names", " "), " ")
    tags = F.when(F.size("_names") > 0, F.array_distinct(words)).otherwise(F.array().cast("array<string>"))
    total = F.col("pos") + F.col("neg")
    price = F.when(F.col("o_totalprice") < 50000, 0.0).when(F.col("o_totalprice") < 490000, F.col("o_totalprice") / 1000.0)
    return orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("item_id"),
        F.year("o_orderdate").alias("release_year"),
        F.to_date("o_orderdate").alias("release_date"),
        price.alias("price"),
        F.col("o_orderstatus").alias("model"),
        F.col("o_orderpriority").alias("factor"),
        "owners",
        "pos",
        "neg",
        total.alias("total_reviews"),
        F.try_divide(F.col("pos").cast("double"), total).alias("ratio"),
        F.array_sort(tags).alias("tags"),
    )


_ITEMS_SQL = """
li as (
  select l_orderkey, cast(sum(l_quantity) as double) as owners,
    cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as bigint) as pos,
    cast(sum(case when l_returnflag <> 'A' then 1 else 0 end) as bigint) as neg
  from lineitem group by l_orderkey),
tg as (
  select l_orderkey, w from (
    select l.l_orderkey, unnest(string_split(p.p_name, ' ')) as w
    from lineitem l join part p on l.l_partkey = p.p_partkey) group by 1, 2),
tgs as (select l_orderkey, list_sort(list(w)) as tags from tg group by 1),
items as (
  select o_orderkey as item_id, cast(year(o_orderdate) as integer) as release_year,
    cast(o_orderdate as date) as release_date,
    case when o_totalprice < 50000 then 0.0 when o_totalprice >= 490000 then null
         else o_totalprice / 1000.0 end as price,
    o_orderstatus as model, o_orderpriority as factor, li.owners, li.pos, li.neg,
    (li.pos + li.neg) as total_reviews,
    li.pos / cast(li.pos + li.neg as double) as ratio,
    coalesce(tgs.tags, cast([] as varchar[])) as tags
  from orders left join li on li.l_orderkey = o_orderkey
              left join tgs on tgs.l_orderkey = o_orderkey)
"""


def over_items(select: str, **ctes: str) -> str:
    """SQL over ``items`` with further named sub-queries."""
    extra = "".join(f",\n{name} as ({body})" for name, body in ctes.items())
    return f"with {_ITEMS_SQL.strip()}{extra}\n{select}"


def r6(col: str | Column, name: str | None = None) -> Column:
    """Double rounded to 6 places: engines differ in the last digits of floating sums."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c.cast("double"), 6)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def joined(col: str | Column, name: str) -> Column:
    """A list as text."""
    return F.array_join(col, "|").alias(name)


MODELS = ("F", "O", "P")
YEARS = 100  # years a report can hold at most
