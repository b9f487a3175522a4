"""One large JSON document, read by many tasks.

Spark's text source cuts a file at every ``}`` and gives each split to its own task. No escape of JSON crosses a ``}``, so a
piece can be judged alone but for one bit: whether it starts inside a string. Every piece is therefore summed up for both
cases (does it end in a string, how does the nesting change), sums run along each split, and the splits of a file are
chained by their totals - one row per split. A record ends where a ``}`` outside strings brings the nesting back
to the root. Pieces between two such ends are put together again, wherever the splits were; a piece between two ends is a record already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.sources.writers import checkpoint

SPLIT = ["file", "block"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file``, its ``size``, ``block`` (where the split starts), ``id`` (order in the split), ``value`` (text before a ``}``)."""
    read = spark.read.text(path, lineSep="}")
    where = [F.col(f"_metadata.file_{c}").alias(n) for c, n in (("path", "file"), ("block_start", "block"), ("size", "size"))]
    return read.select(*where, F.monotonically_increasing_id().alias("id"), "value")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _judged(pieces: DataFrame) -> DataFrame:
    """``odd``: the piece changes between inside and outside a string; ``from_out``, ``from_in``: change of the nesting if it
    starts outside or inside one, its own brace counted where it ends outside."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|$)'
    pieces = pieces.withColumn("_bare", bare).withColumn("odd", (_count(F.col("_bare"), '"') % 2).cast("int"))
    for name, text, ends_out in (
        ("from_out", F.col("_bare"), F.col("odd") == 0),
        ("from_in", F.concat(F.lit('"'), F.col("_bare")), F.col("odd") == 1),
    ):
        code = F.regexp_replace(text, strings, "")
        change = _count(code, "{[") - _count(code, "]") - ends_out.cast("int")
        pieces = pieces.withColumn(name, change.cast("bigint"))
    return pieces.drop("_bare")


def _chained(splits: DataFrame, value: str, name: str) -> DataFrame:
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and ``closed`` for every record below the root of each document in ``path``.

    The text starts with what separates the record from the one before. What follows the last record of a file comes as a row that is
    not ``closed``, unless it is empty. Files are UTF-8 and not compressed; order is not kept.
    """
    along = Window.partitionBy(*SPLIT).orderBy("id")
    sofar, earlier = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("value") + F.lit(1).cast("bigint")
    pieces = checkpoint(_judged(_pieces(spark, path)).withColumn("bytes", length))
    # all that is sorted and summed goes without the text, which is met again at the end
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    judged = pieces.drop("value").withColumn("inside", inside.cast("int"))
    # nesting along the split, if the split starts outside (0) or inside (1) a string
    for start in (0, 1):
        step = F.when(F.col("inside") == start, F.col("from_out")).otherwise(F.col("from_in"))
        judged = judged.withColumn(f"_step{start}", step).withColumn(f"nest{start}", F.sum(f"_step{start}").over(sofar))
    judged = checkpoint(judged.drop("_step0", "_step1", "from_out", "from_in"))

    last = F.max_by(F.struct("nest0", "nest1"), "id").alias("s")
    splits = judged.groupBy(*SPLIT, "size").agg(F.sum("odd").alias("odd"), F.sum("bytes").alias("bytes"), F.max("id").alias("last"), last)
    # with a brace after every piece the file would be too long: what follows the last one ends at the end of the file
    whole = Window.partitionBy("file")
    bare = (F.sum("bytes").over(whole) > F.col("size")) & (F.col("block") == F.max("block").over(whole))
    splits = splits.select(*SPLIT, "odd", "s.*", F.when(bare, F.col("last")).otherwise(-1).alias("tail"))
    splits = _chained(splits, "odd", "_odd").withColumn("start", (F.col("_odd") % 2).cast("int"))
    splits = splits.withColumn("nest", F.when(F.col("start") == 0, F.col("nest0")).otherwise(F.col("nest1")))
    splits = _chained(splits, "nest", "base").select(*SPLIT, "start", "base", "tail")
    met = judged.join(splits, SPLIT)
    nest = F.col("base") + F.when(F.col("start") == 0, F.col("nest0")).otherwise(F.col("nest1"))
    ends_out = (F.col("inside") + F.col("start") + F.col("odd")) % 2 == 0
    ended = met.select(*SPLIT, "id", (ends_out & (nest == 1) & (F.col("id") != F.col("tail"))).cast("bigint").alias("ends"))
    # a piece that ends a record right after the end of another is that record
    alone = (F.col("ends") == 1) & F.coalesce(F.lag("ends").over(along) == 1, F.lit(False))
    ended = checkpoint(ended.select("*", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("record"), alone.alias("alone")))

    firsts = _chained(ended.groupBy(*SPLIT).agg(F.sum("ends").alias("n")), "n", "first").select(*SPLIT, "first")
    texts = pieces.select(*SPLIT, "id", "value")
    single = texts.join(ended.where("alone").select(*SPLIT, "id"), [*SPLIT, "id"]).select(F.concat("value", F.lit("}")).alias("text"), F.lit(True).alias("closed"))
    parts = ended.where("not alone").join(firsts, SPLIT).select(*SPLIT, "id", "ends", (F.col("record") + F.col("first")).alias("record"))
    piece = F.struct("block", "id", "value")
    whole = texts.join(parts, [*SPLIT, "id"]).groupBy("file", "record")
    whole = whole.agg(F.array_sort(F.collect_list(piece)).alias("pieces"), (F.max("ends") == 1).alias("closed"))
    text = F.array_join(F.col("pieces.value"), "}")
    whole = whole.select(F.when(F.col("closed"), F.concat(text, F.lit("}"))).otherwise(text).alias("text"), "closed").where("text <> ''")
    return single.unionAll(whole)
