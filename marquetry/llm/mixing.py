r"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Every document is cut into blocks of ``block`` words; only ids and numbers leave the texts.
2. Sources get targets: shares by weight, stopped at ``cap`` times their size, the excess shared again by weight. The
   water level comes from running sums over the sources ordered by cap per weight.
3. Each source's blocks are put in a seeded order, once per pass over the source. Its quota is the prefix of that
   sequence that holds its target, the last block cut to fit, so the words taken equal the rounded target.
4. A tree over the output shards splits the quotas: a node's left half takes its exact number of blocks, how many of
   each source is a multivariate-hypergeometric draw. A draw over all sources is one over groups of sources and one
   inside each group, so that no row holds more than about the square root of the number of sources (1,024 at least).
5. A shard draws its blocks of a source as one range of the source's sequence - ranges are disjoint by construction -
   and is shuffled on its own.

A source's order is found in buckets of about 4,096 blocks by leading bits of the key, so a source with a third of
all rows is ordered by as many tasks as any other rows. Random numbers are hashes of what they decide, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.plans.skew import attach_group_stats, hash_fraction
from marquetry.sources.writers import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 512  # words
SHARD_BLOCKS = 16_384
RUN = 4_096  # blocks that are ordered together
GROUP = 1_024  # sources that a row of the tree holds, unless there are more than its square
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``source``, ``size`` and ``copies``: rows alike in the first three are told apart by a number later."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")
    )
    return rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Stored rows with running sums of what precedes them: sorted by range, summed in each part, offset by the parts before.

    Rows must differ in ``order``. One row per part meets the parts' offsets, nothing else is gathered.
    """
    placed = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(F.expr(e)).over(own), F.lit(0)).alias(n) for n, e in sums.items()])
    met = inside.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return met.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).cast("bigint").alias(n) for n in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``sizes`` (``source``, ``size`` and more) with ``rank``, ``target`` (double) and ``want``, the target in whole words.

    Sources are ordered by code point, null last, and take ``weights`` in turn. They share ``share`` times all sizes by
    weight, none above ``cap`` times its own size, until nothing is left to share or all are at their cap.
    """
    ranked = running(checkpoint(sizes), [F.col("source").asc_nulls_last()], {"rank": "1"})
    turn = F.array(*[F.lit(w) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    ranked = ranked.withColumn("weight", turn.cast("bigint")).withColumn("most", F.col("size") * cap)
    ranked = checkpoint(ranked.withColumn("ratio", F.col("most") / F.col("weight")))
    filled = running(ranked, [F.col("ratio"), F.col("rank")], {"used": "most", "spent": "weight"})
    total = ranked.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share)) * (total["size"] or 0) - F.col("used")) / (F.lit(total["weight"] or 0) - F.col("spent"))
    filled = filled.withColumn("level", level)
    lowest = filled.where("ratio > level").agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]
    target = F.col("most").cast("double")
    if lowest is not None:
        target = F.least(target, F.lit(lowest) * F.col("weight"))
    out = filled.withColumn("target", target).withColumn("want", F.floor(F.col("target") + 0.5))
    return out.drop("weight", "most", "ratio", "used", "spent", "level")


def hypergeometric(total: Column, of_kind: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are of the kind, by inverting the distribution at ``u``.

    Weights follow from their neighbour's, so no factorial is needed. They are summed over the whole support or, where that is
    wider, over ten deviations and ten more to either side of the mean (what lies outside is below 1e-20).
    """
    big, kind, n = (c.cast("double") for c in (total, of_kind, drawn))
    mean = F.when(total > 0, n * kind / big).otherwise(0.0)
    spread = F.sqrt(F.when(total > 1, mean * (1 - kind / big) * (big - n) / (big - 1)).otherwise(0.0))
    low = F.greatest(F.lit(0).cast("bigint"), drawn + of_kind - total, F.floor(mean - 10 * spread - 10).cast("bigint"))
    high = F.least(of_kind, drawn, F.ceil(mean + 10 * spread + 10).cast("bigint"))

    def next_weight(weight: Column, k: Column) -> Column:
        at = k.cast("double")
        return weight * (kind - at + 1) * (n - at + 1) / (at * (big - kind - n + at))

    one = F.lit(1.0)
    steps = F.sequence(low + 1, high)
    whole = F.aggregate(
        steps,
        F.struct(one.alias("w"), one.alias("s")),
        lambda a, k: F.struct(next_weight(a["w"], k).alias("w"), (a["s"] + next_weight(a["w"], k)).alias("s")),
    )["s"]

    def find(reach: Column) -> Column:
        return F.aggregate(
            steps,
            F.struct(one.alias("w"), one.alias("s"), low.alias("x")),
            lambda a, k: F.struct(
                next_weight(a["w"], k).alias("w"),
                (a["s"] + next_weight(a["w"], k)).alias("s"),
                F.when(a["s"] < reach, k).otherwise(a["x"]).alias("x"),
            ),
        )["x"]

    return F.when(low >= high, low).otherwise(_once(u * whole, find))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the only element of an array."""
    return F.transform(F.array(value), use)[0]


def _dealt(items: Column, total: Column, drawn: Column, seed: Column) -> Column:
    """One multivariate draw: ``items`` (``key``, ``q``) with ``x``, kind after kind from what is left."""
    start = F.struct(
        total.cast("bigint").alias("total"),
        drawn.cast("bigint").alias("drawn"),
        F.expr("cast(array() as array<struct<key:bigint,q:bigint,x:bigint>>)").alias("out"),
    )

    def step(a: Column, item: Column) -> Column:
        x = hypergeometric(a["total"], item["q"], a["drawn"], hash_fraction(0, seed, item["key"]))
        return _once(
            x,
            lambda x: F.struct(
                (a["total"] - item["q"]).alias("total"),
                (a["drawn"] - x).alias("drawn"),
                F.concat(a["out"], F.array(F.struct(item["key"].alias("key"), item["q"].alias("q"), x.alias("x")))).alias("out"),
            ),
        )

    return F.aggregate(items, start, step, lambda a: a["out"])


def split_quotas(quotas: DataFrame, shards: int, blocks: int, sources: int, seed: int) -> DataFrame:
    """``shard``, ``rank``, ``q``: exact quotas (``rank``, ``q``) of ``blocks`` in all, split among shards of equal size.

    Shard ``j`` holds ``floor((j + 1) * blocks / shards) - floor(j * blocks / shards)`` blocks. Each level of the tree is
    one join of two small aggregates and is stored.
    """
    group = max(GROUP, math.isqrt(max(sources - 1, 0)) + 1)

    def upto(shard: str) -> Column:
        return F.floor(F.expr(f"cast({shard} as decimal(38,0)) * {blocks} / {shards}")).cast("bigint")

    state = quotas.select(F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "rank", "q")
    for level in range(max(shards - 1, 0).bit_length()):
        open_ = state.where("hi - lo > 1").withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("g", F.expr(f"rank div {group}"))
        half = upto("mid") - upto("lo")
        members = open_.groupBy("lo", "hi", "mid", "g").agg(
            F.sum("q").alias("q"), F.array_sort(F.collect_list(F.struct(F.col("rank").alias("key"), "q"))).alias("items")
        )
        totals = open_.groupBy("lo", "hi", "mid", "g").agg(F.sum("q").alias("q"))
        nodes = totals.groupBy("lo", "hi", "mid").agg(
            F.sum("q").alias("total"), F.array_sort(F.collect_list(F.struct(F.col("g").alias("key"), "q"))).alias("groups")
        )
        salt = F.xxhash64(F.lit(seed), F.lit(level), "lo", "hi")
        shares = nodes.select("lo", "hi", F.explode(_dealt(F.col("groups"), F.col("total"), half, salt)).alias("d"))
        shares = shares.select("lo", "hi", F.col("d.key").alias("g"), F.col("d.x").alias("share"))
        drawn = members.join(shares, ["lo", "hi", "g"])
        salt = F.xxhash64(F.lit(seed), F.lit(level), "lo", "hi", "g")
        drawn = drawn.select("lo", "hi", "mid", F.explode(_dealt(F.col("items"), F.col("q"), F.col("share"), salt)).alias("d"))
        halves = F.array(
            F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("d.x").alias("q")),
            F.struct(F.col("mid").alias("lo"), F.col("hi"), (F.col("d.q") - F.col("d.x")).alias("q")),
        )
        halved = drawn.select(F.col("d.key").alias("rank"), F.explode(halves).alias("h")).select("h.lo", "h.hi", "rank", "h.q")
        state = checkpoint(halved.where("q > 0").unionByName(state.where("hi - lo <= 1")))
    return state.select(F.col("lo").alias("shard"), "rank", "q")


def blocks_of(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """A row per block and pass that may be taken, with its key in the source's order."""
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    cut = rows.where("size > 0").select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    cut = cut.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("pass"))
    cut = cut.select("*", F.explode(F.expr(f"sequence(0L, (size - 1) div {block})")).alias("block"))
    # a null id is written as an empty one; copies of a row differ by their number
    name = F.concat_ws("-", F.lit(str(seed)), "pass", F.coalesce(F.col("id").cast("string"), F.lit("")), "copy", "block")
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    words = F.least(F.lit(block).cast("bigint"), F.col("size") - F.col("block") * block)
    kept = ("rank", "id", "size", "copy", "pass", "block", "full", "rest", "n_blocks", "bits")
    cut = cut.select(*kept, words.alias("words"), key.alias("key"))
    return cut.withColumn("run", F.expr(f"shiftright(key, {KEY_BITS} - bits)")).drop("bits")


def draw(blocks: DataFrame) -> DataFrame:
    """The blocks inside each source's quota: ``pos`` in the source's sequence and ``n_words`` taken of the block."""
    runs = blocks.groupBy("rank", "pass", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("rank", "pass").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first, sofar = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "w"))
    runs = runs.select("rank", "pass", "run", first.alias("first"), sofar.alias("sofar"))
    own = Window.partitionBy("rank", "pass", "run").orderBy("key", "id", "size", "copy", "block")
    met = blocks.join(runs, ["rank", "pass", "run"]).where("pass < full or sofar < rest")
    met = met.withColumn("at", F.row_number().over(own) - 1)
    words = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("sofar", F.col("sofar") + words).where("pass < full or sofar < rest")
    taken = F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("sofar")))
    pos = F.col("pass") * F.col("n_blocks") + F.col("first") + F.col("at")
    return met.select("rank", pos.alias("pos"), "id", "size", "copy", "pass", "block", taken.alias("n_words"))


def _placed(drawn: DataFrame, quotas: DataFrame) -> DataFrame:
    """``drawn`` with the ``shard`` whose range of the source's sequence holds the block; ranges are met run by run."""
    start = F.sum("q").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ranges = quotas.withColumn("start", F.coalesce(start, F.lit(0)))
    ranges = ranges.select("*", F.explode(F.expr(f"sequence(start div {RUN}, (start + q - 1) div {RUN})")).alias("part"))
    marks = ranges.select("rank", "part", F.greatest(F.col("start"), F.col("part") * RUN).alias("pos"), "shard", F.lit(0).alias("kind"))
    rows = drawn.withColumn("part", F.expr(f"pos div {RUN}")).withColumn("kind", F.lit(1))
    order = Window.partitionBy("rank", "part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(marks, allowMissingColumns=True).withColumn("shard", F.last("shard", ignorenulls=True).over(order))
    return met.where("kind = 1").drop("part", "kind")


def _prepared(docs: DataFrame, id_col, text_col, source_col, weights, share, cap, block) -> tuple[DataFrame, DataFrame]:
    rows = checkpoint(measured(docs, id_col, text_col, source_col))
    per = F.expr(f"copies * ((size + {block - 1}) div {block})")
    sizes = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum(per).alias("n_blocks"), F.count(F.lit(1)).alias("n_rows")
    )
    goal = targets(sizes, weights, share, cap).withColumnRenamed("size", "source_size")
    goal = goal.withColumn("full", F.expr("if(source_size = 0, 0, want div source_size)"))
    goal = goal.withColumn("rest", F.col("want") - F.col("full") * F.col("source_size"))
    runs = F.ceil(F.log2(F.greatest(F.col("n_blocks") / RUN, F.lit(1.0)))).cast("int")
    goal = checkpoint(goal.withColumn("bits", runs))
    return checkpoint(attach_group_stats(rows, goal, ["source"], "n_rows")), goal


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    The mix has a row per block: ``shard``, ``place`` in the shard, ``id``, ``size`` and ``copy`` of the document, ``rank`` of its
    source, ``pass``, and the span ``from_word``, ``n_words``. The documents are ``id``, ``size``, ``copy``, ``rank``,
    ``source``, ``source_size`` and ``target``, a row for each row of ``docs``.

    Null texts have no words, and a document or source without words gives nothing. Null sources are one source, the last.
    Rows alike in id, source and size are documents of their own, told apart by ``copy``; so are rows without an id. Other
    columns are ignored. An empty table gives two empty ones.
    """
    rows, goal = _prepared(docs, id_col, text_col, source_col, weights, share, cap, block)
    drawn = checkpoint(draw(blocks_of(rows, block, seed)))
    quotas = checkpoint(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("q")))
    total = quotas.agg(F.sum("q"), F.max("rank")).first()
    blocks = total[0] or 0
    shards = max(1, -(-blocks // shard_blocks))
    placed = _placed(drawn, split_quotas(quotas, shards, blocks, (total[1] or 0) + 1, seed))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "rank", "pos"), "rank", "pos")
    mixed = placed.withColumn("place", F.row_number().over(local)).withColumn("from_word", F.col("block") * block)
    mixed = mixed.select("shard", "place", "id", "size", "copy", "rank", "pass", "from_word", "n_words")
    parts = rows.select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    return mixed, parts.select("id", "size", "copy", "rank", "source", "source_size", "target")


def words_taken(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """Each of the ``documents`` of a mix with ``taken``, the words that the mix takes of it, repeats counted."""
    key = ["id", "size", "copy", "rank"]
    both = documents.withColumn("n_words", F.lit(0).cast("bigint")).unionByName(mixed.select(*key, "n_words"), allowMissingColumns=True)
    first = [F.max(c).alias(c) for c in ("source", "source_size", "target")]
    return both.groupBy(*key).agg(*first, F.sum("n_words").alias("taken"))
