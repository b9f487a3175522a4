"""Conversation prefix trie: nodes shared by conversations, and subtree totals by parallel tree contraction.

1. Conversations are rebuilt (a shared head, then their own turns) as rows of digests; texts are read once and not shuffled.
2. One sorted Arrow pass chains the digests of each conversation, so every row knows its node: the digest of the
   whole prefix. It keeps one digest at a time. An aggregate over nodes counts members (map-side combined: a
   node that all conversations share is no hot group) and names a node by its smallest member and depth.
3. Contraction in rounds of joins by key (as aggregates of nodes and messages): *rake* - leaves hand their totals to their
   parents; *compress* - nodes with one child are taken out of their chain where their priority is lower than
   that of their neighbours in the chain. Priorities follow the powers of two in the depth, so a chain halves each
   round and a trie of any depth needs about log2(nodes) rounds. Each round is stored in the shared folder.
4. Rounds are re-expanded backwards: a node taken out has the total of the child it led to and what it held itself.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marquetry.sources.writers import checkpoint

from .common import arrow_fields

ROOT = bytes(16)
CHUNK = 4_096  # conversation ids that are joined to a text at a time
STORE_EVERY = 4  # re-expanded rounds between stored layers


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` (from 1), ``digest`` of role and text, ``chars``: the turns in order, null turns first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), "turn", F.md5(content.cast("binary")).alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.withColumn("i", F.row_number().over(order)).select("conv_id", "i", "digest", "chars")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """``conv_id``, ``part``, ``i``, ``digest``, ``chars``: a row of part -1 for each conversation, then the rebuilt turns in order.

    Conversation c takes the first h turns of c - c % ``every``, then its own after the first h; h is crc32(c) % ``heads``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    convs = turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.expr(f"conv_id - conv_id % {every}"))
    first = turns.where((F.expr(f"conv_id % {every}") == 0) & (F.col("i") < heads))
    head = convs.join(first.withColumnRenamed("conv_id", "base"), "base").where("i <= h")
    own = turns.where(F.col("i") > h)
    cols = ["conv_id", F.col("part").cast("int"), "i", "digest", "chars"]
    out = head.withColumn("part", F.lit(0)).select(*cols).unionByName(own.withColumn("part", F.lit(1)).select(*cols))
    start = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("i"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("chars"))
    return out.unionByName(start)


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``node``, ``parent``, ``chars``, ``is_end``: the nodes that each conversation passes."""
    schema = T.StructType.fromDDL("conv_id bigint, depth bigint, node binary, parent binary, chars bigint, is_end boolean")
    types = [f.type for f in arrow_fields(schema)]

    def run(batches):
        held, node, depth = None, ROOT, 0  # the last row waits until it is known whether its conversation goes on
        for batch in batches:
            out = []
            for conv, part, digest, chars in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "chars")]):
                if held is not None:
                    out.append((*held, part < 0))
                parent = None
                if part < 0:
                    node, depth = ROOT, 0
                else:
                    parent, depth = node, depth + 1
                    node = xxhash.xxh128_digest(parent + digest.encode())
                held = (conv, depth, node, parent, chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held, True), types)], names=schema.names)

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i")
    return placed.select("conv_id", "part", "digest", "chars").mapInArrow(run, schema)


def end_digests(passed: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the members that end there: their ids, ascending, joined by commas.

    Ids are joined in chunks by as many tasks as there are; a node's chunks are hashed one after the other, as SHA-256
    must be, with one chunk in memory.
    """
    schema = T.StructType.fromDDL("node binary, ends_sha256 string")
    ends = passed.where("is_end").groupBy("node", F.expr(f"conv_id div {CHUNK}").alias("chunk"))
    texts = ends.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        at, digest = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=schema.names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=schema.names)

    return texts.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, schema)


def nodes_of(passed: DataFrame) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``chars``, ``node``."""
    grouped = passed.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
    )
    grouped = checkpoint(grouped)
    above = grouped.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return grouped.join(above, "parent", "left").drop("parent")


SELF = ("pc", "pd", "leaves", "tokens", "kids")

def _rows(*rows: tuple[Column | None, dict[str, Column]], columns: tuple[str, ...]) -> Column:
    """Exploded rows of the same columns, null where a row says nothing; a row under a condition that fails is left out."""
    made = [(cond, F.struct(*[v.get(c, F.lit(None)).cast("bigint").alias(c) for c in columns])) for cond, v in rows]
    return F.explode(F.array_compact(F.array(*[s if cond is None else F.when(cond, s) for cond, s in made])))


def _met(df: DataFrame, columns: tuple[str, ...], *rows, **sums: str) -> DataFrame:
    """Nodes and messages to nodes, brought together by key. Every column has one writer but those that are summed."""
    sent = df.select(_rows(*rows, columns=("c", "d", *columns)).alias("r")).select("r.*")
    return sent.groupBy("c", "d").agg(*[(F.sum if c in sums else F.max)(c).alias(c) for c in columns])


def contract(state: DataFrame, turn: int) -> DataFrame:
    """One round over the live nodes (``c``, ``d``, parent ``pc``, ``pd``, ``leaves``, ``tokens``, ``kids``).

    Adds ``status`` (0 live, 1 raked, 2 compressed) and the child ``cc``, ``cd`` that a compressed node led to.
    """
    own = {"c": F.col("c"), "d": F.col("d")} | {k: F.col(k) for k in SELF}
    parent = {"c": F.col("pc"), "d": F.col("pd")}
    leaf, has_parent = F.col("kids") == 0, F.col("pc").isNotNull()

    # rake: leaves give what they hold to the parent; other children say who they are
    given = {"add_leaves": F.when(leaf, F.col("leaves")), "add_tokens": F.when(leaf, F.col("tokens"))}
    named = {"on": F.when(~leaf, F.lit(1)), "cc": F.when(~leaf, F.col("c")), "cd": F.when(~leaf, F.col("d"))}
    columns = (*SELF, "add_leaves", "add_tokens", "on", "cc", "cd")
    raked = _met(state, columns, (None, own), (has_parent, parent | given | named), add_leaves="", add_tokens="", on="")
    was_leaf = F.col("kids") == 0
    raked = raked.select(
        "c", "d", "pc", "pd", was_leaf.cast("bigint").alias("raked"), "cc", "cd",
        *[(F.col(k) + F.coalesce(f"add_{k}", F.lit(0))).alias(k) for k in ("leaves", "tokens")],
        F.when(was_leaf, F.lit(0)).otherwise(F.coalesce("on", F.lit(0))).alias("kids"),
    )

    # compress: a node with one child is taken out if its neighbours in the chain stay
    chained = (F.col("raked") == 0) & (F.col("kids") == 1) & F.col("pc").isNotNull()
    low = F.expr("bit_count((d & -d) - 1)")  # the power of two in the depth
    mixed = F.xxhash64("c", "d", F.lit(turn)).bitwiseAND((1 << 56) - 1)
    raked = raked.withColumn("priority", F.when(chained, low.cast("bigint") * (1 << 56) + mixed))
    columns = (*SELF, "raked", "cc", "cd", "priority", "below", "above")
    own = {k: F.col(k) for k in ("c", "d", *SELF, "raked", "cc", "cd", "priority")}
    to_parent = {"c": F.col("pc"), "d": F.col("pd"), "below": F.col("priority")}
    to_child = {"c": F.col("cc"), "d": F.col("cd"), "above": F.col("priority")}
    known = _met(raked, columns, (None, own), (F.col("priority").isNotNull(), to_parent), (F.col("priority").isNotNull(), to_child))
    far = F.lit((1 << 63) - 1)
    out = F.col("priority") < F.least(F.coalesce("below", far), F.coalesce("above", far))
    known = known.withColumn("out", F.coalesce(out, F.lit(False)).cast("bigint"))

    columns = (*SELF, "raked", "cc", "cd", "out", "add_leaves", "add_tokens", "new_pc", "new_pd")
    own = {k: F.col(k) for k in ("c", "d", *SELF, "raked", "cc", "cd", "out")}
    to_parent = {"c": F.col("pc"), "d": F.col("pd"), "add_leaves": F.col("leaves"), "add_tokens": F.col("tokens")}
    to_child = {"c": F.col("cc"), "d": F.col("cd"), "new_pc": F.col("pc"), "new_pd": F.col("pd")}
    gone = F.col("out") == 1
    linked = _met(known, columns, (None, own), (gone, to_parent), (gone, to_child), add_leaves="", add_tokens="")
    return linked.select(
        "c", "d", F.coalesce("new_pc", "pc").alias("pc"), F.coalesce("new_pd", "pd").alias("pd"),
        *[(F.col(k) + F.coalesce(f"add_{k}", F.lit(0))).alias(k) for k in ("leaves", "tokens")],
        "kids", "cc", "cd", F.when(F.col("out") == 1, 2).when(F.col("raked") == 1, 1).otherwise(0).alias("status"),
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``c``, ``d``, ``leaves``, ``tokens`` summed over every node's subtree, for a forest of nodes as in ``contract``."""
    layers, live = [], tree.select("c", "d", *SELF)
    while True:
        layer = checkpoint(contract(live, len(layers)))
        layers.append(layer)
        live = layer.where("status = 0").select("c", "d", *SELF)
        if not live.head(1):
            break
    cols, known = ("c", "d", "leaves", "tokens"), None
    for turn, layer in reversed(list(enumerate(layers))):
        raked = layer.where("status = 1").select(*cols)
        if known is not None:
            out = layer.where("status = 2").select(
                F.col("c").alias("oc"), F.col("d").alias("od"), F.col("cc").alias("c"), F.col("cd").alias("d"),
                F.col("leaves").alias("ol"), F.col("tokens").alias("ot"),
            )
            both = F.array(
                F.struct(*cols),
                F.when(
                    F.col("oc").isNotNull(),
                    F.struct(
                        F.col("oc").alias("c"), F.col("od").alias("d"),
                        (F.col("leaves") + F.col("ol")).alias("leaves"), (F.col("tokens") + F.col("ot")).alias("tokens"),
                    ),
                ),
            )
            known = known.join(out, ["c", "d"], "left").select(F.explode(F.array_compact(both)).alias("r")).select("r.*")
            known = known.unionByName(raked)
            if turn and turn % STORE_EVERY == 0:
                known = checkpoint(known)
        else:
            known = raked
    return known


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``; ``n_leaves`` and ``saved_tokens`` are summed over the subtree. Null roles and texts
    are empty ones. Turns that tie are ordered by the MD5 of their content; repeated rows are turns of their own. Rows
    without a conversation id belong to none. Other columns are ignored; an empty table gives no node.
    """
    turns = checkpoint(turns_of(conversations))
    passed = checkpoint(prefixes(rebuilt(turns, every, heads)))
    nodes = nodes_of(passed)
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    kids = kids.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    nodes = checkpoint(nodes.join(end_digests(passed), "node", "left").drop("node"))
    tree = nodes.select(
        F.col("conv_id").alias("c"),
        F.col("depth").alias("d"),
        F.col("parent_conv_id").alias("pc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("pd"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"),
        F.col("n_children").alias("kids"),
    )
    totals = subtree_totals(tree).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens")
    )
    empty = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals, ["conv_id", "depth"])
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
