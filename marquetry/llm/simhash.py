"""SimHash near-dedup: fingerprints, and exact links between them found with vantage-point trees.

Documents with one fingerprint are one node. A vantage-point tree over a bounded sample of the nodes splits the space into
shards: each split has a vantage point and a radius, and a node lives inside or outside. Two linked nodes differ by at most
``max_bits`` in their distance to any vantage point, so a node that lives inside but close to the border also visits
the outside, and a visitor goes to both sides where it is close to a border. Every pair of linked nodes meets
in the shard where one of them lives. A shard orders its nodes by distance to one more vantage point and compares only
those whose distances to it differ by ``max_bits`` or less, in blocks, and returns a star per connected set, never all
pairs. Shards of more than ``OVERSIZE`` times the usual size are cut into parts of which each node lives in one and visits
the others.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.sources.writers import checkpoint

from .common import add_columns, fresh
from .components import connected

SEED = 42
SAMPLE = 32_768  # nodes from which the tree is built, about
LEAF = 2_048  # nodes that live in a shard, about
OVERSIZE = 4
BLOCK = 1 << 20  # pairs compared at once
HELD = 1 << 20  # links held before they are contracted


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash of the ``size``-word shingles of a text, A-Z lower-cased; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)], ">u8", n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed bigint ``out``; null and empty texts have 0."""

    def make():
        return lambda texts: ([fingerprint(t, size) for t in texts],)

    return add_columns(docs, [text_col], make, f"`{out}` bigint")


class Tree:
    """Vantage points, radii and children of the splits; a child below zero is shard ``-1 - child``."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int):
        self.point: list[int] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []
        self.shards = 0
        self.rng = np.random.default_rng(7)
        self.root = self._grow(sample, total / max(1, len(sample)), leaf)

    def _grow(self, own: np.ndarray, weight: float, leaf: int) -> int:
        best = None
        if len(own) >= 8 and len(own) * weight > leaf:
            for at in self.rng.integers(0, len(own), 12):  # the point with the least crowded border
                d = np.bitwise_count(own ^ own[at])
                r = int(np.median(d))
                inside = d <= r
                near = int(np.count_nonzero((d > r - 2) & (d <= r + 2)))
                if not inside.all() and (best is None or near + abs(2 * inside.sum() - len(own)) < best[0]):
                    best = near + abs(2 * int(inside.sum()) - len(own)), int(own[at]), r, inside
        if best is None:
            self.shards += 1
            return -self.shards
        node = len(self.point)
        self.point.append(best[1])
        self.radius.append(best[2])
        self.child.append([0, 0])
        self.child[node] = [self._grow(own[best[3]], weight, leaf), self._grow(own[~best[3]], weight, leaf)]
        return node

    def deal(self, fps: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: its number, positions in ``fps`` and whether each lives there."""
        out = []
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((-1 - node, at, own))
                continue
            d = np.bitwise_count(fps[at] ^ np.uint64(self.point[node])).astype(np.int16)
            r = self.radius[node]
            home = d <= r
            inner = np.where(own, home, d <= r + reach)
            outer = np.where(own, ~home | (d > r - reach), d > r - reach)
            todo.append((self.child[node][0], at[inner], own[inner]))
            todo.append((self.child[node][1], at[outer], (own & ~home)[outer]))
        return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def shard_links(fps: np.ndarray, own: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, centre) of the links between a node that lives in the shard and any other node in it."""
    here = np.flatnonzero(own)
    if not len(here):
        return fps[:0], fps[:0]
    point = fps[here[0]]
    far = np.bitwise_count(fps ^ point).astype(np.int64)
    order = np.argsort(far, kind="stable")
    fps, own, far = fps[order], own[order], far[order]
    here = np.flatnonzero(own)
    a_all, b_all, held = [], [], 0
    for d in np.unique(far[here]):
        mine = here[far[here] == d]
        lo, hi = np.searchsorted(far, [d - reach, d + reach + 1])
        step = max(1, BLOCK // max(1, hi - lo))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            x, y = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[None, lo:hi]) <= reach)
            a, b = rows[x], y + lo
            apart = a != b
            a_all.append(a[apart])
            b_all.append(b[apart])
            held += len(a_all[-1])
            if held > HELD:
                root = local_roots(len(fps), np.concatenate(a_all), np.concatenate(b_all))
                tied = np.flatnonzero(root != np.arange(len(fps)))
                a_all, b_all, held = [tied], [root[tied]], len(tied)
    root = local_roots(len(fps), np.concatenate(a_all), np.concatenate(b_all))
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return fps[tied], fps[root[tied]]


def near_links(nodes: DataFrame, max_bits: int, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the distinct fingerprints ``fp`` linked within ``max_bits``.

    ``nodes`` holds each fingerprint once. The tree is built in the driver from about ``sample`` fingerprints chosen by
    hash; all nodes are dealt by it and searched on the executors.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    share = max(1, total // sample)
    chosen = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").collect()
    tree = Tree(np.sort(np.array([r[0] for r in chosen], np.int64)).view(np.uint64), total, leaf)
    held = spark.sparkContext.broadcast(tree)

    def sizes(batches):
        count = np.zeros(tree.shards, np.int64)
        for batch in batches:
            for shard, _, own in held.value.deal(_fps(batch), max_bits):
                count[shard] += own.sum()
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["shard", "n"])

    most = OVERSIZE * leaf
    by_shard = nodes.select("fp").mapInArrow(sizes, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n"))
    parts = {r["shard"]: -(-r["n"] // leaf) for r in by_shard.where(F.col("n") > most).collect()}

    def deal(batches):
        for batch in batches:
            fps = _fps(batch)
            for shard, at, own in held.value.deal(fps, max_bits):
                got, cut = fps[at], parts.get(shard, 1)
                part = (got * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(cut)
                for k in range(cut):
                    stays = own & (part == k)
                    there = stays | (~own if cut == 1 else (~own | (part < k)))
                    if there.any():
                        n = int(there.sum())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, shard)),
                                pa.array(np.full(n, k)),
                                pa.array(got[there].view(np.int64)),
                                pa.array(stays[there]),
                            ],
                            names=["shard", "part", "fp", "own"],
                        )

    def search(table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(fps, table.column("own").to_numpy(), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = nodes.select("fp").mapInArrow(deal, "shard bigint, part bigint, fp bigint, own boolean")
    return dealt.groupBy("shard", "part").applyInArrow(search, "a bigint, b bigint")


def _fps(batch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2
) -> DataFrame:
    """``id_col``, ``fp`` (bigint) and ``component`` (smallest id reachable over links) for every row.

    Documents are linked if their fingerprints differ in ``max_bits`` bits or fewer; null and empty texts have the
    fingerprint zero and are linked like any other. Repeated rows give repeated rows. A row without an id takes part as a node
    but names no component: its component is the smallest id linked to it, or null. An empty table gives an empty one.
    """
    marked = checkpoint(fingerprints(docs.select(f"`{id_col}`", f"`{text_col}`"), text_col, size, "_fp").drop(text_col))
    marked = marked.select(F.col(f"`{id_col}`").alias("id"), F.col("_fp").alias("fp"))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected(near_links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of = named.join(least, "root").select("fp", "component")
    return marked.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2
) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their component; all columns stay.

    Rows without an id stay, and so do all rows of an id that stays.
    """
    found = near_duplicates(docs, id_col, text_col, size, max_bits)
    gone = found.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("_gone")).distinct()
    # an id that is the smallest of one component by another of its rows stays
    own = found.where(F.col(id_col) == F.col("component")).select(F.col(id_col).alias("_kept")).distinct()
    gone = gone.join(own, F.col("_gone") == F.col("_kept"), "left_anti")
    out = fresh(docs, "_gone")
    return docs.join(gone.withColumnRenamed("_gone", out), F.col(f"`{id_col}`") == F.col(out), "left_anti")
