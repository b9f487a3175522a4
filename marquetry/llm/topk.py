"""Exact top-k search by inner product: a ball tree per shard, branch and bound, one current k-th score per query.

A shard is what a task reads of the candidates, cut into trees of ``TREE`` vectors. A node is a ball; ``q . centre + |q| radius`` bounds
the product of a query with any vector inside. Each query descends into the child with the higher bound first and leaves
out nodes whose bound is below its k-th score so far. That score starts from a bounded sample of the candidates,
scored for all shards in advance, and is handed on from tree to tree. Only candidates that reach it leave the task.

Queries come in blocks of about ``BLOCK``, each broadcast, with one pass over the candidates per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREE = 16_384
LEAF = 128
BLOCK = 2_048
SEEDS = 4_096  # candidates that give the first k-th scores, about
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min


def quantised(ids: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and ``floor(scale * x)`` of the rows with an id and only finite components."""
    usable = pa.compute.and_(pa.compute.is_valid(ids), pa.compute.is_valid(vectors))
    ids, vectors = ids.filter(usable), vectors.filter(usable)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    starts = np.cumsum(sizes) - sizes
    names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
        fine = np.isfinite(x).all(1)
        out[int(dim)] = names[rows[fine]], x[fine]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of a bigint the nearest one."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], object).reshape(len(q), len(x))
    low, high = NONE + 1, np.iinfo(np.int64).max
    return np.array([[min(high, max(low, v)) for v in r] for r in exact], np.int64).reshape(len(q), len(x))


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.q, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors * vectors).sum(1))
        self.score = np.full((len(ids), k), NONE)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), NONE) if floor is None else floor  # scores below it cannot be among the k

    def kth(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[at, -1], self.floor[at])

    def offer(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        got = products(self.q[at], x)
        got[ids[None, :] == self.own[at][:, None]] = NONE  # not the query itself
        better = (got >= self.kth(at)[:, None]) & (got > NONE)
        some = better.any(1)
        at, got = at[some], np.where(better, got, NONE)[some]
        if not len(at):
            return
        score = np.concatenate([self.score[at], got], 1)
        name = np.concatenate([self.id[at], np.broadcast_to(ids, got.shape)], 1)
        name = np.where(score == NONE, np.iinfo(np.int64).max, name)
        order = np.lexsort((name, -np.maximum(score, NONE + 1)), axis=1)[:, : self.k]
        self.score[at] = np.take_along_axis(score, order, 1)
        self.id[at] = np.take_along_axis(name, order, 1)


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, x, leaf
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, at: np.ndarray):
        x = self.x[at]
        centre = x.mean(0)
        away = x - centre
        radius = float(np.sqrt((away * away).sum(1).max()))
        if len(at) <= self.leaf or radius == 0:
            return centre, radius, at, None
        # split along the line between two far points
        a = x[np.argmax((away * away).sum(1))]
        b = x[np.argmax(((x - a) ** 2).sum(1))]
        side = x @ (b - a)
        half = len(at) // 2
        order = np.argpartition(side, half)
        return centre, radius, None, (self._grow(at[order[:half]]), self._grow(at[order[half:]]))

    def bound(self, node, best: Best, at: np.ndarray) -> np.ndarray:
        centre, radius = node[:2]
        slack = 1e-9 * best.norm[at] * (np.sqrt(centre @ centre) + radius) + 1e-6  # rounding of the bound itself
        return best.q[at] @ centre + best.norm[at] * radius + slack

    def search(self, best: Best) -> None:
        if len(self.ids):
            self._visit(self.root, best, np.arange(len(best.own)))

    def _visit(self, node, best: Best, at: np.ndarray) -> None:
        at = at[self.bound(node, best, at) >= best.kth(at)]
        if not len(at):
            return
        if node[2] is not None:
            rows = node[2]
            for start in range(0, len(rows), 4 * self.leaf):
                some = rows[start : start + 4 * self.leaf]
                best.offer(at, self.ids[some], self.x[some])
            return
        left, right = node[3]
        first = self.bound(left, best, at) >= self.bound(right, best, at)
        self._visit(left, best, at[first])
        self._visit(right, best, at)
        self._visit(left, best, at[~first])


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), the candidate's ``id_col`` and ``score`` (bigint), exact.

    Components are ``floor(scale * x)``. Ties go to the smaller id; a query with fewer candidates has fewer rows. Rows
    without an id, with a null vector or with a null or non-finite component take no part, nor do candidates of
    another dimension or with the query's own id. Repeated query rows count once, repeated candidates each. No query or no
    candidate gives no row.
    """
    spark = queries.sparkSession
    pick = lambda df: df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    asked, rows = pick(queries).where("id is not null and v is not null").distinct(), pick(candidates)
    n, m = asked.count(), rows.count()
    out = None
    seeds = rows.where(F.pmod(F.xxhash64("id", F.lit("seed")), F.lit(max(1, m // SEEDS))) == 0).distinct().toArrow()
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "v").toArrow()  # about ``block`` rows
        part = _one_block(spark, own, seeds, rows, k, scale).withColumn("block", F.lit(b))
        out = part if out is None else out.unionAll(part)
    by = Window.partitionBy("block", "query_id", "q").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _chunk(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    return tuple(c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in table.columns)


def _one_block(spark, own: pa.Table, seeds: pa.Table, rows: DataFrame, k: int, scale: int) -> DataFrame:
    schema = "query_id bigint, q bigint, id bigint, score bigint"
    asked = quantised(*_chunk(own), scale) if own.num_rows else {}
    first = quantised(*_chunk(seeds), scale) if seeds.num_rows else {}
    start = {}
    for dim, (ids, x) in asked.items():
        best = Best(ids, x, k)
        if dim in first:
            BallTree(*first[dim]).search(best)
        start[dim] = ids, x, best.score[:, -1].copy()
    held = spark.sparkContext.broadcast(start)  # one block of queries

    def search(batches):
        best = {dim: Best(ids, x, k, floor) for dim, (ids, x, floor) in held.value.items()}
        waiting: dict[int, list] = {}

        def flush(dim):
            parts = waiting.pop(dim)
            BallTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).search(best[dim])

        for batch in batches:
            for dim, part in quantised(batch.column(0), batch.column(1), scale).items():
                if dim in best and len(part[0]):
                    waiting.setdefault(dim, []).append(part)
                    if sum(len(p[0]) for p in waiting[dim]) >= TREE:
                        flush(dim)
        for dim in list(waiting):
            flush(dim)
        for b in best.values():
            q, r = np.nonzero(b.score > NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.own[q]), pa.array(q), pa.array(b.id[q, r]), pa.array(b.score[q, r])],
                names=["query_id", "q", "id", "score"],
            )

    return rows.mapInArrow(search, schema)
