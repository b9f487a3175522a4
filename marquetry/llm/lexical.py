r"""Ranked lexical search: BM25-like integer scores, searched in buckets of impact vectors ordered by length (after LEMP).

1. One Arrow pass over the texts counts terms and keeps those that can belong to an item: a table of ``PLACES`` bits, set
   at the hashes of the items' terms, decides. What is kept - terms with counts - is stored once; all statistics
   (number of documents, lengths, document frequencies) are aggregates of it.
2. Documents are dealt by random number to shards of bounded size, and the items, in blocks of ``ITEMS``, follow them to
   every shard: sorted, a shard is its documents and then its blocks of items, so a task holds one shard and one block.
3. In a shard the impact vectors are ordered by length and cut in buckets. For each item the buckets are visited in that
   order. Cauchy-Schwarz ends the search at the first bucket too short to reach the item's current tenth score. In a
   bucket the heaviest coordinates of the item are multiplied out; they and the length of what remains bound each
   score, and only documents whose bound reaches the tenth score are scored again, exactly in integers.
4. Of each shard the ``k`` best documents of an item are ranked with those of the other shards.

A score is the product of an item's weights and a document's impacts. Coordinates are scaled by the root of the weight
(the largest weight at that place of the table, a bound known to both sides) before lengths are taken, which makes
the bounds tighter and leaves products as they are. Bounds are raised by one part in 10^9 against rounding.
"""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marquetry.sources.writers import checkpoint

from .common import ROWS_AT_ONCE, explode_rows, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLACES = 1 << 20
ITEMS = 64  # items that a task holds at a time
SHARD_TERMS = 2_000_000  # terms of documents that a task holds, on average
BUCKET = 2_048  # vectors
FOCUS = 0.9  # share of an item's squared length that is multiplied out before the bound is taken
KNOWN = 500_000  # terms whose place a worker remembers

# bytes to bytes: what separates terms becomes a blank, A-Z become a-z
_SIGNS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The maximal matches of ``TERM`` with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_SIGNS).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


def place(term: bytes) -> int:
    """Spark's ``xxhash64(term)`` modulo ``PLACES``."""
    return xxhash.xxh64_intdigest(term, 42) % PLACES


def _place(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(PLACES)).cast("int")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``item`` (a number for the row's content), ``term``, ``times`` for the distinct rows of ``items``."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "text"))

    def make():
        def run(ids, numbers, texts):
            out = ([], [], [], [])
            for own, number, text in zip(ids, numbers, texts):
                for term, times in counted(text).items():
                    for col, value in zip(out, (own, number, term.decode(), times)):
                        col.append(value)
            return out

        return run

    return explode_rows(rows, ["item_id", "item", "text"], make, f"item_id {kind}, item bigint, term string, times bigint")


def _table(places: DataFrame, value: str) -> np.ndarray:
    """A value for each place; at most ``PLACES`` rows of two numbers reach the driver."""
    got = places.toArrow()
    out = np.zeros(PLACES, np.int32)
    out[got.column("place").to_numpy()] = got.column(value).to_numpy()
    return out


def impacts(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), the terms at ``wanted`` places with their counts, and a random ``deal``."""
    bits = np.packbits(wanted.astype(bool))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType.fromDDL(f"doc_id {id_type.simpleString()}, n bigint, terms array<string>, times array<int>, deal bigint")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        keep, known, rng = np.unpackbits(bits), {}, random.Random()
        for batch in slices(batches, ROWS_AT_ONCE):
            sizes, terms, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                counts = counted(text)
                sizes.append(sum(counts.values()))
                for term, n in counts.items():
                    is_kept = known.get(term)
                    if is_kept is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        is_kept = known[term] = bool(keep[place(term)])
                    if is_kept:
                        terms.append(term)
                        times.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    pa.array([rng.getrandbits(62) for _ in sizes], pa.int64()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


class Shard:
    """The impact vectors of a shard, ordered by length, and the search in them."""

    def __init__(self, docs: pa.Table, n_docs: int, n_terms: int, weights: np.ndarray, bucket: int = BUCKET):
        docs = docs.combine_chunks()
        n = docs.column("n").to_numpy()
        norm = 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)
        lists = docs.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        words = lists.flatten().dictionary_encode()
        spelled = [x.encode() for x in words.dictionary.to_pylist()]
        self.number = {t: i for i, t in enumerate(spelled)}
        bound = np.array([weights[place(t)] for t in spelled], np.float64) if spelled else np.zeros(0)
        term = words.indices.to_numpy().astype(np.int64)
        tf = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), lengths)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[row])
        square = impact.astype(np.float64) ** 2 * bound[term] if len(term) else np.zeros(0)
        length2 = np.bincount(row, square, len(n)) if len(n) else np.zeros(0)
        order = np.argsort(-length2, kind="stable")
        at = np.empty(len(n), np.int64)
        at[order] = np.arange(len(n))
        self.ids = docs.column("doc_id").combine_chunks().take(pa.array(order))
        self.by_id = np.empty(len(n), np.int64)
        self.by_id[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(n))  # nulls last
        self.length2 = length2[order]
        self.buckets = []
        pos, used = at[row], bound[term] > 0 if len(term) else np.zeros(0, bool)
        pos, term, impact, square = pos[used], term[used], impact[used], square[used]
        home = pos // bucket
        by = np.lexsort((pos, term, home))
        pos, term, impact, square, home = pos[by], term[by], impact[by], square[by], home[by]
        cuts = np.searchsorted(home, np.arange(-(-len(n) // bucket) + 1))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            starts = np.flatnonzero(np.r_[True, term[lo + 1 : hi] != term[lo : hi - 1]]) if hi > lo else np.zeros(0, int)
            spans = dict(zip(term[lo + starts].tolist(), zip((lo + starts).tolist(), np.r_[lo + starts[1:], hi].tolist())))
            self.buckets.append((b * bucket, min((b + 1) * bucket, len(n)), spans))
        self.pos, self.impact, self.square, self.bound = pos, impact, square, bound

    def search(self, terms: list[bytes], weights: list[int], k: int) -> list[tuple[int, int]]:
        """Positions and scores of the ``k`` best documents of an item, equal scores by id."""
        own = [(self.number.get(t), w) for t, w in zip(terms, weights)]
        own = [(t, w, w / np.sqrt(self.bound[t])) for t, w in own if t is not None and self.bound[t] > 0]
        if not own:
            return []
        own.sort(key=lambda x: -x[2])
        left2 = np.cumsum([x[2] ** 2 for x in own][::-1])[::-1]
        focus = max(1, int(np.sum(left2 > (1 - FOCUS) * left2[0])))
        rest = np.sqrt(left2[focus]) if focus < len(own) else 0.0
        found_at, found, least = [], np.zeros(0, np.int64), 1
        for lo, hi, spans in self.buckets:
            # vectors are ordered by length: no later bucket reaches what this one cannot
            if np.sqrt(left2[0] * self.length2[lo]) * (1 + 1e-9) < least:
                break
            part, seen2 = np.zeros(hi - lo), np.zeros(hi - lo)
            for t, w, _ in own[:focus]:
                if span := spans.get(t):
                    here = slice(*span)
                    at = self.pos[here] - lo
                    part[at] += w * self.impact[here]
                    seen2[at] += self.square[here]
            bound = part + rest * np.sqrt(np.maximum(self.length2[lo:hi] - seen2, 0) + 1e-9 * self.length2[lo:hi])
            alive = bound * (1 + 1e-9) >= least
            if not alive.any():
                continue
            exact = np.zeros(hi - lo, np.int64)
            for t, w, _ in own:
                if span := spans.get(t):
                    here = slice(*span)
                    at = self.pos[here] - lo
                    good = alive[at]
                    exact[at[good]] += w * self.impact[here][good]
            kept = np.flatnonzero(exact >= least)
            found_at.append(kept + lo)
            found = np.concatenate([found, exact[kept]])
            if len(found) >= k:
                least = max(least, int(np.partition(found, len(found) - k)[len(found) - k]))
        at = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
        best = np.lexsort((self.by_id[at], -found))[:k]
        return list(zip(at[best].tolist(), found[best].tolist()))


def rank(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_text_col: str = "text",
    shard_terms: int = SHARD_TERMS,
    bucket: int = BUCKET,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` best documents with a score above 0 for each item.

    Null and empty texts have no terms and are never found. Equal scores are ordered by document id, null ids last. Rows of
    ``docs`` with the same id, or without one, are documents of their own. Repeated rows of ``items`` are one item; rows that
    share an id but not the text are ranked apart. An item without a term that some document has, an empty table of
    items or of documents give no rows. Other columns are ignored.
    """
    item_type = items.schema[item_col].dataType
    doc_type = docs.schema[id_col].dataType
    asked = checkpoint(item_terms(items, item_col, item_text_col))
    wanted = _table(asked.select(_place("term").alias("place"), F.lit(1).alias("wanted")).distinct(), "wanted")
    stored = checkpoint(impacts(docs, id_col, text_col, wanted))
    totals = stored.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("kept")
    ).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0

    df = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = asked.join(df, "term").select("item_id", "item", "term", "times", weight.alias("weight")).where("weight > 0")
    weighed = checkpoint(weighed)
    tops = weighed.groupBy(_place("term").alias("place")).agg(F.max("weight").cast("int").alias("weight"))
    bounds = _table(tops, "weight")

    shards = max(1, -(-(totals["kept"] or 0) // shard_terms))
    blocks = max(1, -(-weighed.select("item").distinct().count() // items_at_once))
    own = F.struct(F.col("term"), (F.col("times") * F.col("weight")).alias("weight"))
    vectors = weighed.groupBy("item_id", "item").agg(F.collect_list(own).alias("own"))
    grouped = vectors.groupBy(F.pmod("item", F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("item_id", "item", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"))).alias("asked")
    )
    asked_of = grouped.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("block").alias("seq"), "asked")
    held = stored.where(F.size("terms") > 0).select(
        F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("bigint").alias("seq"), "doc_id", "n", "terms", "times"
    )
    rows = held.unionByName(asked_of, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "seq")

    names = {"item_id": item_type, "item": T.LongType(), "doc_id": doc_type, "score": T.LongType()}
    schema = T.StructType([T.StructField(n, t) for n, t in names.items()])

    def run(batches):
        at, parts, shard = None, [], None
        for batch in batches:
            keys, seqs = batch.column("shard").to_numpy(), batch.column("seq").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (seqs[1:] != seqs[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != at:
                    at, parts, shard = keys[lo], [], None
                if seqs[lo] < 0:
                    parts.append(batch.slice(lo, hi - lo).select(["doc_id", "n", "terms", "times"]))
                    continue
                if not parts and shard is None:
                    continue  # items have met no documents here
                if shard is None:
                    shard, parts = Shard(pa.Table.from_batches(parts), n_docs, n_terms, bounds, bucket), []
                for asked_here in batch.slice(lo, hi - lo).column("asked").to_pylist():
                    yield from _answers(shard, asked_here, k, schema)

    found = rows.mapInArrow(run, schema)
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answers(shard: Shard, asked: list[dict], k: int, schema: T.StructType):
    ids, numbers, at, scores = [], [], [], []
    for item in asked:
        for pos, score in shard.search([t.encode() for t in item["terms"]], item["weights"], k):
            ids.append(item["item_id"])
            numbers.append(item["item"])
            at.append(pos)
            scores.append(score)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids, to_arrow_type(schema["item_id"].dataType)),
            pa.array(numbers, pa.int64()),
            shard.ids.take(pa.array(at, pa.int64())),
            pa.array(scores, pa.int64()),
        ],
        names=schema.names,
    )
