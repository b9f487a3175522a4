"""Substring dedup: words of repeated passages are removed from all occurrences but the first.

Seeds are winnowed anchors: of the ``ANCHOR``-word sequences in each window of ``window`` words the one with the smallest hash is
taken, so equal windows take the same anchor. Consecutive windows with the same anchor form a run - the anchor extended both ways
to the words of all its windows. Runs meet by anchor in one shuffle:

* a run equal to an earlier one (same anchor, same extension) repeats as a whole: a maximal repeat, removed at once;
* runs that share an anchor but not the extension match in part only; of each distinct one the first occurrence is resolved
  window by window, in a second shuffle that holds such windows alone;
* an anchor found in one extension only needs nothing more.

Texts are shuffled once, to meet the list of their repeated windows. Equal runs and windows are reduced to the first within a
chunk before each shuffle, so a passage of very many copies is no hot group, and groups are passed through in sorted order,
never gathered.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.sources.writers import checkpoint

from .common import add_columns, fresh, others, slices

ANCHOR = 8
CHUNK = 1 << 18  # runs or windows that are sorted at once
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2 ** 64
SCHEMA = "k1 bigint, k2 bigint, doc bigint, at bigint, n int, known boolean"


class _Powers:
    """Powers of the bases and of their inverses, as long as the longest text so far."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 12)

    def grow(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = max(size, 2 * self.size)
        self.up, self.down = [], []
        for base in BASES:
            for out, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                steps = np.full(self.size, b, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Hashes of any word range of one text."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        POWERS.grow(self.n + 1)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(w) for w in words], np.uint64, self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: self.n])]) for up in POWERS.up]

    def hash(self, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = (self.sums[base][end] - self.sums[base][start]) * POWERS.down[base][start]
        return mix(got + (end - start).astype(np.uint64))


def runs_of(seq: Sequence, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the extension, first window and number of windows of each run."""
    count = seq.n - window + 1
    size = min(ANCHOR, window)
    at = np.arange(seq.n - size + 1)
    grams = seq.hash(0, at, at + size)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    chosen = view.argmin(1) + np.arange(count)  # the leftmost of equals
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], count) - 1
    return grams[chosen[first]], seq.hash(1, first, last + window), first, last - first + 1


def place(text: bytes, start: np.ndarray) -> np.ndarray:
    """A window's place: 31 bits of the text's checksum, so that rows of one id with other texts stay apart, and its start."""
    return (start.astype(np.int64)) | np.int64((crc32(text) >> 1) << 32)


def first_only(k1, k2, doc, at, n):
    """Chunk reduced to the first row of each key; the others, which repeat it, are marked as known repeats."""
    order = np.lexsort((at, doc, k2, k1))
    k1, k2, doc, at, n = (x[order] for x in (k1, k2, doc, at, n))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else new
    twin = ~new & (doc == doc[head]) & (at == at[head])  # a repeated row of the table is no repeat in the text
    keep = ~twin
    return tuple(x[keep] for x in (k1, k2, doc, at, n, ~new))


class Chunks:
    """Collects rows and gives them out in reduced chunks."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def take(self, least: int = CHUNK):
        if not self.size or self.size < least:
            return
        k1, k2, doc, at, n = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        got = first_only(k1.view(np.int64), k2.view(np.int64), doc, at, n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["k1", "k2", "doc", "at", "n", "known"])


def find_runs(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches):
        chunks = Chunks()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                raw = text.encode()
                words = raw.split()
                if len(words) < window:
                    continue
                anchor, span, start, n = runs_of(Sequence(words), window)
                chunks.add(anchor, span, np.full(len(n), doc), place(raw, start), n)
                yield from chunks.take()
        yield from chunks.take(1)

    return docs.mapInArrow(scan, SCHEMA)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by key ``k1``, then ``k2``, then place: all of a ``k1`` in one partition, sorted."""
    return rows.repartition("k1").sortWithinPartitions("k1", "known", "k2", "doc", "at")


def resolve(rows: DataFrame) -> DataFrame:
    """``doc``, ``at``, ``n``, ``part``: repeats of an earlier row (part false), and firsts of keys that share ``k1`` (part true).

    Rows come sorted; of a group only its first row and whether it is mixed are remembered.
    """

    def walk(batches):
        k1 = k2 = doc0 = at0 = None  # the current group, the key in it and the place where that key is first
        held, mixed = None, False  # the first row of a group with one key so far; whether the group has more
        for batch in batches:
            a, b, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            known = batch.column(5).to_numpy(zero_copy_only=False)
            size = len(a)
            if not size:
                continue
            group = np.ones(size, bool)
            group[1:] = a[1:] != a[:-1]
            group[0] = k1 is None or a[0] != k1
            key = group.copy()
            key[1:] |= b[1:] != b[:-1]
            key[0] |= k2 is None or b[0] != k2
            key &= ~known
            # the first place of each row's key; before the first new key it is the one carried on
            head = np.cumsum(key) - 1
            heads = np.flatnonzero(key)
            carried = head < 0
            fd = np.where(carried, doc0 if doc0 is not None else 0, doc[heads[np.maximum(head, 0)]] if len(heads) else 0)
            fa = np.where(carried, at0 if at0 is not None else 0, at[heads[np.maximum(head, 0)]] if len(heads) else 0)
            gone = known | (~key & ((doc != fd) | (at != fa)))

            number = np.cumsum(group) - group[0]
            keys = np.bincount(number, key)
            if not group[0]:
                keys[0] += 2 if mixed else held is not None
            part = key & (keys[number] >= 2)
            out = [doc[gone], doc[part]], [at[gone], at[part]], [n[gone], n[part]], [np.zeros(gone.sum(), bool), np.ones(part.sum(), bool)]
            if held is not None:
                if not group[0] and keys[0] >= 2:
                    for o, v in zip(out, (*held, True)):
                        o.append(np.array([v]))
                    held = None
                elif group[0] or number[-1] > 0:
                    held = None
            last = number[-1]
            if last > 0 or group[0]:
                mixed = bool(keys[last] >= 2)
                own = np.flatnonzero(key & (number == last))
                held = None if mixed or not len(own) else (doc[own[0]], at[own[0]], n[own[0]])
            else:
                mixed = mixed or bool(keys[0] >= 2)
                own = np.flatnonzero(key)
                if held is None and not mixed and len(own):
                    held = doc[own[0]], at[own[0]], n[own[0]]
            k1, k2 = a[-1], (b[-1] if not known[-1] else None)
            doc0, at0 = fd[-1], fa[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(o).astype(t)) for o, t in zip(out, (np.int64, np.int64, np.int32, bool))],
                names=["doc", "at", "n", "part"],
            )

    return in_order(rows).mapInArrow(walk, "doc bigint, at bigint, n int, part boolean")


def find_windows(docs: DataFrame, window: int, text_at: int) -> DataFrame:
    """Rows for the single windows of the runs listed with each text."""

    def scan(batches):
        chunks = Chunks()
        for batch in slices(batches):
            lists = batch.column(text_at + 1)
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            ids, texts = batch.column(0), batch.column(text_at)
            for i in some:
                doc, raw = ids[int(i)].as_py(), texts[int(i)].as_py().encode()
                runs = lists[int(i)].values
                starts = runs.field(0).to_numpy() & np.int64(0xFFFFFFFF)
                sizes = runs.field(1).to_numpy().astype(np.int64)
                start = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                seq = Sequence(raw.split())
                keys = [seq.hash(base, start, start + window) for base in (0, 1)]
                chunks.add(*keys, np.full(len(start), doc), place(raw, start), np.ones(len(start), np.int64))
                yield from chunks.take()
        yield from chunks.take(1)

    return docs.mapInArrow(scan, SCHEMA)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    n_words: str = "n_words",
    n_removed: str = "n_removed",
) -> DataFrame:
    r"""``docs`` with repeated passages removed from ``text_col``, and ``n_words`` and ``n_removed`` (bigint).

    Words are separated by ``[\x20\x09-\x0D]+``. A word goes if it lies in a window of ``window`` words whose sequence also
    starts earlier: in a document with a smaller id (an integer), or in the same text further left; windows are judged on the
    input. The words kept are joined by one blank. Null and empty texts become empty. A row without an id is left whole
    and counts for no other. A repeated row is the same document and no repeat of itself; rows with one id but other
    texts are ordered by a checksum. Columns named like the two counts are replaced, others pass.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    found = checkpoint(resolve(find_runs(texts, window)))

    side = F.shiftright(F.crc32(F.col("text").cast("binary")), 1)
    here = texts.select("doc", side.alias("side"), "text")

    def listed(rows: DataFrame) -> DataFrame:
        by = rows.groupBy("doc", F.shiftright("at", 32).alias("side"))
        return by.agg(F.collect_list(F.struct("at", "n")).alias("list")).hint("shuffle_hash")

    partly = here.join(listed(found.where("part")), ["doc", "side"], "left").select("doc", "text", "list")
    again = resolve(find_windows(partly, window, 1)).where("not part")
    gone = checkpoint(found.where("not part").unionByName(again).select("doc", "at", "n"))
    lists = listed(gone)
    doc, side_col, list_col = (fresh(docs, c) for c in ("_doc", "_side", "_list"))
    lists = lists.select(F.col("doc").alias(doc), F.col("side").alias(side_col), F.col("list").alias(list_col))
    own = F.shiftright(F.crc32(F.col(f"`{text_col}`").cast("binary")), 1)
    joined = docs.join(
        lists.hint("shuffle_hash"), (F.col(f"`{id_col}`").cast("bigint") == F.col(doc)) & (own == F.col(side_col)), "left"
    )

    def make():
        def cut(texts, lists):
            kept, before, removed = [], [], []
            for text, runs in zip(texts, lists):
                words = (text or "").encode().split()
                n = len(words)
                before.append(n)
                if runs:
                    starts = np.array([r["at"] & 0xFFFFFFFF for r in runs], np.int64)
                    ends = starts + np.array([r["n"] for r in runs], np.int64) + window - 1
                    edges = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
                    stay = np.flatnonzero(np.cumsum(edges)[:n] == 0)
                    words = [words[i] for i in stay.tolist()]
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            return kept, before, removed

        return cut

    ddl = f"`{text_col}` string, `{n_words}` bigint, `{n_removed}` bigint"
    out = add_columns(joined.drop(doc, side_col), [text_col, list_col], make, ddl, [list_col])
    return out.select(*[f"`{c}`" for c in others(docs, (n_words, n_removed))], f"`{n_words}`", f"`{n_removed}`")
