"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

The items are cut into windows of ``window`` words; the automaton holds every window, and each document is scanned
once. Words are found in the original text, so every match maps back to offsets there. The item table is
small by nature, but its size is measured all the same: items are dealt over as many blocks as needed to keep each
automaton under ``BLOCK_BYTES`` of item text, one narrow pass per block, with no shuffle in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh

WINDOW = 13
BLOCK_BYTES = 256 << 10
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def normalise(text: str | None) -> str:
    """The words with a blank before and after each, so that a match of whole words is a match of the string."""
    inner = GAP.sub(" ", lower_az(text or "")).strip(" ")
    return f" {inner} " if inner else ""


def windows_of(text: str | None, size: int) -> set[str]:
    words = WORD.findall(lower_az(text or ""))  # only ASCII signs part words, here as in documents
    if not words:
        return set()
    return {f" {' '.join(words[i : i + size])} " for i in range(max(1, len(words) - size + 1))}


def build(items: Iterable[tuple[str, str | None]], size: int) -> ahocorasick.Automaton | None:
    """Automaton from window to (length in characters, items that hold it); None without any window."""
    held: dict[str, list[str]] = {}
    for item, text in items:
        for w in windows_of(text, size):
            held.setdefault(w, []).append(item)
    auto = ahocorasick.Automaton()
    for w, own in held.items():
        auto.add_word(w, (len(w), tuple(own)))
    if not held:
        return None
    auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, text: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [first, past the last) character ranges of the normalised ``text`` that are hit, and the items."""
    ranges: list[list[int]] = []
    items: set[str] = set()
    starts = []
    for end, (length, own) in auto.iter(text):
        starts.append((end - length + 1, end))  # the blank after the last word is shared with the next word
        items.update(own)
    for a, b in sorted(starts):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    return [(a, b) for a, b in ranges], items


def word_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers of the words [first, past the last) inside character ranges of the normalised text."""
    out, seen, at = [], 0, 0
    for a, b in ranges:
        seen += text.count(" ", at, a)
        inside = text.count(" ", a, b)
        out.append((seen, seen + inside))
        seen, at = seen + inside, b
    return out


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = True,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_hit`` (bigint), ``items`` (sorted strings) and ``spans``.

    ``spans`` lists the [start, end) character offsets in the original text of each run of hit words. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A document word
    inside any occurrence of a window is hit. Null and empty texts have no words; items without an id still hit but are
    not listed; repeated items and repeated rows are each treated alike. ``prefix`` is put before the new columns' names
    where ``docs`` has columns of these names; others pass through.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("body"))
    items = items.where(F.col("body").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("body")), F.max(F.octet_length("body"))).first()
    blocks = max(1, -(-(total[0] or 0) // block_bytes))
    state = fresh(docs, "_spans"), fresh(docs, "_items")
    out = docs.withColumn(state[0], F.lit(None).cast("array<bigint>")).withColumn(state[1], F.lit(None).cast("array<string>"))
    names = [f"{prefix}{n}" for n in ("n_words", "n_hit", "items", "spans")]
    carried = f"`{state[0]}` array<bigint>, `{state[1]}` array<string>"
    result = f"`{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` array<string>, `{names[3]}` array<array<bigint>>"
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block)
        # bounded: about block_bytes of text
        held = spark.sparkContext.broadcast([tuple(r) for r in mine.toLocalIterator()])
        last = block == blocks - 1  # the last pass also gives the result
        make = _one_block(held, window, last, spans)
        out = add_columns(out, [text_col, *state], make, result if last else carried, state if last else ())
    return out


def _one_block(held, window, last, spans):
    def make():
        auto = build(held.value, window)

        def step(texts, found, items):
            words, hits, offsets = [], [], []
            for i, text in enumerate(texts):
                norm = normalise(text)
                ranges, own = scan(auto, norm) if auto and norm else ((), ())
                if ranges:
                    flat = [x for span in word_spans(norm, ranges) for x in span]
                    found[i] = (found[i] or []) + flat
                    items[i] = sorted({*(items[i] or ()), *(x for x in own if x is not None)})
                if last:
                    runs = merge(found[i])
                    words.append(max(0, norm.count(" ") - 1))
                    hits.append(sum(b - a for a, b in runs))
                    items[i] = items[i] or []
                    offsets.append(original(text, runs) if spans else [])
            return (words, hits, items, offsets) if last else (found, items)

        return step

    return make


def merge(flat: list[int] | None) -> list[tuple[int, int]]:
    """Word ranges (flat list of firsts and ends) sorted, with overlaps joined."""
    out: list[list[int]] = []
    flat = flat or []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original(text: str | None, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Character offsets in the text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(lower_az(text))]
    return [[at[a][0], at[b - 1][1]] for a, b in runs]


def contaminated(n_hit: str, n_words: str, share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))
