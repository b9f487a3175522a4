"""Token counts by prefix dynamic programming.

For merge-based tokenizers every prefix of a text has exactly one last token: the one that ends there and is a
valid neighbour of the last token of the prefix before it. So one left-to-right pass yields the exact token count of
every prefix, and truncation or budget questions are answered from the stored counts without encoding again.

No piece of the vocabulary reaches over a word start, so the pass runs on units of one word, and a task keeps the tables of
units it has met (a bounded number). The table of a text is stored as differences, one signed byte per code point.
"""

from __future__ import annotations

import re
from array import array
from operator import sub

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, kept

SPACE = "▁"  # how the vocabulary writes a blank
UNITS = 400_000  # tables a task keeps; beyond that it starts anew
LONGEST = 64  # longer units are not kept
PAIRS = 300_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece BPE model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


class PrefixCounter:
    """Counts of every prefix under a scored BPE vocabulary with byte fallback and a leading blank."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        ranks = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True), 1)}
        self.time = {p: ranks[s] for p, s in pieces if len(p) > 1}
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        ends: dict[str, set[int]] = {}
        for p in self.time:
            if self.merge(p) == [p]:  # a piece that merging never yields ends no prefix
                ends.setdefault(p[-3:], set()).add(len(p))
            else:
                self.left.pop(p, None)
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items() if len(k) == 3}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}
        self.inside = {p[i : i + 2] for p in self.time for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in self.inside):
            self.split = lambda text: [text] if text else []
        elif any("\n" in x for x in self.inside):
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    def merge(self, text: str) -> list[str]:
        """Tokens of a piece by merging, best score first, leftmost first among equals; notes the last merge."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if len(parts) == 2:
                self.left[text], self.right[text] = parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether token ``b`` may follow token ``a``: no merge reaches over their border while its two parts exist."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = a[-1] + b[0] not in self.inside or self._border(a, b)
        return known

    def _border(self, a: str, b: str) -> bool:
        time, left, right = self.time, self.left, self.right
        until = len(time) + 1
        while True:
            part, seen = a, until
            while part is not None:
                if time.get(part + b, seen + 1) <= seen:
                    return False
                seen = min(seen, time.get(part, 0) - 1)  # among equals the merge further left comes first
                part = right.get(part)
            if b not in left:
                return True
            until, b = time[b], left[b]

    def counts(self, unit: str) -> list[int]:
        """Token counts of the prefixes of length 1, 2, ... of a unit."""
        n, left, score, ends, pairs, neighbours = len(unit), self.left, self.score, self.ends, self.pairs, self.neighbours
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in (*ends.get(unit[max(0, i - 3) : i], ()), 2):
                j = i - size
                if j < 0:
                    continue
                token = unit[j:i]
                if token in left and (not j or pairs.get((last[j], token)) or neighbours(last[j], token)):
                    last[i] = token
                    count[i] = count[j] + 1
                    break
            else:
                token = last[i] = unit[i - 1]
                count[i] = count[i - 1] + (1 if token in score else len(token.encode()))
        return count[1:]

    def table(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            # last signs that merge with nothing before them are counted by themselves
            end = len(unit)
            while end > 1 and unit[end - 2 : end] not in self.inside:
                end -= 1
            if end < len(unit):
                known = self.units
                return b"".join([known.get(u) or self.table(u) for u in (unit[:end], *unit[end:])])
            counts = self.counts(unit)
            found = array("b", map(sub, counts, [0, *counts])).tobytes()
            if len(unit) <= LONGEST:
                if len(self.units) >= UNITS:
                    self.units.clear()
                self.units[unit] = found
        return found

    def steps(self, text: str | None) -> np.ndarray:
        """Differences between the counts of successive prefixes of ``text``, by code point."""
        if not text:
            return np.zeros(0, np.int8)
        units = self.split(SPACE + text.replace(" ", SPACE))
        known, table = self.units, self.table
        steps = np.frombuffer(b"".join([known.get(u) or table(u) for u in units]), np.int8).copy()
        steps[1] += steps[0]  # the leading blank is no prefix of the text
        return steps[1:]


def prefix_token_counts(
    docs: DataFrame,
    pieces: list[tuple[str, float]],
    text_col: str = "text",
    n_bytes: str = "n_bytes",
    n_tokens: str = "n_tokens",
    steps: str = "prefix_steps",
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` (bigint) and ``prefix_steps`` (binary).

    Byte ``p`` of ``prefix_steps`` (signed) is the number of tokens that code point ``p`` adds, so sums from the start are
    the exact counts of all prefixes. Null and empty texts have no tokens and an empty table. Whole texts are counted,
    however long; rows, ties and repeats do not matter to each other; columns with the names of outputs are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # the size of a vocabulary

    def make():
        counter = _counter(held.value)

        def count(texts):
            tables = [counter.steps(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            return sizes, [int(t.sum(dtype=np.int64)) for t in tables], [t.tobytes() for t in tables]

        return count

    return add_columns(docs, [text_col], make, f"`{n_bytes}` bigint, `{n_tokens}` bigint, `{steps}` binary")


def _counter(pieces: list[tuple[str, float]]) -> PrefixCounter:
    """One counter per Python worker, so that its tables serve the next task as well."""
    return kept(("token counts", hash(tuple(pieces))), lambda: PrefixCounter(pieces))


def over_budget(budget: int, n_tokens: str = "n_tokens") -> Column:
    return F.col(n_tokens) > budget


def longest_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate(counted: DataFrame, budget: int, text_col: str = "text", steps: str = "prefix_steps") -> DataFrame:
    """``text_col`` cut to the longest prefix of at most ``budget`` tokens, from the stored counts alone."""

    def make():
        def cut(texts, tables):
            return ([t if t is None else t[: longest_prefix(s, budget)] for t, s in zip(texts, tables)],)

        return cut

    return add_columns(counted, [text_col, steps], make, f"`{text_col}` string")
