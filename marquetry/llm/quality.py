"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns (at most 3 ** labellers rows, whatever the corpus) estimates how often each labeller is right for good and for bad
documents, without any given label; the posterior of its pattern is the label of a document. A hashed linear scorer over
word shapes is trained on the posterior labels of a bounded sample and scores all documents, so that
it also judges documents on which the labellers abstain or differ.
"""

from __future__ import annotations

import re
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, kept

BAD, NONE, GOOD = 0, 1, 2
SAMPLE = 6_000  # documents that train the scorer, chosen by hash
BUCKETS = 1 << 12
FEW = 20  # words below which shares say little
CHUNK = 500  # words within which distinct ones are counted, so that the measure does not fall with the length
SYMBOLS = b"#$%&*|!~^_=<>@+\\{}[]"
UPPER = bytes(range(65, 91))
RUNS = re.compile(rb"[#$%&*|!~^_=<>@+?]{2,}|\s\|\s")


def _side(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(text: str | None) -> list[int]:
    """One vote of each labeller; an empty text gets only the vote on its length."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [BAD] + [NONE] * 8  # the first labeller only knows texts without words
    share = lambda signs: (len(raw) - len(raw.translate(None, signs))) / size
    symbols, upper, stops = share(SYMBOLS), share(UPPER), share(b".,") * size / n
    same = sum(map(eq, words, words[1:])) / n
    lengths = list(map(len, words))
    short, mean = sum([x <= 3 for x in lengths]) / n, sum(lengths) / n
    runs = len(RUNS.findall(raw)) / n
    kinds = sum([len(set(words[i : i + CHUNK])) for i in range(0, n, CHUNK)]) / n
    long_enough = n >= FEW
    return [
        NONE,
        _side(symbols, symbols > 0.03, symbols < 0.005),
        _side(upper, upper > 0.2 and long_enough, upper < 0.08 and long_enough),
        _side(same, same > 0.15, same < 0.03 and long_enough),
        _side(stops, long_enough and stops < 0.03, long_enough and 0.06 < stops < 0.3),
        _side(short, long_enough and short < 0.1, long_enough and 0.15 < short < 0.5),
        _side(mean, long_enough and mean > 7.5, long_enough and 4 < mean < 7),
        _side(runs, runs > 0.05, runs < 0.005),
        _side(kinds, long_enough and kinds < 0.25, long_enough and kinds > 0.5),
    ]


class LabelModel:
    """Accuracies of the labellers by expectation-maximisation, and posteriors of vote patterns."""

    def __init__(self, patterns: list[str], counts: list[int], rounds: int = 100):
        self.prior, self.posterior, self.table = 0.5, {}, np.zeros((2, 0, 3))
        if not patterns:
            return
        v = np.array([[int(c) for c in p] for p in patterns], int).reshape(len(patterns), -1)
        w = np.array(counts, float)
        m = v.shape[1]
        good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
        # at the start a bad vote outweighs a good one: most labellers look for one kind of fault
        q = (good + 1.0) / (good + 4.0 * bad + 2.0)
        self.table = np.zeros((2, m, 3))
        for _ in range(rounds):
            for y, part in ((0, w * (1 - q)), (1, w * q)):
                for k in (BAD, GOOD):
                    self.table[y, :, k] = ((v == k) * part[:, None]).sum(0) + 1
                self.table[y] /= self.table[y].sum(1, keepdims=True)
            self.prior = (float((w * q).sum()) + 1) / (float(w.sum()) + 2)
            # a labeller that abstains says nothing of either class
            bad_odds, good_odds = (np.log(self.table[1, :, k] / self.table[0, :, k]) for k in (BAD, GOOD))
            odds = np.log(self.prior / (1 - self.prior)) + (bad_odds * (v == BAD) + good_odds * (v == GOOD)).sum(1)
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            if len(q) and np.abs(new - q).max() < 1e-6:
                q = new
                break
            q = new
        self.posterior = dict(zip(patterns, q.tolist()))

    def accuracies(self) -> list[tuple[float, float]]:
        """For each labeller the share of right votes among its votes on good and on bad documents."""
        return [(float(good[GOOD]), float(bad[BAD])) for bad, good in zip(*self.table)]


SHAPE = [(re.compile(p), r) for p, r in (("[a-zß-öø-ÿ]+", "a"), ("[A-ZÀ-ÖØ-Þ]+", "A"), ("[0-9]+", "0"), (r"([^aA0])\1+", r"\1\1"))]


def shape(word: str) -> str:
    """``Thing.`` -> ``Aa.``, ``$$$`` -> ``$$``; and how long the word is, in four steps."""
    out = word
    for pattern, sign in SHAPE:
        out = pattern.sub(sign, out)
    return f"{out}{min(3, len(word) // 4)}"


WORDS = 200_000  # words whose bucket a worker keeps; beyond that it starts anew


class Buckets(dict):
    """Feature of a word's shape, worked out when the word is first met."""

    def __missing__(self, word: str) -> int:
        found = crc32(shape(word).encode()) % (BUCKETS - 2)
        if len(word) < 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found


def features(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: share of each word shape, share of words equal to the word before, and a constant."""
    words = (text or "").split()
    if not words:
        return np.array([BUCKETS - 1]), np.array([1.0])
    counts = np.bincount(list(map(buckets.__getitem__, words)), minlength=BUCKETS - 2)
    at = np.flatnonzero(counts)
    same = sum(map(eq, words, words[1:])) / len(words)
    return np.append(at, [BUCKETS - 2, BUCKETS - 1]), np.append(np.sqrt(counts[at] / len(words)), [np.sqrt(same), 1.0])


def train(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for (indices, values, posterior) rows."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return weights
    at = np.concatenate([np.asarray(r[0], int) for r in rows])
    x = np.concatenate([np.asarray(r[1], float) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    first, second = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at] * x, len(rows)), -30, 30)))
        grad = np.bincount(at, ((p - y) / len(y))[row] * x, BUCKETS) + decay * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        weights -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """Label model over all ``docs`` and the scorer from about ``sample`` of their texts, chosen by hash.

    Equal texts are chosen together and train the scorer once, so copies - be they a third of all rows - neither
    outweigh other texts nor reach the driver; the expected number of rows that do is at most ``sample``.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))

    def vote():
        return lambda texts: (["".join(map(str, votes(t))) for t in texts],)

    voted = add_columns(texts, ["text"], vote, "pattern string", ["text"])
    counts = sorted(tuple(r) for r in voted.groupBy("pattern").count().collect())
    model = LabelModel([p for p, _ in counts], [n for _, n in counts])

    total = sum(n for _, n in counts)
    share = min(1.0, sample / max(1, total))
    chosen = texts.where(F.pmod(F.xxhash64("text", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def describe():
        buckets = kept("quality", Buckets)

        def rows(texts):
            got = [features(t, buckets) for t in texts]
            known = model.posterior
            patterns = ["".join(map(str, votes(t))) for t in texts]
            return [g[0].tolist() for g in got], [g[1].tolist() for g in got], [known[p] for p in patterns]

        return rows

    described = add_columns(chosen, ["text"], describe, "at array<int>, x array<double>, y double", ["text"])
    rows = sorted((tuple(r["at"]), tuple(r["x"]), r["y"]) for r in described.distinct().collect())
    return model, train(rows)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality as ``out``; null and empty texts are scored as texts without words."""

    def make():
        buckets = kept("quality", Buckets)

        def rows(texts):
            got = [features(t, buckets) for t in texts]
            return ([float(1 / (1 + np.exp(-np.clip(weights[a] @ x, -30, 30)))) for a, x in got],)

        return rows

    return add_columns(docs, [text_col], make, f"`{out}` double")


def classify(docs: DataFrame, text_col: str = "text", out: str = "score", sample: int = SAMPLE) -> DataFrame:
    """Fit on ``docs`` and score them. Repeated texts have equal scores; an empty table stays empty."""
    _, weights = fit(docs, text_col, sample)
    return score(docs, weights, text_col, out)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay as they are."""
    name = fresh(docs, "_score")
    return classify(docs, text_col, name, sample).where(F.col(name) >= threshold).drop(name)
