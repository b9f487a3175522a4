"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding lower-cases, replaces look-alike letters and digits used as letters (the accented letters of Latin-1 are letters of
their own), and turns everything else into blanks. The lexicon is learnt from labelled documents: words and word starts that
significantly more of the toxic documents have, weighted by the log ratio of their rates. Phrases around a lexicon
word that only clean documents have are exceptions and cancel the match inside them. A text's score is a logistic function of
its summed weights, plain and per hundred words, and of its length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from math import log, log1p

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.sources.writers import checkpoint

from .common import add_columns, explode_rows

PER_CLASS = 6_000  # labelled documents of each class that a model is fitted on, at most; chosen by hash and weighted by their class
STEM = range(3, 11)  # lengths of word starts that may become entries; whole words of any length may, too
SUPPORT = 3  # toxic documents an entry needs
SIGNIFICANT = 20.0  # log-likelihood ratio an entry needs
RATIO = 3.0  # times the share of clean documents that have an entry, at least
MEASURES = 3

# fixed values: digits and signs that stand for letters, and letters of other scripts that look like Latin ones
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}


class _Fold(dict):
    """Folding sign by sign, worked out when a sign is first met."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        low = LOOKALIKES.get(sign.lower(), sign.lower())
        if code < 0x100 and len(low) == 1 and low.isalpha():
            self[code] = low
            return low
        base = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        base = "".join(LOOKALIKES.get(c, c) for c in base)
        hidden = unicodedata.category(sign) in ("Cf", "Mn")
        out = "" if hidden else DIGITS.get(sign) or (base if base.isalnum() else " ")
        self[code] = out
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between blanks; a text without words is one blank. Its length differs from the text's."""
    return f" {(text or '').translate(FOLD)} "


def entries_of(folded: str) -> Counter:
    """The candidate entries in a text and how often each occurs: word starts, and whole words with their end."""
    out: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for size in STEM:
            if size < len(word):
                out[f" {word[:size]}"] += n
    return out


def significance(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Log-likelihood ratio of a document count in two classes; zero if the toxic share is not the higher one."""
    share = (toxic + clean) / F.lit(float(all_toxic + all_clean))

    def part(k: Column, p: Column) -> Column:
        return F.when(k > 0, 2 * k * F.ln(k / p)).otherwise(0.0)

    g = part(toxic, all_toxic * share) + part(all_toxic - toxic, all_toxic * (1 - share))
    g += part(clean, all_clean * share) + part(all_clean - clean, all_clean * (1 - share))
    return F.when(toxic * all_clean > clean * all_toxic, g).otherwise(0.0)


class Matcher:
    """Lexicon and exceptions in one automaton; the longest entry that starts at a word counts once."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = ()):
        self.auto = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.auto.add_word(entry, (len(entry), w))
        for phrase in exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        self.any = bool(weights)
        if self.any:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that no exception covers."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.auto.iter(folded) if self.any else ():
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][0] < end:
                best[start] = end, weight
        spared.sort(reverse=True)
        out, reach = [], -1
        for start, (end, weight) in sorted(best.items()):
            while spared and spared[-1][0] <= start:
                reach = max(reach, spared.pop()[1])
            if end > reach:
                out.append((start, end, weight))
        return out

    def measures(self, folded: str) -> tuple[float, ...]:
        """Logs of the summed weights, of the summed weights per hundred words and, if there are any, of the length."""
        total = sum([w for _, _, w in self.hits(folded)])
        if not total:
            return (0.0,) * MEASURES
        words = len(folded.split())
        return log1p(total), log1p(100 * total / words), log(words)


class Model:
    """What scoring needs: entries with weights, exception phrases and the coefficients, the constant first."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self.matcher: Matcher | None = None

    def __getstate__(self):
        return self.__dict__ | {"matcher": None}

    def score(self, text: str | None) -> float:
        if self.matcher is None:
            self.matcher = Matcher(self.weights, self.exceptions)
        measures = self.matcher.measures(fold(text))
        odds = self.coefficients[0] + sum([c * x for c, x in zip(self.coefficients[1:], measures)])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, odds)))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> Model:
    """A model from the documents that ``labels`` marks 1 or 0; other and null labels are ignored.

    Without toxic rows the lexicon is empty and every score is the same. Of a document with differing labels the
    toxic one counts. Of a class with more than ``per_class`` documents those chosen stand for all: each has the weight
    of as many as it was chosen from, so the base rate is that of all labels.
    """
    marked = checkpoint(
        labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("_id"))
        .agg(F.max(f"`{label_col}`").cast("int").alias("_y"))
    )
    pick = lambda y: marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    chosen = checkpoint(pick(1).unionByName(pick(0)))
    stands_for = {y: n / min(n, per_class) for y, n in marked.groupBy("_y").count().collect()}
    # at most 2 x per_class ids are broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    own = texts.join(F.broadcast(chosen), "_id").select("_text", "_y")

    def folding():
        return lambda texts: ([fold(t) for t in texts],)

    own = checkpoint(add_columns(own, ["_text"], folding, "folded string", ["_text"]))
    sizes = dict(own.groupBy("_y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = log((toxic * stands_for.get(1, 1) + 1) / (clean * stands_for.get(0, 1) + 1))
    if not toxic or not clean:
        return Model({}, [], [base])

    weights = _lexicon(own, toxic, clean)
    exceptions = _exceptions(own, weights)

    def measure():
        matcher = Matcher(weights, exceptions)
        return lambda folded: ([list(matcher.measures(t)) for t in folded],)

    measured = add_columns(own, ["folded"], measure, "measures array<double>", ["folded"])
    rows = sorted((r["_y"], *r["measures"]) for r in measured.collect())  # at most 2 x per_class
    return Model(weights, exceptions, _logistic(np.array(rows, float), np.array([stands_for[r[0]] for r in rows])))


def _counted(own: DataFrame, make_counts) -> DataFrame:
    """Per term the documents and the occurrences in each class, summed within a batch first."""

    def make():
        counts = make_counts()

        def count(folded, ys):
            docs, times = (Counter(), Counter()), (Counter(), Counter())
            for text, y in zip(folded, ys):
                found = counts(text)
                docs[y].update(found.keys())
                times[y].update(found)
            terms = list({**docs[0], **docs[1]})
            return terms, *[[c[t] for t in terms] for c in (docs[1], docs[0], times[1], times[0])]

        return count

    names = ("toxic", "clean", "toxic_times", "clean_times")
    rows = explode_rows(own, ["folded", "_y"], make, "term string, " + ", ".join(f"{n} bigint" for n in names))
    return rows.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def _lexicon(own: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Every candidate that passes the tests of support, ratio and significance, unless a shorter start says as much.

    No number of entries is set; only terms of the at most 2 x ``per_class`` sampled documents can pass.
    """
    counts = _counted(own, lambda: entries_of).where(F.col("toxic") >= SUPPORT)
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    rated = counts.withColumn("g", significance(F.col("toxic"), F.col("clean"), toxic, clean))
    strong = rated.where((ratio >= RATIO) & (F.col("g") >= SIGNIFICANT)).collect()
    words = dict(own.groupBy("_y").agg(F.sum(F.size(F.split(F.trim("folded"), " +")))).collect())
    weights: dict[str, float] = {}
    for r in sorted(strong, key=lambda r: (-round(r["g"], 9), len(r["term"]), r["term"])):
        rates = (r["toxic_times"] + 0.5) / words[1], (r["clean_times"] + 0.5) / words[0]
        weight = log(rates[0] / rates[1])
        # a longer start adds nothing to a stronger shorter one unless it is more telling
        shorter = max(weights.get(r["term"][: n + 1], 0.0) if n + 1 < len(r["term"]) else 0.0 for n in STEM)
        if weight > max(0.5, shorter + 0.5):
            weights[r["term"]] = weight
    return weights


def phrases_of(matcher: Matcher, folded: str) -> Counter:
    """Each matched word together with the word before it, and with the word after it, one blank between them."""
    out: Counter = Counter()
    for start, _, _ in matcher.hits(folded):
        stop = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", stop + 1)
        if 0 <= before < start - 1:
            out[folded[before : stop + 1]] += 1
        if after > stop + 1:
            out[folded[start : after + 1]] += 1
    return out


def _exceptions(own: DataFrame, weights: dict[str, float]) -> list[str]:
    def make():
        matcher = Matcher(weights)
        return lambda folded: phrases_of(matcher, folded)

    rows = _counted(own, make).where((F.col("toxic") == 0) & (F.col("clean") >= SUPPORT))
    return sorted(r["term"] for r in rows.select("term").collect())  # of at most ``per_class`` documents


def _logistic(rows: np.ndarray, counts: np.ndarray, rounds: int = 100, decay: float = 1e-4) -> list[float]:
    """Coefficients, constant first; a row counts as ``counts`` rows. Newton steps, halved until the loss falls."""
    y, x = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])
    share = counts / counts.sum()

    def loss(w: np.ndarray) -> float:
        odds = x @ w
        return float(share @ (np.logaddexp(0, odds) - y * odds) + decay * w @ w / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (share * (p - y)) + decay * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        step, slope = np.linalg.solve(hess, grad), 1.0
        while slope > 1e-9 and loss(w - slope * step) > now - 1e-4 * slope * float(grad @ step):
            slope /= 2
        if slope <= 1e-9 or np.abs(grad).max() < 1e-12:
            break
        w = w - slope * step
        now = loss(w)
    return w.tolist()


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) as ``out``; a null or empty text has no match."""

    def make():
        return lambda texts: ([model.score(t) for t in texts],)

    return add_columns(docs, [text_col], make, f"`{out}` double")
