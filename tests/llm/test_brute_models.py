"""Toxicity, quality and the pipeline recomputed by plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from marquetry.llm import quality, toxicity
from tests.llm.test_models_and_search import brute_components, brute_fingerprint
from tests.llm.test_text_operators import brute_lines, brute_overlap

SF = "/root/testdata/sf0.001"


def labelled(n=400, seed=4):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("stone", "river", "lamp", "cloud", "market", "garden") for b in ("", "s", "ed", "like")]
    rude = ["moron", "morons", "idiot", "trash", "trashy", "scum", "m0ron"]
    rows = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = rng.choices(plain, k=rng.randrange(5, 40))
        for _ in range(rng.randrange(1, 5) if toxic else rng.random() < 0.1):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        if not toxic and i % 3 == 0:
            words[2:2] = ["trash", "can"]
        rows.append((i, rng.choice((" ", ", ", "  ")).join(words) if rng.random() < 0.2 else " ".join(words), toxic))
    return rows + [(n, None, 0), (n + 1, "", 1), (n + 2, "moron " * 300, 1), (n + 3, f"{'a' * 60} {'b' * 60}", 1)] + [
        (n + 10 + i, f"{'y' * 50}{'x' * (i % 4 == 0)} lamp{i}", int(i % 4 == 0)) for i in range(80)
    ]


class BruteToxicity:
    """Lexicon, exceptions and measures word by word; a word starts a match, the longest fitting entry counts."""

    def __init__(self, rows):
        texts = [(toxicity.fold(t), y) for _, t, y in rows]
        all_of = [sum(y == k for _, y in texts) for k in (0, 1)]
        words_of = [sum(max(1, len(f.split())) for f, y in texts if y == k) for k in (0, 1)]
        docs, times = (Counter(), Counter()), (Counter(), Counter())
        for f, y in texts:
            found = Counter()
            for w in f.split():
                found[f"{w}$"] += 1
                found.update(w[:n] for n in range(3, 11) if n < len(w))
            docs[y].update(found.keys())
            times[y].update(found)
        rated = []
        for e, toxic in docs[1].items():
            clean, n = docs[0][e], sum(all_of)
            ratio = (toxic + 0.5) / (all_of[1] + 1) / ((clean + 0.5) / (all_of[0] + 1))
            cells = [(toxic, all_of[1], toxic + clean), (clean, all_of[0], toxic + clean)]
            cells += [(of - k, of, n - seen) for k, of, seen in cells]
            g = sum(2 * k * math.log(k * n / (of * seen)) for k, of, seen in cells if k)
            if toxic >= 3 and ratio >= 3 and g >= 20 and toxic / all_of[1] > clean / all_of[0]:
                weight = math.log((times[1][e] + 0.5) / words_of[1] / ((times[0][e] + 0.5) / words_of[0]))
                rated.append((-round(g, 9), len(e) + (e[-1] == "$"), e, weight))
        self.weights = {}
        for _, _, e, weight in sorted(rated, key=lambda r: (r[0], len(r[2]), f" {r[2]}".replace("$", " "))):
            starts = [s for s in self.weights if s[-1] != "$" and e != s and e.startswith(s)]
            if weight > max(0.5, max((self.weights[s] for s in starts), default=0.0) + 0.5):
                self.weights[e] = weight
        self.exceptions = set()
        around = (Counter(), Counter())
        for f, y in texts:
            around[y].update(set(self.phrases(f)))
        self.exceptions = {p for p, n in around[0].items() if n >= 3 and not around[1][p]}

    def entry(self, word):
        fits = [e for e in self.weights if e == f"{word}$" or (e[-1] != "$" and word.startswith(e))]
        return max(fits, key=lambda e: (e[-1] == "$", len(e)), default=None)

    @staticmethod
    def pairs(folded):
        """Words with the word before and after if one blank parts them."""
        spans = [m.span() for m in re.finditer("[^ ]+", folded)]
        for i, (a, b) in enumerate(spans):
            before = folded[spans[i - 1][0] : b] if i and spans[i - 1][1] == a - 1 else None
            after = folded[a : spans[i + 1][1]] if i + 1 < len(spans) and spans[i + 1][0] == b + 1 else None
            yield folded[a:b], before, after

    def phrases(self, folded):
        return [p for w, *two in self.pairs(folded) if self.entry(w) for p in two if p]

    def measures(self, folded):
        got = [self.weights[self.entry(w)] for w, *two in self.pairs(folded) if self.entry(w) and not self.exceptions & set(two)]
        words = len(folded.split())
        return [math.log1p(sum(got)), math.log1p(100 * sum(got) / words), math.log(words)] if got else [0.0] * 3


def test_toxicity_equals_brute_force(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    want = BruteToxicity(rows)
    assert {e[1:].replace(" ", "$"): pytest.approx(w) for e, w in model.weights.items()} == want.weights
    assert f"{'y' * 50}x$" in want.weights  # a whole word of any length
    assert {p.strip() for p in model.exceptions} == want.exceptions and "trash can" in want.exceptions
    c = np.array(model.coefficients)
    x = np.array([[1.0, *want.measures(toxicity.fold(t))] for _, t, _ in rows])
    p = 1 / (1 + np.exp(-(x @ c)))
    slope = x.T @ (p - np.array([r[2] for r in rows])) / len(rows) + 1e-4 * c
    assert np.abs(slope).max() < 1e-8
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == {r[0]: pytest.approx(s) for r, s in zip(rows, p)}


def test_toxicity_of_a_long_text_is_linear():
    matcher = toxicity.Matcher({" trash": 2.0, " moron ": 1.0}, [" trash can "])
    text = toxicity.fold("trash can moron a trashy " * 200_000)  # 5 MB, three matches and an exception in 25 signs
    start = time.perf_counter()
    assert matcher.measures(text)[0] == pytest.approx(math.log1p(200_000 * 3.0))
    assert toxicity.phrases_of(matcher, text)[" can moron "] == 200_000
    assert time.perf_counter() - start < 5


def brute_posteriors(counts, rounds=100):
    """Expectation-maximisation over vote patterns, value by value."""
    q = {p: (p.count("2") + 1) / (p.count("2") + 4 * p.count("0") + 2) for p in counts}
    for _ in range(rounds):
        rate, total = {}, sum(counts.values())
        for y in (0, 1):
            for m in range(len(next(iter(counts)))):
                bad, good = (1 + sum(n * (q[p] if y else 1 - q[p]) for p, n in counts.items() if p[m] == k) for k in "02")
                rate[y, m, "0"], rate[y, m, "2"] = bad / (bad + good), good / (bad + good)
        prior = (sum(n * q[p] for p, n in counts.items()) + 1) / (total + 2)
        new = {}
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1, m, k] / rate[0, m, k]) for m, k in enumerate(p) if k != "1")
            new[p] = 1 / (1 + math.exp(-min(40, max(-40, odds))))
        near = max(abs(new[p] - q[p]) for p in q) < 1e-6
        q = new
        if near:
            break
    return q


def brute_scores(texts):
    """Posteriors of the votes train a logistic scorer of hashed shapes; every text is scored."""
    votes = {t: "".join(map(str, quality.votes(t))) for t in set(texts)}
    posterior = brute_posteriors(Counter(votes[t] for t in texts))
    x = {}
    for t in set(texts):
        words = (t or "").split()
        shapes = Counter(hashlib.sha1(quality.shape(w).encode()).hexdigest() for w in words)
        x[t] = {s: math.sqrt(n / len(words)) for s, n in shapes.items()} | {"1": 1.0}
        if words:
            x[t]["same"] = math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / len(words))
    rows = list({(tuple(sorted(x[t].items())), posterior[votes[t]]) for t in x})
    names = sorted({k for r, _ in rows for k, _ in r})
    w, first, second = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    sigmoid = lambda v: 1 / (1 + math.exp(-min(30, max(-30, v))))
    for step in range(1, 301):
        grad = {k: 1e-4 * v for k, v in w.items()}
        for r, y in rows:
            off = (sigmoid(sum(w[k] * v for k, v in r)) - y) / len(rows)
            for k, v in r:
                grad[k] += off * v
        for k, g in grad.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
            w[k] -= 0.3 * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return [sigmoid(sum(w[k] * v for k, v in x[t].items())) for t in texts]


def test_quality_equals_brute_force(spark):
    rng = random.Random(2)
    good = "the small house by a lake. It was late, and rain fell on an old road near the town".split()
    bad = "$$$ BUY NOW!!! click|here #### WINNER xxxxxxxxxxxxxxx 99999".split()
    texts = [" ".join(rng.choices(bad if i % 4 == 0 else good, k=rng.randrange(1, 90))) for i in range(80)]
    texts += [None, "", texts[0], texts[0], " ".join(good * 400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.classify(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(s, abs=1e-4) for s in brute_scores(texts)]


def test_votes_on_kinds_do_not_depend_on_the_length():
    words = [f"word{i % 3_000}" for i in range(120_000)]
    assert {quality.votes(" ".join(words[:n]))[-1] for n in (400, 5_000, 20_000, 120_000)} == {quality.GOOD}
    assert {quality.votes("the same few words " * n)[-1] for n in (20, 2_000, 40_000)} == {quality.BAD}
    assert quality.shape("a-1" * 6 + "x") != quality.shape("a-1" * 6 + "X")


def test_pipeline_equals_a_chain_of_brute_forces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.good_quality(spark, docs, SF).collect()]
    assert 0 < len(left) < docs.count()
    left = [r[:2] for r in brute_lines(left)]
    groups = brute_components([brute_fingerprint(t) for _, t in left], 2)
    first = {g: min(d for (d, _), h in zip(left, groups) if h == g) for g in set(groups)}
    left = [(d, t) for (d, t), g in zip(left, groups) if first[g] == d]
    items = [tuple(r) for r in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    hit = {d for d, n, h, _ in brute_overlap(left, items) if h and 20 * h >= n}
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in left:
        if d not in hit:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
