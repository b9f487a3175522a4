"""Models, near duplicates, search and URL filters, on edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from marquetry.llm import components, quality, simhash, topk, toxicity, url_filters
from marquetry.llm.queries import QUERIES
from tests.llm.conftest import edge_rows

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, reach):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_on_edge_rows(edge, none):
    rows = [r[:2] for r in edge_rows()]
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(fps, 2)
    named = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    got = simhash.near_duplicates(edge)
    want = sorted(((r[0], f, named[g]) for r, f, g in zip(rows, fps, groups)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component) for r in got.collect()), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    expected = sorted((r[0] for r, g in zip(rows, groups) if r[0] is None or r[0] == named[g]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == expected


@pytest.mark.parametrize("leaf,oversize", [(32, 4), (400, 4), (32, 1)])
def test_links_of_many_fingerprints(spark, monkeypatch, leaf, oversize):
    monkeypatch.setattr(simhash, "OVERSIZE", oversize)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:  # chains and clumps
        for _ in range(rng.randrange(6)):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp bigint").repartition(4)
    roots = {r.node % (1 << 64): r.root for r in components.connected(simhash.near_links(nodes, 2, leaf)).collect()}
    want = brute_components(fps, 2)
    got = [roots.get(f, f if f < 1 << 63 else f - (1 << 64)) for f in fps]
    pairs = set(zip(want, got))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k_edges(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], "x") for i in range(300)]  # very many ties
    rows += [(301, None, "x"), (None, [1.0] * 4, "x"), (302, [1.0, None, 1.0, 1.0], "x"), (303, [1.0, math.nan, 1.0, 1.0], "x")]
    rows += [(304, [math.inf] * 4, "x"), (305, [1.0] * 3, "x"), (306, [], "x"), (7, rows[7][1], "x"), (307, [1e15] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = {}
    for r in topk.top_k(df.where("vec_id % 50 = 0 or vec_id = 305"), df, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    top = (1 << 63) - 1
    for q, v in fine:
        if q % 50 == 0 or q == 305:
            all_scores = [(min(top, sum(a * b for a, b in zip(v, w))), i) for i, w in fine if i != q and len(w) == len(v)]
            best = sorted(all_scores, key=lambda x: (-x[0], x[1]))[:5]
            assert sorted(got.get(q, [])) == [(k, i, s) for k, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def auc(labels, scores):
    ranks, ones = pd.Series(scores).rank().to_numpy(), int((labels == 1).sum())
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_toxicity_held_out(spark):
    got = QUERIES["op4_toxicity"](spark, SF.replace("0.01", "0.1")).toPandas()
    labels = pd.read_parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    both = got[got.held_out].merge(labels, on="doc_id")
    assert auc(both.toxic.to_numpy(), both.score.to_numpy()) > 0.95
    assert both[both.toxic == 1].predicted.mean() > 0.85 and both[both.toxic == 0].predicted.mean() < 0.01


def test_toxicity_folding_exceptions_and_edges(spark, edge, none):
    assert toxicity.fold("1d1ot, ІDІОТ!  i​diot") == " idiot  idiot   idiot "
    matcher = toxicity.Matcher({" trash": 2.0, " idiot ": 1.0}, [" trash can "])
    assert matcher.hits(toxicity.fold("a trash can")) == []
    assert [w for _, _, w in matcher.hits(toxicity.fold("trash trashy idiots idiot"))] == [2.0, 2.0, 1.0]
    clean = [(i, f"the trash can stood by the door number{i} of a quiet house", 0) for i in range(40)]
    toxic = [(100 + i, f"you utter trash and m0ron number{i} of a loud house", 1) for i in range(40)]
    rows = clean + toxic
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score("what a moron, utter trash") > 0.7 > 0.5 > model.score("put it in the trash can")
    scored = toxicity.score(edge, model)
    assert scored.count() == edge.count() and scored.where("score is null or score > 0.5").count() == 0
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert 0 <= nothing.score(None) == nothing.score("trash") <= 1


def test_toxicity_bound_keeps_the_base_rate(spark):
    rows = [(i, f"left{i} {'trash' if i % 5 else 'plain'} right{i} of a house", 1) for i in range(100)]
    rows += [(1000 + i, f"left{i} {'plain' if i % 10 else 'trash'} right{i} of a house", 0) for i in range(1000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    one, whole = (toxicity.fit(docs, labels, per_class=n).score("some trash right of a house") for n in (100, 10_000))
    assert abs(whole - 80 / 180) < 0.1 and abs(one - whole) < 0.15
    nothing = [toxicity.fit(docs, labels.where("toxic = 0"), per_class=n).score("x") for n in (100, 10_000)]
    assert nothing[0] == pytest.approx(nothing[1])


def test_quality_accuracy(spark):
    got = QUERIES["op8_quality"](spark, SF.replace("0.01", "0.1")).toPandas()
    both = got.merge(pd.read_parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet"), on="doc_id")
    assert auc(both.quality.to_numpy(), both.score.to_numpy()) > 0.99
    assert both[both.quality == 1].kept.mean() > 0.99 and both[both.quality == 0].kept.mean() < 0.05


def test_label_model_and_edges(edge, none):
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    right = (0.95, 0.8, 0.7)
    votes = ["".join(str(quality.GOOD if (y if rng.random() < p else not y) else quality.BAD) for p in right) for y in truth]
    kinds = sorted(set(votes))
    model = quality.LabelModel(kinds, [votes.count(k) for k in kinds])
    assert all(abs(got - p) < 0.08 for (got, _), p in zip(model.accuracies(), right))
    scored = quality.classify(edge)
    assert scored.count() == edge.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(none).count() == 0 and quality.keep_good(none).columns == none.columns


def test_url_filters(spark):
    entries = [
        ("domain", "bad.org", "block", "2024-03-01"),
        ("domain", "bad.org", "allow", "2024-06-01"),
        ("domain", "bad.org", "allow", "2024-03-01"),  # the same day: the last action in the alphabet counts
        ("prefix", "bad.org/good/", "allow", "2024-01-01"),
        ("url", "bad.org/good/x?q=1", "block", "2024-04-01"),
        ("domain", "org", "allow", "2024-01-01"),
        ("strange", "bad.org", "block", "2020-01-01"),
        ("domain", None, "block", "2020-01-01"),
        ("domain", "ok.org", None, "2020-01-01"),
        ("domain", "ok.org", "block", None),
    ]
    cases = [
        (1, "http://u:p@WWW.Bad.org.:80/a#f", "2024-02-29", "allow", "org"),
        (2, "http://www.bad.org/a", "2024-03-01", "block", "bad.org"),
        (3, "http://www.bad.org/a", "2024-06-01", "allow", "bad.org"),
        (4, "http://bad.org/good/y", "2024-04-01", "allow", "bad.org/good/"),
        (5, "http://bad.org/good/x?q=1#z", "2024-04-01", "block", "bad.org/good/x?q=1"),
        (6, "http://notbad.org", "2024-04-01", "allow", "org"),
        (7, None, "2024-04-01", "allow", None),
        (8, "http://bad.org/", None, "allow", None),
        (9, "no url", "2024-04-01", "allow", None),
        (2, "http://www.bad.org/a", "2024-03-01", "block", "bad.org"),
        (None, "http://ok.org", "2024-03-01", "allow", "org"),
    ]
    lists = spark.createDataFrame(entries, "kind string, name string, action string, since string")
    df = spark.createDataFrame([(*c[:3], "x") for c in cases], "page_id long, url string, fetched string, rule string")
    got = url_filters.judge(df, lists)
    want = sorted(((c[0], c[3], c[4]) for c in cases), key=repr)
    assert sorted(((r.page_id, r.action, r.rule) for r in got.collect()), key=repr) == want
    kept = url_filters.drop_blocked(df, lists)
    assert kept.columns == df.columns and kept.count() == len([c for c in cases if c[3] != "block"])
    assert url_filters.judge(df.limit(0), lists).count() == 0
    assert url_filters.judge(df, lists.limit(0)).where("action <> 'allow'").count() == 0
