"""Lexical search, the conversation trie and mixing against brute force, on edge rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marquetry.llm import lexical, mixing, prefix_trie

# ---- ranked lexical search

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rank(items, docs, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in Counter(terms(text)).items()
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [
    (1, "common3 common4 COMMON5 first line"), (2, None), (3, ""), (4, "absent words only"), (None, "Été İstanbul; short"),
    (5, "short"), (5, "another opening"), (5, "short"), (6, "w1 w1 w1 w2 thing3 thing4 w900"),
]


@pytest.mark.parametrize("size", [{}, {"shard_terms": 40, "bucket": 2, "items_at_once": 2}])
def test_rank_equals_brute_force(spark, edge, size):
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    got = lexical.rank(items, edge, k=4, **size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_rank(ITEMS, docs, 4)


def test_rank_of_many_equal_and_random_documents(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(1, 60)))) for i in range(800)]
    docs += [(1000 + i, "t7 t9 t11 t13") for i in range(400)]
    items = [(i, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 12)))) for i in range(30)]
    frames = (spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))
    got = lexical.rank(*frames, shard_terms=3_000, bucket=64, items_at_once=7)
    assert Counter(tuple(r) for r in got.collect()) == brute_rank(items, docs, 10)


def test_buckets_are_pruned(spark):
    """A short vector cannot reach the tenth score of a long one: the search ends before its bucket."""
    import numpy as np
    import pyarrow as pa

    n = 200
    words = [["rare", "other"] if i < 20 else ["other"] for i in range(n)]
    table = pa.table({"doc_id": list(range(n)), "n": [2 if i < 20 else 40 for i in range(n)], "terms": words, "times": [[1] * len(w) for w in words]})
    weights = np.zeros(lexical.PLACES, np.int32)
    weights[lexical.place(b"rare")], weights[lexical.place(b"other")] = 5000, 10
    shard = lexical.Shard(table, n, 100, weights, bucket=20)
    seen = []
    shard.buckets = [(lo, hi, Seen(spans, seen, lo)) for lo, hi, spans in shard.buckets]
    found = shard.search([b"rare", b"other"], [5000, 10], 10)
    assert [shard.ids[p].as_py() for p, _ in found] == list(range(10)) and set(seen) == {0}


class Seen(dict):
    def __init__(self, spans, seen, lo):
        super().__init__(spans)
        self.seen, self.lo = seen, lo

    def get(self, key):
        self.seen.append(self.lo)
        return super().get(key)


def test_rank_of_nothing(spark, none, edge):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.rank(items, none).collect() == [] == lexical.rank(items.limit(0), edge).collect()


# ---- conversation prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, order), (role, text)))
    turns = {c: [x for _, x in sorted(own)] for c, own in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            (min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(own) if len(paths[c]) == len(p)).encode()).hexdigest())
            for p, own in members.items()
        )
    )


def check_trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    frame = frame.withColumn("depth", F.lit(7)).withColumn("node", F.lit("x"))
    got = prefix_trie.prefix_trie(frame).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute_trie(rows)


def test_trie_equals_brute_force_on_edge_rows(spark):
    rows = [
        (0, None, "system", None), (0, 0, None, "Hé"), (0, 1, "user", "b"), (0, 1, "user", "b"), (3, 0, "user", "x" * 50_000), (7, 5, "user", "q"),
        (7, 5, "bot", "q"), (57, 0, None, None), (101, 0, "user", "a"), (205, 0, "user", "a"), (None, 0, "user", "lost"), (-5, 0, "user", "a"),
        (150, 2, "user", "same"), (150, 2, "user", "same"),
    ]
    rows += [(300 + c, t, "user", f"t{t}") for c in range(60) for t in range(9)]
    check_trie(spark, rows)


def test_trie_with_long_chains(spark):
    rng = random.Random(5)
    rows = []
    for c in range(24):
        stem = rng.randrange(3)
        cut = rng.randrange(5, 130)
        rows += [(c, t, "user", f"s{stem} {t}" if t < cut else f"own {c} {t}") for t in range(rng.randrange(100, 140))]
    check_trie(spark, rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Sizes in order of their sources; the excess is shared again until nobody is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped, total = set(), share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(cap * sizes[i] for i in capped)) / max(sum(weight[i] for i in free), 1)
        above = {i for i in free if level * weight[i] > cap * sizes[i]}
        if not above:
            return [cap * s if i in capped else level * w for i, (s, w) in enumerate(zip(sizes, weight))]
        capped |= above


@pytest.mark.parametrize("size", [{}, {"block": 7, "shard_blocks": 40}])
def test_mix_takes_what_targets_say(spark, edge, size):
    docs = edge.drop("source").withColumn("source", F.expr("case doc_id % 4 when 0 then 'a' when 1 then 'é' when 2 then 'z' end"))
    docs = docs.unionByName(docs.where("doc_id in (1, 2)")).withColumn("rank", F.lit("clash"))
    mixed, parts = mixing.mix(docs, **size)
    out = mixing.words_taken(mixed, parts).collect()
    assert len(out) == docs.count()
    words = {(r.doc_id, r.source, len(re.findall(mixing.WORD, r.text or ""))) for r in docs.collect()}
    assert {(r.id, r.source, r.size) for r in out} == words
    by = defaultdict(lambda: [0, 0, set(), set()])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        own = by[r.source]
        own[0] += r.size
        own[1] += r.taken
        own[2].add(r.target)
        own[3].add(r.source_size)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, brute_targets([by[s][0] for s in order])):
        total, taken, targets, sizes = by[source]
        assert sizes == {total} and len(targets) == 1 and targets.pop() == pytest.approx(target)
        assert abs(taken - target) <= 0.5
    again = mixing.words_taken(*mixing.mix(docs.repartition(5), **size)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_shards_are_exact_and_disjoint(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40), f"s{i % 7}") for i in range(900)], "doc_id int, text string, source string")
    mixed, _ = mixing.mix(docs, block=8, shard_blocks=100)
    rows = mixed.collect()
    assert len({(r.rank, r.id, r["pass"], r.from_word) for r in rows}) == len(rows)
    shards = Counter(r.shard for r in rows)
    assert len(shards) == -(-len(rows) // 100) and max(shards.values()) - min(shards.values()) <= 1
    for shard in shards:
        assert sorted(r.place for r in rows if r.shard == shard) == list(range(1, shards[shard] + 1))
    assert all(1 <= r.n_words <= 8 and r.from_word % 8 == 0 for r in rows)


def test_quotas_are_split_by_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    quotas = spark.createDataFrame([(i, 1 + i % 9) for i in range(30)], "rank bigint, q bigint")
    total = sum(1 + i % 9 for i in range(30))
    got = mixing.split_quotas(quotas, 5, total, 30, 1).collect()
    for j in range(5):
        assert sum(r.q for r in got if r.shard == j) == (j + 1) * total // 5 - j * total // 5
    for i in range(30):
        assert sum(r.q for r in got if r["rank"] == i) == 1 + i % 9


def test_hypergeometric_draws_follow_the_distribution(spark):
    cases = [(20, 8, 10), (50, 3, 49), (7, 7, 3), (9, 0, 4), (1, 1, 1), (0, 0, 0)]
    for total, kind, drawn in cases:
        n = 20_000
        draw = mixing.hypergeometric(*[F.lit(x).cast("bigint") for x in (total, kind, drawn)], (F.col("id") + 0.5) / n)
        got = {r[0]: r[1] for r in spark.range(n).select(draw.alias("x")).groupBy("x").count().collect()}
        for x in range(max(0, drawn + kind - total), min(kind, drawn) + 1):
            want = math.comb(kind, x) * math.comb(total - kind, drawn - x) / math.comb(total, drawn)
            assert abs(got.get(x, 0) / n - want) < 2 / n + 1e-9
    big = mixing.hypergeometric(*[F.lit(x).cast("bigint") for x in (10**9, 4 * 10**8, 5 * 10**8)], F.rand(1))
    stats = spark.range(40).select(big.alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 2e8 - 1e5 < stats[0] <= stats[1] < 2e8 + 1e5


def test_mix_of_nothing(spark, none):
    mixed, parts = mixing.mix(none)
    assert mixed.collect() == [] == parts.collect()
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, " ", None)], "doc_id int, text string, source string")
    out = mixing.words_taken(*mixing.mix(blank)).collect()
    assert sorted((r.id or 0, r.size, r.source_size, r.target, r.taken) for r in out) == [(i, 0, 0, 0.0, 0) for i in (0, 1, 2)]


def test_mixing_runs_no_python(spark):
    from marquetry.llm.queries import QUERIES

    plan = QUERIES["op13_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
