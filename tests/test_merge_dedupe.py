import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.operators import dedupe, fuzzy, merge

M_DDL = "appid int, name string, release_date string, supported_languages array<string>"
MASTER = [(1, "Game A", None, ["English", "French"]), (2, "Game B", "2022-05-01", []), (3, "Game C", "", ["Spanish"])]
INCOMING = [
    (4, "Game D", "2023-08-10", [], 8, "here"),
    (2, "Game B", "", ["Spanish"], 6, ""),
    (1, "Game A", "2021-11-15", ["German", "English"], 5, ""),
    (3, "Game C", "2023-08-11", ["French", "Spanish"], 7, ""),
]


def frames(spark):
    return spark.createDataFrame(MASTER, M_DDL), spark.createDataFrame(INCOMING, M_DDL + ", new_column int, `2nd_new_column` string")


def by_key(df):
    return {r["appid"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("how", ["pair", "fold", "all"])
def test_fixture(spark, how):
    master, incoming = frames(spark)
    rule = {"supported_languages": merge.union_lists}
    if how == "pair":
        out = merge.merge_sources(master, incoming, "appid", rule)
    else:
        out = {"fold": merge.merge_fold, "all": merge.merge_all}[how]([(master, {}), (incoming, rule)], "appid")
    rows = by_key(out)
    assert {k: r["release_date"] for k, r in rows.items()} == {1: "2021-11-15", 2: "2022-05-01", 3: "2023-08-11", 4: "2023-08-10"}
    assert {k: set(r["supported_languages"]) if r["supported_languages"] is not None else None for k, r in rows.items()} == {
        1: {"English", "French", "German"}, 2: {"Spanish"}, 3: {"Spanish", "French"}, 4: None,
    }
    # new columns follow the key, whatever the row order
    assert {k: r["new_column"] for k, r in rows.items()} == {1: 5, 2: 6, 3: 7, 4: 8}
    assert rows[4]["2nd_new_column"] == "here" and rows[4]["name"] == "Game D"


def test_merge_is_idempotent(spark):
    master, incoming = frames(spark)
    rule = {"supported_languages": merge.union_lists_or_either}
    once = merge.merge_sources(master, incoming, "appid", rule)
    twice = merge.merge_sources(once, incoming, "appid", rule)
    norm = lambda df: sorted(map(str, df.withColumn("supported_languages", F.array_sort("supported_languages")).collect()))
    assert norm(once) == norm(twice)


@pytest.mark.parametrize("how", ["fold", "all"])
def test_rows_without_a_key_survive_unmatched(spark, how):
    a = spark.createDataFrame([(None, "x"), (None, "x"), (1, "")], "k int, v string")
    b = spark.createDataFrame([(None, "y"), (1, "z")], "k int, v string")
    out = {"fold": merge.merge_fold, "all": merge.merge_all}[how]([(a, {}), (b, {})], "k")
    assert sorted(((r["k"], r["v"]) for r in out.collect()), key=str) == sorted([(None, "x"), (None, "x"), (None, "y"), (1, "z")], key=str)


def test_one_shuffle_merge_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key within one source"):
        merge.merge_all([(a, {}), (b, {})], "k").collect()
    assert merge.merge_fold([(a, {}), (b, {})], "k").count() == 2


def test_all_empty_takes_the_last_source(spark):
    a = spark.createDataFrame([(1, ""), (2, "")], "k int, v string")
    b = spark.createDataFrame([(1, None)], "k int, v string")
    for fn in (merge.merge_fold, merge.merge_all):
        assert {r["k"]: r["v"] for r in fn([(a, {}), (b, {})], "k").collect()} == {1: None, 2: None}


def test_emptiness_by_type(spark):
    df = spark.createDataFrame([(False, 0, 0.0, "", []), (True, 1, float("nan"), "0", [1]), (None, None, None, None, None)], "b boolean, i int, d double, s string, a array<int>")
    out = [tuple(r) for r in df.select([merge.is_empty(F.col(f.name), f.dataType) for f in df.schema.fields]).collect()]
    assert out == [(True,) * 5, (False, False, True, False, False), (True,) * 5]
    assert df.select(merge.is_empty(F.col("b"), T.BooleanType(), false_is_empty=False)).first()[0] is False


def test_name_join_never_fans_out(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    right = spark.createDataFrame([("a", 5), ("a", 3), (None, 9)], "title string, hours int")
    out = {r["id"]: r["hours"] for r in merge.left_join_by_name(left, right, "name", "title").collect()}
    assert out == {1: 3, 2: None, 3: None}


@pytest.mark.parametrize("limit", [100, None])
def test_band_join_against_brute_force(spark, limit):
    xs = [0.0, 0.5, 1.0, 1.0, 1.0, 2.5, 9.0, None, -3.0]
    grid = [(0.0, 1.0), (1.0, 0.25), (5.0, 4.0), (-3.0, 0.0)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    g = spark.createDataFrame(grid, "c double, w double")
    out = sorted((r["x"], r["c"]) for r in merge.band_join(rows, g, "x", "c", "w", max_grid=limit).collect())
    assert out == sorted((x, c) for x in xs if x is not None for c, w in grid if c - w <= x <= c + w)


DUP_DDL = "id int, name string, day string, reviews int, tags array<string>, price double"
DUPS = [
    (1, "a", "d", 10, ["x"], None),
    (2, "a", "d", 90, [], 5.0),
    (3, "a", "d", 90, ["x", "y"], 7.0),
    (4, "b", "d", None, None, 1.0),
    (5, None, "d", 1, ["n"], 1.0),
    (6, None, "d", 2, [], 2.0),
]


@pytest.mark.parametrize("limit", [100, None])
def test_collapse(spark, limit):
    df = spark.createDataFrame(DUPS, DUP_DDL)
    out = {r["id"]: r for r in dedupe.collapse_duplicates(df, ["name", "day"], {"reviews": 2.0, "tags": 1.0}, "id", max_groups=limit).collect()}
    assert set(out) == {3, 4, 5, 6}
    assert out[3]["price"] == 7.0 and out[3]["tags"] == ["x", "y"] and out[3]["reviews"] == 90
    assert out[4]["tags"] is None and out[6]["tags"] == []


def test_collapse_fills_gaps_from_lower_scores(spark):
    df = spark.createDataFrame([(1, "a", 1, [], 3.0), (2, "a", 9, [], None)], "id int, name string, reviews int, tags array<string>, price double")
    row = dedupe.collapse_duplicates(df, ["name"], {"reviews": 1.0}, "id").first()
    assert (row["id"], row["reviews"], row["price"], row["tags"]) == (2, 9, 3.0, [])


def test_null_score_option(spark):
    df = spark.createDataFrame([(1, "a", None, "low"), (2, "a", 9, "high")], "id int, name string, reviews int, v string")
    assert dedupe.collapse_duplicates(df, ["name"], {"reviews": 1.0}, "id").first()["v"] == "high"
    assert dedupe.collapse_duplicates(df, ["name"], {"reviews": 1.0}, "id", null_score_wins=True).first()["v"] == "low"


def test_group_size_and_null_keys(spark):
    df = spark.createDataFrame(DUPS, DUP_DDL)
    sizes = {r["id"]: r["group_count"] for r in dedupe.with_group_size(df, ["name", "day"]).collect()}
    assert sizes == {1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 1}
    assert dedupe.with_group_size(df, ["name", "day"], drop_null_keys=True).count() == 4


def test_unique_key(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    with pytest.raises(ValueError, match="duplicate key"):
        dedupe.assert_unique(df, "k")
    assert dedupe.assert_unique(df.distinct(), "k").count() == 2


def test_fuzzy_lookup(spark):
    df = spark.createDataFrame([("tags_cout",), ("tags_cout",), ("prise",), (None,)], "t string")
    out = {(r["text"], r["rank"]): r["match"] for r in fuzzy.fuzzy_lookup(df, "t", ["price", "tags_count", "tag"], k=2).collect()}
    assert out[("tags_cout", 1)] == "tags_count" and out[("prise", 1)] == "price" and len(out) == 4
    for block in (1, 2):  # any number of blocks gives the same
        again = fuzzy.fuzzy_lookup(df, "t", ["price", "tags_count", "tag", None, "tag"], k=2, block=block).collect()
        assert {(r["text"], r["rank"]): r["match"] for r in again} == out


def test_fuzzy_rounds_equal_the_scan_of_all_pairs(spark):
    rng = random.Random(11)
    parts = "ba be co da el fi gro han ist ka lu mo ne or pra qu ris sto tul um é".split()
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(2_000)}) + ["", "a", "aaaaaaaaaaaa", "aaaaaa"]
    texts = ["", "zzzz", "aaaaaaaa", "x" * 300, None]
    for word in rng.sample(words, 150):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word) + 1)
            word = word[:i] + rng.choice(["", "x", "a"]) + word[i + rng.randrange(2) :]
        texts.append(word)
    df = spark.createDataFrame([(t,) for t in texts], "t string").unionAll(spark.createDataFrame([(t,) for t in texts[:40]], "t string"))
    vocab = spark.createDataFrame([(w, 1) for w in words], "word string, text int")
    for k in (1, 4):
        got = sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "t", vocab, k).collect())
        assert got == sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "t", vocab, k, rounds=()).collect())
        assert len(got) == k * len({t for t in texts if t is not None})


def test_few_pairs_are_measured(spark):
    """Misspelt by one letter: the first round finds them and measures under one in a hundred of all pairs."""
    rng = random.Random(2)
    parts = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    words = sorted({"".join(rng.choice(parts) for _ in range(5)) for _ in range(4_000)})
    texts = [w[:3] + w[4:] for w in rng.sample(words, 300)]
    words = fuzzy._strings(spark.createDataFrame([(w,) for w in words], "w string"), "w", "word_no", "word")
    texts = fuzzy._strings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "text_no", "text")
    assert fuzzy.candidate_pairs(texts, words, *fuzzy.ROUNDS[0]).count() < 0.01 * texts.count() * words.count()
    with pytest.raises(ValueError):
        fuzzy.candidate_pairs(texts, words, 3, 40)


def test_merge_all_moves_rows_as_they_came(spark):
    """One exchange for the rows with a key, no aggregate before it; nulls, empty and missing values resolve as ever."""
    a = spark.createDataFrame([(1, 0, ["x"], None), (2, 5, None, "u"), (None, 7, [], "v")], "k int, n int, t array<string>, s string")
    b = spark.createDataFrame([(1, 3, ["y", "x"]), (3, None, ["z"]), (None, 8, None)], "k int, n int, t array<string>")
    only = spark.createDataFrame([(3,), (4,)], "k int")
    out = merge.merge_all([(a, {}), (b, {"t": merge.union_lists_or_either}), (only, {})], "k")
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    assert got == sorted(map(str, [(1, 3, ["x", "y"], None), (2, 5, None, "u"), (3, None, ["z"], None), (4, None, None, None), (None, 7, [], "v"), (None, 8, None, None)]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("Aggregate") < plan.index("Exchange")


def test_few_pairs_are_measured_where_names_share_their_stem(spark):
    """All misspelt in the same stem, told apart by digits: the grams of the stem cost edits and meet nothing."""
    names = [f"Customer#{i * 37:09d}" for i in range(2_000)]
    df = spark.createDataFrame([(n[:4] + "0" + n[5:8] + n[9:],) for n in names[::10]], "t string")
    vocab = spark.createDataFrame([(n,) for n in names], "w string")
    words, texts = fuzzy._strings(vocab, "w", "word_no", "word"), fuzzy._strings(df, "t", "text_no", "text")
    assert fuzzy.candidate_pairs(texts, words, *fuzzy.ROUNDS[1]).count() < 0.02 * texts.count() * words.count()
    got = sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "t", vocab, 2).collect())
    assert got == sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "t", vocab, 2, rounds=()).collect())


def test_fuzzy_candidates_miss_no_pair(spark):
    """Repeated letters, unequal lengths, strings too long to travel with their grams; every round on its own."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(150)} | {"ab" * 40, "ab" * 38 + "c", "a" * 70})
    texts = sorted({w[:i] + rng.choice(["", "b", "aa"]) + w[i + rng.randrange(2) :] for w in words for i in [rng.randrange(len(w) + 1)]})
    w = fuzzy._strings(spark.createDataFrame([(x,) for x in words], "w string"), "w", "word_no", "word")
    t = fuzzy._strings(spark.createDataFrame([(x,) for x in texts], "t string"), "t", "text_no", "text")
    for q, percent in fuzzy.ROUNDS:
        got = {(r["text"], r["word"]) for r in fuzzy.near_within(t, w, q, percent).collect()}
        pairs = t.crossJoin(w).where(f"levenshtein(text, word) <= floor(greatest(length(text), length(word)) * {percent} / 100)")
        assert got == {(r["text"], r["word"]) for r in pairs.collect()}


@pytest.mark.parametrize("limit", [2_000, None])
def test_band_join_with_windows_of_all_widths(spark, limit):
    """One window over the whole axis and 1,000 narrow ones: pairs tested stay within three times the result."""
    rng = random.Random(7)
    xs = [rng.uniform(-1e4, 1e4) for _ in range(3_000)] + [0.0, 5e-324, 1e300, 1e308, -1e308, 4.0, 4.0, float("nan")]
    grid = [(rng.uniform(-1e4, 1e4), rng.choice([1.0, 3.0, 20.0, 55.0])) for _ in range(1_000)]
    grid += [(0.0, 2e4), (0.0, 0.0), (4.0, 0.0), (1e300, 1e290), (1e308, 1e307), (7.0, -1.0), (None, 1.0), (1.0, None)]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "x double, c long")
    g = spark.createDataFrame([(c, w, k) for k, (c, w) in enumerate(grid)], "c double, w double, k int")
    want = sorted((i, k) for i, x in enumerate(xs) for k, (c, w) in enumerate(grid) if None not in (c, w) and c - w <= x <= c + w)
    got = merge.band_join(rows.withColumnRenamed("c", "i"), g, "x", "c", "w", max_grid=limit)
    assert sorted((r["i"], r["k"]) for r in got.collect()) == want
    assert merge.band_candidates(rows, g, "x", "c", "w", limit).count() < 3 * len(want)


@pytest.mark.parametrize("block", [10, 4096])
def test_repeated_keys_pair_in_blocks(spark, block):
    """A key in a third of both sides, one that only a side has, null keys, rows alike."""
    left = [(7 if i % 3 == 0 else None if i % 50 == 1 else i % 40, f"a{i % 200}") for i in range(600)] + [(-1, "x")] * 30 + [(-2, f"{i}") for i in range(90)]
    right = [(7 if i % 3 == 0 else None if i % 50 == 1 else i % 60, f"b{i}") for i in range(300)] + [(-3, "y")] * 25
    master, incoming = (spark.createDataFrame(r, f"k int, {c} string").repartition(4) for r, c in ((left, "a"), (right, "b")))
    got = sorted(map(str, merge.merge_sources(master, incoming, "k", block=block).collect()))
    want = [(k, a, b) for k, a in left if k is not None for j, b in right if j == k]
    keys = {k for k, _ in left} & {k for k, _ in right} - {None}
    want += [(k, a, None) for k, a in left if k not in keys] + [(k, None, b) for k, b in right if k not in keys]
    assert got == sorted(f"Row(k={k!r}, a={a!r}, b={b!r})" for k, a, b in want)


def test_no_block_of_a_hot_key_is_large(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 10 < 3, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(2_000).select(F.when(F.col("id") % 10 < 3, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    blocks = merge.paired(left, right, "k", block=200).where("m.k = 0").groupBy("m._at__m", "m._at__s").count().collect()
    sizes = [r["count"] for r in blocks]
    assert sum(sizes) == 6_000 * 600 and len(sizes) == 30 * 3 and max(sizes) < 2 * sum(sizes) / len(sizes)


def _copies(spark, rows, block=2):
    """Pairs, blocks, rows copied into blocks and tasks for a key that is all of two sides of ``rows`` rows."""
    left, right = (spark.range(rows).select(F.lit(0).alias("k"), F.col("id").alias(c)) for c in "ab")
    found = merge.paired(left, right, "k", block=block).select("m._at__m", "m._at__s", "a", "b", F.spark_partition_id().alias("task"))
    blocks = found.groupBy("_at__m", "_at__s").agg(F.count("*").alias("n"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"), F.max("task").alias("task")).collect()
    return sum(r["n"] for r in blocks), len(blocks), sum(r["a"] + r["b"] for r in blocks), len({r["task"] for r in blocks}), max(max(r["a"], r["b"]) for r in blocks)


def test_copies_of_a_hot_key_grow_with_its_rows(spark):
    """With blocks of a fixed width, twice the rows are copied four times as often; few bytes make many pairs, but not one task."""
    pairs, blocks, copied, tasks, _ = _copies(spark, 400)
    pairs2, blocks2, copied2, _, _ = _copies(spark, 800)
    assert (pairs, pairs2) == (400 * 400, 800 * 800)
    assert copied2 < 2.5 * copied and tasks == 8
    assert blocks <= merge.BLOCKS and blocks2 <= merge.BLOCKS


def test_blocks_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(merge, "BLOCKS", 4)
    monkeypatch.setattr(merge, "WIDEST", 50)
    pairs, blocks, _, _, widest = _copies(spark, 400)
    assert pairs == 400 * 400 and blocks == 64 and widest < 2 * 50  # 200 rows wide without the bound


def test_wide_blocks_lose_no_pair(spark, monkeypatch):
    """Hot on both sides, on one side, null keys, keys of different types, rows alike."""
    monkeypatch.setattr(merge, "BLOCKS", 9)
    left = [(7 if i % 2 == 0 else None if i % 50 == 1 else i % 40, f"a{i % 90}", i % 3 if i % 7 else None) for i in range(200)] + [(-2, f"{i}", 1) for i in range(30)]
    right = [(7 if i % 2 == 0 else None if i % 50 == 1 else i % 60, i % 5, f"b{i}") for i in range(120)] + [(-3, 4, "y")] * 25
    master = spark.createDataFrame(left, "k int, a string, n int").repartition(4)
    incoming = spark.createDataFrame(right, "k long, n int, b string").repartition(4)
    got = sorted(map(str, merge.merge_sources(master, incoming, "k", block=5).collect()))
    keys = {k for k, _, _ in left} & {k for k, _, _ in right} - {None}
    want = [(k, a, n or o, b) for k, a, n in left if k in keys for j, o, b in right if j == k]
    want += [(k, a, n or None, None) for k, a, n in left if k not in keys] + [(k, None, o, b) for k, o, b in right if k not in keys]
    assert got == sorted(f"Row(k={k!r}, a={a!r}, n={n!r}, b={b!r})" for k, a, n, b in want)


def test_halves_miss_no_pair(spark, monkeypatch):
    """Texts that crowds share grams with are looked up by their halves; all edits, at the ends and in the middle, of short and long strings."""
    monkeypatch.setattr(fuzzy, "CROWD", 3)
    rng = random.Random(8)
    words = sorted({f"Store#{rng.randrange(600):0{rng.choice([3, 6, 9])}d}" for _ in range(150)} | {"", "a", "ab", "é" * 70, "Store#" + "é" * 60})
    texts = ["", "b", "é" * 69, "Store#" + "é" * 58]
    for w in rng.sample(words, 60):
        for _ in range(rng.randrange(4)):
            i = rng.choice([0, len(w) // 2, len(w), rng.randrange(len(w) + 1)])
            w = w[:i] + rng.choice(["", "0", "#0"]) + w[i + rng.randrange(2) :]
        texts.append(w)
    w = fuzzy._strings(spark.createDataFrame([(x,) for x in words], "w string"), "w", "word_no", "word")
    t = fuzzy._strings(spark.createDataFrame([(x,) for x in texts], "t string"), "t", "text_no", "text")
    q, percent = fuzzy.ROUNDS[1]
    got = {(r["text"], r["word"]) for r in fuzzy.near_within(t, w, q, percent).collect()}
    pairs = t.crossJoin(w).where(f"levenshtein(text, word) <= floor(greatest(length(text), length(word)) * {percent} / 100)")
    assert got == {(r["text"], r["word"]) for r in pairs.collect()}
    df, vocab = t.select("text"), w.select("word")
    got = sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "text", vocab, 3).collect())
    assert got == sorted(tuple(r) for r in fuzzy.fuzzy_lookup(df, "text", vocab, 3, rounds=()).collect())


def test_pairs_do_not_grow_with_the_square_of_names_that_share_their_stem(spark, monkeypatch):
    """Five times the names of one stem make no more pairs for each."""
    monkeypatch.setattr(fuzzy, "CROWD", 10)
    names = spark.range(2_500).select(F.format_string("Customer#%09d", "id").alias("w"))
    wrong = names.select(F.concat(F.substring("w", 1, 4), F.lit("0"), F.substring("w", 6, 3), F.substring("w", 10, 9)).alias("t"))
    texts, words = fuzzy._strings(wrong, "t", "text_no", "text"), fuzzy._strings(names, "w", "word_no", "word")
    pairs = [fuzzy.candidate_pairs(texts.where(f"text < 'Cust0mer{n:09d}'"), words.where(f"word < 'Customer#{n:09d}'"), *fuzzy.ROUNDS[1], 3).count() for n in (500, 2_500)]
    assert pairs[1] < 10 * pairs[0] and pairs[1] < 2_500 * 60
