from datetime import date

import pytest
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions import metrics as M
from marquetry.functions import parsing as P
from marquetry.functions.tails import beta_inc, f_tail, t_two_sided


def values(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def texts(spark, items, expr):
    return values(spark, [(x,) for x in items], "c string", expr)


def test_splitting_and_counting(spark):
    assert texts(spark, ["a,b", "", None, " a ;b"], P.split_list("c")) == [["a", "b"], [""], [], [" a ;b"]]
    assert texts(spark, ["a;b", None], P.split_list("c", ";")) == [["a", "b"], []]
    assert texts(spark, ["a,b,c", "", None], P.count_items("c")) == [3, 1, 0]


def test_range_midpoint(spark):
    given = ["100000000 - 200000000", "0", "0.0", "5", "x - 3", None, "10-20"]
    assert texts(spark, given, P.range_midpoint("c")) == [150000000.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0]
    assert texts(spark, ["10-20"], P.range_midpoint("c", "-")) == [15.0]
    assert texts(spark, ["10,000,000 .. 20,000,000"], P.range_midpoint(P.normalize_range("c"))) == [15000000.0]


def test_sentinels_and_ranges(spark):
    assert texts(spark, ["8999.0", "59.99", "free", None], P.null_if_out_of_range("c")) == [None, 59.99, None, None]
    assert texts(spark, ["FALSE", "False", "88", None], P.null_if_sentinel("c")) == [None, None, 88.0, None]
    assert texts(spark, ["{'FPS': 90076, 'Shooter': 64786}", None], P.map_key_list("c")) == [["FPS", "Shooter"], []]
    assert texts(spark, ["1999", "n/a"], P.cents_to_units("c")) == [19.99, None]


def test_coercion(spark):
    assert texts(spark, ["1.5", "x", None, "NaN"], P.to_double("c")) == [1.5, None, None, None]
    assert texts(spark, ["1.9", "-1.9", "9007199254740993", "x", "1e3"], P.to_long("c")) == [1, -1, 9007199254740993, None, 1000]
    assert texts(spark, ["True", "false", "1", "yes", None], P.to_bool("c")) == [True, False, None, None, None]


def test_dates(spark):
    given = ["1998-11-08", "2018-04-05 00:00:00", "Dec 22, 2023", "February 9, 2024", "January 2020", "Jan 2020", "May 2020", "Not Released", "coming_soon", "unknown", "", None]
    want = [date(1998, 11, 8), date(2018, 4, 5), date(2023, 12, 22), date(2024, 2, 9), date(2020, 1, 1), date(2020, 1, 1), date(2020, 5, 1)] + [None] * 5
    assert texts(spark, given, P.parse_date("c")) == want
    assert texts(spark, ["someday"], P.parse_date("c", on_error="null")) == [None]
    with pytest.raises(Exception, match="invalid date"):
        texts(spark, ["someday"], P.parse_date("c"))


def test_list_normalisation(spark):
    given = ["['B', 'a', 'b']", '["It\'s", "x"]', "[]", "", None, r"['caf\xe9']", "['a, b', 'c']"]
    want = [["a", "b"], ["it's", "x"], [], [], [], ["café"], ["a, b", "c"]]
    assert texts(spark, given, P.normalize_list("c")) == want
    for bad in ("[1, 2]", "['a', 3]", "not a list", "{'a': 1}"):
        with pytest.raises(Exception, match="invalid list"):
            texts(spark, [bad], P.normalize_list("c"))
    assert texts(spark, ["['a']", "oops"], P.parse_list_or_empty("c")) == [["a"], []]


def test_vocabulary(spark):
    given = ["['English', 'French (full audio)', 'Klingon', 'english']", None]
    assert texts(spark, given, P.normalize_vocab("c", is_text=True)) == [["english", "french"], []]
    # an ambiguous element takes the alphabetically first allowed term
    assert texts(spark, ["['german and dutch']"], P.normalize_vocab("c", is_text=True)) == [["dutch"]]
    assert len(K.LANGUAGES) == len(set(K.LANGUAGES)) == 102


def test_tag_spelling_is_substring_replacement(spark):
    out = values(spark, [(["action rogue-like", "parody ", "base building"],), (None,)], "c array<string>", P.replace_in_list("c", K.TAG_FIXES))
    assert out == [["action roguelike", "parody", "base-building"], []]


def test_row_helpers(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (float("nan"), 3.0, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(P.row_mean("a", "b", "c")).collect()] == [2.5, None, 3.0]
    assert [r[0] for r in df.select(P.row_max("a", "b", "c")).collect()] == [4.0, None, 3.0]


def test_bin_closure(spark):
    edges = values(spark, [(0,), (50,), (51,), (5000,), (5001,), (None,)], "c int", P.bucketize("c", K.REVIEW_BIN_EDGES))
    assert edges == [0, 0, 1, 6, 7, None]
    left = values(spark, [(0.0,), (1.0,), (2.0,)], "c double", P.bucketize("c", [0, 1, 2], "left"))
    assert left == [0, 1, None]
    assert values(spark, [(2.0,)], "c double", P.bucketize("c", [0, 1, 2], "left", last_closed=True)) == [1]


def test_price_brackets(spark):
    out = values(spark, [(0.0,), (4.99,), (5.0,), (80.0,), (None,)], "c double", M.price_bracket(F.col("c")))
    assert out == ["Free", "<10", "5-10", "80+", "Unknown"]


def test_decayed_score(spark):
    tags = [(["casual", "indie", "cozy", "moddable"],), (["mmorpg", "massively multiplayer", "unknown"],), ([],)]
    out = values(spark, tags, "c array<string>", M.decayed_score(F.col("c")))
    assert out == pytest.approx([1 - 0.64453125, 1 + 3 + 0.75, 1.0])


def test_owner_estimate(spark):
    rows = [(100, 2013, 0.0), (100, 2012, 0.0), (100, 2020, 0.0), (100, 2021, 0.0), (200000, 2014, None), (0, 2014, 0.0), (None, 2014, 0.0), (100, None, 0.0)]
    df = spark.createDataFrame(rows, "r bigint, y int, p double")
    out = [r[0] for r in df.select(M.estimate_owners(F.col("r"), F.col("y"), F.col("p"))).collect()]
    assert out == [23700, 24000, 24000, 9300, None, None, None, 24000]
    open_start = [r[0] for r in df.limit(2).select(M.estimate_owners(F.col("r"), F.col("y"), F.col("p"), open_start=True)).collect()]
    assert open_start == [23700, 23700]


def test_discount_without_age(spark):
    out = values(spark, [(0.5, None), (0.0, 10.0)], "d double, a double", M.discount_factor(F.col("d"), F.col("a")))
    assert out == pytest.approx([0.8 - 0.15, 0.8])


def test_step_round(spark):
    given = [(29,), (479,), (48713,), (100,), (25,)]
    assert values(spark, given, "c bigint", P.step_round("c", K.STEP_ROUNDING)) == [30, 500, 50000, 100, 20]


def test_binomial_interval_edges(spark):
    df = spark.createDataFrame([(0, 0), (10, 10), (5, 10)], "s int, n int")
    lo, hi = M.binom_ci(F.col("s"), F.col("n"))
    rows = df.select(lo, hi).collect()
    assert tuple(rows[0]) == (0.0, 0.0) and tuple(rows[1]) == (1.0, 1.0)
    assert rows[2][0] == pytest.approx(0.5 - 1.959964 * (0.025) ** 0.5, abs=1e-6)


def test_distribution_tails():
    # textbook critical values
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(4.256495, 2, 9) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(3.0, 1, 1) == pytest.approx(1 / 3, abs=1e-12)
    assert beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert t_two_sided(0.0, 5) == 1.0


def test_long_elements_of_a_list_literal(spark):
    long = "a" * 30_000
    assert texts(spark, [f"['{long}', \"b\\'c\"]"], P.read_list("c")) == [[long, "b'c"]]
    assert texts(spark, [r"['caf\xE9', 'x']", "['English', 'french (audio)', 'none']"], P.normalize_vocab("c", ["english", "french", "x"], is_text=True)) == [["x"], ["english", "french"]]
