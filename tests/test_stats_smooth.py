import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquetry.operators import reports, smooth, stats


def test_welch_against_numpy(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 24.4]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    row = stats.welch_ttest(df, "v", "g").first()
    va, vb = np.var(a, ddof=1) / 15, np.var(b, ddof=1) / 15
    assert row["t_stat"] == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt(va + vb))
    # the tail area by numerical integration of the t density
    dof = row["dof"]
    grid = np.linspace(abs(row["t_stat"]), 400, 2_000_001)
    density = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + grid**2 / dof) ** (-(dof + 1) / 2)
    assert dof == pytest.approx((va + vb) ** 2 / (va**2 / 14 + vb**2 / 14))
    assert row["p_value"] == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-7)


def test_welch_guards(spark):
    three = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, v double")
    with pytest.raises(Exception, match="exactly 2 groups"):
        stats.welch_ttest(three, "v", "g").collect()
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert stats.welch_ttest(flat, "v", "g", p_value=False).first()["t_stat"] is None


def test_anova_textbook(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("a", None)], "g string, v double")
    row = stats.anova(df, "v", "g").first()
    assert row["f_stat"] == pytest.approx(9.264706, abs=1e-5) and row["p_value"] == pytest.approx(0.0023988, abs=1e-6)
    assert row["eta_squared"] == pytest.approx(84 / 152)
    assert stats.anova(df.where("g = 'a'"), "v", "g").count() == 0


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_polynomial_fit(spark, degree):
    rng = np.random.default_rng(degree)
    x = rng.uniform(1995, 2025, 300)
    y = 3 + 0.2 * (x - 2000) - 0.05 * (x - 2000) ** 2 + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2000.0, None)], "x double, y double")
    row = stats.poly_regression(df, "x", "y", degree).first()
    fitted = np.polyval(row["coefficients"][::-1], x)
    best = np.polyval(np.polyfit(x - 2010, y, degree), x - 2010)
    assert fitted == pytest.approx(best, abs=1e-4)
    r2 = 1 - np.sum((y - best) ** 2) / np.sum((y - y.mean()) ** 2)
    assert row["n"] == 300 and row["r_squared"] == pytest.approx(r2, abs=1e-9)
    assert len(row["p_values"]) == degree + 1 and 0 <= row["f_p_value"] < 0.05


def test_slope_p_value_equals_f_p_value(spark):
    df = spark.createDataFrame([(float(i), float((i * 7) % 11)) for i in range(30)], "x double, y double")
    row = stats.poly_regression(df, "x", "y").first()
    assert row["p_values"][1] == pytest.approx(row["f_p_value"], rel=1e-9)


def test_adjustment_removes_group_level(spark):
    df = spark.createDataFrame([(y, float(v + 10 * y)) for y in (1, 2, 3) for v in range(5)] + [(4, 1.0)], "y int, v double")
    out = stats.adjust_for_group(df, "v", "y", "a")
    means = {r[0]: r[1] for r in out.groupBy("y").agg(F.avg("a")).collect()}
    assert means[1] == pytest.approx(means[2]) and means[4] is None


def test_factor_battery_finds_the_driver(spark):
    rng = np.random.default_rng(0)
    rows = [(int(2000 + i % 5), float(x), float(z), "hi" if x > 0.5 else "lo", float(x + 0.1 * e)) for i, (x, z, e) in enumerate(zip(rng.uniform(size=400), rng.uniform(size=400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "release_year int, x double, z double, c string, y double")
    battery = stats.factor_battery(df, "y", [stats.Factor("x", F.col("x")), stats.Factor("z", F.col("z"), degree=2, trim=(0.01, 0.99))], [stats.Factor("c", F.col("c"))])
    ranked = [r.asDict() for r in reports.rank_factors(battery).collect()]
    assert ranked[0]["factor"] == "x" and ranked[0]["strength"] == "strong" and ranked[0]["significance"] == "significant"
    assert ranked[-1]["factor"] == "z" and ranked[-1]["n"] < 400


def test_catalog_battery_runs(spark):
    rng = np.random.default_rng(5)
    n = 200
    ddl = (
        "release_year int, steam_total_reviews int, steam_positive_review_ratio double, achievements_count int, average_time_to_beat double, price_original double, "
        "steam_store_movie_count int, steam_store_screenshot_count int, languages_supported array<string>, languages_with_full_audio array<string>, tags array<string>, "
        "controller_support string, early_access boolean, gamefaqs_difficulty_rating string, has_demos boolean, runs_on_linux boolean, runs_on_mac boolean, "
        "runs_on_steam_deck boolean, runs_on_windows boolean, vr_supported boolean"
    )
    flag = lambda: bool(rng.integers(2))
    rows = [
        (int(rng.integers(2000, 2005)), 50, float(rng.uniform()), int(rng.integers(1, 99)), float(rng.uniform(1, 9)), float(rng.uniform(1, 60)), int(rng.integers(9)), int(rng.integers(20)),
         ["english"] * int(rng.integers(1, 9)), ["english"] * int(rng.integers(1, 5)), ["a"] * int(rng.integers(9)), ["full", "none", None][int(rng.integers(3))], flag(),
         ["Easy", "Easy-Just Right", None][int(rng.integers(3))], flag(), flag(), flag(), flag(), flag(), flag())
        for _ in range(n)
    ]
    out = stats.factor_battery(spark.createDataFrame(rows, ddl), "steam_positive_review_ratio", *stats.catalog_factors())
    got = {r["factor"]: r["n"] for r in out.collect()}
    assert len(got) == 17 and got["gamefaqs_difficulty_rating"] == n


def test_savgol_weights():
    w = [v for t, _, v in smooth.savgol_weights(9, 5, 2) if t == 4]
    assert w == pytest.approx(np.array([-3, 12, 17, 12, -3]) / 35)
    # a quadratic passes unchanged, ends included
    y = (np.arange(9) - 3.0) ** 2
    out = np.zeros(9)
    for t, s, v in smooth.savgol_weights(9, 5, 2):
        out[t] += v * y[s]
    assert out == pytest.approx(y)
    assert len({s for t, s, _ in smooth.savgol_weights(6, 13, 2) if t == 0}) == 5


def test_density(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(2).normal(size=500)], "x double")
    rows = smooth.kde(df, "x", 60).orderBy("x").collect()
    xs, ds = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert np.trapezoid(ds, xs) == pytest.approx(1.0, abs=0.03)
    assert smooth.kde(df.limit(1), "x", 10).count() == 0
    assert smooth.kde(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 10).count() == 0


def test_grids():
    grid = smooth.price_grid(0.0, 80.0)
    assert len(grid) == 90 and grid[0] == 0.0 and grid[30] == 5.0 and grid[60] == 25.0 and grid[-1] == 80.0
    edges = smooth.step_edges([(0, 2, 0.1), (2, 5, 0.25), (5, 15, 0.5)])
    assert len(edges) == 21 + 12 + 20


def test_triangular_mean_edges(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0), (None, 5.0)], "x double, v double")
    out = {r["center"]: r["mean"] for r in smooth.triangular_mean(df, "v", "x", [1.0, 2.0, 4.0], [1.0, 2.0, 1.0]).collect()}
    assert out == {1.0: 10.0, 2.0: 20.0, 4.0: None}


def test_histogram_closure_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (4.0,), (None,)], "x double")
    assert [r["value"] for r in reports.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 2, 0, 1]
    assert [r["value"] for r in reports.histogram(df.where("x = 1"), "x", 4).orderBy("bin").collect()] == [0, 0, 2, 0]


def test_common_values_bins(spark):
    prices = [0.3, 0.3, 0.35, 1.99, 2.0, 4.99, 5.0, 15.0, 15.5, 20.0, -1.0, None]
    df = spark.createDataFrame([(p, 0.5, 10) for p in prices], "p double, r double, o int")
    out = {(r["start"], r["end"]): r["count"] for r in reports.common_values(df, "p", "r", "o").collect()}
    assert out[(0.3, 0.4)] == 3 and out[(2.0, 2.25)] == 1 and out[(4.75, 5.0)] == 1 and out[(5.0, 5.5)] == 1
    assert out[(15.0, 16.0)] == 2 and sum(out.values()) == 9  # 20.0 lies on the last edge


def test_rows_without_a_group_form_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "k int, v double")
    assert {r["k"]: r["median"] for r in reports.stats_by(df, "k", "v").collect()} == {None: 2.0, 1: 5.0}
    assert {r["k"]: r["count"] for r in reports.median_ci_by(df, "k", "v", top=None).collect()} == {None: 2, 1: 1}


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(2000 + i % 3, ["a", "b", "c", "d"][: 1 + i % 4]) for i in range(40)], "y int, tags array<string>")
    sums = reports.category_share_long(df, "y", "tags", 3).groupBy("y").agg(F.sum("share").alias("s")).collect()
    assert [r["s"] for r in sums] == pytest.approx([1.0] * 3)


def test_anova_keeps_the_null_group(spark):
    rows = [(k, c, float(i % 5 + (c == "b"))) for k in (1, None) for c in "ab" for i in range(6)]
    got = stats.anova(spark.createDataFrame(rows, "k int, c string, y double"), "y", "c", by=["k"], p_value=False).collect()
    assert sorted((r["k"] is None, r["n"], r["groups"]) for r in got) == [(False, 12, 2), (True, 12, 2)]


def test_triangular_mean_against_brute_force(spark):
    xs = [(0.0, 1.0), (0.5, 2.0), (1.0, 4.0), (1.5, 8.0), (2.0, 16.0), (7.0, 3.0)]
    centers, halves = [0.0, 1.0, 1.2, 6.5], [1.0, 1.0, 0.9, 1.0]
    df = spark.createDataFrame([(x, v) for x, v in xs] + [(None, 1.0), (1.0, None)], "x double, v double")
    got = {r["center"]: r["mean"] for r in smooth.triangular_mean(df, "v", "x", centers, halves).collect()}
    for c, h in zip(centers, halves):
        w = [(max(0.0, 1 - abs(x - c) / h), v) for x, v in xs]
        assert got[c] == pytest.approx(sum(a * v for a, v in w) / sum(a for a, _ in w))


def test_a_trim_reads_only_its_own_factors(spark):
    df = spark.range(200).select(*[(F.col("id") * k % 97).cast("double").alias(n) for n, k in (("y", 7), ("alpha", 3), ("beta", 5), ("gamma", 11))])
    trims = {"alpha": None, "beta": (0.05, 0.95), "gamma": (0.0, 0.9)}
    factors = [stats.Factor(n, F.col(n), trim=t) for n, t in trims.items()]
    out = stats.numeric_factors(df, "y", factors)
    laid = [line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "Generate explode(array(struct(factor" in line]
    assert laid and all(sum(f"struct(factor, {n}," in line for n in trims) == 1 for line in laid)
    alone = [tuple(stats.numeric_factors(df, "y", [f]).first()) for f in factors]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, alone))
