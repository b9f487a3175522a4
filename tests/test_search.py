"""Boosted stumps against rows boosted one by one, and successive halving against full scoring."""

import math
import random

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from marquetry.operators import models, stumps
from marquetry.plans.skew import hash_fraction


def plain_boosting(rows, edges, folds, rounds, rate):
    """Rows are (fold, x, y); every split is tried on the rows themselves."""
    place = lambda x: -1 if x is None or math.isnan(x) else sum(e < x for e in edges)
    out = []
    for fold in range(folds):
        train = [(place(x), y) for f, x, y in rows if f != fold]
        held = [(place(x), y) for f, x, y in rows if f == fold]
        start = sum(y for _, y in train) / len(train)
        splits = []

        def value(b, start=start, splits=splits):
            return start + sum(lo if b <= at else hi for at, lo, hi in splits)

        for _ in range(rounds):
            rest = [(b, y - value(b)) for b, y in train]
            best = None
            for at in range(-1, len(edges)):
                left, right = [r for b, r in rest if b <= at], [r for b, r in rest if b > at]
                if left and right:
                    gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, at, rate * sum(left) / len(left), rate * sum(right) / len(right))
            splits.append(best[1:])
        mean = sum(y for _, y in held) / len(held)
        out.append(1 - sum((y - value(b)) ** 2 for b, y in held) / sum((y - mean) ** 2 for _, y in held))
    return sum(out) / folds


def test_stumps_equal_boosting_on_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        a, b = rng.gauss(0, 1), rng.randrange(5)
        rows.append((i, a if rng.random() > 0.1 else None, float(b), rng.choice([1.0, float("nan")]), 3 * math.sin(a) + b + rng.gauss(0, 0.3)))
    df = spark.createDataFrame(rows + [(900, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double").repartition(3)
    cols = ["a", "b", "c"]
    got = {r["feature"]: r["r2"] for r in stumps.feature_power(df, "y", cols, "id", max_iter=6, folds=3, seed=7, bins=16).collect()}
    edges = {r["column"]: r["edges"] for r in stumps.bin_edges(df, cols, 16).collect()}
    fold = df.where("y is not null").select("*", F.floor(hash_fraction(7, F.col("id")) * 3).cast("int").alias("f")).collect()
    assert len(edges["a"]) == 15 and len(edges["b"]) == 5
    for c in cols:
        assert got[c] == pytest.approx(plain_boosting([(r["f"], r[c], r["y"]) for r in fold], edges.get(c, []), 3, 6, 0.3), abs=1e-9)
    assert got["a"] > got["b"] > got["c"]


def test_many_columns_are_two_aggregates(spark):
    """150 columns: the number of jobs does not grow with columns or rounds."""
    cols = [f"x{i}" for i in range(150)]
    df = spark.range(400).select("id", *[(F.xxhash64("id", F.lit(i)) % 97).cast("double").alias(c) for i, c in enumerate(cols)])
    df = df.withColumn("y", F.col("x77") * 2 + F.col("x3"))
    group = "many-columns"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = stumps.feature_power(df, "y", cols, "id", max_iter=40, folds=3).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["feature"] for r in out[:2]] == ["x77", "x3"] and len(out) == 150
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 15


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 2.0)], "id int, a double, y double")
    assert [(r["feature"], r["r2"]) for r in stumps.feature_power(df, "y", ["a"], "id").collect()] == [("a", 0.0)]
    assert stumps.feature_power(df.limit(0), "y", ["a"], "id").collect() == []


def test_halving_finds_the_best_trial_with_few_fits(spark):
    df = spark.range(4_000).select("id", (F.col("id") % 64).cast("double").alias("x"), F.lit(1.0).alias("z"))
    df = df.withColumn("y", F.when(F.col("x") % 8 < 4, F.col("x")).otherwise(-F.col("x")) + F.rand(3))
    est = DecisionTreeRegressor(labelCol="y", featuresCol="features", seed=1)
    space, fits = {"maxDepth": [1, 2, 3, 4, 5, 6, 7, 8, 9]}, []
    fit = DecisionTreeRegressor._fit
    DecisionTreeRegressor._fit = lambda self, data: fits.append(data) or fit(self, data)
    try:
        table = models.halving(est, space, df, ["x", "z"], "y", "id", n_trials=9, seed=5).collect()
    finally:
        DecisionTreeRegressor._fit = fit
    assert len(table) == 9 and [r["rung"] for r in table] == [2] + [1] * 2 + [0] * 6
    rows = {r["rung"]: r["rows"] for r in table}
    assert rows[0] < rows[1] < rows[2] and 2.5 < rows[2] / rows[1] < 3.5
    assert len(fits) == 9 + 3 + 1 < 9 * 5 / 2  # full scoring is five folds for each trial
    full = models.tune(est, space, df, ["x", "z"], models.r2_evaluator("y"), "id", n_trials=9, seed=5, folds=3).collect()
    best = {r["params"] for r in full if r["mean"] > full[0]["mean"] - 1e-3}
    assert table[0]["params"] in best
