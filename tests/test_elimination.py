"""Recursive elimination against least squares over the rows themselves."""

import random

import numpy as np
import pytest

from marquetry.operators import models as ML

COLS = ["strong", "weak", "noise", "copy"]


def brute_elimination(rows, folds):
    """Least squares row by row: drop the smallest coefficient, score on the fold left out, repeat on all rows down to the best size."""
    x = np.array([[1.0, *(r[c] for c in COLS)] for r in rows])
    y, fold = np.array([r["y"] for r in rows]), np.array([r["_fold"] for r in rows])

    def path(mask):
        left = list(range(1, len(COLS) + 1))
        while left:
            beta = np.linalg.lstsq(x[mask][:, [0, *left]], y[mask], rcond=None)[0]
            yield list(left), beta
            left.pop(int(np.argmin(np.abs(beta[1:]))))

    curve = {}
    for f in range(folds):
        test = fold == f
        for left, beta in path(~test):
            off = y[test] - x[test][:, [0, *left]] @ beta
            curve.setdefault(len(left), []).append(1 - (off @ off) / ((y[test] - y[test].mean()) ** 2).sum())
    curve = {n: float(np.mean(v)) for n, v in curve.items()}
    best = min(curve, key=lambda n: (-curve[n], n))
    sizes = {a: min(len(left) for left, _ in path(y == y) if a in left) for a in range(1, len(COLS) + 1)}
    rank = {COLS[a - 1]: 1 if n <= best else n - best + 1 for a, n in sizes.items()}
    return rank, curve


@pytest.mark.parametrize("folds,seed", [(5, 42), (3, 7)])
def test_elimination_equals_least_squares_over_rows(spark, folds, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        rows.append((i, a, b, c, a + rng.gauss(0, 0.1), 3 * a + 0.4 * b + rng.gauss(0, 1)))
    rows += [(1000, None, 1.0, 1.0, 1.0, 5.0), (1001, 1.0, 1.0, 1.0, 1.0, None)]  # incomplete rows take no part
    df = spark.createDataFrame(rows, "id long, strong double, weak double, noise double, copy double, y double").repartition(3)
    got, curve = ML.rfe_cv(df, "y", COLS, "id", folds=folds, seed=seed)
    whole = [r.asDict() for r in ML._folded(df, "id", folds, seed).dropna().collect()]
    rank, means = brute_elimination(whole, folds)
    assert {r.feature: r.ranking for r in got.collect()} == rank
    assert all(r.selected == (rank[r.feature] == 1) for r in got.collect())
    assert {r.n_features: r.mean_r2 for r in curve.collect()} == {n: pytest.approx(v, abs=1e-8) for n, v in means.items()}
