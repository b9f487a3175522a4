import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquetry.plans.quantiles import exact_quantiles, mode_by
from marquetry.plans.ranking import dense_index
from marquetry.plans.skew import attach_group_stats, lookup_join

PROBS = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99, "g": 1.0}


def test_quantiles_of_skewed_groups(spark):
    # one group holds most rows and a third of it is a single value; the sketch is far coarser than the data
    rng = np.random.default_rng(3)
    big = np.concatenate([rng.lognormal(size=20000), np.full(10000, 1.5)])
    small = {g: rng.normal(size=int(n)) for g, n in zip("bcd", (1, 2, 77))}
    rows = [("a", float(v)) for v in big] + [(g, float(v)) for g, vs in small.items() for v in vs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for limit in (10, None):
        out = {r["k"]: r for r in exact_quantiles(df, "v", PROBS, ["k"], max_groups=limit, count_as="n", accuracy=200).collect()}
        assert set(out) == {"a", "b", "c", "d"}
        for g, vs in {"a": big, **small}.items():
            assert out[g]["n"] == len(vs)
            assert [out[g][p] for p in PROBS] == pytest.approx(np.quantile(vs, list(PROBS.values())).tolist())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, "v", PROBS, accuracy=50).first()
    assert list(row) == pytest.approx(np.quantile(values, list(PROBS.values())).tolist(), rel=1e-9, abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).collect()[0]["m"] is None
    assert exact_quantiles(df.withColumn("k", F.lit(1)), "v", {"m": 0.5}, ["k"]).count() == 0


def test_too_many_groups_fails_instead_of_losing_rows(spark):
    df = spark.range(20).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="more than 3 groups"):
        exact_quantiles(df, "v", {"m": 0.5}, ["k"], max_groups=3).collect()


def test_mode_prefers_the_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (1, 3), (2, None), (2, 9)], "k int, v int")
    assert {r["k"]: r["mode"] for r in mode_by(df, "v", ["k"]).collect()} == {1: 3, 2: 9}


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_group_stats_reach_every_row_once(spark, heavy):
    keys = ["hot"] * 500 + ["warm"] * 50 + [None] * 30 + [f"k{i}" for i in range(40)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, id int").repartition(5)
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = attach_group_stats(df, stats, ["k"], "n", heavy=heavy)
    assert out.count() == len(keys)
    assert out.groupBy("k", "n").count().where("n <> count").count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_lookup_join_keeps_every_row(spark, heavy):
    keys = ["hot"] * 300 + ["unmatched"] * 200 + [None] * 50 + ["a", "b", "c"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, id int").repartition(4)
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("other", 3)], "t string, v int")
    out = lookup_join(rows, table, "k", "t", heavy)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert got == {i: {"hot": 1, "a": 2}.get(k) for i, k in enumerate(keys)} and out.columns == ["k", "id", "v"]


def test_dense_index_is_a_gapless_order(spark):
    rng = np.random.default_rng(1)
    values = sorted({int(v) for v in rng.lognormal(8, 3, size=3000)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(6)
    out = [r["i"] for r in dense_index(df, "v", "i").orderBy("v").collect()]
    assert out == list(range(len(values)))


def test_group_stats_meet_hot_and_rare_and_null_keys(spark):
    rows = [(i, "hot" if i % 2 else (None if i % 10 == 0 else f"k{i}")) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(5)
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for heavy in (1, 5, 1000):
        got = attach_group_stats(df, sizes, ["k"], "n", heavy=heavy).collect()
        assert len(got) == 400 and set(got[0].asDict()) == {"id", "k", "n"}
        assert {(r["k"], r["n"]) for r in got} >= {("hot", 200), (None, 40), ("k2", 1)}
    some = attach_group_stats(df, sizes.where("k = 'hot' or k = 'k2'"), ["k"], "n", heavy=1).collect()
    assert sorted({(r["k"], r["n"]) for r in some}) == [("hot", 200), ("k2", 1)] and len(some) == 201


def test_salts_depend_on_rows_not_on_their_order(spark):
    """A map task that runs again over rows in another order deals them as before."""
    from marquetry.plans.skew import salt_of

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.create_map(F.lit("a"), "id").alias("m"))
    once, again = (
        {r["v"]: r["s"] for r in x.select("v", salt_of(df, 64).alias("s")).collect()} for x in (df, df.repartition(7).orderBy(F.desc("v")))
    )
    assert once == again and len(set(once.values())) > 50


def test_places_in_a_global_order(spark):
    from marquetry.plans.ranking import place_rows

    rows = [(i, (i * 37) % 11 if i % 4 else None, f"t{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int, place string").repartition(6)
    out = place_rows(df, [F.desc_nulls_last("v"), F.asc("id")]).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["place"]) for r in out] == [(r[0], k + 1) for k, r in enumerate(want)]
    assert place_rows(df.limit(0), [F.asc("id")]).collect() == []


def test_numbering_at_the_bounds_of_all_buckets(spark):
    rows = spark.range(5_000).select(F.col("id"), F.floor(F.col("id") / 7).alias("v")).repartition(5)
    for buckets in (1, 2, 16, 17, 256):
        out = dense_index(rows, "v", "n", tie="id", buckets=buckets).where("n <> id or n is null")
        assert out.count() == 0
    # every STEP-th bound is compared, then those of one step
    plan = dense_index(rows, "v", "n", tie="id")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan
