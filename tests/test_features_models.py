from datetime import date

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marquetry.operators import derive, evaluate, features, filters, models
from marquetry.operators import models as ML
from marquetry.sources import writers


def test_fill_policy_rejects_unknown_columns(spark):
    with pytest.raises(ValueError, match="no fill policy"):
        features.fill_policy(spark.range(2), {})


def test_label_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(1, "z"), (2, None), (3, "a"), (4, "z")], "id int, c string")
    assert [r["c"] for r in features.label_encode(df, ["c"], "id").orderBy("id").collect()] == [0, -1, 1, 0]


def test_baseline_ties_and_rounding(spark):
    df = spark.createDataFrame([(1, "b", 1.0, 2), (0, "a", 2.0, 3), (0, "a", 4.0, 4), (1, "b", 10.0, 5)], "f int, c string, x double, o int")
    row = features.baseline_row(df, ["f", "c"], ["x"], ["o"], {}).first()
    assert row.asDict() == {"f": 0, "c": "a", "x": 3.0, "o": 4}


def test_code_tables_have_no_bound(spark, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_CODES", 3)  # the others meet their codes by a shuffle
    df = spark.range(12_000).select(F.col("id"), F.col("id").cast("string").alias("c"), (F.col("id") % 2 == 0).alias("b"))
    coded = features.label_encode(df, ["c", "b"], "id").orderBy("id").collect()
    assert [r["c"] for r in coded] == list(range(12_000)) and [r["b"] for r in coded[:3]] == [0, 1, 0]


def test_multi_hot_keeps_every_term(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, t array<string>")
    hot, model = features.multi_hot_sparse(df, "t", "v")
    assert sorted(model.vocabulary) == ["a", "b", "c"]
    assert [r["v"].numNonzeros() for r in hot.orderBy("id").collect()] == [2, 1, 0]


def test_multi_hot_places_need_no_vocabulary_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(features, "CountVectorizer", None)
    lists = [(1, ["a", "b", "a"]), (1, ["c", None, "x\ny", ""]), (None, []), (2, None), (3, [f"w{i}" for i in range(3_000)] + ["a"])]
    df = spark.createDataFrame(lists, "id int, t array<string>").repartition(3)
    hot, codes = features.multi_hot_places(df, "t", "v")
    names = {r["code"]: r["term"] for r in codes.collect()}
    assert sorted(names) == list(range(len(names))) and hot.columns == ["id", "v"]
    got = [(r["id"], r["v"] if r["v"] is None else sorted(names[p] for p in r["v"])) for r in hot.collect()]
    want = [(i, t if t is None else sorted({x for x in t if x is not None})) for i, t in lists]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rows_with_missing_features_are_scored(spark):
    rows = [(i, float(i % 7), float(i % 3), i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "id int, x double, `~y` double, label int")
    fitted = models.train_models(train, ["x", "~y"], {"dt": ML.classifier_specs("label")["dt"]})
    some = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), None), (3, 1.0, 1.0)], "id int, x double, `~y` double")
    out = models.score(some, fitted, 2).collect()
    assert len(out) == 3 and all(r["blend_class"] is not None for r in out)
    assert set(out[0].asDict()) == {"id", "x", "~y", "blend", "blend_class"}


def test_a_failing_load_overwrites_nothing(spark, regression, tmp_path):
    spec = {"lr": LinearRegression(labelCol="y", featuresCol="features")}
    place = tmp_path / "lr" / models.model_key(regression, ["a", "c"], spec["lr"])
    place.mkdir(parents=True)
    (place / "keep").write_text("x")
    with pytest.raises(Exception):  # noqa: B017
        models.train_or_load(regression, ["a", "c"], spec, str(tmp_path))
    assert (place / "keep").read_text() == "x"


def test_search_by_kappa(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (2, 1.0)], "y int, prediction double")
    assert models.kappa_evaluator("y").evaluate(df) == pytest.approx(evaluate.qwk(df, "y", "prediction").first()[0])


RAW = (
    "appid long, name string, release_date string, required_age int, price_original string, price_2024_09 double, price_2019_06 double, tags string, genres string, categories string, "
    "developers string, publishers string, supported_languages string, full_audio_languages string, positive int, negative int, is_free string, windows string, mac string, linux string, "
    "steam_deck string, early_access string, has_demos string, has_drm string, vr_only string, vr_supported string, controller_support string, gamefaqs_difficulty_rating string, metacritic_score double, "
    "hltb_single double, achievements int, dlc_count int, peak_ccu int, recommendations int, average_playtime_forever double, average_playtime_2weeks double, median_playtime_forever double, "
    "median_playtime_2weeks double, screenshots int, movies int, estimated_owners double, num_reviews_total int"
)


def raw_row(i, **over):
    base = dict(
        appid=i, name=f"g{i}", release_date="2015-06-01", required_age=0, price_original="10", price_2024_09=8.0, price_2019_06=12.0, tags="['Indie', 'rogue-like']", genres="['RPG']",
        categories="['Single']", developers="['D']", publishers="['P']", supported_languages="['English']", full_audio_languages="[]", positive=90, negative=10, is_free="False", windows="True",
        mac=None, linux="False", steam_deck=None, early_access=None, has_demos="True", has_drm=None, vr_only=None, vr_supported=None, controller_support="full", gamefaqs_difficulty_rating="Easy",
        metacritic_score=80.0, hltb_single=5.0, achievements=3, dlc_count=None, peak_ccu=5, recommendations=2, average_playtime_forever=1.0, average_playtime_2weeks=0.0,
        median_playtime_forever=1.0, median_playtime_2weeks=0.0, screenshots=3, movies=1, estimated_owners=5.0, num_reviews_total=1,
    )
    return tuple({**base, **over}.values())


def test_clean_catalog_to_features(spark):
    rows = [
        raw_row(1), raw_row(2, tags="['Free to Play', 'PvP']", is_free=None), raw_row(3, is_free="True", price_original="0", price_2024_09=0.0, price_2019_06=None),
        raw_row(4, price_original=None), raw_row(5, release_date="coming soon", positive=0, negative=0, dlc_count=4),
    ]
    out, report = derive.preprocess(spark.createDataFrame(rows, RAW), date(2025, 6, 1))
    got = {r["appid"]: r for r in out.collect()}
    assert report["unmapped"] == ["appid"] and report["missing"] == []
    assert [got[i]["monetization_model"] for i in range(1, 6)] == ["paid", "f2p", "free", "paid", "paid"]
    assert got[1]["tags"] == ["indie", "roguelike"] and got[1]["release_year"] == 2015
    assert got[2]["price_original"] == 0.0 and got[3]["estimated_ltarpu"] == 0.0
    assert got[4]["price_original"] == 12.0 and got[1]["price_latest"] == 8.0
    assert got[1]["average_non_steam_review_score"] == pytest.approx(0.8)
    assert got[5]["estimated_owners_boxleiter"] is None and got[5]["release_date"] is None
    owners = round(100 * 80 * (62 / 80) * (1 + 2 * np.exp(-2.0)))
    assert got[1]["estimated_owners_boxleiter"] == owners
    per_user = round(10 * (0.5 * np.exp(-0.01 * 3653 / 365.25) + 0.3))
    assert got[1]["estimated_ltarpu"] == per_user and got[1]["estimated_gross_revenue_boxleiter"] == owners * per_user
    assert derive.dense(out).count() == 5

    # layers are stored between steps
    allow, no_na = features.feature_layers(writers.checkpoint(out.drop("name")))
    coded = {r["appid"]: r for r in allow.collect()}
    assert [coded[i]["monetization_model"] for i in range(1, 6)] == [0, 1, 2, 0, 0]
    assert coded[1]["controller_support"] == 1.0 and coded[1]["gamefaqs_difficulty_rating"] == 2 and coded[1]["tags_count"] == 2
    assert coded[1]["early_access"] == -1 and coded[1]["dlc_count"] is None
    filled = {r["appid"]: r for r in no_na.collect()}
    assert filled[1]["dlc_count"] == 4.0 and filled[5]["release_month"] == 0 and features.null_total(no_na).first()[0] == 0
    assert "steam_total_reviews_bin" in features.inference_set(no_na).columns


def test_kappa_extremes(spark):
    df = spark.createDataFrame([(0, 0, 2), (1, 1, 1), (2, 2, 0)], "y int, same int, reverse int")
    assert evaluate.qwk(df, "y", "same").first()[0] == pytest.approx(1.0)
    assert evaluate.qwk(df, "y", "reverse").first()[0] == pytest.approx(-1.0)


def test_split_ignores_partitioning(spark):
    df = spark.range(5000)
    a = {r["id"] for r in evaluate.split(df, "id").where("is_test").collect()}
    assert a == {r["id"] for r in evaluate.split(df.repartition(13), "id").where("is_test").collect()}
    assert 900 < len(a) < 1100


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 100 < 90).cast("int").alias("s"))
    out = evaluate.stratified_split(df, F.col("s"), "id").groupBy("s").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["s"]: r["n"] for r in out} == {0: 20, 1: 180}


def test_trimmed_blend_with_many_models(spark):
    df = spark.range(1).select(*[F.array(F.lit(v), F.lit(1 - v)).alias(f"m{i}") for i, v in enumerate([0.0, 1.0] + [0.4] * 8)])
    out = evaluate.blend(df, [f"m{i}" for i in range(10)], 2, "trimmed").first()
    assert out["blend"] == pytest.approx([0.4, 0.6]) and out["blend_class"] == 1


def test_quantile_uniform_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 2.0, 3.0]], "x double")
    out = sorted(r[0] for r in evaluate.quantile_uniform(df, ["x"], n=5, exact=True).collect())
    assert out == pytest.approx([0.0, 0.5, 0.5, 0.5, 1.0])


def test_class_labels(spark):
    df = spark.createDataFrame([(2021, 0.0)], "y int, p double")
    assert evaluate.class_labels(df, "y", "p").first()["labels"][:2] == ["< 4k", "4k - 9k"]


def test_iqr_bounds_of_integers_are_whole(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 100]] + [(None,)], "v int")
    assert sorted(r[0] for r in filters.iqr_outliers(df, "v").collect()) == [1, 2, 3, 4]
    assert sorted((r[0] for r in filters.iqr_outliers(df, "v", cap=True).collect()), key=lambda v: (v is None, v)) == [1, 2, 3, 4, 7, None]
    with pytest.raises(ValueError, match="numeric"):
        filters.iqr_outliers(df.select(F.col("v").cast("string").alias("v")), "v")


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    y = 3 * x[:, 0] - 2 * x[:, 2] + 0.1 * rng.normal(size=400) + 5
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double")


def test_recursive_elimination(regression):
    chosen, curve = models.rfe_cv(regression, "y", ["a", "b", "c", "d"], "id")
    ranks = {r["feature"]: r["ranking"] for r in chosen.collect()}
    means = {r["n_features"]: r["mean_r2"] for r in curve.collect()}
    assert ranks["a"] == ranks["c"] == 1 and means[2] > 0.98 > means[1] and set(means) == {1, 2, 3, 4}


def test_single_feature_screen(regression):
    out = [r["feature"] for r in models.feature_screen(regression, "y", ["a", "b", "c", "d"]).collect()]
    assert out[:2] == ["a", "c"]


def test_models_are_stored_and_reused(spark, regression, tmp_path, monkeypatch):
    """Order of rows does not matter; other rows, features or parameters train again."""
    trained, train = [], models.train_models
    monkeypatch.setattr(models, "train_models", lambda df, cols, specs: trained.append(list(specs)) or train(df, cols, specs))

    def fitted(df=regression, cols=("a", "c"), **params):
        spec = {"lr": LinearRegression(labelCol="y", featuresCol="features", **params)}
        return models.train_or_load(df, list(cols), spec, str(tmp_path))["lr"].stages[-1].coefficients

    first = fitted()
    assert fitted(regression.repartition(5).withColumn("other", F.lit(1))) == first and len(trained) == 1
    fitted(regression.unionAll(regression.limit(1)))
    fitted(regression.withColumn("y", F.col("y") + 1))
    fitted(cols=("c", "a"))
    fitted(regParam=0.5)
    assert len(trained) == 5
    assert fitted(regParam=0.5) == fitted(regression.orderBy("y"), regParam=0.5) and len(trained) == 5


def test_models_are_saved_and_loaded_by_name(spark, regression, tmp_path):
    made = models.train_models(regression, ["a", "c"], {"lr": LinearRegression(labelCol="y", featuresCol="features")})
    models.save_models(made, str(tmp_path))
    assert models.load_models(["lr"], str(tmp_path))["lr"].stages[-1].coefficients == made["lr"].stages[-1].coefficients


def test_search_table_is_ordered(regression):
    est = LinearRegression(labelCol="y", featuresCol="features")
    table = models.tune(est, models.LINEAR_SPACE, regression, ["a", "c"], models.r2_evaluator("y"), "id", n_trials=2, folds=2).collect()
    assert len(table) == 2 and table[0]["score"] >= table[1]["score"]


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_label_codes_of_any_number_of_values(spark, heavy):
    """Codes by first appearance, whether values are broadcast or looked up in long form."""
    rows = [(i, f"v{(i * 7) % 40}" if i % 5 else None, i % 3, f"w{i % 50}" if i < 150 else "w1", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, `a b` string, b int, c string, d string").repartition(5)
    got = features.label_encode(df, ["a b", "b", "c", "d"], "id", heavy=heavy)
    assert got.columns == df.columns

    def codes(at):
        seen = {}
        return [-1 if r[at] is None else seen.setdefault(r[at], len(seen)) for r in rows]

    assert [tuple(r) for r in got.orderBy("id").collect()] == list(zip(range(400), *[codes(at) for at in range(1, 5)]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= (0 if heavy > 50 else 2)


def test_what_if_runs_the_models_once_per_change(spark):
    """Filter and sort meet stored scores; neither repeats the models."""
    rows = spark.createDataFrame([(i, float(i % 7), i % 2, float((i % 7 > 3) + (i % 2))) for i in range(60)], ["id", "price", "~tag", "label"])
    model = models.train_models(rows, ["price", "~tag"], {"dt": models.classifier_specs("label")["dt"]})
    out = models.what_if(rows.drop("label"), "id", model, 3, tests={"price": [1.0, 6.0]})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "Generate" not in plan and "Sort" in plan
    got = [tuple(r) for r in out.collect()]
    assert got == sorted(got, key=lambda r: (r[0], -r[3], r[1], r[2])) and all(abs(r[3]) > 0.025 for r in got)
    assert {r[0] for r in got} == set(range(60)) and ("~tag", 1.0, 1.0) in {(r[1], r[2], round(r[3], 6)) for r in got if r[0] == 0}


def test_flag_terms_make_no_struct_per_term(spark, monkeypatch):
    rows = [(["b", "a"], None), (None, ["x"]), ([None, "a"], []), ([], ["x", "y"])]
    df = spark.createDataFrame(rows, "tags array<string>, genres array<string>")
    monkeypatch.setattr(features.F, "transform", None)
    assert features.flag_terms(df) == {"genres": ["x", "y"], "tags": ["a", "b"]}
    assert features.flag_terms(df.limit(0)) == {"genres": [], "tags": []}


def test_multi_hot_places_count_terms_once(spark, monkeypatch):
    seen, join = [], features.lookup_join
    monkeypatch.setattr(features, "HEAVY_TERMS", 2)
    monkeypatch.setattr(features, "lookup_join", lambda *a: seen.append({r["_k"]: r["_w"] for r in a[5].collect()}) or join(*a))
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", None]), (3, None), (4, ["c", "a", "b"])], "id int, t array<string>")
    hot, codes = features.multi_hot_places(df, "t", "v")
    assert seen == [{"a": 3, "b": 2, "c": 1}]
    names = {r["code"]: r["term"] for r in codes.collect()}
    assert codes.columns == ["term", "code"]
    assert {r["id"]: r["v"] and sorted(names[p] for p in r["v"]) for r in hot.collect()} == {1: ["a", "b"], 2: ["a"], 3: None, 4: ["a", "b", "c"]}
