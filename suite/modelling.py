"""Splits, blending, scoring, what-if and Spark ML training."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from marquetry.operators import evaluate as L
from marquetry.operators import features as G
from marquetry.operators import models as ML
from marquetry.operators import stats as J
from marquetry.operators import stumps
from marquetry.sources import writers
from suite.catalog import _OWNERS
from suite.items import items, joined, over_items, query, r6, stored

# -- splits and samples -------------------------------------------------------------


@query("l01_seeded_split")
def _(spark, sf):
    return L.split(items(spark, sf).select("item_id"), "item_id")


@query("l01_split_facts", over_items("select count(*) as rows, true as near_share, true as repeatable from items"))
def _(spark, sf):
    """The split keeps every row, marks about a fifth, and does not depend on the partitioning."""
    rows = items(spark, sf).select("item_id")
    again = L.split(rows.repartition(7), "item_id").select(F.col("item_id").alias("i"), F.col("is_test").alias("t"))
    both = L.split(rows, "item_id").join(again, F.col("item_id") == F.col("i"))
    share = F.count_if("is_test") / F.count(F.lit(1))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.abs(share - 0.2).between(0.0, 0.05).alias("near_share"), F.every(F.col("is_test") == F.col("t")).alias("repeatable")
    )


@query("l02_stratified_split_counts", over_items("select cast(release_year - 1995 as integer) as stratum, cast(count(*) - 1 - floor(0.8 * (count(*) - 1)) as bigint) as test_rows from items group by 1"))
def _(spark, sf):
    rows = items(spark, sf).select("item_id", (F.col("release_year") - 1995).alias("stratum"))
    marked = L.stratified_split(rows, F.col("stratum"), "item_id")
    return marked.groupBy("stratum").agg(F.count_if("is_test").alias("test_rows"))


_STRATUM = "cast(greatest(least(ceil((owners - lo) * 10 / (hi - lo)) - 1, 9), 0) as integer)"


@query("l02_equal_width_strata", over_items(f"select {_STRATUM} as stratum, count(*) as rows from items, s where owners is not null group by 1", s="select min(owners) lo, max(owners) hi from items"))
def _(spark, sf):
    rows = items(spark, sf).where("owners is not null")
    return rows.withColumn("stratum", L.equal_width_stratum(rows, "owners")).groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))


@query("l03_stratified_sample_size", over_items("select cast(sum(floor(0.25 * (n - 1)) + 1) as bigint) as rows from (select count(*) n from items, s where owners is not null group by " + _STRATUM + ")", s="select min(owners) lo, max(owners) hi from items"))
def _(spark, sf):
    rows = items(spark, sf).where("owners is not null").select("item_id", "owners")
    return L.stratified_sample(rows, "owners", "item_id", 0.25).agg(F.count(F.lit(1)).alias("rows"))


@query("l04_drop_extremes", over_items("select item_id from (select item_id, row_number() over (order by owners desc, item_id) as k from items where owners > 20) where k > 25"))
def _(spark, sf):
    return L.drop_extremes(items(spark, sf), "owners", "item_id", above=20).select("item_id")


_MARK_COLUMNS = ", ".join(f"quantile_cont(owners, {i / 10}) as q{i}" for i in range(11))


def _uniform_sql() -> str:
    lower = " + ".join(f"(q{i} < owners)::int" for i in range(11))
    upper = " + ".join(f"(q{i} <= owners)::int" for i in range(11))
    marks = "[" + ", ".join(f"q{i}" for i in range(11)) + "]"
    return f"""select item_id, round(case when owners is null then null when owners <= q0 then 0 when owners >= q10 then 1
  when lo = up then (lo - 1 + (owners - m[lo]) / (m[lo + 1] - m[lo])) / 10.0 else ((lo + up - 1) / 2.0) / 10.0 end, 6) as owners
from (select item_id, owners, q0, q10, {lower} as lo, {upper} as up, {marks} as m from items, q)"""


@query("l05_quantile_uniform", over_items(_uniform_sql(), q=f"select {_MARK_COLUMNS} from items"))
def _(spark, sf):
    return L.quantile_uniform(items(spark, sf).select("item_id", "owners"), ["owners"], n=11, exact=True).select("item_id", r6("owners"))


@query("l06_standardize", over_items("select item_id, round((owners - (select avg(owners) from items where release_year < 1999)) / (select stddev_pop(owners) from items where release_year < 1999), 6) as owners from items where release_year >= 1999"))
def _(spark, sf):
    rows = items(spark, sf).select("item_id", "owners", "release_year")
    _train, valid = L.standardize(rows.where("release_year < 1999"), rows.where("release_year >= 1999"), "owners")
    return valid.select("item_id", r6("owners"))


# -- predictions derived from the tables --------------------------------------------

CLASSES = 4
PROBS = ["p1", "p2", "p3", "p4"]
# four "models": positive weights per class made from the order's own columns, normalised per row
_WEIGHT = "((item_id * {a} + c * {b} + release_year) % {m} + 1)"
_SPEC = ((7, 3, 11), (5, 11, 13), (13, 7, 17), (3, 5, 19))


def _predictions(spark, sf):
    df = items(spark, sf).select("item_id", "release_year", F.least(F.coalesce("total_reviews", F.lit(0)) / 2, F.lit(3)).cast("int").alias("label"))
    for name, (a, b, m) in zip(PROBS, _SPEC):
        raw = F.array(*[((F.col("item_id") * a + c * b + F.col("release_year")) % m + 1).cast("double") for c in range(CLASSES)])
        df = df.withColumn(name, L.normalized(raw))
    return df


def _prob_sql(name: str, a: int, b: int, m: int) -> str:
    w = [_WEIGHT.format(a=a, b=b, m=m).replace("c *", f"{c} *") for c in range(CLASSES)]
    total = " + ".join(w)
    return ", ".join(f"{x} / cast({total} as double) as {name}_{c}" for c, x in enumerate(w))


_P = "select item_id, cast(least(floor(coalesce(total_reviews, 0) / 2), 3) as integer) as label, " + ", ".join(_prob_sql(n, *s) for n, s in zip(PROBS, _SPEC)) + " from items"


def _argmax_sql(cells: list[str]) -> str:
    return f"list_position([{', '.join(cells)}], greatest({', '.join(cells)})) - 1"


def _cells(c: int, names=PROBS) -> list[str]:
    return [f"{n}_{c}" for n in names]


_HOW = {
    "mean": lambda v: f"({' + '.join(v)}) / {len(v)}",
    "weighted": lambda v: "(" + " + ".join(f"{x} * {w}" for x, w in zip(v, (1.0, 2.0, 3.0, 4.0))) + ") / 10.0",
    "median": lambda v: f"list_aggregate([{', '.join(v)}], 'median')",
    "p25": lambda v: f"list_aggregate([{', '.join(v)}], 'quantile_cont', 0.25)",
    "p75": lambda v: f"list_aggregate([{', '.join(v)}], 'quantile_cont', 0.75)",
    "geometric": lambda v: "exp((" + " + ".join(f"ln({x} + 1e-12)" for x in v) + f") / {len(v)})",
    "harmonic": lambda v: f"{len(v)} / (" + " + ".join(f"1 / ({x} + 1e-12)" for x in v) + ")",
    "trimmed": lambda v: f"({' + '.join(v)}) / {len(v)}",
}


def _blend_query(how: str):
    cells = ", ".join(f"round({_HOW[how](_cells(c))}, 9) as b{c}" for c in range(CLASSES))

    @query(f"l11_blend_{how}", over_items(f"select item_id, {cells} from p", p=_P))
    def _(spark, sf):
        out = L.blend(_predictions(spark, sf), PROBS, CLASSES, how, weights=(1.0, 2.0, 3.0, 4.0))
        return out.select("item_id", *[F.round(F.get("blend", F.lit(c)), 9).alias(f"b{c}") for c in range(CLASSES)])


for _how in L.CLASS_BLENDS:
    _blend_query(_how)

_KAPPA = "round(1 - avg((label - pred) * (label - pred)) / (avg(label * label) + avg(pred * pred) - 2 * avg(label) * avg(pred)), 6)"


@query("l10_quadratic_weighted_kappa", over_items(
    "select round(1 - (select sum((label - pred)^2 * n) from o) / (select sum((a.label - b.pred)^2 * a.n * b.n / t.n) from r a, c b, t), 6) as qwk",
    p=_P, x="select label, " + _argmax_sql([f"p1_{c}" for c in range(CLASSES)]) + " as pred from p",
    o="select label, pred, count(*) n from x group by 1, 2", r="select label, count(*) n from x group by 1", c="select pred, count(*) n from x group by 1", t="select count(*) n from x",
))
def _(spark, sf):
    rows = _predictions(spark, sf).withColumn("pred", L.argmax(F.col("p1")))
    return L.qwk(rows, "label", "pred").select(r6("qwk"))


@query("l10_confusion", over_items("select label, pred, count(*) as count from x group by 1, 2", p=_P, x="select label, cast(" + _argmax_sql([f"p1_{c}" for c in range(CLASSES)]) + " as integer) as pred from p"))
def _(spark, sf):
    return L.confusion(_predictions(spark, sf).withColumn("pred", L.argmax(F.col("p1"))), "label", "pred")


@query("l12_blend_values", over_items("select item_id, round((price + owners + pos) / 3, 6) as mean, round(list_aggregate([price, owners, pos], 'median'), 6) as median, round(greatest(price, owners, pos), 6) as max, round(list_aggregate([price, owners, pos], 'quantile_cont', 0.6), 6) as p60, round(list_aggregate([price, owners, pos], 'quantile_cont', 0.4), 6) as p40 from items where price is not null and owners is not null"))
def _(spark, sf):
    df = items(spark, sf).dropna(subset=["price", "owners"])
    for how in L.VALUE_BLENDS:
        df = L.blend_values(df, ["price", "owners", "pos"], how, out=how)
    return df.select("item_id", *[r6(h) for h in L.VALUE_BLENDS])


def _combo_sql() -> str:
    parts = []
    for names in L._subsets(PROBS):
        mean = [f"({' + '.join(_cells(c, names))}) / {len(names)}" for c in range(CLASSES)]
        parts.append(f"select '{' + '.join(names)}' as models, label, {_argmax_sql(mean)} as pred from p")
    return " union all ".join(parts)


@query("l13_score_combinations", over_items(f"select models, {_KAPPA} as qwk from x group by 1 order by qwk desc, models limit 10", p=_P, x=_combo_sql()))
def _(spark, sf):
    return L.score_combinations(_predictions(spark, sf), PROBS, CLASSES, "label").select("models", r6("qwk"))


_REGRESSORS = ("pos", "neg", "rel")


def _value_combo_sql() -> str:
    parts = []
    for names in L._subsets(_REGRESSORS):
        for how in ("mean", "median"):
            value = f"({' + '.join(names)}) / {float(len(names))}" if how == "mean" else f"list_aggregate([{', '.join(names)}], 'median')"
            parts.append(f"select '{how}: {' + '.join(names)}' as models, owners as y, {value} as pred from v")
    return " union all ".join(parts)


@query("l13_score_value_combinations", over_items(
    "select models, round(1 - avg((y - pred)^2) / var_pop(y), 6) as r2 from x group by 1",
    v="select owners, cast(pos * 25 as double) as pos, cast(neg * 25 as double) as neg, cast(total_reviews * 20 as double) as rel from items where owners is not null", x=_value_combo_sql(),
))
def _(spark, sf):
    rows = items(spark, sf).where("owners is not null").select("owners", (F.col("pos") * 25).cast("double").alias("pos"), (F.col("neg") * 25).cast("double").alias("neg"), (F.col("total_reviews") * 20).cast("double").alias("rel"))
    return L.score_value_combinations(rows, list(_REGRESSORS), "owners").select("models", r6("r2"))


@query("l21_expected_class", over_items("select item_id, round(p1_1 + 2 * p1_2 + 3 * p1_3, 6) as expected from p", p=_P))
def _(spark, sf):
    return _predictions(spark, sf).select("item_id", r6(L.expected_class(F.col("p1")), "expected"))


_STEP = "case when o < 100 then round_even(o / 10.0, 0) * 10 when o < 500 then round_even(o / 50.0, 0) * 50 when o < 1000 then round_even(o / 100.0, 0) * 100 when o < 2000 then round_even(o / 250.0, 0) * 250 when o < 5000 then round_even(o / 500.0, 0) * 500 when o < 10000 then round_even(o / 1000.0, 0) * 1000 else round_even(o / 5000.0, 0) * 5000 end"


@query("l20_step_round", over_items(f"select item_id, cast({_STEP} as bigint) as rounded from (select item_id, item_id * 7 as o from items)"))
def _(spark, sf):
    from marquetry.constants import STEP_ROUNDING
    from marquetry.functions.parsing import step_round

    return items(spark, sf).select("item_id", step_round(F.col("item_id") * 7, STEP_ROUNDING).alias("rounded"))


_EDGES = (0, 50, 100, 250, 500, 1000, 2500, 5000)
_LABEL_PARTS = ", ".join(
    f"'>= ' || k[{i}] || 'k'" if i == len(_EDGES) else f"case when r[{i}] = 0 then '< ' || k[{i + 1}] || 'k' else k[{i}] || 'k - ' || k[{i + 1}] || 'k' end"
    for i in range(1, len(_EDGES) + 1)
)


@query("l20_class_labels", over_items(
    f"select item_id, array_to_string([{_LABEL_PARTS}], '|') as labels from labelled",
    b=f"select item_id, release_year + 20 as y, price / 10 as p, unnest([{', '.join(map(str, _EDGES))}]) as t from items where price is not null",
    estimated=f"select item_id, t, cast({_OWNERS.format(first='<=')} as bigint) as o from b",
    rounded=f"select item_id, t, cast({_STEP} as bigint) as r from estimated",
    labelled="select item_id, list(r order by t) as r, list(cast(cast(round_even(r / 1000.0, 0) as bigint) as varchar) order by t) as k from rounded group by 1",
))
def _(spark, sf):
    rows = items(spark, sf).where("price is not null").select("item_id", (F.col("release_year") + 20).alias("year"), (F.col("price") / 10).alias("p"))
    return L.class_labels(rows, "year", "p").select("item_id", joined("labels", "labels"))


# -- candidates ---------------------------------------------------------------------

FEATURES = ["price", "pos", "neg", "~tag_ring", "~tag_bolt"]


def _candidate_text(spark, sf):
    k = F.col("item_id")
    return items(spark, sf).select(
        "item_id",
        F.concat_ws(
            "\n", F.concat(F.lit("price = "), (k % 60).cast("string")), F.when(k % 2 == 0, "~tag_ring=1").otherwise("~tag_ring=2"),
            F.when(k % 3 == 0, "pricy=3"), F.lit("a remark"), F.when(k % 5 == 0, "neg=many"), F.when(k % 4 == 0, "price=99.5"),
        ).alias("text"),
    )


@query("l18_candidate_settings", "select o_orderkey as item_id, 'price' as feature, cast(case when o_orderkey % 4 = 0 then 99.5 else o_orderkey % 60 end as double) as value from orders union all select o_orderkey, '~tag_ring', 1.0 from orders where o_orderkey % 2 = 0")
def _(spark, sf):
    valid, _rejected = L.parse_candidates(_candidate_text(spark, sf), "item_id", "text", FEATURES)
    return valid


@query("l18_rejected_settings", "select o_orderkey as item_id, '~tag_ring' as feature, '2' as raw, 'must be 0 or 1' as reason from orders where o_orderkey % 2 = 1 union all select o_orderkey, 'pricy', '3', 'unknown feature' from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'neg', 'many', 'must be a number' from orders where o_orderkey % 5 = 0")
def _(spark, sf):
    _valid, rejected = L.parse_candidates(_candidate_text(spark, sf), "item_id", "text", FEATURES)
    return rejected


@query("l18_suggested_features", "select 'pricy' as text, 1 as rank, 'price' as match from orders where o_orderkey % 3 = 0 limit 1")
def _(spark, sf):
    _valid, rejected = L.parse_candidates(_candidate_text(spark, sf), "item_id", "text", FEATURES)
    return L.suggest_features(rejected, FEATURES).select("text", "rank", "match")


def _matrix(spark, sf):
    return stored(spark, sf, "matrix", lambda: _derive_matrix(spark, sf))


def _derive_matrix(spark, sf):
    rows = items(spark, sf).dropna(subset=["price", "owners", "ratio"])
    rows = rows.select(
        "item_id", "price", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg"), F.col("release_year").cast("double").alias("year"),
        "owners", G.review_bin("owners", (float("-inf"), 50, 100, 150, float("inf"))).cast("double").alias("label"), "tags",
    )
    return G.multi_hot(rows, "tags", "~tag_", ["ring", "bolt"])


@query(
    "l18_overlay_on_baseline",
    over_items(
        f"select o_orderkey as item_id, cast(case when o_orderkey % 4 = 0 then 99.5 else o_orderkey % 60 end as double) as price, (select median(pos) from m) as pos, (select median(neg) from m) as neg, case when o_orderkey % 2 = 0 then cast(1.0 as double) else {'(select t from m group by t order by count(*) desc, t limit 1)'} end as \"~tag_ring\", (select b from m group by b order by count(*) desc, b limit 1) as \"~tag_bolt\" from orders",
        m="select pos, neg, list_contains(tags, 'ring')::int::double as t, list_contains(tags, 'bolt')::int::double as b from items where price is not null and owners is not null and ratio is not null",
    ),
)
def _(spark, sf):
    base = G.baseline_row(_matrix(spark, sf).select(FEATURES), modes=["~tag_ring", "~tag_bolt"], medians=["price", "pos", "neg"])
    texts = _candidate_text(spark, sf)
    valid, _rejected = L.parse_candidates(texts, "item_id", "text", FEATURES)
    return L.overlay(texts, "item_id", valid, base)


@query("l22_what_if_rows", over_items(
    """select item_id, feature as change_feature, cast(value as double) as change_value from (
  select item_id, '~tag_ring' as feature, case when list_contains(tags, 'ring') then 0.0 else 1.0 end as value from x union all
  select item_id, '~tag_bolt', case when list_contains(tags, 'bolt') then 0.0 else 1.0 end from x union all select item_id, 'price', unnest([9.99, 19.99]) from x)""",
    x="select item_id, tags from items where price is not null and owners is not null and ratio is not null",
))
def _(spark, sf):
    rows = L.what_if_rows(_matrix(spark, sf).select("item_id", *FEATURES), "item_id", {"price": [9.99, 19.99]})
    return rows.select("item_id", "change_feature", "change_value")


# -- Spark ML -----------------------------------------------------------------------

_X = ["price", "pos", "neg", "~tag_ring", "~tag_bolt"]


@lru_cache(maxsize=4)
def _models(spark, sf):
    """A fast tree and a linear model on the whole table, trained once per session."""
    specs = ML.classifier_specs("label")
    train = L.split(_matrix(spark, sf), "item_id").where("not is_test")
    return ML.train_models(train, _X, {"dt": specs["dt"], "lr": specs["lr"]})


def _valid(spark, sf):
    return L.split(_matrix(spark, sf), "item_id").where("is_test").drop("is_test")


@query("l07_classifier_kappa")
def _(spark, sf):
    return ML.evaluate_classifiers(_valid(spark, sf), _models(spark, sf), "label").select("model", r6("qwk"))


@query("l07_one_vs_rest_boosting")
def _(spark, sf):
    specs = ML.classifier_specs("label")
    train = L.split(_matrix(spark, sf), "item_id").where("not is_test")
    models = ML.train_models(train, _X, {"gbt": specs["gbt"].copy({}), "rf": specs["rf"]})
    return ML.evaluate_classifiers(_valid(spark, sf), models, "label").select("model", r6("qwk"))


@query("l08_regressor_r2")
def _(spark, sf):
    specs = ML.regressor_specs("owners")
    train = L.split(_matrix(spark, sf), "item_id").where("not is_test")
    _m, table_ = ML.train_regressors(train, _valid(spark, sf), _X, {n: specs[n] for n in ("dt", "elastic_net", "gbt")}, "owners")
    return table_.select("model", r6("r2"))


@query("l09_stored_model", over_items("""select item_id, round(a + b * pos, 2) as fitted
from m, (select regr_intercept(owners, pos) as a, regr_slope(owners, pos) as b from m)""",
    m="select item_id, owners, pos from items where price is not null and owners is not null and ratio is not null"))
def _(spark, sf):
    """A straight line, trained and stored; the model that predicts is the one loaded for the same rows in another order."""
    root = f"{writers.shared_folder(spark)}/models-{spark.sparkContext.applicationId}"
    spec = {"line": LinearRegression(labelCol="owners", featuresCol="features", tol=1e-12)}
    rows = _matrix(spark, sf)
    ML.train_or_load(rows, ["pos"], spec, root)
    loaded = ML.train_or_load(rows.repartition(7, "item_id"), ["pos"], spec, root)
    return ML.with_predictions(rows, loaded).select("item_id", F.round("y_line", 2).alias("fitted"))


@query("l14_cross_validated_score")
def _(spark, sf):
    est = DecisionTreeRegressor(labelCol="owners", featuresCol="features", maxDepth=4, seed=1)
    rows = [(s["mean"], s["sd"], s["score"]) for s in ML.cv_score(est, _matrix(spark, sf), _X, ML.r2_evaluator("owners"), "item_id", folds=3)]
    return spark.createDataFrame(rows, "mean double, sd double, score double")


@query("l15_random_search")
def _(spark, sf):
    est = DecisionTreeRegressor(labelCol="owners", featuresCol="features", seed=1)
    return ML.tune(est, {"maxDepth": ("int", 2, 6)}, _matrix(spark, sf), _X, ML.r2_evaluator("owners"), "item_id", n_trials=3, folds=3)


@query("l15_halving_search")
def _(spark, sf):
    est = DecisionTreeRegressor(labelCol="owners", featuresCol="features", seed=1)
    space = {"maxDepth": ("int", 1, 6), "minInstancesPerNode": ("int", 1, 20)}
    return ML.halving(est, space, _matrix(spark, sf), _X, "owners", "item_id", n_trials=9)


@query("l16_feature_screen", over_items(
    " union all ".join(f"select '{c}' as feature, round(regr_r2(owners, {c}), 6) as r2 from m" for c in ("price", "pos", "neg")),
    m="select owners, price, pos, neg from items where price is not null and owners is not null and ratio is not null",
))
def _(spark, sf):
    return ML.feature_screen(_matrix(spark, sf), "owners", ["price", "pos", "neg"]).select("feature", r6("r2"))


@query("l16_feature_power")
def _(spark, sf):
    return stumps.feature_power(_matrix(spark, sf), "owners", ["price", "pos", "neg", "year"], "item_id", folds=3)


@query("l17_recursive_elimination")
def _(spark, sf):
    chosen, _curve = ML.rfe_cv(_matrix(spark, sf), "owners", _X, "item_id")
    return chosen


@query("l19_blended_scores")
def _(spark, sf):
    out = ML.score(_matrix(spark, sf), _models(spark, sf), CLASSES)
    return out.select("item_id", "blend_class", r6(L.expected_class(F.col("blend")), "expected"))


@query("l19_every_candidate", over_items("select item_id, true as scored from items"))
def _(spark, sf):
    """Rows with missing features are scored like any other."""
    flags = {f"~tag_{t}": F.array_contains("tags", t).cast("int") for t in ("ring", "bolt")}
    out = ML.score(items(spark, sf).withColumns(flags).select("item_id", *_X), _models(spark, sf), CLASSES)
    return out.select("item_id", (F.col("blend_class").isNotNull() & F.col("blend").isNotNull()).alias("scored"))


@query("l15_kappa_search")
def _(spark, sf):
    est = DecisionTreeClassifier(labelCol="label", featuresCol="features", seed=1)
    return ML.tune(est, {"maxDepth": ("int", 2, 6)}, _matrix(spark, sf), _X, ML.kappa_evaluator("label"), "item_id", n_trials=2, folds=2)


@query("l22_what_if")
def _(spark, sf):
    rows = _matrix(spark, sf).select("item_id", *FEATURES)
    base = G.baseline_row(_matrix(spark, sf).select(FEATURES), modes=["~tag_ring", "~tag_bolt"], medians=["price", "pos", "neg"])
    return ML.what_if(rows, "item_id", _models(spark, sf), CLASSES, tests={"price": [9.99, 19.99, 59.99]}, baseline=base)
