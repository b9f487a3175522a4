"""Training, validation and search with Spark ML estimators."""

from __future__ import annotations

import hashlib
import math
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.evaluate import blend, expected_class, normalized, qwk_column, r2_column, what_if_rows
from marquetry.plans.skew import hash_fraction
from marquetry.sources.writers import checkpoint, path_exists


FILLED = "_x_"  # prefix of the helper columns of the assembly


def assemble(features: Sequence[str], out: str = "features") -> PipelineModel:
    """The features as one vector. No row is left out: a null or NaN feature counts as 0, and a flag beside each feature
    (0 or 1, after the features) tells a missing value from a true zero."""
    values = [f"coalesce(nanvl(cast(`{c}` as double), null), 0.0) as `{FILLED}{i}`" for i, c in enumerate(features)]
    flags = [f"cast(nanvl(cast(`{c}` as double), null) is null as double) as `{FILLED}m{i}`" for i, c in enumerate(features)]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(values + flags)} FROM __THIS__")
    names = [f"{FILLED}{i}" for i in range(len(features))] + [f"{FILLED}m{i}" for i in range(len(features))]
    return PipelineModel([fill, VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error")])


def without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(FILLED)])


def classifier_specs(label: str, seed: int = 42) -> dict[str, Estimator]:
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "rf": RandomForestClassifier(numTrees=40, maxDepth=6, seed=seed, **common),
        "dt": DecisionTreeClassifier(maxDepth=6, seed=seed, **common),
        "lr": LogisticRegression(maxIter=50, regParam=0.01, **common),
        "gbt": OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=seed), **common),
    }


def regressor_specs(label: str, seed: int = 42) -> dict[str, Estimator]:
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "gbt": GBTRegressor(maxIter=20, maxDepth=3, seed=seed, **common),
        "rf": RandomForestRegressor(numTrees=40, maxDepth=6, seed=seed, **common),
        "dt": DecisionTreeRegressor(maxDepth=6, seed=seed, **common),
        "elastic_net": LinearRegression(regParam=0.01, elasticNetParam=0.5, **common),
    }


def train_models(df: DataFrame, features: Sequence[str], specs: Mapping[str, Estimator]) -> dict[str, PipelineModel]:
    """Fit each estimator behind the shared feature assembly."""
    return {name: Pipeline(stages=[*assemble(features).stages, est]).fit(df) for name, est in specs.items()}


def probabilities(predicted: DataFrame) -> Column:
    """Class probabilities of a transformed frame; margins of one-vs-rest are squashed and normalised."""
    if "probability" in predicted.columns:
        return vector_to_array("probability")
    raw = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
    return normalized(raw)


_MODEL_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


def with_probabilities(df: DataFrame, models: Mapping[str, Model], prefix: str = "p_") -> DataFrame:
    for name, model in models.items():
        out = model.transform(df)
        df = without_helpers(out.withColumn(prefix + name, probabilities(out))).drop(*_MODEL_COLUMNS)
    return df


def with_predictions(df: DataFrame, models: Mapping[str, Model], prefix: str = "y_") -> DataFrame:
    for name, model in models.items():
        df = without_helpers(model.transform(df)).withColumnRenamed("prediction", prefix + name).drop("features")
    return df


def score(df: DataFrame, models: Mapping[str, Model], classes: int, out: str = "blend") -> DataFrame:
    """Mean of the models' class probabilities, normalised; adds ``out`` and ``out_class``."""
    names = list(models)
    blended = blend(with_probabilities(df, models), [f"p_{n}" for n in names], classes, "mean", out=out)
    return blended.withColumn(out, normalized(F.col(out))).drop(*[f"p_{n}" for n in names])


def evaluate_classifiers(df: DataFrame, models: Mapping[str, Model], label: str) -> DataFrame:
    """One row per model: kappa on ``df``."""
    scored = with_predictions(df.select("*"), {n: _only_prediction(m) for n, m in models.items()})
    items = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"y_{n}").alias("pred")) for n in models])
    long = scored.select(F.col(label).alias("label"), F.explode(items).alias("_m"))
    return long.groupBy("_m.model").agg(qwk_column(F.col("label"), F.col("_m.pred")).alias("qwk"))


class _only_prediction:
    """A model whose output is reduced to its prediction column."""

    def __init__(self, model: Model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).select(*df.columns, "prediction")


def train_regressors(train: DataFrame, valid: DataFrame, features: Sequence[str], specs: Mapping[str, Estimator], label: str) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fitted regressors and their R squared on ``valid``, one row per model."""
    models = train_models(train, features, specs)
    scored = with_predictions(valid, {n: _only_prediction(m) for n, m in models.items()})
    items = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"y_{n}").alias("pred")) for n in models])
    long = scored.select(F.col(label).cast("double").alias("y"), F.explode(items).alias("_m"))
    return models, long.groupBy("_m.model").agg(r2_column(F.col("y"), F.col("_m.pred")).alias("r2"))


def save_models(models: Mapping[str, PipelineModel], root: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{root}/{name}")


def load_models(names: Sequence[str], root: str) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{root}/{n}") for n in names}


def _described(est: Estimator) -> str:
    """Class and parameters, those of inner estimators included, without the ids of instances."""
    values = {p.name: v for p, v in est.extractParamMap().items()}
    shown = {n: _described(v) if isinstance(v, Estimator) else repr(v) for n, v in values.items()}
    return f"{type(est).__name__}({', '.join(f'{n}={shown[n]}' for n in sorted(shown))})"


def rows_digest(df: DataFrame, cols: Sequence[str]) -> str:
    """A digest of the rows' values and how often they occur, whatever their order: one aggregate of hashes."""
    names = sorted(cols)
    hashed = [F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names]) for i in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(h.cast("decimal(38,0)")) for h in hashed]).first()
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in names]
    return hashlib.sha256(repr((kinds, tuple(map(str, row)))).encode()).hexdigest()


def model_key(df: DataFrame, features: Sequence[str], est: Estimator, digest: str | None = None) -> str:
    """Names a fitted model by what it follows from: training rows, features in order, estimator and parameters."""
    label = est.getOrDefault("labelCol") if est.hasParam("labelCol") else None
    digest = digest or rows_digest(df, [*features, *([label] if label in df.columns else [])])
    return hashlib.sha256(repr((digest, list(features), _described(est))).encode()).hexdigest()[:32]


def train_or_load(df: DataFrame, features: Sequence[str], specs: Mapping[str, Estimator], root: str) -> dict[str, PipelineModel]:
    """Fitted models, stored below ``root/name/<key>``; those whose rows, features and parameters are known are loaded.

    A model is written beside its place and moved there when it is complete, so a run that broke off leaves none. Models
    of other data or parameters stay until they are deleted.
    """
    spark, models, digests = df.sparkSession, {}, {}
    for name, est in specs.items():
        label = est.getOrDefault("labelCol") if est.hasParam("labelCol") else None
        if label not in digests:
            digests[label] = rows_digest(df, [*features, *([label] if label in df.columns else [])])
        path = f"{root}/{name}/{model_key(df, features, est, digests[label])}"
        if not path_exists(spark, path):  # an error on load rises; nothing stored is overwritten
            aside = f"{path}-{uuid.uuid4().hex}"
            train_models(df, features, {name: est})[name].write().save(aside)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(aside), at)
        models[name] = PipelineModel.load(path)
    return models


def what_if(
    candidates: DataFrame, candidate: str, models: Mapping[str, Model], classes: int, cutoff: float = 0.025,
    tests: Mapping[str, Sequence[float]] | None = None, baseline: DataFrame | None = None,
) -> DataFrame:
    """Score change of every single-feature change against the candidate itself, best first.

    Candidates are scored once; the change rows carry that score along, so nothing is joined.
    """
    base = score(candidates, models, classes).withColumn("_base", expected_class(F.col("blend"))).drop("blend", "blend_class")
    kwargs = {} if tests is None else {"tests": tests}
    rows = what_if_rows(base.withColumn("_key", F.struct(candidate, "_base")).drop(candidate, "_base"), "_key", baseline=baseline, **kwargs)
    scored = score(rows, models, classes).withColumn("score", expected_class(F.col("blend")) - F.col("_key._base"))
    # stored: the filter would repeat the models below the projections, and the sort would run them twice
    scored = checkpoint(scored.select(F.col(f"_key.{candidate}").alias(candidate), "change_feature", "change_value", "score"))
    return scored.where(F.abs("score") > cutoff).orderBy(candidate, F.desc("score"), "change_feature", "change_value")


# -- validation and search ----------------------------------------------------------


def _folded(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    return df.withColumn("_fold", F.floor(hash_fraction(seed, F.col(key)) * folds).cast("int"))


def cv_score(
    est: Estimator, df: DataFrame, features: Sequence[str], evaluator: Evaluator, key: str, folds: int = 5, seed: int = 42,
    param_maps: Sequence[dict] | None = None, parallelism: int = 4, penalty: float = 0.1,
) -> list[dict]:
    """Mean, deviation and penalised score per parameter map. Folds depend on the key only."""
    data = _folded(without_helpers(assemble(features).transform(df)), key, folds, seed)
    maps = list(param_maps or [{}])
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, foldCol="_fold")
    fitted = cv.fit(data)
    return [
        {"mean": float(m), "sd": float(s), "score": float(m - penalty * s)} for m, s in zip(fitted.avgMetrics, fitted.stdMetrics)
    ]


def draw_params(est: Estimator, space: Mapping[str, object], n: int, seed: int) -> list[dict]:
    """``n`` random parameter maps. A space entry is a list of choices or (kind, low, high),
    kind one of int, float, log."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        values = {}
        for name, spec in space.items():
            if isinstance(spec, list):
                v = rng.choice(spec)
            else:
                kind, lo, hi = spec
                if kind == "int":
                    v = rng.randint(lo, hi)
                elif kind == "float":
                    v = rng.uniform(lo, hi)
                elif kind == "log":
                    v = math.exp(rng.uniform(math.log(lo), math.log(hi)))
                else:
                    raise ValueError(f"unknown kind {kind!r}")
            values[est.getParam(name)] = v
        out.append(values)
    return out


def tune(
    est: Estimator, space: Mapping[str, object], df: DataFrame, features: Sequence[str], evaluator: Evaluator, key: str,
    n_trials: int = 20, seed: int = 42, folds: int = 5, parallelism: int = 4,
) -> DataFrame:
    """Random search scored by cross-validation; one row per trial, best first."""
    maps = draw_params(est, space, n_trials, seed)
    scores = cv_score(est, df, features, evaluator, key, folds, seed, maps, parallelism)
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in m.items()), s["mean"], s["sd"], s["score"]) for i, (m, s) in enumerate(zip(maps, scores))
    ]
    table = df.sparkSession.createDataFrame(rows, "trial int, params string, mean double, sd double, score double")
    return table.orderBy(F.desc("score"), "trial")


def halving(
    est: Estimator, space: Mapping[str, object], df: DataFrame, features: Sequence[str], label: str, key: str,
    n_trials: int = 27, keep: int = 3, rungs: int = 3, metric: Callable[[Column, Column], Column] = r2_column,
    seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Random search that stops bad trials early: one row per trial, the last rung reached first, best first.

    Each rung trains the trials still running on a sample of rows ``keep`` times the one before (the last on all), scores them
    on one and the same fifth of the rows that no trial sees, and hands the best ``1 / keep`` on. Samples are by hash of the key, so a
    rung's rows are among the next one's. All trials of a rung are scored in one pass and one aggregate. ``score`` is the
    ``metric`` of label and prediction at the last rung of the trial, ``rows`` how many rows it was trained on there.
    """
    maps = dict(enumerate(draw_params(est, space, n_trials, seed)))
    data = without_helpers(assemble(features).transform(df))
    data = data.withColumn("_u", hash_fraction(seed, F.col(f"`{key}`"))).withColumn("_held", hash_fraction(seed + 1, F.col(f"`{key}`")) < 0.2)
    data = checkpoint(data)
    held, seen, running, done = data.where("_held"), data.where("not _held"), list(maps), {}
    for rung in range(rungs):
        sample = seen.where(F.col("_u") < keep ** float(rung + 1 - rungs))
        with ThreadPoolExecutor(parallelism) as pool:
            fitted = dict(zip(running, pool.map(lambda i: est.copy(maps[i]).fit(sample), running)))
        out = held
        for i, model in fitted.items():
            before = set(out.columns)
            out = model.transform(out)
            new = [c for c in out.columns if c not in before and c != "prediction"]
            out = out.withColumnRenamed("prediction", f"_p{i}").drop(*new)
        row = out.agg(*[metric(F.col(f"`{label}`"), F.col(f"_p{i}")).alias(f"s{i}") for i in running]).first()
        rows = sample.count()
        done |= {i: (i, rung, rows, float("-inf") if row[f"s{i}"] is None else float(row[f"s{i}"])) for i in running}
        running = sorted(running, key=lambda i: (-done[i][3], i))[: max(1, len(running) // keep)]
    table = [(*done[i], ", ".join(f"{p.name}={v}" for p, v in maps[i].items())) for i in maps]
    shown = df.sparkSession.createDataFrame(table, "trial int, rung int, rows bigint, score double, params string")
    return shown.orderBy(F.desc("rung"), F.desc("score"), "trial")


# --- fixed values: search ranges of the tree-based learners ---
TREE_SPACE = {"maxDepth": ("int", 2, 10), "minInstancesPerNode": ("int", 1, 20)}
FOREST_SPACE = {**TREE_SPACE, "numTrees": ("int", 10, 100)}
BOOST_SPACE = {**TREE_SPACE, "stepSize": ("log", 0.01, 0.2), "maxIter": ("int", 2, 40)}
LINEAR_SPACE = {"regParam": ("log", 1e-5, 1e-1), "elasticNetParam": ("float", 0.0, 1.0)}


class KappaEvaluator(Evaluator):
    """Quadratic weighted kappa of the ``prediction`` column, for cross-validation; one aggregate per evaluation."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        value = dataset.agg(qwk_column(F.col(self.label), F.col("prediction")).alias("k")).first()["k"]
        return 0.0 if value is None else float(value)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def kappa_evaluator(label: str) -> Evaluator:
    return KappaEvaluator(label)


def r2_evaluator(label: str) -> Evaluator:
    return RegressionEvaluator(labelCol=label, metricName="r2")


def feature_screen(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """R squared of the straight-line fit on each column alone; one aggregate for all columns."""
    row = df.agg(*[F.regr_r2(F.col(target).cast("double"), F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("r2")) for c in cols])
    return row.select(F.explode(items).alias("_i")).select("_i.feature", "_i.r2").orderBy(F.desc_nulls_last("r2"), "feature")


# -- recursive feature elimination --------------------------------------------------


GROUPS = 64  # groups of tasks whose matrices are summed before the last step


def gram_by_fold(df: DataFrame, cols: Sequence[str], target: str, key: str, folds: int, seed: int) -> dict[int, np.ndarray]:
    """[1, X, y]' [1, X, y] per fold: summed in each task, then by groups of tasks; one array per fold reaches the driver."""
    names = [*cols, target]
    data = _folded(df, key, folds, seed).select("_fold", *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    width = len(names) + 1

    def as_rows(sums):
        lists = pd.Series([g.ravel().tolist() for g in sums.values()], dtype=object)
        return pd.DataFrame({"fold": pd.Series(list(sums), dtype="int32"), "gram": lists})

    def partial(batches):
        grams: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("_fold"):
                z = np.column_stack([np.ones(len(part)), part.iloc[:, 1:].to_numpy(dtype=float)])
                grams[int(fold)] = grams.get(int(fold), 0.0) + z.T @ z
        yield as_rows(grams)

    def combine(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, gram in zip(pdf["fold"], pdf["gram"]):
                sums[int(fold)] = sums.get(int(fold), 0.0) + np.asarray(gram)
        yield as_rows(sums)

    schema = "fold int, gram array<double>"
    parts = data.mapInPandas(partial, schema)
    parts = parts.repartition(GROUPS).mapInPandas(combine, schema).repartition(folds, "fold").mapInPandas(combine, schema)
    return {r["fold"]: np.asarray(r["gram"]).reshape(width, width) for r in parts.collect()}  # one row per fold


def _fit(gram: np.ndarray, active: list[int]) -> np.ndarray:
    """Least squares on centred and scaled columns, with the coefficients in the units of the data."""
    n = gram[0, 0]
    mean, target = gram[0, active] / n, gram[0, -1] / n
    cross = gram[np.ix_(active, active)] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross), 0.0))
    scale[scale == 0] = 1.0
    slopes, *_ = np.linalg.lstsq(cross / np.outer(scale, scale), (gram[active, -1] / n - mean * target) / scale, rcond=None)
    slopes = slopes / scale
    return np.concatenate([[target - slopes @ mean], slopes])


def _r2(gram: np.ndarray, active: list[int], beta: np.ndarray) -> float:
    idx = [0, *active]
    n, sy, yy = gram[0, 0], gram[0, -1], gram[-1, -1]
    sse = yy - 2 * beta @ gram[idx, -1] + beta @ gram[np.ix_(idx, idx)] @ beta
    return 1.0 - sse / (yy - sy * sy / n)


def _eliminate(gram: np.ndarray, d: int, step: int, until: int = 1):
    """Yield (active columns, coefficients), dropping the smallest coefficients each time."""
    active = list(range(1, d + 1))
    while True:
        beta = _fit(gram, active)
        yield active, beta
        if len(active) <= until:
            return
        drop = min(step, len(active) - until)
        weakest = set(np.argsort(beta[1:] ** 2, kind="stable")[:drop])
        active = [a for i, a in enumerate(active) if i not in weakest]


def rfe_cv(df: DataFrame, target: str, cols: Sequence[str], key: str, folds: int = 5, step: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Linear recursive feature elimination with cross-validation.

    Returns (features with their rank and whether they are kept, mean R squared per feature count).
    One pass over the data; elimination works on matrices as wide as the feature list.
    """
    spark: SparkSession = df.sparkSession
    grams = gram_by_fold(df, cols, target, key, folds, seed)
    total = sum(grams.values())
    curves: dict[int, list[float]] = {}
    for g in grams.values():
        for active, beta in _eliminate(total - g, len(cols), step):
            curves.setdefault(len(active), []).append(_r2(g, active, beta))
    means = {n: float(np.mean(v)) for n, v in curves.items()}
    best = min(means, key=lambda n: (-means[n], n))
    rank = {c: 1 for c in cols}
    left = list(range(1, len(cols) + 1))
    stages = [a for a, _ in _eliminate(total, len(cols), step, until=best)]
    for i, active in enumerate(stages[1:], start=1):
        for a in set(left) - set(active):
            rank[cols[a - 1]] = len(stages) - i + 1
        left = active
    table = spark.createDataFrame([(c, rank[c], rank[c] == 1) for c in cols], "feature string, ranking int, selected boolean")
    curve = spark.createDataFrame(sorted(means.items()), "n_features int, mean_r2 double")
    return table.orderBy("ranking", "feature"), curve
