"""Model search (M1-M7, J5, J8): estimator registry, hyper-parameter grids, random
candidate sampling, k-fold cross-validation with Spark ML, refit and comparison.

Every fit is a Spark ML job over the distributed training table; the driver only
holds the small grid and the per-setting scores.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import col

# Hyper-parameter spaces searched per estimator.
HYPER_SPACE_CLASS = {
    "RandomForestClassifier": {
        "n_estimators": [100, 200, 300, 400, 500],
        "max_depth": [None, 5, 10, 20, 30],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", 0.5],
    },
    "GradientBoostingClassifier": {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.01, 0.05, 0.1],
        "max_depth": [3, 5, 7],
        "subsample": [0.7, 0.8, 1.0],
    },
    "LogisticRegression": {
        "C": [0.01, 0.1, 1, 10],
        "penalty": ["l1", "l2"],
        "solver": ["saga"],
    },
    "SVC": {
        "C": [0.1, 1, 10],
        "kernel": ["rbf", "linear"],
        "gamma": ["scale", "auto"],
    },
    "KNeighborsClassifier": {
        "n_neighbors": [3, 5, 7, 9],
        "weights": ["uniform", "distance"],
    },
}
HYPER_SPACE_REGR = {
    "RandomForestRegressor": {
        "n_estimators": [100, 200, 300],
        "max_depth": [None, 5, 10, 20],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", 0.7],
    },
    "GradientBoostingRegressor": {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.01, 0.05, 0.1],
        "max_depth": [3, 5, 7],
        "subsample": [0.7, 0.8, 1.0],
    },
    "SVR": {
        "C": [0.1, 1, 10],
        "kernel": ["rbf", "linear"],
        "gamma": ["scale", "auto"],
    },
}
# Scoring-function name -> search objective.
SCORING_CLASS = {"accuracy_score": "accuracy", "precision_score": "precision", "recall_score": "recall",
                 "f1_score": "f1"}
SCORING_REGR = {"mean_squared_error": "neg_mean_squared_error", "mean_absolute_error": "neg_mean_absolute_error",
                "r2_score": "r2"}
CLASSIFIERS = ("RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression", "SVC",
               "KNeighborsClassifier", "XGBClassifier", "LGBMClassifier")
REGRESSORS = ("RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression", "SVR",
              "KNeighborsRegressor", "XGBRegressor", "LGBMRegressor")


def _text(v) -> str:
    return "None" if v is None else str(v)


def grid_frame(spark: SparkSession, spaces: dict | None = None) -> DataFrame:
    """Every setting of every space, (model, setting, params map<string,string>).

    The grid is a product of fixed candidate lists (at most a few hundred settings per
    model), built by chained ``explode`` per parameter.
    """
    spaces = spaces or {**HYPER_SPACE_CLASS, **HYPER_SPACE_REGR}
    frames = None
    for model, space in spaces.items():
        df = spark.range(1).select(F.lit(model).alias("model"))
        for p, vals in space.items():
            df = df.withColumn(p, F.explode(F.array(*[F.lit(_text(v)) for v in vals])))
        names = list(space)
        params = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
        setting = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names])
        out = df.select("model", setting.alias("setting"), params.alias("params"))
        frames = out if frames is None else frames.unionByName(out)
    return frames


def sample_grid(records: DataFrame, grid: DataFrame, n_iter: int = 20, seed: int = 42,
                key: Sequence[str] = ("notebook", "cell_index")) -> DataFrame:
    """M3: up to ``n_iter`` settings per model record, drawn without replacement by a seeded md5 order."""
    from pyspark.sql import Window
    grid = grid.withColumn("_at", F.row_number().over(Window.partitionBy("model").orderBy("setting")))
    whole = grid.groupBy("model").agg(F.collect_list(F.struct("_at", "setting")).alias("_all"))  # grid: <= 675 rows/model
    # each record sorts its own grid: the settings that are not drawn never become rows
    drawn = F.slice(F.sort_array(F.transform("_all", lambda s: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], s["setting"])).alias("_h"),
        s["_at"].alias("_at")))), 1, n_iter)
    # an explicit count: AQE would put the narrow records, and so all draws, into few tasks
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = records.repartition(n, *key).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*key))).join(
        F.broadcast(whole), records["model_type"] == whole["model"])
    rows = [*records.columns, "_same", "model"]
    j = j.select(*rows, F.posexplode(drawn).alias("_pos", "_s")).select(*rows, "_pos", "_s.*")
    once = j.filter("_same = 1").withColumn("draw", F.col("_pos") + 1)
    # records of one key draw together, each has all that can be among the first
    w = Window.partitionBy(*key).orderBy("_h", "_at")
    many = j.filter("_same > 1").withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n_iter)
    out = once.unionByName(many).join(F.broadcast(grid), ["model", "_at"])
    return out.select(*records.columns, *[c for c in grid.columns if c not in ("model", "_at")], "draw")


def distinct_grid(spark: SparkSession, spaces: dict | None = None) -> DataFrame:
    """J8 for draws: of the settings that mean the same Spark estimator, the one of smallest text; settings that no
    Spark estimator has (kernels) are left out.  (model, setting, params)."""
    from itertools import product
    rows = []
    for model, space in (spaces or {**HYPER_SPACE_CLASS, **HYPER_SPACE_REGR}).items():
        if ESTIMATORS.get(model) is None:
            continue
        first: dict[tuple, tuple] = {}
        for values in product(*space.values()):
            params = {k: _text(v) for k, v in zip(space, values)}
            if params.get("kernel", "linear") != "linear":
                continue
            same = tuple(sorted(translate(model, params, 1)[0].items()))
            one = ", ".join(f"{k}={v}" for k, v in params.items())
            first[same] = min(first.get(same, (one, params)), (one, params), key=lambda x: x[0])
        rows += [(model, one, params) for one, params in first.values()]
    return spark.createDataFrame(rows, "model string, setting string, params map<string,string>")


# ----------------------------------------------------------------------------- estimator registry (M2)


# Recorded model type -> Spark ML estimator that stands for it (None: no such estimator).
ESTIMATORS = {
    "RandomForestClassifier": "RandomForestClassifier",
    "GradientBoostingClassifier": "GBTClassifier",
    "LogisticRegression": "LogisticRegression",
    "SVC": "LinearSVC",
    "KNeighborsClassifier": None,
    "XGBClassifier": "GBTClassifier",
    "LGBMClassifier": "GBTClassifier",
    "RandomForestRegressor": "RandomForestRegressor",
    "GradientBoostingRegressor": "GBTRegressor",
    "LinearRegression": "LinearRegression",
    "SVR": None,
    "KNeighborsRegressor": None,
    "XGBRegressor": "GBTRegressor",
    "LGBMRegressor": "GBTRegressor",
}
# Keyword arguments that have a Spark ML parameter.
MAPPED_KWARGS = ("n_estimators", "max_depth", "min_samples_leaf", "max_features", "learning_rate", "subsample", "C",
                 "penalty", "max_iter")


def registry_frame(spark: SparkSession) -> DataFrame:
    """One row per known model type: task, Spark estimator (NULL: none), number of distinct settings to draw from.
    A fixed table of 14 rows."""
    rows = [(m, "classification", ESTIMATORS[m]) for m in CLASSIFIERS] + [
        (m, "regression", ESTIMATORS[m]) for m in REGRESSORS]
    counts = distinct_grid(spark).groupBy(F.col("model").alias("model_type")).agg(
        F.count("*").alias("n_settings"))
    return spark.createDataFrame(rows, "model_type string, task string, estimator string").join(
        counts, "model_type", "left").withColumn("n_settings", F.coalesce("n_settings", F.lit(0).cast("bigint")))


def match_records(records: DataFrame) -> DataFrame:
    """Records whose type the registry knows, with task, estimator, settings and the objective of their score
    (unknown or missing scores: accuracy, r2)."""
    j = records.join(F.broadcast(registry_frame(records.sparkSession)), "model_type")

    def named(table: dict, default: str):
        out = F.lit(default)
        for k, v in table.items():
            out = F.when(F.col("score") == k, F.lit(v)).otherwise(out)
        return out

    return j.withColumn("objective", F.when(F.col("task") == "classification", named(SCORING_CLASS, "accuracy"))
                        .otherwise(named(SCORING_REGR, "r2")))


def unmatched_records(records: DataFrame) -> DataFrame:
    """U4: records that the registry does not know, by anti-join; they are reported, not fitted."""
    return records.join(F.broadcast(registry_frame(records.sparkSession).select("model_type")), "model_type", "left_anti")


def plan_records(records: DataFrame, n_iter: int = 20) -> DataFrame:
    """What the search does with each matched record: ``status`` search (original and draws), original (no space) or
    unsupported (no Spark estimator, or a kernel that is not linear), the keyword arguments that the estimator does
    not have (``ignored``, sorted names) and the number of settings drawn."""
    m = match_records(records)
    kernel = F.when(F.col("model_type") == "SVC", F.coalesce(F.element_at("kwargs", F.lit("kernel")), F.lit("rbf")))
    known = F.array(*[F.lit(k) for k in MAPPED_KWARGS])
    m = m.withColumn("status", F.when(F.col("estimator").isNull() | (kernel != "linear"), "unsupported")
                     .when(F.col("n_settings") > 0, "search").otherwise("original"))
    return (m.withColumn("ignored", F.array_join(F.array_sort(F.array_except(F.map_keys("kwargs"), known)), ","))
            .withColumn("n_draws", F.when(F.col("status") == "search",
                                          F.least(F.col("n_settings"), F.lit(n_iter).cast("bigint")))
                        .otherwise(F.lit(0).cast("bigint"))))


MAX_DEPTH = 30  # of Spark ML's trees; also stands for an unlimited depth


def _max_features(v):
    if v in (None, "None"):
        return "all"
    if v in ("sqrt", "log2"):
        return v
    return str(float(v))


def translate(model_type: str, params: dict, n_rows: int) -> tuple[dict, list[str]]:
    """Estimator kwargs -> Spark ML params; unmapped kwargs are returned, not dropped silently."""
    if params.get("kernel", "linear") != "linear":
        raise ValueError(f"kernel {params['kernel']}: only linear support vectors are fitted")
    out, ignored = {}, []
    for k, v in params.items():
        if v is None or v == "None":
            v = None
        if k == "n_estimators":
            out["numTrees" if "RandomForest" in model_type else "maxIter"] = int(v)
        elif k == "max_depth":
            if v is not None and int(v) > MAX_DEPTH:
                raise ValueError(f"max_depth {v}: trees are at most {MAX_DEPTH} deep")
            out["maxDepth"] = MAX_DEPTH if v is None else int(v)
        elif k == "min_samples_leaf":
            out["minInstancesPerNode"] = int(v)
        elif k == "max_features":
            out["featureSubsetStrategy"] = _max_features(v)
        elif k == "learning_rate":
            out["stepSize"] = float(v)
        elif k == "subsample":
            out["subsamplingRate"] = float(v)
        elif k == "C":
            out["regParam"] = 1.0 / (float(v) * max(n_rows, 1))
        elif k == "penalty":
            out["elasticNetParam"] = 1.0 if v == "l1" else 0.0
        elif k == "max_iter":
            out["maxIter"] = int(v)
        else:
            ignored.append(k)
    return out, ignored


def make_estimator(model_type: str, params: dict, features: str = "features", label: str = "label", seed: int = 42):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    if model_type == "RandomForestClassifier":
        est = C.RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed)
    elif model_type in ("GradientBoostingClassifier", "XGBClassifier", "LGBMClassifier"):
        est = C.GBTClassifier(featuresCol=features, labelCol=label, seed=seed)
    elif model_type == "LogisticRegression":
        est = C.LogisticRegression(featuresCol=features, labelCol=label, maxIter=100, standardization=True)
    elif model_type == "SVC":
        est = C.LinearSVC(featuresCol=features, labelCol=label)
    elif model_type == "RandomForestRegressor":
        est = R.RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed)
    elif model_type in ("GradientBoostingRegressor", "XGBRegressor", "LGBMRegressor"):
        est = R.GBTRegressor(featuresCol=features, labelCol=label, seed=seed)
    elif model_type == "LinearRegression":
        est = R.LinearRegression(featuresCol=features, labelCol=label)
    elif model_type == "Sequential":
        est = C.MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, seed=seed)
    else:
        raise KeyError(f"unsupported model type {model_type}")
    for k, v in params.items():
        if est.hasParam(k):
            est._set(**{k: v})
    return est


# ----------------------------------------------------------------------------- search


@dataclass
class SearchResult:
    trials: DataFrame      # (setting, fold, score)
    summary: DataFrame     # (setting, mean_score, std_score)
    best_setting: str
    original: dict
    optimized: dict
    ignored: list[str]     # keyword arguments of the original that the Spark estimator does not have
    best_model: object


def _score(pred: DataFrame, objective: str, label: str = "label") -> float:
    from .metrics import classification_metrics, regression_metrics
    if objective in ("accuracy", "precision", "recall", "f1"):
        m = classification_metrics(pred, label, "prediction", positive=1.0).first()
        return float(m[objective])
    m = regression_metrics(pred, label, "prediction").first()
    return {"neg_mean_squared_error": -m["mse"], "neg_mean_absolute_error": -m["mae"], "r2": m["r2"]}[objective]


def assemble(df: DataFrame, features: Sequence[str], label: str, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")
    return va.transform(df.select("*", col(label).cast("double").alias("label")))


def _evaluator(objective: str):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    by_label = {"precision": "precisionByLabel", "recall": "recallByLabel", "f1": "fMeasureByLabel"}
    if objective == "accuracy":
        return MulticlassClassificationEvaluator(metricName="accuracy"), 1.0
    if objective in by_label:  # binary scores of the positive class, like zero_division=0 scorers
        return MulticlassClassificationEvaluator(metricName=by_label[objective], metricLabel=1.0), 1.0
    if objective == "neg_mean_squared_error":
        return RegressionEvaluator(metricName="mse"), -1.0
    if objective == "neg_mean_absolute_error":
        return RegressionEvaluator(metricName="mae"), -1.0
    return RegressionEvaluator(metricName="r2"), 1.0


def random_search(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, model_type: str,
                  original_kwargs: dict, settings: Sequence[tuple[str, dict]], objective: str = "accuracy",
                  folds: int = 5, id_col: str = "id", parallelism: int = 4) -> SearchResult:
    """M1 + M4 + M5: fit the original, cross-validate every setting, refit the best, score both.

    Folds are stratified by label for classification (hash order inside each class, no
    single-partition window) and by id hash for regression.  ``parallelism`` fits run at a time;
    ``trials`` has one row per setting and fold, ``summary`` mean and population std per setting.
    """
    from .autoprep import hash_bucket
    from .metrics import classification_metrics, regression_metrics, stratified_folds
    spark = train.sparkSession
    n = train.count()
    is_cls = objective in ("accuracy", "precision", "recall", "f1")
    base = assemble(train, features, label)
    if is_cls:
        base = stratified_folds(base, "label", id_col, folds)
    else:
        base = base.withColumn("fold", (hash_bucket(col(id_col), "fold") % folds).cast("int"))
    # Iterative fits run one job per iteration over every partition of the cached data:
    # size partitions by rows (about 500k each), not by the session's shuffle setting.
    parts = max(1, -(-n // 500_000))
    tr = base.select("features", "label", "fold").repartition(parts).cache()
    va = assemble(valid, features, label).select("features", "label").repartition(parts).cache()

    def metrics(pred):
        if is_cls:
            r = classification_metrics(pred, "label", "prediction", positive=1.0).first()
            return {k: float(r[k]) for k in ("accuracy", "precision", "recall", "f1")}
        r = regression_metrics(pred, "label", "prediction").first()
        return {k: float(r[k]) for k in ("mse", "mae", "r2")}

    params, ignored = translate(model_type, original_kwargs, n)
    original = metrics(make_estimator(model_type, params).fit(tr).transform(va))
    est = make_estimator(model_type, {})
    maps = []
    for _, p in settings:
        sp, _ = translate(model_type, p, n)
        maps.append({est.getParam(k): v for k, v in sp.items() if est.hasParam(k)})
    evaluator, sign = _evaluator(objective)

    def fold_score(job: tuple[int, int]) -> float:
        fold, i = job
        fitted = est.fit(tr.filter(F.col("fold") != fold), maps[i])
        return sign * float(evaluator.evaluate(fitted.transform(tr.filter(F.col("fold") == fold))))

    jobs = [(fold, i) for fold in range(folds) for i in range(len(settings))]
    with ThreadPool(parallelism) as pool:  # each fit is a Spark job of its own
        scores = pool.map(inheritable_thread_target(spark)(fold_score), jobs, 1)
    rows = [(settings[i][0], fold, s) for (fold, i), s in zip(jobs, scores)]
    trials = spark.createDataFrame(rows, "setting string, fold int, score double")
    summary = trials.groupBy("setting").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    means = [statistics.fmean(s for (_, j), s in zip(jobs, scores) if j == i) for i in range(len(settings))]
    best_i = max(range(len(means)), key=lambda i: (means[i], -i))  # first best, like the search itself
    best_model = est.fit(tr, maps[best_i])
    optimized = metrics(best_model.transform(va))
    tr.unpersist()
    va.unpersist()
    return SearchResult(trials, summary, settings[best_i][0], original, optimized, ignored, best_model)


def submission(model, test: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """P10 / M6: (id, Prediction) of the test table from a fitted Spark ML model."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return model.transform(va.transform(test)).select(col(id_col), F.col("prediction").alias("Prediction"))
