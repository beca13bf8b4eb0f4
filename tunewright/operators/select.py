"""Feature selection (F9 SelectKBest, F10 VarianceThreshold, F11 SelectFromModel, F12 RFE).

SelectFromModel and RFE take a logistic model, a forest, or (``estimator="linear"``) least squares from additive
statistics: one aggregate of the rows, whatever the number of eliminated features (``gram.py``).

The ANOVA F statistic needs only per-class count, mean and population variance
of every feature: one ``groupBy(label)`` with partial aggregation, so a class
holding most rows costs no more than any other.  F is then derived from that
(classes x features) table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import col
from .gram import Moments, eliminate, least_squares, moments


def anova_f(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, f_score) with f_score = (SSB / (k - 1)) / (SSW / (n - k)); NULL when undefined."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(features):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per_class = df.groupBy(col(label)).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"), F.col(f"m{i}").alias("m"),
                              F.col(f"v{i}").alias("v")) for i, c in enumerate(features)])
    long = per_class.select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    tot = long.groupBy("feature", "idx").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("_n") * F.col("m")) / F.sum("_n")).alias("gm"),
        F.sum(F.col("_n") * F.col("v")).alias("ssw"))
    j = long.join(tot, ["feature", "idx"])
    ssb = j.groupBy("feature", "idx", "n", "k", "ssw").agg(
        F.sum(F.col("_n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"))
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    return ssb.select("feature", "idx", f.alias("f_score"))


@dataclass
class SelectKBest:
    k: int | str = 10

    def fit(self, df: DataFrame, features: Sequence[str], label: str, scores: DataFrame | None = None) -> DataFrame:
        """Scores with rank and ``selected`` flag (k='all' keeps everything).  ``scores``: those of ``anova_f``, if known."""
        scores = anova_f(df, label, features) if scores is None else scores
        w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("idx"))  # one row per feature
        ranked = scores.withColumn("rank", F.row_number().over(w))
        k = len(features) if self.k == "all" else int(self.k)
        return ranked.withColumn("selected", F.col("rank") <= k).drop("idx")


@dataclass
class VarianceThreshold:
    threshold: float = 0.0

    def fit(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        row = df.agg(*[F.var_pop(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
        long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"))
                                              for i, c in enumerate(features)])).alias("r")).select("r.*")
        return long.withColumn("selected", F.col("variance") > F.lit(float(self.threshold)))

    def transform_columns(self, df: DataFrame, features: Sequence[str]) -> list[str]:
        return [r["feature"] for r in self.fit(df, features).filter("selected").collect()]


def _assemble(df: DataFrame, features: Sequence[str], label: str):
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return va.transform(df.select(*[col(c).cast("double").alias(c) for c in features],
                                  col(label).cast("double").alias("_label")))


def _importances(data: DataFrame, n_features: int, estimator: str, norm_order: float, seed: int) -> list[float]:
    if estimator == "forest":
        from pyspark.ml.classification import RandomForestClassifier
        m = RandomForestClassifier(featuresCol="_features", labelCol="_label", seed=seed, numTrees=50).fit(data)
        return list(m.featureImportances.toArray())
    from pyspark.ml.classification import LogisticRegression
    m = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=100, standardization=True).fit(data)
    coef = m.coefficientMatrix.toArray()  # classes x features
    out = []
    for j in range(n_features):
        col_j = [abs(coef[i][j]) for i in range(coef.shape[0])]
        if norm_order == float("inf"):
            out.append(max(col_j))
        elif norm_order == float("-inf"):
            out.append(min(col_j))
        else:
            out.append(sum(v ** norm_order for v in col_j) ** (1.0 / norm_order))
    return out


@dataclass
class SelectFromModel:
    threshold: float | str | None = None
    prefit: bool = False
    norm_order: float | str = 1
    max_features: int | None = None
    estimator: str = "logistic"
    seed: int = 42

    def importances(self, df: DataFrame, features: Sequence[str], label: str, stats: Moments | None = None
                    ) -> list[float]:
        if self.estimator == "linear":  # one row of coefficients: every norm is the absolute value
            m = stats or moments(df, [*features, label])
            return [abs(float(c)) for c in least_squares(m, m.total(), features, label).coefficients]
        order = {"inf": float("inf"), "-inf": float("-inf")}.get(str(self.norm_order), None)
        order = float(self.norm_order) if order is None else order
        data = _assemble(df, features, label).cache()
        try:
            return _importances(data, len(features), self.estimator, order, self.seed)
        finally:
            data.unpersist()

    def fit(self, df: DataFrame, features: Sequence[str], label: str, importances: Sequence[float] | None = None,
            stats: Moments | None = None) -> DataFrame:
        """(feature, importance, selected).  With ``prefit`` the importances of a fitted model are given and no model
        is fitted; without them that is an error.  ``stats``: the linear model's moments, if they are known."""
        features = list(features)
        if self.prefit and importances is None:
            raise ValueError("prefit: the importances of the fitted model are needed")
        imp = list(importances) if self.prefit else self.importances(df, features, label, stats)
        thr = self.threshold
        if thr is None:
            thr = "mean"  # an l1 penalty would use 1e-5, plain models use the mean
        if thr == "mean":
            cut = sum(imp) / len(imp)
        elif thr == "median":
            s = sorted(imp)
            mid = len(s) // 2
            cut = s[mid] if len(s) % 2 else (s[mid - 1] + s[mid]) / 2
        else:
            cut = float(thr)
        keep = [i for i, v in enumerate(imp) if v >= cut]
        if self.max_features is not None:
            keep = sorted(keep, key=lambda i: (-imp[i], i))[: self.max_features]
        rows = [(f, float(imp[i]), i in keep) for i, f in enumerate(features)]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double, selected boolean")


@dataclass
class RFE:
    n_features_to_select: int | float | None = None
    step: int | float = 1
    seed: int = 42
    estimator: str = "logistic"

    def fit(self, df: DataFrame, features: Sequence[str], label: str, stats: Moments | None = None) -> DataFrame:
        """Recursive elimination by squared coefficients; returns (feature, ranking, selected).  ``stats``: the linear
        model's moments, if they are known."""
        features = list(features)
        n = len(features)
        target = n // 2 if self.n_features_to_select is None else self.n_features_to_select
        if isinstance(target, float) and target < 1:
            target = int(target * n)
        target = max(1, min(int(target), n))
        step = max(1, int(self.step * n)) if isinstance(self.step, float) and self.step < 1 else int(self.step)
        if self.estimator == "linear":
            m = stats or moments(df, [*features, label])
            rounds = [[features.index(f) for f in gone]
                      for gone in eliminate(m, m.total(), features, label, target, step)]
        else:
            rounds = self._logistic_rounds(df, features, label, target, step)
        # rank 1: kept; 2: gone in the last round; one more for every round before
        ranking = dict.fromkeys(range(n), 1) | {a: r + 2 for r, gone in enumerate(reversed(rounds)) for a in gone}
        rows = [(features[i], int(ranking[i]), ranking[i] == 1) for i in range(n)]
        return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")

    def _logistic_rounds(self, df: DataFrame, features: list[str], label: str, target: int, step: int
                         ) -> list[list[int]]:
        from pyspark.ml.feature import VectorSlicer
        data = _assemble(df, features, label).cache()
        alive = list(range(len(features)))
        rounds: list[list[int]] = []
        while len(alive) > target:
            sliced = VectorSlicer(inputCol="_features", outputCol="_sub", indices=alive).transform(data)
            from pyspark.ml.classification import LogisticRegression
            m = LogisticRegression(featuresCol="_sub", labelCol="_label", maxIter=100).fit(sliced)
            coef = m.coefficientMatrix.toArray()
            score = [sum(coef[i][j] ** 2 for i in range(coef.shape[0])) for j in range(len(alive))]
            drop_n = min(step, len(alive) - target)
            worst = sorted(range(len(alive)), key=lambda j: (score[j], j))[:drop_n]
            rounds.append([alive[j] for j in worst])
            alive = [a for j, a in enumerate(alive) if j not in set(worst)]
        data.unpersist()
        return rounds
