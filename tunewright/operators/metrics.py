"""Evaluation metrics as grouped aggregates (G1 classification, G2 regression, G3 CV summary).

Each metric is a sum or average, so ``groupBy(by)`` runs with map-side partial
aggregation and the result has one row per group.  Zero denominators give 0,
as ``zero_division=0`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col


def _grouped(df: DataFrame, by: Sequence[str] | None):
    return df.groupBy(*[col(c) for c in by]) if by else df.groupBy()


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] | None = None,
                           positive=1) -> DataFrame:
    t, p = col(y_true), col(y_pred)
    pos_t, pos_p = t == F.lit(positive), p == F.lit(positive)
    agg = _grouped(df, by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(t == p, 1).otherwise(0)).alias("correct"),
        F.sum(F.when(pos_t & pos_p, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~pos_t & pos_p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(pos_t & ~pos_p, 1).otherwise(0)).alias("fn"))
    z = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        *(by or []), "n",
        F.coalesce(F.try_divide(F.col("correct"), F.col("n")).cast("double"), z).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp).cast("double"), z).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn).cast("double"), z).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn).cast("double"), z).alias("f1"))


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] | None = None) -> DataFrame:
    t, p = col(y_true).cast("double"), col(y_pred).cast("double")
    e = t - p
    agg = _grouped(df, by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), F.var_pop(t).alias("vt"))
    sst = F.col("vt") * F.col("n")
    r2 = (F.when(sst == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("sse") / sst))
    return agg.select(*(by or []), "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def cv_summary(fold_scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and population std of fold scores per setting (np.std semantics)."""
    return fold_scores.groupBy(*[col(k) for k in keys]).agg(
        F.avg(col(score)).alias("mean_score"), F.stddev_pop(col(score)).alias("std_score"),
        F.count(F.lit(1)).alias("n_folds"))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, salt: str = "") -> DataFrame:
    """Fold column: rows of each label ordered by a hash of the id, dealt round-robin to k folds.

    The rank inside a label uses a range-partitioned sort (no single-partition window):
    ``fold = (rank within label) mod k``.
    """
    from .encode import dense_codes
    # the rows themselves are ranked, so ids need not be unique
    keyed = df.select(F.struct("*").alias("_row"), col(label).alias("_lab"),
                      F.xxhash64(F.concat(F.lit(salt), col(id_col).cast("string"))).alias("_h"),
                      col(id_col).alias("_id"))
    coded, _ = dense_codes(keyed, "_id", order_cols=["_lab", "_h", "_id"])
    first = coded.groupBy(F.col("_lab").alias("_of")).agg(F.min("code").alias("_first"))
    if first.count() <= 100_000:  # one row per class: broadcast once its size is known
        first = F.broadcast(first)
    ranked = coded.join(first, F.col("_lab").eqNullSafe(F.col("_of")))
    return ranked.select("_row.*", ((F.col("code") - F.col("_first")) % k).cast("int").alias("fold"))
