"""Evaluation queries (G1-G3, J11) over prediction fixtures, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import classification_metrics, cv_summary, regression_metrics
from .fixtures import FX_PRED_CLASS_SQL, FX_PRED_REG_SQL, fx_pred_class, fx_pred_reg, md5_bucket
from .registry import r6, register

CLASS_SQL = """select {by} count(*) n,
  round(coalesce(sum(case when y_true = y_pred then 1 else 0 end) / count(*), 0), 6) accuracy,
  round(coalesce(sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)
     / nullif(sum(case when y_pred = 1 then 1 else 0 end), 0), 0), 6) "precision",
  round(coalesce(sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)
     / nullif(sum(case when y_true = 1 then 1 else 0 end), 0), 0), 6) recall,
  round(coalesce(2 * sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)
     / nullif(sum(case when y_true = 1 then 1 else 0 end) + sum(case when y_pred = 1 then 1 else 0 end), 0), 0), 6) f1
  from {src} {group}"""


def _round_all(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


@register("metrics_classification",
          f"with {FX_PRED_CLASS_SQL} " + CLASS_SQL.format(by="lang,", src="fxc", group="group by lang"))
def q_metrics_classification(spark: SparkSession, sf: str) -> DataFrame:
    out = classification_metrics(fx_pred_class(spark, sf), "y_true", "y_pred", by=["lang"])
    return _round_all(out, ["lang", "n"])


@register("metrics_classification_zero_division",
          f"with {FX_PRED_CLASS_SQL}, z as (select lang, y_true, 0 y_pred from fxc) "
          + CLASS_SQL.format(by="lang,", src="z", group="group by lang"))
def q_metrics_zero(spark: SparkSession, sf: str) -> DataFrame:
    """No positive predictions at all: precision and f1 fall back to 0."""
    d = fx_pred_class(spark, sf).withColumn("y_pred", F.lit(0))
    return _round_all(classification_metrics(d, "y_true", "y_pred", by=["lang"]), ["lang", "n"])


REG_SQL = """select {by} count(*) n, round(avg((y_true - y_pred) ^ 2), 6) mse,
  round(sqrt(avg((y_true - y_pred) ^ 2)), 6) rmse, round(avg(abs(y_true - y_pred)), 6) mae,
  round(case when var_pop(y_true) = 0 then (case when sum((y_true - y_pred) ^ 2) = 0 then 1.0 else 0.0 end)
   else 1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) end, 6) r2
  from {src} {group}"""


@register("metrics_regression",
          f"with {FX_PRED_REG_SQL} " + REG_SQL.format(by="event_type,", src="fxr", group="group by event_type"))
def q_metrics_regression(spark: SparkSession, sf: str) -> DataFrame:
    out = regression_metrics(fx_pred_reg(spark, sf), "y_true", "y_pred", by=["event_type"])
    return _round_all(out, ["event_type", "n"])


@register("metrics_regression_overall", f"with {FX_PRED_REG_SQL} " + REG_SQL.format(by="", src="fxr", group=""))
def q_metrics_regression_all(spark: SparkSession, sf: str) -> DataFrame:
    out = regression_metrics(fx_pred_reg(spark, sf), "y_true", "y_pred")
    return _round_all(out, ["n"])


@register("cv_summary", f"""with {FX_PRED_CLASS_SQL},
 folds as (select lang, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::BIGINT % 5 fold,
   avg(case when y_true = y_pred then 1.0 else 0.0 end) score from fxc group by all)
 select lang, round(avg(score), 6) mean_score, round(stddev_pop(score), 6) std_score, count(*) n_folds
 from folds group by lang""")
def q_cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Fold scores (accuracy per lang and hash fold) -> mean and population std per setting."""
    d = fx_pred_class(spark, sf).withColumn("fold", md5_bucket(F.col("doc_id")) % 5)
    scores = classification_metrics(d, "y_true", "y_pred", by=["lang", "fold"]).select(
        "lang", "fold", F.col("accuracy").alias("score"))
    out = cv_summary(scores, ["lang"], "score")
    return out.select("lang", r6(F.col("mean_score")).alias("mean_score"),
                      r6(F.col("std_score")).alias("std_score"), "n_folds")


def compare_runs(original: DataFrame, optimized: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Original vs optimized metrics side by side on the run key."""
    o = original.select(F.col(key), *[F.col(m).alias(f"original_{m}") for m in metrics])
    p = optimized.select(F.col(key), *[F.col(m).alias(f"optimized_{m}") for m in metrics])
    j = o.join(p, key, "full_outer")
    return j.withColumn("improved", F.col(f"optimized_{metrics[0]}") > F.col(f"original_{metrics[0]}"))


@register("compare_runs", f"""with {FX_PRED_CLASS_SQL}, d as (select fxc.*, fxc.lang || '::' || documents.source run_key,
   case when documents.n_chars % 2 = 0 then 1 else 0 end y_opt from fxc join documents using (doc_id)),
 o as ({CLASS_SQL.format(by="run_key,", src="d", group="group by run_key")}),
 p as ({CLASS_SQL.format(by="run_key,", src="(select run_key, y_true, y_opt y_pred from d) dd",
                         group="group by run_key")})
 select run_key, o.accuracy original_accuracy, o.f1 original_f1, p.accuracy optimized_accuracy,
   p.f1 optimized_f1, p.accuracy > o.accuracy improved
 from o full outer join p using (run_key)""")
def q_compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import read_table
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    d = (fx_pred_class(spark, sf).join(docs, "doc_id")
         .withColumn("run_key", F.concat_ws("::", "lang", "source"))
         .withColumn("y_opt", F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0)))
    orig = _round_all(classification_metrics(d, "y_true", "y_pred", by=["run_key"]), ["run_key", "n"])
    opt = _round_all(classification_metrics(d, "y_true", "y_opt", by=["run_key"]), ["run_key", "n"])
    return compare_runs(orig, opt, "run_key", ["accuracy", "f1"])


# ----------------------------------------------------------------------------- J9: k nearest neighbours

from ..operators.knn import knn_neighbors, knn_vote  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

EMB_SPLIT_SQL = """
emb as (select vec_id, embedding, label,
          ('0x' || substr(md5(cast(vec_id as varchar)), 1, 8))::BIGINT % 100 < 20 is_query from embeddings),
tr as (select * from emb where not is_query), qs as (select * from emb where is_query),
pd as (select qs.vec_id query_id, tr.vec_id neighbor_id, tr.label,
         sqrt(list_sum(list_transform(list_zip(qs.embedding, tr.embedding),
              lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) dist
       from qs cross join tr),
nn as (select * from (select *, row_number() over (partition by query_id order by dist, neighbor_id) "rank"
       from pd) where "rank" <= 5)
"""


def _emb_split(spark: SparkSession, sf: str):
    e = read_table(spark, sf, "embeddings")
    is_q = md5_bucket(F.col("vec_id")) % 100 < 20
    return e.filter(~is_q), e.filter(is_q)


@register("knn_neighbors", "with " + EMB_SPLIT_SQL + """
 select query_id, "rank", neighbor_id, round(dist, 6) dist from nn""")
def q_knn_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Exact 5 nearest training embeddings of every held-out embedding (pivot-pruned)."""
    train, queries = _emb_split(spark, sf)
    nb = knn_neighbors(train, queries, 5, id_col="vec_id", vec_col="embedding")
    return nb.select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id",
                     r6(F.col("dist")).alias("dist"))


@register("knn_vote", "with " + EMB_SPLIT_SQL + """,
 v as (select query_id, label, count(*) score from nn group by all)
 select query_id, arg_max(label, score * 1000 - label) prediction from v group by query_id""")
def q_knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    """J9 classifier: uniform vote of the 5 nearest neighbours (ties -> smallest label)."""
    train, queries = _emb_split(spark, sf)
    nb = knn_neighbors(train, queries, 5, id_col="vec_id", vec_col="embedding")
    return knn_vote(nb, train, "vec_id", "label").select("query_id", F.col("prediction").cast("int"))
