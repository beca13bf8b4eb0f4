"""Cell-output text queries: metric-line filter (P8), last matching line (W4),
free-text metric extraction (X5).  Output lines are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BEST_LINE_PATTERNS, FLOAT_LINE, free_text_metrics, is_metric_line, last_matching_line
from ..sources.tables import read_table
from .registry import r6, register


def fx_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """One printed line per event; run = user_id, line order = event_id."""
    e = read_table(spark, sf, "events")
    v = F.col("value").cast("decimal(12,2)")
    d4 = lambda x: x.cast("decimal(12,4)").cast("string")
    line = (F.when(F.col("event_type") == "click", F.concat(F.lit("Validation Accuracy: "), d4(v * F.lit(0.002).cast('decimal(4,3)'))))
            .when(F.col("event_type") == "view", F.concat(F.lit("oob score "), d4(v * F.lit(0.0025).cast('decimal(5,4)'))))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("RMSE = "), d4(v)))
            .when(F.col("event_type") == "signup",
                  F.concat(F.lit("r2_rf_train R2 Train Score: "), d4(v * F.lit(0.0025).cast('decimal(5,4)'))))
            .otherwise(F.concat(F.lit("Epoch "), (F.col("event_id") % 10).cast("string"), F.lit(" - loss: "),
                                d4(v * F.lit(0.01).cast('decimal(3,2)')), F.lit(" - acc: ."))))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


FX_OUTPUTS_SQL = """
fxo as (select user_id run_id, event_id line_no,
  case event_type
    when 'click' then 'Validation Accuracy: ' || cast(cast(cast(value as decimal(12,2)) * 0.002 as decimal(12,4)) as varchar)
    when 'view' then 'oob score ' || cast(cast(cast(value as decimal(12,2)) * 0.0025 as decimal(12,4)) as varchar)
    when 'purchase' then 'RMSE = ' || cast(cast(cast(value as decimal(12,2)) as decimal(12,4)) as varchar)
    when 'signup' then 'r2_rf_train R2 Train Score: ' || cast(cast(cast(value as decimal(12,2)) * 0.0025 as decimal(12,4)) as varchar)
    else 'Epoch ' || cast(event_id % 10 as varchar) || ' - loss: ' || cast(cast(cast(value as decimal(12,2)) * 0.01 as decimal(12,4)) as varchar)
         || ' - acc: .' end line
  from events)
"""


@register("metric_lines", f"""with {FX_OUTPUTS_SQL} select run_id, line_no, line from fxo
  where contains(lower(line), 'accuracy') or contains(lower(line), 'precision') or contains(lower(line), 'recall')
     or contains(lower(line), 'f1') or contains(lower(line), 'roc_auc') or contains(lower(line), 'loss')
     or contains(lower(line), 'score')""")
def q_metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx_outputs(spark, sf).filter(is_metric_line(F.col("line")))


@register("last_metric_line", f"""with {FX_OUTPUTS_SQL},
 a as (select run_id, arg_max(trim(line), line_no) acc_line from fxo
       where regexp_matches(line, '(?i){BEST_LINE_PATTERNS["accuracy_score"]}') group by run_id),
 s as (select run_id, arg_max(trim(line), line_no) score_line from fxo
       where regexp_matches(line, '(?i){BEST_LINE_PATTERNS["score"]}') group by run_id),
 f as (select run_id, arg_max(trim(line), line_no) float_line from fxo
       where regexp_matches(line, '{FLOAT_LINE}') group by run_id)
 select * from a full join s using (run_id) full join f using (run_id)""")
def q_last_metric_line(spark: SparkSession, sf: str) -> DataFrame:
    """Per run, the last accuracy line, the last score line and the last line with a 2+ decimal float."""
    lines = fx_outputs(spark, sf)
    a = last_matching_line(lines, ["run_id"], "accuracy_score").withColumnRenamed("line", "acc_line")
    s = last_matching_line(lines, ["run_id"], "score").withColumnRenamed("line", "score_line")
    f = last_matching_line(lines, ["run_id"], None).withColumnRenamed("line", "float_line")
    return a.join(s, "run_id", "full").join(f, "run_id", "full")


def _x5_sql() -> str:
    from ..functions.text import OOB_SCORE, R2_TEST, R2_TRAIN, RMSE, VALIDATION_ACCURACY
    def num(p, name):
        return (f"case when regexp_matches(line, '{p}') then "
                f"round(try_cast(regexp_extract(line, '{p}', 1) as double), 6) end {name}")
    def model(kind, name):
        return (f"case when regexp_matches(line, '{R2_TRAIN if kind == 'train' else R2_TEST}') then "
                f"case when contains(lower(line), 'r2_svr_{kind}') then 'svr' when contains(lower(line), 'r2_rf_{kind}') "
                f"then 'rf' when contains(lower(line), 'r2_lr_{kind}') then 'lr' when contains(lower(line), "
                f"'r2_xgb_{kind}') then 'xgb' else 'model' end end {name}")
    cols = ", ".join([num(VALIDATION_ACCURACY, "validation_accuracy"), num(OOB_SCORE, "oob_score"),
                      num(RMSE, "rmse"), num(R2_TRAIN, "r2_train"), model("train", "r2_train_model"),
                      num(R2_TEST, "r2_test"), model("test", "r2_test_model")])
    return f"with {FX_OUTPUTS_SQL} select run_id, line_no, {cols} from fxo"


@register("free_text_metrics", _x5_sql())
def q_free_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    o = fx_outputs(spark, sf)
    m = o.select("run_id", "line_no", free_text_metrics(F.col("line")).alias("m"))
    out = []
    for f in ("validation_accuracy", "oob_score", "rmse", "r2_train", "r2_test"):
        out.append(r6(F.col(f"m.{f}").try_cast("double")).alias(f))
    return m.select("run_id", "line_no", *out, F.col("m.r2_train_model").alias("r2_train_model"),
                    F.col("m.r2_test_model").alias("r2_test_model"))
