"""Trial analytics: metric logs -> last values -> best model; trial tables -> best value and reports.

(X3, X4, G4, G5, G8, K1-K4, W3, R1-R3.)  Per-run selections are aggregates
(``max_by``/``min_by``) rather than windows, so a run or a sweep group with very
many rows is still combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logs import METRICS, canonical_entries, parse_metric_log
from ..session import reliable_checkpoint
from .fixtures import FX_TRIALS_SQL, fx_log, fx_log_rich, fx_log_rich_sql, fx_log_sql, fx_trials
from .registry import r6, register

KEYS = ("run_id", "line_no")


def _ord(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def last_values(canon: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, model, metric, value) keeping the latest logged value."""
    return (canon.filter(F.col("metric").isNotNull())
            .groupBy(run, "model", "metric")
            .agg(F.max_by("value", _ord("line_no", "pos", "sub")).alias("value")))


def metrics_wide(last: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per (run, model), one column per metric (fixed list, so no extra pass)."""
    return last.groupBy(run, "model").pivot("metric", list(METRICS)).agg(F.first("value"))


def best_model(canon: DataFrame, rule: str = "logs", run: str = "run_id") -> DataFrame:
    """K1 (rule='logs') / K2 (rule='outputs'): best model per run and the run's metric record.

    Every input the rule needs (last value per model and metric, first appearance of a
    model, last run-level value, the TensorFlow flag) comes out of one aggregate over the
    log entries, so the logs are read and shuffled once; the rest works on that result.
    """
    # One row per (run, model, metric): small next to the logs.  Checkpointing it keeps the
    # branches of the rule from each re-reading the logs (they prune different columns of it).
    return best_of_metrics(reliable_checkpoint(metric_table(canon, run)), rule, run)


#: place of a line number above (pos, sub) in one number, and what stands for a null line number, before all others
LINE, NO_LINE = 10 ** 12, -(2 ** 63) - 1


def _packed() -> Column:
    """(line_no, pos, sub) as one number of the same order, which an aggregate by hash can hold (a struct it cannot)."""
    line = F.coalesce(F.col("line_no").cast("decimal(20,0)"), F.lit(str(NO_LINE)).cast("decimal(20,0)"))
    return line * F.lit(LINE).cast("decimal(13,0)") + (F.col("pos").cast("long") * 10 + F.col("sub")).cast("decimal(12,0)")


def _unpacked(c: str) -> Column:
    n = F.col(c)
    rest = F.pmod(n, F.lit(LINE).cast("decimal(13,0)"))
    line = F.when(n >= F.lit(str(-(2 ** 63) * LINE)).cast("decimal(38,0)"), F.expr(
        f"({c} - pmod({c}, cast({LINE} as decimal(13,0)))) div cast({LINE} as decimal(13,0))"))
    rest = rest.cast("long")
    return F.when(n.isNotNull(), F.struct(line.alias("line_no"), F.floor(rest / 10).cast("int").alias("pos"),
                                          (rest % 10).cast("int").alias("sub")))


def metric_table(canon: DataFrame, run: str = "run_id") -> DataFrame:
    """What the best-model rules need of every (run, model, metric); works on a stream as well."""
    rows = canon.select(run, "model", "metric", "value", "is_global", "tf_hit", _packed().alias("_at"))
    glob = F.when(F.col("is_global") & F.col("metric").isNotNull(), F.col("_at"))
    table = rows.groupBy(run, "model", "metric").agg(
        F.max_by("value", "_at").alias("last"), F.min("_at").alias("first"), F.max_by("value", glob).alias("glast"),
        F.max(glob).alias("gord"), F.max(F.col("tf_hit").cast("int")).alias("tf"))
    return table.select(run, "model", "metric", "last", _unpacked("first").alias("first"), "glast",
                        _unpacked("gord").alias("gord"), "tf")


def best_of_metrics(g: DataFrame, rule: str = "logs", run: str = "run_id") -> DataFrame:
    """The rule on a ``metric_table``."""
    wide = (g.filter(F.col("metric").isNotNull()).groupBy(run, "model")
            .pivot("metric", list(METRICS)).agg(F.first("last")))
    first_seen = g.groupBy(run, "model").agg(F.min("first").alias("first_seen"))
    w = wide.join(first_seen, [run, "model"])
    is_cls = F.max((F.col("accuracy").isNotNull() | F.col("f1").isNotNull()).cast("int"))
    task = w.groupBy(run).agg((is_cls == 1).alias("is_classification"))
    w = w.join(task, run)
    if rule == "logs":
        reg = F.coalesce(F.col("r2"), -F.col("mse"), -F.col("rmse"), -F.col("mae"))
    elif rule == "outputs":
        reg = -F.coalesce(F.col("mse"), F.col("rmse"), F.col("mae"), -F.col("r2"))
    else:
        raise ValueError(f"unknown rule {rule}")
    score = F.when(F.col("is_classification"), F.coalesce(F.col("f1"), F.col("accuracy"))).otherwise(reg)
    scored = w.withColumn("score", score).filter(F.col("score").isNotNull())
    # highest score, earliest first appearance on ties: max of (score, -first_seen)
    key = F.struct(F.col("score"), F.struct(-F.col("first_seen.line_no"), -F.col("first_seen.pos"),
                                            -F.col("first_seen.sub")))
    best = scored.groupBy(run).agg(F.max_by(F.struct("model", *METRICS), key).alias("b"))
    glob = (g.filter(F.col("gord").isNotNull()).groupBy(run).pivot("metric", list(METRICS))
            .agg(F.max_by("glast", "gord")))
    runs = g.groupBy(run).agg(F.max("tf").alias("_tf"))
    j = runs.join(glob, run, "left").join(best, run, "left").join(task, run, "left")
    vals = {m: F.coalesce(F.col(f"b.{m}"), F.col(m)) for m in METRICS}
    vals["rmse"] = F.coalesce(vals["rmse"], F.sqrt(vals["mse"]))
    name = F.coalesce(F.col("b.model"), F.when(F.col("_tf") == 1, F.lit("tensorflow")), F.lit("unknown"))
    return j.select(run, name.alias("best_model"), F.coalesce(F.col("is_classification"), F.lit(False))
                    .alias("is_classification"), *[vals[m].alias(m) for m in METRICS])


def _canon(spark: SparkSession, sf: str, rich: bool = True, by_task: bool = False) -> DataFrame:
    src = fx_log_rich(spark, sf) if rich else fx_log(spark, sf, by_task)
    return canonical_entries(parse_metric_log(src, "text", KEYS), KEYS)


# ----------------------------------------------------------------------------- oracle SQL pieces

PARSE_SQL = r"""
parsed as (
  select run_id, line_no, unnest(range(len(ns))) pos, unnest(ns) name_raw, unnest(vs) v_raw
  from (select run_id, line_no,
          regexp_extract_all(text, 'METRIC_LOG: ([^=]+) = ([^(\n]+)', 1) ns,
          regexp_extract_all(text, 'METRIC_LOG: ([^=]+) = ([^(\n]+)', 2) vs from {src}) x),
p as (select run_id, line_no, pos, trim(name_raw) name, trim(v_raw) value_text,
        try_cast(trim(v_raw) as double) value from parsed)
"""

CANON_SQL = r"""
s as (select *, regexp_extract(name, '^([a-zA-Z0-9_]+)_([a-zA-Z0-9_]+)', 1) pm,
        regexp_extract(name, '^([a-zA-Z0-9_]+)_([a-zA-Z0-9_]+)', 2) pmt from p where value is not null),
c as (select *, case when pmt in ('accuracy','precision','recall','f1','mse','rmse','r2','mae') then pm
        else 'model' end model0,
      case when pmt in ('accuracy','precision','recall','f1','mse','rmse','r2','mae') then pmt else name end m
      from s),
r as (select *,
      case when contains(m, 'mean_squared_error') then 'mse' when contains(m, 'mean_absolute_error') then 'mae'
           when contains(m, 'r2_score') then 'r2' when contains(m, 'accuracy_score') then 'accuracy'
           when contains(m, 'precision_score') then 'precision' when contains(m, 'recall_score') then 'recall'
           when contains(m, 'f1_score') then 'f1' end sk from c),
k as (select *, sk is null and starts_with(m, 'tf_') is_tf from r),
ce as (
  select run_id, line_no, pos, 0 sub, model0 model, null metric, null::double value, false is_global, false tf_hit
  from k
  union all select run_id, line_no, pos, 1, model0, sk, value, true, false from k where sk is not null
  union all select run_id, line_no, pos, 2, model0, 'rmse', sqrt(value), true, false from k where sk = 'mse'
  union all select run_id, line_no, pos, 1, 'tensorflow', 'accuracy', value, true, true from k
    where is_tf and contains(substr(m, 4), 'acc') and not contains(substr(m, 4), 'val_')
  union all select run_id, line_no, pos, 1, split_part(m, '_score', 1),
    case when contains(m, 'accuracy') then 'accuracy' else 'r2' end, value, false, false from k
    where sk is null and not is_tf and contains(m, '_score')
  union all select run_id, line_no, pos, 1, model0, m, value, true, false from k
    where sk is null and not is_tf and not contains(m, '_score')
      and m in ('accuracy','precision','recall','f1','mse','rmse','r2','mae'))
"""

METRIC_LIST = ("accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae")


def _pivot_sql(src: str, val: str, keys: str) -> str:
    cols = ", ".join(f"max(case when metric = '{m}' then {val} end) \"{m}\"" for m in METRIC_LIST)
    return f"select {keys}, {cols} from {src} group by {keys}"


def _best_sql(rule: str) -> str:
    if rule == "logs":
        reg = "coalesce(r2, -mse, -rmse, -mae)"
    else:
        reg = "-coalesce(mse, rmse, mae, -r2)"
    pick = ", ".join(f"coalesce(b.\"{m}\", g.\"{m}\") \"{m}\"" if m != "rmse" else
                     "coalesce(b.rmse, g.rmse, sqrt(coalesce(b.mse, g.mse))) rmse" for m in METRIC_LIST)
    rounded = ", ".join(f"round(\"{m}\", 6) \"{m}\"" for m in METRIC_LIST)
    return f"""
o as (select *, line_no * 1000 + pos * 10 + sub o from ce),
lastv as (select run_id, model, metric, arg_max(value, o) v from o where metric is not null group by all),
w as ({_pivot_sql('lastv', 'v', 'run_id, model')}),
fs as (select run_id, model, min(o) fs from o group by all),
cls as (select run_id, bool_or(accuracy is not null or f1 is not null) is_classification from w group by run_id),
sc as (select w.*, fs.fs, cls.is_classification,
         case when cls.is_classification then coalesce(f1, accuracy) else {reg} end score
       from w join fs using (run_id, model) join cls using (run_id)),
b as (select * from (select *, row_number() over (partition by run_id order by score desc, fs) rk
       from sc where score is not null) where rk = 1),
gl as (select run_id, metric, arg_max(value, o) v from o where is_global and metric is not null group by all),
g as ({_pivot_sql('gl', 'v', 'run_id')}),
runs as (select run_id, bool_or(tf_hit) tf from o group by run_id),
res as (select runs.run_id, coalesce(b.model, case when runs.tf then 'tensorflow' end, 'unknown') best_model,
          coalesce(cls.is_classification, false) is_classification, {pick}
        from runs left join g using (run_id) left join b using (run_id) left join cls using (run_id))
select run_id, best_model, is_classification, {rounded} from res"""


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in METRICS else F.col(c) for c in df.columns])


# ----------------------------------------------------------------------------- log queries


@register("log_parse", "with " + fx_log_rich_sql() + ", " + PARSE_SQL.format(src="fxlr")
          + " select run_id, line_no, pos, name, value_text, round(value, 6) value from p")
def q_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_metric_log(fx_log_rich(spark, sf), "text", KEYS)
    return p.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), "name", "value_text",
                    r6(F.col("value")).alias("value"))


@register("log_canonical", "with " + fx_log_rich_sql() + ", " + PARSE_SQL.format(src="fxlr") + ", " + CANON_SQL
          + " select run_id, line_no, pos, sub, model, metric, round(value, 6) value, is_global from ce"
            " where metric is not null")
def q_log_canonical(spark: SparkSession, sf: str) -> DataFrame:
    c = _canon(spark, sf).filter(F.col("metric").isNotNull())
    return c.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), F.col("sub").cast("int").alias("sub"),
                    "model", "metric", r6(F.col("value")).alias("value"), "is_global")


@register("last_metric", "with " + fx_log_rich_sql() + ", " + PARSE_SQL.format(src="fxlr") + ", " + CANON_SQL
          + ", o as (select *, line_no * 1000 + pos * 10 + sub o from ce) "
            "select run_id, model, metric, round(arg_max(value, o), 6) value from o where metric is not null "
            "group by all")
def q_last_metric(spark: SparkSession, sf: str) -> DataFrame:
    last = last_values(_canon(spark, sf))
    return last.select("run_id", "model", "metric", r6(F.col("value")).alias("value"))


@register("metrics_wide", "with " + fx_log_rich_sql() + ", " + PARSE_SQL.format(src="fxlr") + ", " + CANON_SQL
          + ", o as (select *, line_no * 1000 + pos * 10 + sub o from ce), "
            "lastv as (select run_id, model, metric, arg_max(value, o) v from o where metric is not null group by all) "
          + "select run_id, model, " + ", ".join(f"round(\"{m}\", 6) \"{m}\"" for m in METRIC_LIST)
          + " from (" + _pivot_sql("lastv", "v", "run_id, model") + ") w")
def q_metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _round_metrics(metrics_wide(last_values(_canon(spark, sf))))


@register("run_task_type", "with " + fx_log_sql(True) + ", " + PARSE_SQL.format(src="fxl") + ", " + CANON_SQL
          + " select run_id, bool_or(metric in ('accuracy', 'f1')) is_classification from ce group by run_id")
def q_run_task_type(spark: SparkSession, sf: str) -> DataFrame:
    """G8 on the whole log, regression lines as runs of their own: classification iff some model logged accuracy or f1."""
    c = _canon(spark, sf, rich=False, by_task=True)
    return c.groupBy("run_id").agg(F.max(F.col("metric").isin("accuracy", "f1").cast("int")).cast("boolean")
                                   .alias("is_classification"))


@register("best_model_logs", "with " + fx_log_rich_sql() + ", " + PARSE_SQL.format(src="fxlr") + ", " + CANON_SQL
          + ", " + _best_sql("logs"))
def q_best_model_logs(spark: SparkSession, sf: str) -> DataFrame:
    return _round_metrics(best_model(_canon(spark, sf), "logs"))


@register("best_model_logs_regression", "with " + fx_log_sql(True) + ", " + PARSE_SQL.format(src="fxl") + ", "
          + CANON_SQL + ", " + _best_sql("logs"))
def q_best_model_logs_reg(spark: SparkSession, sf: str) -> DataFrame:
    return _round_metrics(best_model(_canon(spark, sf, rich=False, by_task=True), "logs"))


@register("best_model_outputs", "with " + fx_log_sql(True) + ", " + PARSE_SQL.format(src="fxl") + ", "
          + CANON_SQL + ", " + _best_sql("outputs"))
def q_best_model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return _round_metrics(best_model(_canon(spark, sf, rich=False, by_task=True), "outputs"))


# ----------------------------------------------------------------------------- trial tables


def best_value(trials: DataFrame, objective: str = "mse", keys=("method", "parameter")) -> DataFrame:
    """K3: per sweep, the value with the lowest non-NULL objective (first in order on ties)."""
    lower = objective in ("mse", "rmse", "mae")
    o = F.col(objective) if lower else -F.col(objective)
    return (trials.filter(F.col(objective).isNotNull())
            .groupBy(*keys)
            .agg(F.min_by(F.struct("value", F.col(objective).alias("best")), F.struct(o, F.col("ord"))).alias("b"))
            .select(*keys, F.col("b.value").alias("best_value"), F.col("b.best").alias(f"best_{objective}")))


@register("best_value", f"""with {FX_TRIALS_SQL}
 select method, parameter, arg_min(value, mse * 1e12 + ord) best_value, round(min(mse), 6) best_mse
 from fxt where mse is not null group by all""")
def q_best_value(spark: SparkSession, sf: str) -> DataFrame:
    out = best_value(fx_trials(spark, sf), "mse")
    return out.select("method", "parameter", "best_value", r6(F.col("best_mse")).alias("best_mse"))


@register("best_setting", f"""with {FX_TRIALS_SQL}
 select method, arg_max(parameter || '=' || value, accuracy * 1e12 - ord) best_setting,
   round(max(accuracy), 6) best_accuracy from fxt where accuracy is not null group by method""")
def q_best_setting(spark: SparkSession, sf: str) -> DataFrame:
    """Per model (method), the setting with the highest score; earliest on ties."""
    t = fx_trials(spark, sf).filter(F.col("accuracy").isNotNull())
    b = t.groupBy("method").agg(
        F.max_by(F.concat_ws("=", "parameter", "value"), F.struct(F.col("accuracy"), -F.col("ord")))
        .alias("best_setting"), F.max("accuracy").alias("best_accuracy"))
    return b.select("method", "best_setting", r6(F.col("best_accuracy")).alias("best_accuracy"))


RANK_KEYS = (("accuracy", False), ("f1", False), ("mse", True), ("rmse", True), ("r2", False))


def ranked_report(trials: DataFrame, keys=("method", "parameter")) -> DataFrame:
    """R2: rank inside each sweep by the first metric present in *all* its rows; else keep order.

    The rank is a position in one global range-partitioned sort minus the start of
    the sweep, so a sweep with a huge number of trials is not sorted by one task.
    """
    from ..operators.encode import dense_codes
    keys = list(keys)
    present = trials.groupBy(*keys).agg(
        *[(F.count(m) == F.count(F.lit(1))).alias(f"all_{m}") for m, _ in RANK_KEYS])
    sort_key = F.lit(None).cast("double")
    for m, asc in reversed(RANK_KEYS):
        sort_key = F.when(F.col(f"all_{m}"), F.col(m) if asc else -F.col(m)).otherwise(sort_key)
    with_key = _join_null_safe(trials, present, keys).withColumn("_sk", sort_key)
    coded, _ = dense_codes(with_key.select(*trials.columns, "_sk"), "ord", order_cols=[*keys, "_sk", "ord"])
    start = coded.groupBy(*keys).agg(F.min("code").alias("_start"))
    ranked = _join_null_safe(coded, start, keys)
    return ranked.select(*trials.columns, (F.col("code") - F.col("_start") + 1).alias("rank"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; the keys are kept once."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def _ranked_sql() -> str:
    alls = ", ".join(f"count({m}) = count(*) all_{m}" for m, _ in RANK_KEYS)
    sk = "case " + " ".join(f"when all_{m} then {'' if asc else '-'}{m}" for m, asc in RANK_KEYS) + " end"
    return f"""with {FX_TRIALS_SQL},
 t as (select *, sqrt(mse) rmse, null::double f1, null::double r2 from fxt),
 pr as (select method, parameter, {alls} from t group by all),
 k as (select t.*, {sk} sk from t join pr using (method, parameter))
 select method, parameter, value, row_number() over (partition by method, parameter order by sk nulls first, ord) rank
 from k"""


@register("report_ranked", _ranked_sql())
def q_report_ranked(spark: SparkSession, sf: str) -> DataFrame:
    t = (fx_trials(spark, sf).withColumn("rmse", F.sqrt("mse"))
         .withColumn("f1", F.lit(None).cast("double")).withColumn("r2", F.lit(None).cast("double")))
    r = ranked_report(t)
    return r.select("method", "parameter", "value", F.col("rank").cast("bigint").alias("rank"))


@register("report_ranked_nulls", f"""with {FX_TRIALS_SQL},
 t as (select * replace (case when ord % 7 = 0 then null else parameter end as parameter) from fxt),
 k as (select t.*, case when count(accuracy) over g = count(*) over g then -accuracy
   when count(mse) over g = count(*) over g then mse end sk from t window g as (partition by method, parameter))
 select method, parameter, value, ord, row_number() over (partition by method, parameter order by sk nulls first, ord) rank
 from k""")
def q_report_ranked_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """R2 with trials whose parameter is unknown: they are one sweep, none is lost."""
    none = F.lit(None).cast("double")
    t = fx_trials(spark, sf).withColumn("parameter", F.when(F.col("ord") % 7 != 0, F.col("parameter")))
    t = t.withColumn("rmse", F.sqrt("mse")).withColumn("f1", none).withColumn("r2", none)
    return ranked_report(t).select("method", "parameter", "value", "ord", F.col("rank").cast("bigint").alias("rank"))


def _fmt(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.6f", c)).otherwise(F.lit("N/A"))


def markdown_rows(trials: DataFrame, notebook: Column) -> DataFrame:
    """One Markdown table row per trial; the layout follows the sweep's task type."""
    is_cls = F.max(F.col("accuracy").isNotNull().cast("int")).over(
        __import__("pyspark.sql").sql.Window.partitionBy("method", "parameter")) == 1
    cls_row = F.concat(F.lit("| "), F.concat_ws(" | ", notebook, F.col("value"), _fmt(F.col("accuracy")),
                                                _fmt(F.col("precision")), _fmt(F.col("recall")), _fmt(F.col("f1")),
                                                F.coalesce(F.col("best_model"), F.lit("N/A"))), F.lit(" |"))
    reg_row = F.concat(F.lit("| "), F.concat_ws(" | ", notebook, F.col("value"), _fmt(F.col("mse")),
                                                _fmt(F.col("rmse")), _fmt(F.col("mae")), _fmt(F.col("r2")),
                                                F.coalesce(F.col("best_model"), F.lit("N/A"))), F.lit(" |"))
    return trials.select("method", "parameter", "value", F.when(is_cls, cls_row).otherwise(reg_row).alias("row"))


@register("report_markdown", f"""with {FX_TRIALS_SQL},
 t as (select *, sqrt(mse) rmse, null::double mae, null::double r2, null::double "precision", null::double recall,
         null::double f1, 'model' best_model from fxt),
 c as (select method, parameter, bool_or(accuracy is not null) is_cls from t group by all)
 select method, parameter, value, case when is_cls then
   '| ' || concat_ws(' | ', 'part.parquet', value, coalesce(printf('%.6f', accuracy), 'N/A'),
     coalesce(printf('%.6f', "precision"), 'N/A'), coalesce(printf('%.6f', recall), 'N/A'),
     coalesce(printf('%.6f', f1), 'N/A'), best_model) || ' |'
   else '| ' || concat_ws(' | ', 'part.parquet', value, coalesce(printf('%.6f', mse), 'N/A'),
     coalesce(printf('%.6f', rmse), 'N/A'), coalesce(printf('%.6f', mae), 'N/A'),
     coalesce(printf('%.6f', r2), 'N/A'), best_model) || ' |' end "row"
 from t join c using (method, parameter)""")
def q_report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    t = fx_trials(spark, sf).select(
        "*", F.sqrt("mse").alias("rmse"), *[F.lit(None).cast("double").alias(m) for m in
                                            ("mae", "r2", "precision", "recall", "f1")],
        F.lit("model").alias("best_model"))
    return markdown_rows(t, F.lit("part.parquet"))


@register("trial_summary", f"""with {FX_TRIALS_SQL}
 select method, parameter, value, concat_ws(', ', case when mse is not null then 'MSE: ' || printf('%.4f', mse) end,
   case when accuracy is not null then 'R²: ' || printf('%.4f', accuracy) end) summary from fxt""")
def q_trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    """R1: 'MSE: x, R²: y' per trial (accuracy stands in for r2 in the fixture)."""
    t = fx_trials(spark, sf)
    s = F.concat_ws(", ", F.when(F.col("mse").isNotNull(), F.concat(F.lit("MSE: "), F.format_string("%.4f", "mse"))),
                    F.when(F.col("accuracy").isNotNull(),
                           F.concat(F.lit("R²: "), F.format_string("%.4f", "accuracy"))))
    return t.select("method", "parameter", "value", s.alias("summary"))
