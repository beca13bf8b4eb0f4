"""Recorded models through the registry: matches, reports, search plans, draws and a regression checked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import regression_metrics, stratified_folds
from ..operators.search import (HYPER_SPACE_CLASS, HYPER_SPACE_REGR, assemble, distinct_grid, make_estimator,
                                match_records, plan_records, sample_grid, translate, unmatched_records)
from ..sources.tables import read_table
from .fixtures import md5_bucket
from .registry import register

# Model types and scores of the derived records.
TYPES = ("RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression", "SVC", "KNeighborsClassifier",
         "XGBClassifier", "LGBMClassifier", "RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression",
         "SVR", "KNeighborsRegressor", "XGBRegressor", "LGBMRegressor", "Sequential", "GaussianNB")
SCORES = ("accuracy_score", "f1_score", "mean_squared_error", "r2_score", "score")


def fx_records(spark: SparkSession, sf: str) -> DataFrame:
    """Model records of every ``part`` row: (notebook, cell_index, model_type, score, kwargs)."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    none = F.create_map().cast("map<string,string>")
    kwargs = (F.when(k % 5 == 0, none)
              .when(k % 5 == 1, F.create_map(F.lit("n_estimators"), (size * 10).cast("string"), F.lit("n_jobs"),
                                             F.lit("-1")))
              .when(k % 5 == 2, F.create_map(F.lit("kernel"), F.when(size % 2 == 0, "linear").otherwise("rbf"),
                                             F.lit("C"), size.cast("string")))
              .when(k % 5 == 3, F.create_map(F.lit("verbose"), F.lit("1"), F.lit("max_depth"), F.lit("5"),
                                             F.lit("min_samples_split"), F.lit("2")))
              .otherwise(none))
    return read_table(spark, sf, "part").select(
        F.concat(F.lit("nb"), (k % 30).cast("string")).alias("notebook"), k.cast("bigint").alias("cell_index"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % len(TYPES) + 1).cast("int")).alias("model_type"),
        F.when(size % 6 > 0, F.element_at(F.array(*[F.lit(s) for s in SCORES]), F.greatest(size % 6, F.lit(1))
                                          .cast("int"))).alias("score"),
        kwargs.alias("kwargs"))


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _grid_sql() -> str:
    """Distinct settings in SQL: the product of the lists, grouped by the parameters that reach the estimator."""
    dropped = {"min_samples_split", "solver", "kernel", "gamma"}
    parts = []
    for model, space in {**HYPER_SPACE_CLASS, **HYPER_SPACE_REGR}.items():
        if model in ("KNeighborsClassifier", "SVR"):
            continue
        lists = {p: [v for v in vals if p != "kernel" or v == "linear"] for p, vals in space.items()}
        src = "(select 1)"  # nested, since several unnests of one select run side by side
        for p, v in lists.items():
            src = f"(select *, unnest({_texts(v)}) {p}_ from {src})"
        text = " || ', ' || ".join(f"'{p}=' || {p}_" for p in lists)
        same = ", ".join(f"case {p}_ when 'None' then '30' else {p}_ end" if p == "max_depth" else f"{p}_"
                         for p in lists if p not in dropped)
        parts.append(f"select '{model}' model, min({text}) setting from {src} group by {same}")
    return "grid as (" + " union all ".join(parts) + ")"


_MATCHED_SQL = f"""rec as (select 'nb' || (p_partkey % 30) notebook, p_partkey::BIGINT cell_index, p_partkey k, p_size sz,
   ({_texts(TYPES)})[(p_partkey % {len(TYPES)} + 1)::INT] model_type,
   case when p_size % 6 > 0 then ({_texts(SCORES)})[(p_size % 6)::INT] end score from part),
{_grid_sql()},
n as (select model, count(*) n from grid group by 1),
reg(model_type, estimator) as (values ('RandomForestClassifier', 'RandomForestClassifier'),
  ('GradientBoostingClassifier', 'GBTClassifier'), ('LogisticRegression', 'LogisticRegression'), ('SVC', 'LinearSVC'),
  ('KNeighborsClassifier', null), ('XGBClassifier', 'GBTClassifier'), ('LGBMClassifier', 'GBTClassifier'),
  ('RandomForestRegressor', 'RandomForestRegressor'), ('GradientBoostingRegressor', 'GBTRegressor'),
  ('LinearRegression', 'LinearRegression'), ('SVR', null), ('KNeighborsRegressor', null),
  ('XGBRegressor', 'GBTRegressor'), ('LGBMRegressor', 'GBTRegressor')),
matched as (select rec.*, estimator, coalesce(n.n, 0) n_settings,
   case when model_type like '%Regressor' or model_type in ('LinearRegression', 'SVR') then 'regression'
        else 'classification' end task
 from rec join reg using (model_type) left join n on n.model = rec.model_type),
objectives as (select *, case
   when task = 'classification' then
     case score when 'f1_score' then 'f1' when 'precision_score' then 'precision' when 'recall_score' then 'recall'
          else 'accuracy' end
   when score = 'mean_squared_error' then 'neg_mean_squared_error'
   when score = 'mean_absolute_error' then 'neg_mean_absolute_error' else 'r2' end objective from matched)"""


@register("registry_match", "with " + _MATCHED_SQL + """
 select notebook, cell_index, model_type, task, estimator, n_settings, objective from objectives""")
def q_registry_match(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded models with what the registry knows of them."""
    return match_records(fx_records(spark, sf)).select(
        "notebook", "cell_index", "model_type", "task", "estimator", "n_settings", "objective")


@register("registry_unmatched", "with " + _MATCHED_SQL + """
 select notebook, cell_index, model_type from rec where model_type not in (select model_type from reg)""")
def q_registry_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded models that the registry does not know."""
    return unmatched_records(fx_records(spark, sf)).select("notebook", "cell_index", "model_type")


_PLAN_SQL = "with " + _MATCHED_SQL + """,
plan as (select *, case
   when estimator is null or (model_type = 'SVC' and not (k % 5 = 2 and sz % 2 = 0)) then 'unsupported'
   when n_settings > 0 then 'search' else 'original' end status,
   case k % 5 when 1 then 'n_jobs' when 2 then 'kernel' when 3 then 'min_samples_split,verbose' else '' end ignored
 from objectives)"""


@register("search_plan", _PLAN_SQL + """
 select notebook, cell_index, model_type, objective, status, ignored,
        case when status = 'search' then least(n_settings, 20) else 0 end n_draws from plan""")
def q_search_plan(spark: SparkSession, sf: str) -> DataFrame:
    """M1/M2: what the search does with every matched record."""
    return plan_records(fx_records(spark, sf)).select(
        "notebook", "cell_index", "model_type", "objective", "status", "ignored", "n_draws")


@register("grid_sample_full", _PLAN_SQL + """
 select notebook, cell_index, model_type, setting, draw from (
   select notebook, cell_index, model_type, setting, row_number() over (partition by notebook, cell_index
     order by md5('42|' || notebook || '|' || cell_index || '|' || setting), setting) draw
   from plan join grid on grid.model = plan.model_type where status = 'search')
 where draw <= 20""")
def q_grid_sample_full(spark: SparkSession, sf: str) -> DataFrame:
    """M3: 20 draws from the distinct settings of each searched record."""
    planned = plan_records(fx_records(spark, sf)).filter(F.col("status") == "search").select(
        "notebook", "cell_index", "model_type")
    return sample_grid(planned, distinct_grid(spark)).select(
        "notebook", "cell_index", "model_type", "setting", F.col("draw").cast("bigint").alias("draw"))


@register("original_linear", """
with d as (select l_quantity x, l_extendedprice y,
   ('0x' || substr(md5(cast(l_orderkey as varchar)), 1, 8))::BIGINT % 100 < 20 is_valid from lineitem),
fit as (select regr_slope(y, x) b, regr_intercept(y, x) a from d where not is_valid),
r as (select y, a + b * x p, avg(y) over () m from d, fit where is_valid)
select avg((y - p) * (y - p))::REAL mse, avg(abs(y - p))::REAL mae,
       (1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)))::REAL r2 from r""")
def q_original_linear(spark: SparkSession, sf: str) -> DataFrame:
    """M1 for a recorded LinearRegression: fitted on the hash split, scored on its validation rows."""
    d = read_table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"),
        (md5_bucket(F.col("l_orderkey")) % 100 < 20).alias("is_valid"))
    params, _ = translate("LinearRegression", {}, 1)
    model = make_estimator("LinearRegression", params).fit(assemble(d.filter(~F.col("is_valid")), ["x"], "y"))
    pred = model.transform(assemble(d.filter("is_valid"), ["x"], "y"))
    return regression_metrics(pred, "label", "prediction").select(
        *[F.col(c).cast("float").alias(c) for c in ("mse", "mae", "r2")])


@register("stratified_folds", """
with r as (select l_returnflag, (row_number() over (partition by l_returnflag order by l_orderkey) - 1) % 5 fold
  from lineitem)
select l_returnflag, fold::INT fold, count(*) n_rows from r group by all""")
def q_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """M4: sizes of the folds of rows whose ids (order keys) repeat; no row is lost or doubled."""
    d = read_table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return stratified_folds(d, "l_returnflag", "l_orderkey", 5).groupBy("l_returnflag", "fold").agg(
        F.count("*").alias("n_rows"))
