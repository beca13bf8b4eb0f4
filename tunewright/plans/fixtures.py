"""Deterministic inputs derived from the driver tables (see FIXTURES.md).

Each builder returns a DataFrame computed by Spark from the given parquet tables,
so its size grows with the scale factor.  The ``*_SQL`` strings are the DuckDB
twins used by the oracle; they compute the same rows from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def md5_bucket(c) -> F.Column:
    """First 32 bits of md5(text) as a non-negative integer; DuckDB has the same."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-type train/test table: ids, 3 numeric, 3 categorical, target, split flag."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    return j.select(
        k.alias("id"),
        F.col("o_totalprice").alias("f1"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("f2"),
        F.col("c_nationkey").cast("double").alias("f3"),
        F.col("o_orderpriority").alias("c1"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("c2"),
        F.col("c_name").alias("c3"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
        (md5_bucket(k) % 100 < 20).alias("is_test"),
    )


FX_SQL = """
fx as (
  select o_orderkey id, o_totalprice f1,
         case when o_orderkey % 7 = 0 then null else c_acctbal end f2,
         cast(c_nationkey as double) f3,
         o_orderpriority c1,
         case when o_orderkey % 11 = 0 then null else c_mktsegment end c2,
         c_name c3,
         case when o_orderstatus = 'F' then 1 else 0 end target,
         ('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::BIGINT % 100 < 20 is_test
  from orders join customer on o_custkey = c_custkey),
train as (select * from fx where not is_test),
test as (select * from fx where is_test)
"""


def fx_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = fx(spark, sf_dir)
    return d.filter(~F.col("is_test")), d.filter(F.col("is_test"))


def fx_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rows with gaps: order ``event_id``, partition ``user_id``."""
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", "user_id",
        F.when(i % 5 >= 2, F.col("value")).alias("v1"),
        F.when(i % 3 != 0, F.col("event_type")).alias("v2"),
    )


FX_FRAME_SQL = """
fxf as (
  select event_id, user_id,
         case when event_id % 5 < 2 then null else value end v1,
         case when event_id % 3 = 0 then null else event_type end v2
  from events)
"""


def fx_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class numeric table (label ``l_returnflag``) with a constant column ``k``."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("l_returnflag").alias("label"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(1.0).alias("k"))


FX_NUM_SQL = """
fxn as (
  select l_orderkey, cast(l_linenumber as bigint) l_linenumber, l_returnflag label,
         l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE k
  from lineitem)
"""


def fx_pred_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    return j.select(
        "doc_id", "lang",
        F.col("quality").cast("int").alias("y_true"),
        F.when(F.col("n_chars") % 3 > 0, 1).otherwise(0).alias("y_pred"))


FX_PRED_CLASS_SQL = """
fxc as (
  select doc_id, lang, cast(quality as integer) y_true,
         case when n_chars % 3 > 0 then 1 else 0 end y_pred
  from documents join labels using (doc_id))
"""


def fx_pred_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "event_type",
        F.col("value").alias("y_true"),
        (F.col("value") * 0.9 + F.col("user_id") % 5).alias("y_pred"))


FX_PRED_REG_SQL = """
fxr as (
  select event_id, event_type, value y_true, value * 0.9 + user_id % 5 y_pred
  from events)
"""


# Metric-name mapping of the synthetic log lines (FIXTURES.md fx_log).
LOG_NAME_BY_EVENT = (
    ("click", "accuracy_score"),
    ("view", "mean_squared_error"),
    ("purchase", "svr_r2"),
    ("signup", "knn_mae"),
)
LOG_NAME_OTHER = "tf_acc"


# Events whose log lines carry a regression metric.
REGRESSION_EVENTS = ("view", "purchase", "signup")


def fx_log(spark: SparkSession, sf_dir: str, by_task: bool = False) -> DataFrame:
    """Metric-log lines ``METRIC_LOG: <name> = <value>`` per run (``user_id``; ``by_task``: a user's regression and
    other lines are two runs, 2 * user_id and 2 * user_id + 1)."""
    e = read_table(spark, sf_dir, "events")
    run = F.col("user_id")
    if by_task:
        run = run * 2 + F.when(F.col("event_type").isin(*REGRESSION_EVENTS), 0).otherwise(1)
    name = F.lit(LOG_NAME_OTHER)
    for ev, nm in reversed(LOG_NAME_BY_EVENT):
        name = F.when(F.col("event_type") == ev, F.lit(nm)).otherwise(name)
    return e.select(
        run.alias("run_id"),
        F.col("event_id").alias("line_no"),
        F.col("ts"),
        F.concat(F.lit("METRIC_LOG: "), name, F.lit(" = "),
                 F.col("value").cast("decimal(12,2)").cast("string")).alias("text"),
    )


def fx_log_sql(by_task: bool = False) -> str:
    cases = " ".join(f"when '{ev}' then '{nm}'" for ev, nm in LOG_NAME_BY_EVENT)
    run = f"user_id * 2 + case when event_type in {REGRESSION_EVENTS!r} then 0 else 1 end" if by_task else "user_id"
    return f"""
fxl as (
  select {run} run_id, event_id line_no, ts,
         concat('METRIC_LOG: ', case event_type {cases} else '{LOG_NAME_OTHER}' end,
                ' = ', cast(cast(value as decimal(12,2)) as varchar)) text
  from events)
"""


def fx_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial results: one row per (method, parameter, value) with nullable metrics."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("method"),
        (F.col("p_size") % 4).cast("string").alias("parameter"),
        k.cast("string").alias("value"),
        k.alias("ord"),
        F.when(k % 13 != 0, F.col("p_retailprice") / 1000).alias("mse"),
        F.when(F.col("p_size") % 2 == 0, (k % 97) / 97.0).alias("accuracy"),
    )


FX_TRIALS_SQL = """
fxt as (
  select p_brand method, cast(p_size % 4 as varchar) parameter, cast(p_partkey as varchar) value,
         p_partkey ord,
         case when p_partkey % 13 = 0 then null else p_retailprice / 1000 end mse,
         case when p_size % 2 = 0 then (p_partkey % 97) / 97.0 end accuracy
  from part)
"""


# Extra entries appended to every log line by event_id % 8, covering each
# canonicalisation rule and two unparseable values.
LOG_EXTRA = (
    "tf_val_accuracy",
    "model_score",
    "rf_accuracy_score",
    "xgb_f1",
    "lr_mean_squared_error",
    "svr_mae",
    "bad_value",
    "nan_value",
)


def fx_log_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_log with a second entry per line (newline or blank separated) for every rule."""
    base = fx_log(spark, sf_dir)
    k = F.col("line_no") % 8
    name = F.element_at(F.array(*[F.lit(n) for n in LOG_EXTRA]), (k + 1).cast("int"))
    value = (F.when(k == 6, F.lit("0.9.1")).when(k == 7, F.lit("nan"))
             .otherwise((F.col("line_no") % 97 / 100.0).cast("decimal(6,2)").cast("string")))
    sep = F.when(k == 3, F.lit(" ")).otherwise(F.lit("\n"))
    text = F.concat(F.col("text"), sep, F.lit("METRIC_LOG: "), name, F.lit(" = "), value)
    return base.select("run_id", "line_no", "ts", text.alias("text"))


def fx_log_rich_sql() -> str:
    names = ", ".join(f"'{n}'" for n in LOG_EXTRA)
    return fx_log_sql() + f""",
fxlr as (
  select run_id, line_no, ts,
         text || case when line_no % 8 = 3 then ' ' else chr(10) end || 'METRIC_LOG: '
           || [{names}][line_no % 8 + 1] || ' = '
           || case when line_no % 8 = 6 then '0.9.1' when line_no % 8 = 7 then 'nan'
                   else cast(cast(line_no % 97 / 100.0 as decimal(6,2)) as varchar) end text
  from fxl)
"""


def fx_log_rich_columns(events: DataFrame) -> DataFrame:
    """fx_log_rich computed from an events DataFrame (batch or stream)."""
    name = F.lit(LOG_NAME_OTHER)
    for ev, nm in reversed(LOG_NAME_BY_EVENT):
        name = F.when(F.col("event_type") == ev, F.lit(nm)).otherwise(name)
    base = F.concat(F.lit("METRIC_LOG: "), name, F.lit(" = "), F.col("value").cast("decimal(12,2)").cast("string"))
    k = F.col("event_id") % 8
    extra = F.element_at(F.array(*[F.lit(n) for n in LOG_EXTRA]), (k + 1).cast("int"))
    value = (F.when(k == 6, F.lit("0.9.1")).when(k == 7, F.lit("nan"))
             .otherwise((F.col("event_id") % 97 / 100.0).cast("decimal(6,2)").cast("string")))
    sep = F.when(k == 3, F.lit(" ")).otherwise(F.lit("\n"))
    text = F.concat(base, sep, F.lit("METRIC_LOG: "), extra, F.lit(" = "), value)
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), "ts",
                         text.alias("text"))
