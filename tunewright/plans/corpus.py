"""Pipeline-corpus jobs: cells -> events -> calls, lineage, usage table, models (C1-C11,
J1-J4, J10, W1, W2, P5-P7, P9, G9, S3, S5).

Only ``scan_events`` runs Python (the syntax walk inside ``mapInPandas``); every
rule after it is a join, window or aggregate.  Windows are partitioned by
notebook (or notebook and column), so one task holds at most one notebook's
events, which the notebook file itself bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from ..session import reliable_checkpoint

from ..functions.codescan import EVENT_SCHEMA, MAGIC_COMMANDS, scan_cells
from ..sources.cells import fx_cells, fx_cells_sql
from .catalog import catalog_rows, catalog_sql
from .registry import register

# Call categories.
FEATURE_SELECTION = ("SelectKBest", "VarianceThreshold", "SelectFromModel", "RFE", "drop", "dropna")
FEATURE_ENGINEERING = (
    "SimpleImputer", "PolynomialFeatures", "StandardScaler", "MinMaxScaler", "RobustScaler", "Normalizer",
    "OneHotEncoder", "LabelEncoder", "OrdinalEncoder", "ColumnTransformer", "fillna", "replace", "map",
    "get_dummies",
)
LINEAGE_KINDS = ("Feature Addition", "Feature Engineering", "Feature Selection")

# Default-parameter text per method. The pandas methods and LabelEncoder
# are given by hand; the estimator rows are the constructor signatures of
# scikit-learn 1.3 rendered as name=default.
METHOD_DEFAULTS = (
    ("fillna", "value=None, method=None, axis=None, inplace=False, limit=None, downcast=None"),
    ("drop", "labels=None, axis=0, index=None, columns=None, level=None, inplace=False, errors='raise'"),
    ("dropna", "axis=0, how='any', thresh=None, subset=None, inplace=False"),
    ("replace", "to_replace=None, value=None, inplace=False, limit=None, regex=False, method='pad'"),
    ("map", "arg, na_action=None"),
    ("get_dummies", "data, prefix=None, prefix_sep='_', dummy_na=False, columns=None, sparse=False, "
                    "drop_first=False, dtype=None"),
    ("LabelEncoder", "No parameters required for initialization"),
    ("StandardScaler", "copy=True, with_mean=True, with_std=True"),
    ("MinMaxScaler", "feature_range=(0, 1), copy=True, clip=False"),
    ("RobustScaler", "with_centering=True, with_scaling=True, quantile_range=(25.0, 75.0), copy=True, "
                     "unit_variance=False"),
    ("Normalizer", "norm=l2, copy=True"),
    ("OneHotEncoder", "categories=auto, drop=None, sparse_output=True, dtype=<class 'numpy.float64'>, "
                      "handle_unknown=error, min_frequency=None, max_categories=None, feature_name_combiner=concat"),
    ("OrdinalEncoder", "categories=auto, dtype=<class 'numpy.float64'>, handle_unknown=error, unknown_value=None, "
                       "encoded_missing_value=nan, min_frequency=None, max_categories=None"),
    ("PolynomialFeatures", "degree=2, interaction_only=False, include_bias=True, order=C"),
    ("SimpleImputer", "missing_values=nan, strategy=mean, fill_value=None, copy=True, add_indicator=False, "
                      "keep_empty_features=False"),
    ("SelectKBest", "score_func=<function f_classif>, k=10"),
    ("VarianceThreshold", "threshold=0.0"),
    ("SelectFromModel", "estimator=No Default, threshold=None, prefit=False, norm_order=1, max_features=None, "
                        "importance_getter=auto"),
    ("RFE", "estimator=No Default, n_features_to_select=None, step=1, verbose=0, importance_getter=auto"),
)

# Model constructors, layer and scoring names of the model scan.
MODEL_KEYWORDS = (
    "RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression", "SVC", "RandomForestRegressor",
    "GradientBoostingRegressor", "LinearRegression", "SVR", "Sequential", "XGBClassifier", "KNeighborsClassifier",
    "LGBMClassifier", "LazyClassifier",
)
SCORING_KEYWORDS = (
    "score", "evaluate", "accuracy_score", "f1_score", "roc_auc_score", "log_loss", "mean_squared_error",
    "mean_absolute_error", "r2_score", "precision_score", "recall_score", "cross_val_score",
    "balanced_accuracy_score", "classification_report",
)
# Markers of test-data lines, and names of binary operators in lineage details.
TEST_MARKERS = ("test_data", "X_test")
OP_NAMES = (("Add", "Addition"), ("Sub", "Subtraction"), ("Mult", "Multiplication"), ("Div", "Division"))


def scan_events(cells: DataFrame, scans: tuple[str, ...] = ("calls", "models", "values")) -> DataFrame:
    """One Python pass over (notebook, cell_index, source), dealt by cell, so that a large
    notebook's cells are parsed by many tasks.  ``scans`` names the facts wanted: a job that reads metrics only
    needs no call or model scan.

    The events are checkpointed (reliably, to the shared checkpoint folder): every
    rule after this reads them without re-running Python, and an executor loss does not
    repeat the scan.  Only the small event rows are shuffled by notebook.
    """
    # An explicit count: AQE would otherwise coalesce this small-in-bytes but
    # Python-heavy input into very few tasks.
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = F.coalesce("source", F.lit(""))
    texts = {"calls": clean_magics(F.btrim(source, F.lit(" \t\r\n"))), "models": blank_shell(source), "values": source}
    dealt = cells.select("notebook", "cell_index", *[texts[s].alias(s) for s in scans]).repartition(
        n, "notebook", "cell_index")
    # Ship the scan code with the task: executors need not have this package installed.
    from pyspark import cloudpickle

    from ..functions import codescan
    cloudpickle.register_pickle_by_value(codescan)
    return reliable_checkpoint(dealt.mapInPandas(scan_cells, EVENT_SCHEMA))


def is_test_line(line: Column) -> Column:
    cond = F.lit(False)
    for m in TEST_MARKERS:
        cond = cond | F.coalesce(line.contains(m), F.lit(False))
    return cond


def category(func: Column) -> Column:
    return (F.when(func.isin(*FEATURE_SELECTION), "Feature Selection")
            .when(func.isin(*FEATURE_ENGINEERING), "Feature Engineering")
            .when(func.isin(*LINEAGE_KINDS), func).otherwise("Other"))


def column_list(text: Column) -> Column:
    """X10: "['a', 'b']" -> [a, b]."""
    parts = F.split(F.translate(text, "[]'", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def lineage(events: DataFrame) -> DataFrame:
    """(notebook, cell_index, phase, seq, sub, col, kind, outcome, detail, line)."""
    ev = events.filter((F.col("scan") == "calls") & ~is_test_line(F.col("line")))
    assigns = ev.filter(F.col("kind") == "assign_col").select(
        "notebook", "cell_index", F.lit(1).alias("phase"), F.col("bfs").alias("seq"), F.lit(0).alias("sub"),
        "col", F.lit("assign").alias("kind"), "op", "line")
    drops = ev.filter((F.col("kind") == "call") & (F.col("func") == "drop"))
    cols = F.when(F.col("args").getItem("columns").isNotNull(), column_list(F.col("args").getItem("columns"))) \
        .when(F.col("first_const").isNotNull(), F.array(F.col("first_const"))) \
        .otherwise(F.array().cast("array<string>"))
    axis_ok = F.coalesce(F.col("args").getItem("axis"), F.lit("1")) == "1"
    drops = drops.filter(axis_ok).select(
        "notebook", "cell_index", F.lit(0).alias("phase"), F.col("bfs").alias("seq"),
        F.posexplode(cols).alias("sub", "col"), F.lit("drop").alias("kind"), F.lit(None).cast("string").alias("op"),
        "line").select("notebook", "cell_index", "phase", "seq", (F.col("sub") + 1).alias("sub"), "col", "kind",
                       "op", "line")
    u = assigns.unionByName(drops)
    # Assigns of a cell are walked before its calls: phase 1 sorts before 0 only in
    # this order key, so use (cell_index, assign-first, seq).
    w = Window.partitionBy("notebook", "col").orderBy("cell_index", F.col("phase").desc(), "seq", "sub")
    known = F.coalesce(F.lag("kind").over(w) == "assign", F.lit(False))
    op_name = F.col("op")
    for a, b in OP_NAMES:
        op_name = F.when(F.col("op") == a, F.lit(b)).otherwise(op_name)
    q = F.concat(F.lit("'"), F.col("col"), F.lit("'"))
    outcome = (F.when((F.col("kind") == "assign") & ~F.col("_known"), "Feature Addition")
               .when(F.col("kind") == "assign", "Feature Engineering")
               .when(F.col("_known"), "Feature Selection"))
    detail = (F.when((F.col("kind") == "assign") & ~F.col("_known") & F.col("op").isNotNull(),
                     F.concat(F.lit("Create column "), q, F.lit(" by "), op_name))
              .when((F.col("kind") == "assign") & ~F.col("_known"), F.concat(F.lit("Create column "), q))
              .when(F.col("kind") == "assign", F.concat(F.lit("Modify column "), q))
              .when(F.col("_known"), F.concat(F.lit("Drop column "), q)))
    return (u.withColumn("_known", known)
            .select("notebook", "cell_index", "phase", "seq", "sub", "col", "kind", outcome.alias("outcome"),
                    detail.alias("detail"), "line"))


def usage_table(events: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """G9 + J1 + J2 + P7: the 7-column usage table plus order and detail columns."""
    spark = events.sparkSession
    calls = events.filter((F.col("scan") == "calls") & (F.col("kind") == "call") & ~is_test_line(F.col("line")))
    call_rows = calls.select(
        "notebook", "cell_index", F.lit(0).alias("part"), F.col("bfs").alias("seq"), F.lit(0).alias("sub"),
        F.col("func").alias("function"), "args", F.lit(None).cast("string").alias("detail"), "line")
    lin = lineage(events).filter(F.col("outcome").isNotNull())
    fs_rows = lin.filter(F.col("kind") == "drop").select(
        "notebook", "cell_index", F.lit(0).alias("part"), "seq", "sub", F.lit("Feature Selection").alias("function"),
        F.create_map(F.lit("action"), F.col("detail")).alias("args"), "detail", "line")
    add_rows = lin.filter(F.col("kind") == "assign").select(
        "notebook", "cell_index", F.lit(1).alias("part"), "seq", "sub", F.col("outcome").alias("function"),
        F.lit(None).cast("map<string,string>").alias("args"), "detail", "line")
    rows = call_rows.unionByName(fs_rows).unionByName(add_rows)
    rows = rows.withColumn("category", category(F.col("function")))
    rows = rows.filter((F.col("category") != "Other") & (F.col("function") != "print"))
    if defaults is None:
        defaults = spark.createDataFrame(list(METHOD_DEFAULTS), "function string, all_defaults string")
    has_args = F.coalesce(F.size(F.col("args")) > 0, F.lit(False))
    action = F.col("args").getItem("action")
    custom = F.when(has_args, F.array_join(F.transform(F.map_entries(F.col("args")),
                                                       lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "))
    j = rows.join(F.broadcast(defaults), "function", "left")  # fixed table of 19 rows
    all_params = (F.when(F.col("function").isin(*LINEAGE_KINDS), F.lit("N/A"))
                  .otherwise(F.coalesce(F.col("all_defaults"), F.lit(""))))
    return j.select(
        "notebook", "cell_index", "part", "seq", "sub", "category",
        F.coalesce(action, F.col("function")).alias("function"),
        F.when(has_args, "No").otherwise("Yes").alias("uses_default"),
        F.coalesce(custom, F.lit("")).alias("custom_params"), all_params.alias("all_params"),
        F.col("line").alias("original_code"), "detail")


def _cell_pos(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("notebook", "cell_index").orderBy("part", "seq", "sub")
    return df.withColumn("pos", F.row_number().over(w).cast("bigint"))


def literal_asof(events: DataFrame) -> DataFrame:
    """Every name reference in a model constructor resolved to the latest literal before it."""
    ev = events.filter(F.col("scan") == "models")
    lits = ev.filter(F.col("kind") == "literal").select(
        "notebook", "name", "cell_index", "dfs", F.lit(0).alias("is_ref"),
        F.col("args").getItem("value").alias("lit"), F.lit(None).cast("string").alias("param"))
    models = ev.filter((F.col("kind") == "call") & F.col("func").isin(*MODEL_KEYWORDS))
    refs = models.select("notebook", "cell_index", "dfs", F.explode("arg_kinds").alias("param", "k"),
                         F.col("args")).filter(F.col("k") == "name").select(
        "notebook", F.col("args")[F.col("param")].alias("name"), "cell_index", "dfs", F.lit(1).alias("is_ref"),
        F.lit(None).cast("string").alias("lit"), "param")
    u = lits.unionByName(refs)
    w = (Window.partitionBy("notebook", "name").orderBy("cell_index", "dfs", "is_ref")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    res = u.withColumn("resolved", F.last("lit", ignorenulls=True).over(w)).filter(F.col("is_ref") == 1)
    return res.select("notebook", "cell_index", "dfs", "param", "name",
                      F.coalesce(F.col("resolved"), F.concat(F.lit('"'), F.col("name"), F.lit('"'))).alias("value"))


def model_records(events: DataFrame) -> DataFrame:
    """C5-C8 + J10: one row per model constructor with resolved kwargs and scoring method."""
    ev = events.filter((F.col("scan") == "models") & (F.col("kind") == "call"))
    models = ev.filter(F.col("func").isin(*MODEL_KEYWORDS)).select(
        "notebook", "cell_index", "dfs", F.col("func").alias("model_type"), "target", "args", "arg_kinds",
        "pos_args", "first_const")
    resolved = literal_asof(events).groupBy("notebook", "cell_index", "dfs").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("_res"))  # per model: its few kwargs
    m = models.join(resolved, ["notebook", "cell_index", "dfs"], "left")
    kwargs = F.map_zip_with(F.col("args"), F.coalesce(F.col("_res"), F.create_map().cast("map<string,string>")),
                            lambda k, a, r: F.coalesce(r, a))
    # `.add(layer)` and `.compile(...)` attach to the current (latest) model of the notebook
    attach = ev.filter((F.col("op") == "attr") & (
        (F.col("func") == "add") & F.col("layer").isNotNull() | (F.col("func") == "compile"))).select(
        "notebook", "cell_index", "dfs", F.lit(1).alias("is_ev"), "func", "layer",
        F.col("args").alias("cargs"), F.lit(None).cast("long").alias("mid_c"), F.lit(None).cast("int").alias("mid_d"),
        F.lit(None).cast("string").alias("mtype"))
    cur = models.select("notebook", "cell_index", "dfs", F.lit(0).alias("is_ev"), F.lit(None).cast("string")
                        .alias("func"), F.lit(None).cast("string").alias("layer"),
                        F.lit(None).cast("map<string,string>").alias("cargs"), F.col("cell_index").alias("mid_c"),
                        F.col("dfs").alias("mid_d"), F.col("model_type").alias("mtype"))
    wn0 = (Window.partitionBy("notebook").orderBy("cell_index", "dfs", "is_ev")  # one notebook
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    att = (cur.unionByName(attach)
           .withColumn("m_c", F.last("mid_c", ignorenulls=True).over(wn0))
           .withColumn("m_d", F.last("mid_d", ignorenulls=True).over(wn0))
           .withColumn("m_t", F.last("mtype", ignorenulls=True).over(wn0))
           .filter((F.col("is_ev") == 1) & F.col("m_c").isNotNull()))
    order = F.struct("cell_index", "dfs")
    layers = (att.filter((F.col("func") == "add") & (F.col("m_t") == "Sequential"))
              .groupBy(F.col("notebook"), F.col("m_c").alias("cell_index"), F.col("m_d").alias("dfs"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "layer"))),
                                            lambda e: e["layer"]), ", ").alias("_layers")))  # one model's layers
    comp = (att.filter(F.col("func") == "compile")
            .groupBy(F.col("notebook"), F.col("m_c").alias("cell_index"), F.col("m_d").alias("dfs"))
            .agg(F.max_by(F.map_filter("cargs", lambda k, v: k.isin("optimizer", "metrics")), order).alias("_comp")))
    m = m.join(layers, ["notebook", "cell_index", "dfs"], "left").join(comp, ["notebook", "cell_index", "dfs"], "left")
    kwargs = F.map_concat(F.map_filter(kwargs, lambda k, v: ~k.isin("optimizer", "metrics") | F.col("_comp").isNull()),
                          F.coalesce(F.col("_comp"), F.create_map().cast("map<string,string>")))
    base_list = F.regexp_replace(F.regexp_replace(F.col("first_const"), r"^\[", ""), r"\]$", "")
    seq_args = F.concat(F.lit("["), F.concat_ws(", ", F.when(base_list != "", base_list), F.col("_layers")),
                        F.lit("]"))
    args = F.when((F.col("model_type") == "Sequential") & (F.col("first_const").isNotNull() | F.col("_layers")
                                                           .isNotNull()),
                  F.to_json(F.array(seq_args))).otherwise(F.to_json("pos_args"))
    models = m.select("notebook", "cell_index", "dfs", "model_type", "target", kwargs.alias("kwargs"),
                      args.alias("args_json"))
    # model of var.score(...): latest model assigned to that variable (as-of by variable)
    attr_scores = ev.filter((F.col("func") == "score") & (F.col("op") == "attr") & F.col("name").isNotNull()).select(
        "notebook", F.col("name").alias("target"), "cell_index", "dfs", F.lit(1).alias("is_ev"),
        F.lit(None).cast("long").alias("mid_c"), F.lit(None).cast("int").alias("mid_d"))
    tagged = models.select("notebook", "target", "cell_index", "dfs", F.lit(0).alias("is_ev"),
                           F.col("cell_index").alias("mid_c"), F.col("dfs").alias("mid_d"))
    wv = (Window.partitionBy("notebook", "target").orderBy("cell_index", "dfs", "is_ev")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit_attr = (tagged.filter(F.col("target").isNotNull()).unionByName(attr_scores)
                .withColumn("m_c", F.last("mid_c", ignorenulls=True).over(wv))
                .withColumn("m_d", F.last("mid_d", ignorenulls=True).over(wv))
                .filter((F.col("is_ev") == 1) & F.col("m_c").isNotNull())
                .select("notebook", F.col("m_c").alias("cell_index"), F.col("m_d").alias("dfs"))
                .distinct().withColumn("attr_score", F.lit("score")))
    # bare scoring call: current (latest) model of the notebook, first such call wins
    bare = ev.filter((F.col("op") == "name") & F.col("func").isin(*SCORING_KEYWORDS)).select(
        "notebook", "cell_index", "dfs", F.lit(1).alias("is_ev"), F.col("func").alias("fn"),
        F.lit(None).cast("long").alias("mid_c"), F.lit(None).cast("int").alias("mid_d"))
    allm = models.select("notebook", "cell_index", "dfs", F.lit(0).alias("is_ev"), F.lit(None).cast("string")
                         .alias("fn"), F.col("cell_index").alias("mid_c"), F.col("dfs").alias("mid_d"))
    wn = (Window.partitionBy("notebook").orderBy("cell_index", "dfs", "is_ev")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit_bare = (allm.unionByName(bare)
                .withColumn("m_c", F.last("mid_c", ignorenulls=True).over(wn))
                .withColumn("m_d", F.last("mid_d", ignorenulls=True).over(wn))
                .filter((F.col("is_ev") == 1) & F.col("m_c").isNotNull())
                .groupBy(F.col("notebook"), F.col("m_c").alias("cell_index"), F.col("m_d").alias("dfs"))
                .agg(F.min_by("fn", F.struct("cell_index", "dfs")).alias("bare_score")))
    out = (models.join(hit_attr, ["notebook", "cell_index", "dfs"], "left")
           .join(hit_bare, ["notebook", "cell_index", "dfs"], "left"))
    return out.select("notebook", "cell_index", "dfs", "model_type", "target", "kwargs", "args_json",
                      F.coalesce("attr_score", "bare_score").alias("score"))


def modifiable_params(usage: DataFrame, catalog: DataFrame, match: str = "substring") -> DataFrame:
    """P9 + J3: (usage row, catalog parameter) pairs a sweep may change, usage x catalog order."""
    u = usage.filter(~F.col("function").isin("drop", "dropna")
                     & ~F.col("function").startswith("Drop column '")
                     & ~F.col("function").startswith("Create column '"))
    params = catalog.filter(F.col("has_values") & ~F.col("no_params")).select(
        F.col("method").alias("function"), "param", "param_ord").distinct()
    j = u.join(F.broadcast(params), "function")  # the catalog is a fixed, bounded table
    if match == "substring":
        already = F.col("custom_params").contains(F.col("param"))
    else:
        already = F.col("custom_params").rlike(F.concat(F.lit("(^|, )"), F.col("param"), F.lit("=")))
    return j.filter(~already).select("notebook", "cell_index", "part", "seq", "sub",
                                     F.col("function").alias("method"), "param", "param_ord")


def clean_magics(source: Column) -> Column:
    """P5 (call scan form): drop lines starting with one of the magic commands."""
    lines = F.split(F.trim(source), "\n")
    keep = F.filter(lines, lambda ln: ~F.exists(F.array(*[F.lit(m) for m in MAGIC_COMMANDS]),
                                                lambda m: F.ltrim(ln).startswith(m)))
    return F.array_join(keep, "\n")


def blank_shell(source: Column) -> Column:
    """P5 (model scan form): blank every line that starts with ! or %."""
    return F.regexp_replace(source, r"(?m)^[ \t]*[!%].*", "")


# ----------------------------------------------------------------------------- queries


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return scan_events(fx_cells(spark, sf))


CALLS_SQL = fx_cells_sql() + """,
ok as (select * from cells where variant <> 7),
call_ev as (
  select notebook, cell_index, 0 k, 'drop' func, 'columns=[''' || p_brand || ''']' custom_params from ok where is_drop
  union all select notebook, cell_index, 1,
    case variant when 1 then 'LogisticRegression' when 2 then 'score' when 3 then 'accuracy_score'
      when 4 then 'StandardScaler' when 5 then 'fillna' end,
    case variant when 1 then 'C=n' when 4 then 'with_mean=False' when 5 then 'value=0' else '' end
  from ok where variant in (1, 2, 3, 4, 5)),
lin_ev as (select notebook, cell_index, p_brand col, case when is_drop then 'drop' else 'assign' end kind,
    coalesce(lag(not is_drop) over (partition by notebook, p_brand order by cell_index), false) known,
    case when is_drop then 'df = df.drop(columns=["' || p_brand || '"])'
         else 'df["' || p_brand || '"] = df["a"] + ' || cast(p_size as varchar) end line
  from ok)
"""


@register("code_calls", "with " + CALLS_SQL + """
 select notebook, cell_index, row_number() over (partition by notebook, cell_index order by k) call_pos, func,
   custom_params from call_ev""")
def q_code_calls(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf).filter((F.col("scan") == "calls") & (F.col("kind") == "call")
                                   & ~is_test_line(F.col("line")))
    w = Window.partitionBy("notebook", "cell_index").orderBy("bfs")
    custom = F.array_join(F.transform(F.map_entries("args"), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                          ", ")
    return ev.select("notebook", "cell_index", F.row_number().over(w).cast("bigint").alias("call_pos"), "func",
                     custom.alias("custom_params"))


@register("lineage", "with " + CALLS_SQL + """
 select notebook, cell_index, col, kind,
   case when kind = 'assign' and not known then 'Feature Addition' when kind = 'assign' then 'Feature Engineering'
        when known then 'Feature Selection' end outcome,
   case when kind = 'assign' and not known then 'Create column ''' || col || ''' by Addition'
        when kind = 'assign' then 'Modify column ''' || col || ''''
        when known then 'Drop column ''' || col || '''' end detail
 from lin_ev""")
def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return lineage(_events(spark, sf)).select("notebook", "cell_index", "col", "kind", "outcome", "detail")


def _defaults_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(f, d.replace("'", "''")) for f, d in METHOD_DEFAULTS)
    return f"defaults(function, all_defaults) as (values {rows})"


USAGE_SQL = "with " + CALLS_SQL + ", " + _defaults_sql() + """,
 u as (
  select notebook, cell_index, 0 part, 0 k, 'Feature Selection' category, 'drop' function, 'No' uses_default,
    custom_params, 'df = df.drop(columns=["' || substr(custom_params, 11, length(custom_params) - 12) || '"])' line
    from call_ev where func = 'drop'
  union all select notebook, cell_index, 0, 1, 'Feature Selection', 'Drop column ''' || col || '''', 'No',
    'action=Drop column ''' || col || '''', line from lin_ev where kind = 'drop' and known
  union all select notebook, cell_index, 0, 2, 'Feature Engineering', func, 'No', custom_params,
    case func when 'StandardScaler' then 'StandardScaler(with_mean=False)' else 'df.fillna(value=0)' end
    from call_ev where func in ('StandardScaler', 'fillna')
  union all select notebook, cell_index, 1, 3, case when known then 'Feature Engineering' else 'Feature Addition' end,
    case when known then 'Feature Engineering' else 'Feature Addition' end, 'Yes', '', line
    from lin_ev where kind = 'assign')
"""


@register("usage_table", USAGE_SQL + """
 select notebook, cell_index, row_number() over (partition by notebook, cell_index order by part, k) pos,
   category, u.function, uses_default, custom_params,
   case when category in ('Feature Addition', 'Feature Engineering', 'Feature Selection')
         and (u.function in ('Feature Addition', 'Feature Engineering') or u.function like 'Drop column%') then 'N/A'
        else coalesce(all_defaults, '') end all_params, line original_code
 from u left join defaults d on u.function = d.function""")
def q_usage_table(spark: SparkSession, sf: str) -> DataFrame:
    u = _cell_pos(usage_table(_events(spark, sf)))
    return u.select("notebook", "cell_index", "pos", "category", "function", "uses_default", "custom_params",
                    "all_params", "original_code")


@register("usage_summary", USAGE_SQL + """
 select category, function, uses_default, count(*) n_calls, count(distinct notebook) n_notebooks
 from u group by all""")
def q_usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus roll-up of the usage table: calls and notebooks per function."""
    u = usage_table(_events(spark, sf))
    return u.groupBy("category", "function", "uses_default").agg(
        F.count(F.lit(1)).alias("n_calls"), F.countDistinct("notebook").alias("n_notebooks"))


MODELS_SQL = fx_cells_sql() + """,
ok as (select * from cells where variant <> 7),
m as (select notebook, cell_index,
   (select p_size from ok l where l.notebook = ok.notebook and l.variant = 0 and l.cell_index < ok.cell_index
    order by l.cell_index desc limit 1) c_lit,
   coalesce((select min(cell_index) from ok n where n.notebook = ok.notebook and n.variant = 1
             and n.cell_index > ok.cell_index), 9223372036854775807) next_m
  from ok where variant = 1),
s as (select m.*,
   exists (select 1 from ok e where e.notebook = m.notebook and e.variant = 2 and e.cell_index > m.cell_index
           and e.cell_index < m.next_m) has_attr,
   exists (select 1 from ok e where e.notebook = m.notebook and e.variant = 3 and e.cell_index > m.cell_index
           and e.cell_index < m.next_m) has_bare
  from m)
"""


@register("literal_asof", "with " + MODELS_SQL + """
 select notebook, cell_index, 'C' param, 'n' "name", coalesce(cast(c_lit as varchar), '"n"') value from s""")
def q_literal_asof(spark: SparkSession, sf: str) -> DataFrame:
    return literal_asof(_events(spark, sf)).select("notebook", "cell_index", "param", "name", "value")


@register("model_records", "with " + MODELS_SQL + """
 select notebook, cell_index, 'LogisticRegression' model_type, 'm' target,
   '{"C":' || coalesce(cast(c_lit as varchar), '"n"') || '}' kwargs_json,
   case when has_attr then 'score' when has_bare then 'accuracy_score' end score from s""")
def q_model_records(spark: SparkSession, sf: str) -> DataFrame:
    """S4 shape: one record per model; kwargs are JSON values keyed by parameter."""
    m = model_records(_events(spark, sf))
    kw = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("kwargs"), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return m.select("notebook", "cell_index", "model_type", "target", kw.alias("kwargs_json"), "score")


@register("parse_errors", "with " + fx_cells_sql() + """
 select notebook, cell_index, scan, 'SyntaxError' error_kind from cells, (values ('calls'), ('models')) t(scan)
 where variant = 7""")
def q_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    """C11: a cell that does not parse becomes an error row instead of stopping the job."""
    ev = _events(spark, sf).filter((F.col("kind") == "error") & F.col("scan").isin("calls", "models"))
    return ev.select("notebook", "cell_index", "scan", F.split("error", ":").getItem(0).alias("error_kind"))


@register("clean_cells", "with " + fx_cells_sql() + r"""
 select notebook, cell_index,
   array_to_string(list_filter(string_split(trim(source), chr(10)), lambda l: not starts_with(ltrim(l), '%matplotlib')),
     chr(10)) clean_source,
   regexp_replace(source, '(^|\n)[ \t]*[!%][^\n]*', '\1', 'g') blank_source
 from cells""")
def q_clean_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = fx_cells(spark, sf)
    return c.select("notebook", "cell_index", clean_magics(F.col("source")).alias("clean_source"),
                    blank_shell(F.col("source")).alias("blank_source"))


@register("modifiable_params", USAGE_SQL + ", " + catalog_sql() + """,
 uu as (select notebook, cell_index, part, k, u.function, custom_params from u),
 pc as (select distinct method, param, param_ord from catalog where has_values and not no_params)
 select notebook, cell_index, uu.function method, param, param_ord from uu join pc on uu.function = pc.method
 where uu.function not in ('drop', 'dropna') and not starts_with(uu.function, 'Drop column ''')
   and not starts_with(uu.function, 'Create column ''') and not contains(custom_params, param)""")
def q_modifiable_params(spark: SparkSession, sf: str) -> DataFrame:
    u = usage_table(_events(spark, sf))
    out = modifiable_params(u, catalog_rows(spark))
    return out.select("notebook", "cell_index", "method", "param", "param_ord")


# ----------------------------------------------------------------------------- A8, A9, X11

from ..operators.pipeline import override_param, params_text  # noqa: E402
from ..sources.cells import fx_cells_io, fx_cells_io_sql  # noqa: E402

# Patterns of table loading, the four-way split and a model assignment.
READ_CSV = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[A-Za-z_][A-Za-z0-9_.]*\.read_csv\(\s*['\"]([^'\"]*)['\"]"
ASSIGNED = r"(?m)^([A-Za-z_][A-Za-z0-9_]*)\s*=[^=]"
SPLIT4 = r"([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+)\s*=\s*train_test_split"
MODEL_ASSIGN = r"([A-Za-z0-9_]+)\s*=\s*[A-Za-z]+\("
# Model-name fragments that mark a model cell, and evaluation calls.
ROLE_MODEL_WORDS = ("LinearRegression", "RandomForest", "XGBRegressor", "DecisionTree")
ROLE_EVAL_WORDS = ("mean_squared_error", "r2_score", "accuracy_score")
# Fallback table names.
COMMON_TRAIN = ("train", "df_train", "train_df", "X_train")
COMMON_TEST = ("test", "df_test", "test_df", "X_test")


def discover_tables(cells: DataFrame, fallback: bool = False) -> DataFrame:
    """Per notebook the last read_csv target whose name says train (else test), with its path.

    With ``fallback`` a notebook where either is missing takes, for both, the first of the usual names that a loading
    cell assigns (path only where read_csv gave it), and else keeps what was found; every notebook with a loading cell
    has a row."""
    src = F.col("source")
    names = F.regexp_extract_all(src, F.lit(READ_CSV), 1)
    paths = F.regexp_extract_all(src, F.lit(READ_CSV), 2)
    load = F.transform(F.arrays_zip(names.alias("n"), paths.alias("p")), lambda e, i: F.struct(
        i.alias("pos"), e["n"].alias("n"), e["p"].alias("p"), F.lit(True).alias("read")))
    facts = load
    if fallback:
        facts = F.concat(load, F.transform(F.regexp_extract_all(src, F.lit(ASSIGNED), 1), lambda n: F.struct(
            F.lit(-1).alias("pos"), n.alias("n"), F.lit(None).cast("string").alias("p"), F.lit(False).alias("read"))))
    ev = cells.filter(src.contains("read_csv")).select(
        "notebook", "cell_index", (F.explode_outer if fallback else F.explode)(facts).alias("e"))
    low = F.lower(F.col("e.n"))
    role = F.when(F.col("e.read"), F.when(low.contains("train"), "train").when(low.contains("test"), "test"))
    ev = ev.withColumn("role", role).withColumn("order", F.struct("cell_index", "e.pos"))
    if not fallback:
        ev = ev.filter(F.col("role").isNotNull())

    def last(value: str, cond: Column) -> Column:
        return F.max_by(F.col(value), F.when(cond, F.col("order")))

    found = [last(f"e.{f}", F.col("role") == r).alias(f"{r}_{out}")
             for r in ("train", "test") for f, out in (("n", "var"), ("p", "path"))]
    if not fallback:
        return ev.groupBy("notebook").agg(*found)
    usual = {"train": COMMON_TRAIN, "test": COMMON_TEST}
    g = ev.groupBy("notebook").agg(
        *found,
        *[F.max(F.col("e.n") == n).alias(f"has_{n}") for r in usual for n in usual[r]],
        *[last("e.p", F.col("e.read") & (F.col("e.n") == n)).alias(f"path_{n}") for r in usual for n in usual[r]])
    missing = F.col("train_var").isNull() | F.col("test_var").isNull()
    out = []
    for r, common in usual.items():
        name, path = F.col(f"{r}_var"), F.col(f"{r}_path")
        for n in reversed(common):
            here = missing & F.coalesce(F.col(f"has_{n}"), F.lit(False))
            name, path = F.when(here, n).otherwise(name), F.when(here, F.col(f"path_{n}")).otherwise(path)
        out += [name.alias(f"{r}_var"), path.alias(f"{r}_path")]
    return g.select("notebook", *out)


def split_roles(cells: DataFrame) -> DataFrame:
    """Per notebook the X/y train/test names, the model variable, its fit cell and evaluation cell."""
    src = F.col("source")
    has_model = F.lit(False)
    for w in ROLE_MODEL_WORDS:
        has_model = has_model | src.contains(w)
    c = cells.select(
        "notebook", "cell_index", "source",
        F.when(src.contains("train_test_split") & src.rlike(SPLIT4),
               F.array(*[F.regexp_extract(src, SPLIT4, i) for i in (1, 2, 3, 4)])).alias("split"),
        F.when(src.rlike(MODEL_ASSIGN) & has_model, F.regexp_extract(src, MODEL_ASSIGN, 1)).alias("model_set"))
    w = (Window.partitionBy("notebook").orderBy("cell_index")  # one notebook's cells
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = c.withColumn("model", F.last("model_set", ignorenulls=True).over(w))
    evals = F.lit(False)
    for e in ROLE_EVAL_WORDS:
        evals = evals | src.contains(e)
    fit = F.col("model").isNotNull() & F.expr("instr(source, concat(model, '.fit')) > 0")
    return c.groupBy("notebook").agg(
        F.max_by("split", F.when(F.col("split").isNotNull(), F.col("cell_index"))).alias("split"),
        F.max_by("model_set", F.when(F.col("model_set").isNotNull(), F.col("cell_index"))).alias("model"),
        F.max(F.when(fit, F.col("cell_index"))).alias("model_fit_cell"),
        F.max(F.when(F.col("model").isNotNull() & evals, F.col("cell_index"))).alias("evaluation_cell"),
    ).select("notebook", F.col("split")[0].alias("x_train"), F.col("split")[1].alias("x_test"),
             F.col("split")[2].alias("y_train"), F.col("split")[3].alias("y_test"), "model", "model_fit_cell",
             "evaluation_cell")


@register("discover_tables", "with " + fx_cells_io_sql() + r""",
 ev as (select notebook, cell_index, regexp_extract(source, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=', 1) n,
          regexp_extract(source, 'read_csv\(\s*[''"]([^''"]*)[''"]', 1) p from cio where contains(source, 'read_csv')),
 r as (select *, case when contains(lower(n), 'train') then 'train' when contains(lower(n), 'test') then 'test' end
         role from ev)
 select notebook, arg_max(n, case when role = 'train' then cell_index end) train_var,
   arg_max(p, case when role = 'train' then cell_index end) train_path,
   arg_max(n, case when role = 'test' then cell_index end) test_var,
   arg_max(p, case when role = 'test' then cell_index end) test_path
 from r where role is not null group by notebook""")
def q_discover_tables(spark: SparkSession, sf: str) -> DataFrame:
    return discover_tables(fx_cells_io(spark, sf))


@register("split_roles", "with " + fx_cells_io_sql() + r""",
 c as (select notebook, cell_index, source,
   case when regexp_matches(source, '([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+)\s*=\s*train_test_split')
        then regexp_extract(source, '([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+),\s*([A-Za-z0-9_]+)\s*=\s*train_test_split', ['a','b','c','d']) end sp,
   case when regexp_matches(source, '([A-Za-z0-9_]+)\s*=\s*[A-Za-z]+\(')
         and (contains(source, 'LinearRegression') or contains(source, 'RandomForest')
              or contains(source, 'XGBRegressor') or contains(source, 'DecisionTree'))
        then regexp_extract(source, '([A-Za-z0-9_]+)\s*=\s*[A-Za-z]+\(', 1) end model_set from cio),
 m as (select *, last_value(model_set ignore nulls) over (partition by notebook order by cell_index
         rows between unbounded preceding and current row) model from c)
 select notebook, arg_max(sp.a, case when sp is not null then cell_index end) x_train,
   arg_max(sp.b, case when sp is not null then cell_index end) x_test,
   arg_max(sp.c, case when sp is not null then cell_index end) y_train,
   arg_max(sp.d, case when sp is not null then cell_index end) y_test,
   arg_max(model_set, case when model_set is not null then cell_index end) model,
   max(case when model is not null and contains(source, model || '.fit') then cell_index end) model_fit_cell,
   max(case when model is not null and (contains(source, 'mean_squared_error') or contains(source, 'r2_score')
            or contains(source, 'accuracy_score')) then cell_index end) evaluation_cell
 from m group by notebook""")
def q_split_roles(spark: SparkSession, sf: str) -> DataFrame:
    return split_roles(fx_cells_io(spark, sf))


@register("spec_override", "with " + CALLS_SQL + """
 select notebook, cell_index, func, case func when 'StandardScaler' then 'with_mean=False, with_std=False'
   when 'fillna' then 'value=1' when 'LogisticRegression' then 'C=n, with_std=False' else 'with_std=False' end params
 from call_ev where func <> 'drop'""")
def q_spec_override(spark: SparkSession, sf: str) -> DataFrame:
    """X11: set with_std=False on every recorded call spec (fillna: value=1), replacing or appending."""
    ev = _events(spark, sf).filter((F.col("scan") == "calls") & (F.col("kind") == "call")
                                   & ~is_test_line(F.col("line")) & (F.col("func") != "drop"))
    p = F.when(F.col("func") == "fillna", override_param(F.col("args"), "value", "1")) \
        .otherwise(override_param(F.col("args"), "with_std", "False"))
    return ev.select("notebook", "cell_index", "func", params_text(p).alias("params"))


from ..sources.cells import FX_CELLS_NN_SQL, fx_cells_nn  # noqa: E402


@register("model_layers", "with " + FX_CELLS_NN_SQL + """,
 m as (select notebook, cell_index, p_size,
         coalesce(lead(cell_index) over (partition by notebook order by cell_index), 9223372036854775807) nxt
       from cnn where kind = 0),
 a as (select m.notebook, m.cell_index, string_agg(case when c.kind = 1 then 'Dense(' || cast(c.p_size % 7 + 1 as varchar)
         || ')' else 'Dropout(0.5)' end, ', ' order by c.cell_index) layers
       from m join cnn c on c.notebook = m.notebook and c.cell_index > m.cell_index and c.cell_index < m.nxt
       where c.kind in (1, 4) group by all),
 k as (select distinct m.notebook, m.cell_index from m join cnn c on c.notebook = m.notebook
       and c.cell_index > m.cell_index and c.cell_index < m.nxt where c.kind = 2)
 select m.notebook, m.cell_index, 'Sequential' model_type,
   '["[' || concat_ws(', ', 'Dense(' || cast(m.p_size as varchar) || ', activation=''relu'')', a.layers) || ']"]'
     args_json,
   case when k.cell_index is not null then '{"optimizer":"adam","metrics":["accuracy"]}' else '{}' end kwargs_json
 from m left join a using (notebook, cell_index) left join k using (notebook, cell_index)""")
def q_model_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential models with their list and .add() layers, and compile settings."""
    m = model_records(scan_events(fx_cells_nn(spark, sf)))
    kw = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("kwargs"), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return m.select("notebook", "cell_index", "model_type", "args_json", kw.alias("kwargs_json"))
