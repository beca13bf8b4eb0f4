"""Metrics of a notebook from its code and its printed outputs.

Code facts (metric-variable assignments, prints of metrics, training-history
accesses) come from the syntax scan.  For every cell output, every model known
at that cell is matched against its pattern cascade (model/metric/variable-name
patterns, first one that yields a number wins); later cells overwrite earlier
values, then rmse is derived from mse and r2 from r2_test / r2_train.  All of it
is joins, windows and aggregates per notebook; patterns built from columns are
evaluated by ``regexp_extract`` with a per-row pattern.

Deviations kept on purpose: a value text that is not a number is skipped (the
reference stops the whole notebook), and the quoted-accuracy history rule, which
always fails in the reference (undefined name), is not applied.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from ..session import reliable_checkpoint

from ..functions.text import OOB_SCORE, R2_PREFIXES, R2_TEST, R2_TRAIN, RMSE, VALIDATION_ACCURACY
from ..sources.tables import read_table
from .corpus import scan_events
from .registry import r6, register

# The per-model pattern cascades ({m} model name, {v} variable name).
CLASS_PATTERNS = (r"{m}.*?{k}.*?([0-9.]+)", r"{k}.*?{m}.*?([0-9.]+)", r"{v}.*?([0-9.]+)", r"{k}[:\s=]+([0-9.]+)")
RMSE_PATTERNS = (r"{m}.*?rmse.*?([0-9.]+)", r"rmse.*?{m}.*?([0-9.]+)", r"root mean squared error.*?{m}.*?([0-9.]+)",
                 r"{v}.*?([0-9.]+)", r"rmse[:\s=]+([0-9.]+)")
MSE_PATTERNS = (r"{m}.*?mse.*?([0-9.]+)", r"mse.*?{m}.*?([0-9.]+)", r"mean squared error.*?{m}.*?([0-9.]+)",
                r"{v}.*?([0-9.]+)", r"mse[:\s=]+([0-9.]+)")
R2_PATTERNS = (r"{m}.*?r2.*?([0-9.]+)", r"r2.*?{m}.*?([0-9.]+)", r"r squared.*?{m}.*?([0-9.]+)", r"{v}.*?([0-9.]+)",
               r"r2[:\s=]+([0-9.]+)", r"r[^\w]?squared[:\s=]+([0-9.]+)")
TF_PATTERNS = (r"accuracy[:\s=]+([0-9.]+)", r"acc[:\s=]+([0-9.]+)", r"Accuracy[:\s=]+([0-9.]+)",
               r"val[_\s]accuracy[:\s=]+([0-9.]+)", r"val[_\s]Accuracy[:\s=]+([0-9.]+)",
               r"val[_\s]acc[:\s=]+([0-9.]+)", r"accuracy[^:]*:\s*([0-9.]+)", r"Accuracy[^:]*:\s*([0-9.]+)")
HISTORY_PATTERNS = (r"Accuracy:?\s*([0-9.]+)", r"accuracy:?\s*([0-9.]+)", r"acc:?\s*([0-9.]+)")
HISTORY_VAL_PATTERNS = (r"val_Accuracy:?\s*([0-9.]+)", r"val_accuracy:?\s*([0-9.]+)", r"val_acc:?\s*([0-9.]+)")
# Fixed values: (metric, flags that enable it, patterns).
CASCADES = (
    ("accuracy", ("accuracy_calc", "accuracy_in_print"), CLASS_PATTERNS),
    ("precision", ("precision_calc", "precision_in_print"), CLASS_PATTERNS),
    ("recall", ("recall_calc", "recall_in_print"), CLASS_PATTERNS),
    ("f1", ("f1_calc", "f1_in_print"), CLASS_PATTERNS),
    ("rmse", ("rmse_calc", "rmse_in_print"), RMSE_PATTERNS),
    ("mse", ("mse_calc", "mse_in_print", "has_direct_mse"), MSE_PATTERNS),
    ("r2", ("r2_calc", "r2_in_print"), R2_PATTERNS),
)


# Name prefixes of metric variables and of %-format print strings, metrics looked for in a name.
METRIC_VAR_PREFIXES = ("catb", "xgboost", "linear", "lasso", "ridge", "elastic_net", "svr", "knn", "gb", "en")
PRINT_PREFIXES = ("catb", "xgboost", "linear", "lasso", "ridge", "svr", "knn")
ERROR_METRICS, CLASS_METRICS = ("rmse", "mse", "r2"), ("accuracy", "precision", "recall", "f1")


def _first(options) -> Column:
    """The value of the first (condition, value) whose condition holds."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in options])


def metric_facts(events: DataFrame) -> DataFrame:
    """(notebook, cell_index, dfs, model, key, value): the metric rules over the scan's value facts.

    A rule is (condition, model, key, value); all rules of a fact are evaluated in one projection."""
    ev = events.filter((F.col("scan") == "values") & (F.col("kind") != "error"))
    t, low, yes = F.col("name"), F.lower("name"), F.lit("true")
    func, by_name = F.col("func"), F.col("op") == "name"
    key = F.lower("col")
    text = F.lower("line")
    assign, shown, called = (F.col("kind") == k for k in ("assign", "print_text", "print_call"))
    history = assign & (F.col("layer") == "history")
    key_acc, key_val = F.coalesce(key.contains("acc"), F.lit(False)), F.coalesce(key.contains("val_"), F.lit(False))
    scoring = assign & by_name & (func == "cross_val_score") & F.coalesce(
        F.col("args").getItem("scoring").contains("neg_mean_squared_error"), F.lit(False))
    r2 = assign & low.contains("r2")
    r2_model = F.when(t.contains("_"), F.substring_index(t, "_", 1)).otherwise("model")
    prefix = _first([(t.startswith(f"{p}_"), p) for p in METRIC_VAR_PREFIXES])
    plain = [(low.contains(m), m) for m in CLASS_METRICS]
    metric = F.when(prefix.isNotNull(), _first(
        [(t.contains(m), m) for m in ERROR_METRICS] + [(low.contains("mae"), "mae")] + plain)).otherwise(_first(plain))
    model = F.coalesce(prefix, F.lit("model"))
    is_metric = assign & metric.isNotNull()
    assigned = [
        (assign & (F.col("op") == "attr") & (func == "fit"), "tensorflow", "history_var", t),
        (history, "tensorflow", "created", yes),
        (history & key_acc, "tensorflow", F.when(key_val, "val_accuracy_var").otherwise("accuracy_var"), t),
        (history & ~(key_acc & key_val) & low.contains("acc"), "tensorflow",
         F.when(low.contains("val_"), "val_accuracy_var").otherwise("accuracy_var"), t),
        (scoring, "model", "uses_cv_rmse", yes),
        (scoring, "model", "cv_rmse_var", t),
        (r2 & low.contains("_train"), r2_model, "r2_train_var", t),
        (r2 & ~low.contains("_train") & low.contains("_test"), r2_model, "r2_test_var", t),
        (is_metric, model, F.concat(metric, F.lit("_calc")), yes),
        (is_metric, model, "var_name", t),
        (is_metric & (func == "mean_squared_error"), model, "has_direct_mse", yes),
        (is_metric & (func == "sqrt"), model, "uses_sqrt", yes),
        (is_metric & F.array_contains("pos_args", "log"), model, "uses_log", yes),
    ]
    calls = [
        (called & (func == "accuracy_score"), "model", "accuracy_in_print", yes),
        (called & (func == "r2_score"), "model", "r2_in_print", yes),
    ]
    prints = [(shown & (F.col("op") == "const") & text.contains("oob score"), "model", "uses_oob_score", yes)]
    for p in PRINT_PREFIXES:
        on = shown & (F.col("op") == "mod") & text.contains(p)
        prints += [(on, p, "created", yes), (on & text.contains("rmse"), p, "rmse_in_print", yes),
                   (on & text.contains("mse"), p, "mse_in_print", yes),
                   (on & (text.contains("r2") | text.contains("r squared")), p, "r2_in_print", yes)]

    def lit(x) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    # one projection per kind of fact, filtered after the explode: generated code stays small and is used at all
    # (a filter by lambda would evaluate the rules outside of it)
    out = []
    for kind, own in ((assign, assigned), (called, calls), (shown, prints)):
        facts = F.array(*[F.when(c, F.struct(lit(m).alias("model"), lit(k).alias("key"), lit(v).alias("value")))
                          for c, m, k, v in own])
        out.append(ev.filter(kind).select("notebook", "cell_index", "dfs", F.explode(facts).alias("f")).filter(
            F.col("f").isNotNull()).select("notebook", "cell_index", "dfs", "f.model", "f.key", "f.value"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _extract(text: Column, pat: Column) -> Column:
    """Group 1 of the first match as a double; NULL when there is no match (an empty group) or no number."""
    return F.call_function("regexp_extract", text, pat, F.lit(1)).try_cast("double")


def _small(c: Column) -> Column:
    """A-Z lower-cased, as (?i) compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _needed(pattern: str) -> list[str]:
    """What a text must hold to match a cascade's pattern: {m}, {v} and the pattern's plain words."""
    parts = re.split(r"(\{[mv]\})|\.\*\?|\[:\\s=\]\+|\(\[0-9\.\]\+\)", pattern)
    return [x for x in parts if x and (x in ("{m}", "{v}") or x.replace(" ", "").isalnum())]


#: cell numbers of a block of the as-of search for names
NAME_BLOCK = 1 << 16


def _block() -> Column:
    return F.floor(F.col("cell_index") / F.lit(NAME_BLOCK)).cast("long")


def output_values(outputs: DataFrame, facts: DataFrame) -> DataFrame:
    """(notebook, cell_index, sub, model, metric, value) produced by every cell output."""
    t = F.col("text")
    rows = []
    # Free-text rules
    pre_model = lambda kind: F.coalesce(*[F.when(F.lower(t).contains(f"r2_{p}_{kind}"), F.lit(p))
                                         for p in R2_PREFIXES], F.lit("model"))
    x5 = [(0, F.lit("model"), "accuracy", VALIDATION_ACCURACY), (1, F.lit("model"), "oob_score", OOB_SCORE),
          (2, F.lit("model"), "rmse", RMSE), (3, pre_model("train"), "r2_train", R2_TRAIN),
          (4, pre_model("test"), "r2", R2_TEST)]
    for sub, model, metric, pat in x5:
        rows.append(F.struct(F.lit(sub).alias("sub"), model.alias("model"), F.lit(metric).alias("metric"),
                             _extract(t, F.lit(pat)).alias("value")))
    free = outputs.select("notebook", "cell_index", F.explode(F.array(*rows)).alias("r")).select(
        "notebook", "cell_index", "r.*").filter(F.col("value").isNotNull())

    # flags active per (notebook, model): first cell of each key; variable names with their cells
    first = facts.groupBy("notebook", "model", "key").agg(F.min("cell_index").alias("first_cell"))
    flags = first.groupBy("notebook", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "first_cell"))).alias("flags"),  # one model's keys
        F.min("first_cell").alias("born"))
    pairs = outputs.join(flags, "notebook").filter(F.col("born") <= F.col("cell_index"))  # one notebook's models
    on = lambda key: F.coalesce(F.element_at(F.col("flags"), F.lit(key)) <= F.col("cell_index"),
                                F.lit(False))
    # the variable name that is known at an output: the last one of its model up to its cell, as of (notebook, model).
    # It is found within blocks of cell numbers, so no task sorts a whole notebook's outputs; each block begins with
    # the last name of the blocks before it.
    names = facts.filter(F.col("key") == "var_name").select(
        "notebook", "model", "cell_index", "dfs", F.col("value").alias("_name"), F.lit(False).alias("_out"),
        _block().alias("_block"))
    order = ["cell_index", "_out", "dfs", "_name"]
    last = names.groupBy("notebook", "model", "_block").agg(F.max_by("_name", F.struct(*order)).alias("_name"))
    asked = outputs.select("notebook", _block().alias("_block")).distinct().join(
        flags.select("notebook", "model"), "notebook").withColumn("_name", F.lit(None).cast("string"))
    blocks = last.unionByName(asked).groupBy("notebook", "model", "_block").agg(
        F.first("_name", ignorenulls=True).alias("_name"))
    before = (Window.partitionBy("notebook", "model").orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    begun = blocks.withColumn("_name", F.last("_name", ignorenulls=True).over(before)).filter(
        F.col("_name").isNotNull()).withColumn("_out", F.lit(False))
    asof = (Window.partitionBy("notebook", "model", "_block").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = pairs.withColumns({"_out": F.lit(True), "_block": _block()}).unionByName(
        names, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True).withColumn(
        "_var", F.coalesce(F.last("_name", ignorenulls=True).over(asof), F.lit(""))).filter("_out").drop("_block")
    # Rows that build the same pattern sit next to each other, so every regex expression
    # reuses its compiled pattern instead of compiling one per row.
    pairs = pairs.withColumns({"_low": _small(t), "_m": _small(F.col("model")), "_v": _small(F.col("_var"))}
                              ).sortWithinPartitions("model", "_var")
    var = F.col("_var")
    m = F.col("model")
    cas = []
    for j, (metric, keys, pats) in enumerate(CASCADES):
        enabled = F.lit(False)
        for k in keys:
            enabled = enabled | on(k)
        vals = []
        for p in pats:
            parts = p.replace("{m}", "\x00m\x00").replace("{k}", metric).replace("{v}", "\x00v\x00").split("\x00")
            built = F.concat(F.lit("(?i)"), *[m if x == "m" else var if x == "v" else F.lit(x) for x in parts if x])
            holds = [F.col("_low").contains({"{m}": F.col("_m"), "{v}": F.col("_v")}.get(x, F.lit(x)))
                     for x in _needed(p.replace("{k}", metric))]
            vals.append(F.when(reduce(lambda a, b: a & b, holds, F.lit(True)), _extract(t, built)))  # words before the regex
        cas.append(F.struct(F.lit(20 + j).alias("sub"), m.alias("model"), F.lit(metric).alias("metric"),
                            F.when(enabled, F.coalesce(*vals)).alias("value")))
    casc = pairs.select("notebook", "cell_index", F.explode(F.array(*cas)).alias("r")).select(
        "notebook", "cell_index", "r.*").filter(F.col("value").isNotNull())

    # TensorFlow accuracy patterns, once a tensorflow entry exists
    tf = pairs.filter(m == "tensorflow").select(
        "notebook", "cell_index", F.lit(10).alias("sub"), F.lit("tensorflow").alias("model"),
        F.lit("accuracy").alias("metric"), F.coalesce(*[_extract(t, F.lit("(?i)" + p)) for p in TF_PATTERNS])
        .alias("value")).filter(F.col("value").isNotNull())
    return free.unionByName(tf).unionByName(casc)


def model_metrics(outputs: DataFrame, facts: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """X6 + X7: last value per (notebook, model, metric); rmse from mse, r2 from r2_train."""
    v = values if values is not None else output_values(outputs, facts)
    last = v.groupBy("notebook", "model", "metric").agg(F.max_by("value", F.struct("cell_index", "sub")).alias("value"))
    wide = last.groupBy("notebook", "model").pivot(
        "metric", ["accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae", "oob_score", "r2_train"]
    ).agg(F.first("value"))
    wide = wide.withColumn("rmse", F.coalesce("rmse", F.sqrt("mse"))).withColumn("r2", F.coalesce("r2", "r2_train"))
    metrics = ["accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae", "oob_score", "r2_train"]
    return wide.select("notebook", "model", F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("r")).select(
        "notebook", "model", "r.metric", "r.value").filter(F.col("value").isNotNull())


def history_accuracy(cells: DataFrame) -> DataFrame:
    """Per notebook, the last accuracy printed by cells that read a training history
    (val_ values only when there is no plain one)."""
    h = cells.filter(F.col("source").contains("history.history"))

    def found(patterns, is_val):
        arr = F.array(*[F.struct(F.lit(i).alias("p"), F.regexp_extract_all("text", F.lit("(?i)" + p), 1).alias("xs"))
                        for i, p in enumerate(patterns)])
        e = h.select("notebook", "cell_index", F.explode(arr).alias("e")).select(
            "notebook", "cell_index", "e.p", F.posexplode("e.xs").alias("k", "x"))
        return e.select("notebook", "cell_index", "p", "k", F.col("x").try_cast("double").alias("v"),
                        F.lit(is_val).alias("is_val")).filter(F.col("v").isNotNull())

    allv = found(HISTORY_PATTERNS, False).unionByName(found(HISTORY_VAL_PATTERNS, True))
    order = F.struct("cell_index", "p", "k")
    g = allv.groupBy("notebook").agg(
        F.max_by("v", F.when(~F.col("is_val"), order)).alias("acc"),
        F.max_by("v", F.when(F.col("is_val"), order)).alias("val_acc"))
    return g.select("notebook", F.coalesce("acc", "val_acc").alias("accuracy"))


# ----------------------------------------------------------------------------- fixture and queries

# The code line of each generated cell, chosen by event_id % 7.
METRIC_CELLS = (
    "svr_rmse = np.sqrt(mean_squared_error(y, p))",
    "knn_accuracy = accuracy_score(y, p)",
    'print(f"Accuracy: {accuracy_score(y, p)}")',
    'print("ridge r2: %.3f" % score)',
    "r2_test = r2_score(y, p)",
    "acc = history.history['accuracy']",
    "gb_mse = mean_squared_error(y, p)",
)


def fx_cells_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with code and printed output from ``events``: notebook = user, order = event."""
    e = read_table(spark, sf, "events")
    k = F.col("event_id") % 7
    v = F.col("value").cast("decimal(12,2)")
    v1 = v.cast("string")
    v2 = (v * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(12,4)").cast("string")
    v3 = (v * F.lit(0.0005).cast("decimal(5,4)")).cast("decimal(12,4)").cast("string")
    src = F.element_at(F.array(*[F.lit(c) for c in METRIC_CELLS]), (k + 1).cast("int"))
    text = (F.when(k == 0, F.concat(F.lit("svr rmse: "), v1))
            .when(k == 1, F.concat(F.lit("knn_accuracy = "), v2))
            .when(k == 2, F.concat(F.lit("Accuracy: "), v2))
            .when(k == 3, F.concat(F.lit("ridge r2: "), v2))
            .when(k == 4, F.concat(F.lit("R2 Test Score: "), v2))
            .when(k == 5, F.concat(F.lit("loss: "), v1, F.lit(" - accuracy: "), v2, F.lit(" - val_accuracy: "), v3))
            .otherwise(F.concat(F.lit("mse = "), v1)))
    return e.select(F.concat(F.lit("mx"), F.col("user_id").cast("string"), F.lit(".ipynb")).alias("notebook"),
                    F.col("event_id").alias("cell_index"), src.alias("source"), text.alias("text"))


def fx_cells_metrics_sql() -> str:
    cells = ", ".join("'" + c.replace("'", "''") + "'" for c in METRIC_CELLS)
    v1 = "cast(cast(value as decimal(12,2)) as varchar)"
    v2 = "cast(cast(cast(value as decimal(12,2)) * 0.001 as decimal(12,4)) as varchar)"
    v3 = "cast(cast(cast(value as decimal(12,2)) * 0.0005 as decimal(12,4)) as varchar)"
    return f"""
cm as (select 'mx' || cast(user_id as varchar) || '.ipynb' notebook, event_id cell_index, event_id % 7 kind,
  [{cells}][event_id % 7 + 1] source,
  case event_id % 7 when 0 then 'svr rmse: ' || {v1} when 1 then 'knn_accuracy = ' || {v2}
    when 2 then 'Accuracy: ' || {v2} when 3 then 'ridge r2: ' || {v2} when 4 then 'R2 Test Score: ' || {v2}
    when 5 then 'loss: ' || {v1} || ' - accuracy: ' || {v2} || ' - val_accuracy: ' || {v3}
    else 'mse = ' || {v1} end text
  from events)
"""


# facts per kind, as the scan reports them: (kind, model, key, value or NULL for the variable name)
KIND_FACTS = (
    (0, "svr", "rmse_calc", "true"), (0, "svr", "var_name", "svr_rmse"), (0, "svr", "uses_sqrt", "true"),
    (1, "knn", "accuracy_calc", "true"), (1, "knn", "var_name", "knn_accuracy"),
    (2, "model", "accuracy_in_print", "true"),
    (3, "ridge", "created", "true"), (3, "ridge", "r2_in_print", "true"),
    (4, "r2", "r2_test_var", "r2_test"),
    (5, "tensorflow", "created", "true"), (5, "tensorflow", "accuracy_var", "acc"),
    (5, "tensorflow", "accuracy_var", "acc"),
    (6, "gb", "mse_calc", "true"), (6, "gb", "var_name", "gb_mse"), (6, "gb", "has_direct_mse", "true"),
)


def _kind_facts_sql() -> str:
    rows = ", ".join(f"({k}, '{m}', '{key}', '{v}')" for k, m, key, v in KIND_FACTS)
    return f"kf(kind, model, key, value) as (values {rows})"


@register("metric_vars", "with " + fx_cells_metrics_sql() + ", " + _kind_facts_sql() + """
 select notebook, cell_index, model, key, value from cm join kf using (kind)""")
def q_metric_vars(spark: SparkSession, sf: str) -> DataFrame:
    """Metric-variable, history and print facts of every cell."""
    f = metric_facts(scan_events(fx_cells_metrics(spark, sf), ("values",)))
    return f.select("notebook", "cell_index", "model", "key", "value")


def _hist_sql() -> str:
    def arr(pats):
        return ", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in pats)
    return "with " + fx_cells_metrics_sql() + f""",
 h as (select * from cm where contains(source, 'history.history')),
 a as (select notebook, cell_index, p, k, try_cast(x as double) v from (
         select notebook, cell_index, unnest(range(3)) p, unnest([{arr(HISTORY_PATTERNS)}]) xs from h) t,
         unnest(xs) with ordinality u(x, k)),
 b as (select notebook, cell_index, p, k, try_cast(x as double) v from (
         select notebook, cell_index, unnest(range(3)) p, unnest([{arr(HISTORY_VAL_PATTERNS)}]) xs from h) t,
         unnest(xs) with ordinality u(x, k)),
 la as (select notebook, arg_max(v, cell_index * 1000000 + p * 1000 + k) acc from a where v is not null group by all),
 lb as (select notebook, arg_max(v, cell_index * 1000000 + p * 1000 + k) val_acc from b where v is not null
        group by all)
 select notebook, round(coalesce(acc, val_acc), 6) accuracy from la full join lb using (notebook)"""


@register("history_accuracy", _hist_sql())
def q_history_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = history_accuracy(fx_cells_metrics(spark, sf))
    return out.select("notebook", r6(F.col("accuracy")).alias("accuracy"))


METRIC_KEYS = ("accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae", "oob_score", "r2_train")


def _output_metrics_sql() -> str:
    def ext(pat_sql):
        return f"case when regexp_matches(text, {pat_sql}) then try_cast(regexp_extract(text, {pat_sql}, 1) as double) end"

    def q(x):
        return "'" + x.replace("'", "''") + "'"

    flag_keys = sorted({k for _, keys, _ in CASCADES for k in keys})
    fcols = ", ".join(f"min(case when key = '{k}' then fc end) \"fc_{k}\"" for k in flag_keys)
    x5 = [(0, "'model'", "accuracy", VALIDATION_ACCURACY), (1, "'model'", "oob_score", OOB_SCORE),
          (2, "'model'", "rmse", RMSE), (3, None, "r2_train", R2_TRAIN), (4, None, "r2", R2_TEST)]
    free = []
    for sub, model, metric, pat in x5:
        if model is None:
            kind = "train" if metric == "r2_train" else "test"
            model = "case " + " ".join(f"when contains(lower(text), 'r2_{p}_{kind}') then '{p}'" for p in R2_PREFIXES) \
                + " else 'model' end"
        free.append(f"select notebook, cell_index, {sub} sub, {model} model, '{metric}' metric, {ext(q(pat))} value "
                    "from cm")
    casc = []
    for j, (metric, keys, pats) in enumerate(CASCADES):
        enabled = " or ".join(f"coalesce(\"fc_{k}\" <= cell_index, false)" for k in keys)
        vals = []
        for p in pats:
            parts = p.replace("{m}", "\x00m\x00").replace("{k}", metric).replace("{v}", "\x00v\x00").split("\x00")
            built = " || ".join(["'(?i)'"] + ["model" if x == "m" else "var" if x == "v" else q(x) for x in parts if x])
            vals.append(ext(built))
        casc.append(f"select notebook, cell_index, {20 + j} sub, model, '{metric}' metric, "
                    f"case when {enabled} then coalesce({', '.join(vals)}) end value from pv")
    tf = ("select notebook, cell_index, 10 sub, 'tensorflow' model, 'accuracy' metric, coalesce("
          + ", ".join(ext(q("(?i)" + p)) for p in TF_PATTERNS) + ") value from pv where model = 'tensorflow'")
    piv = ", ".join(f"max(case when metric = '{k}' then v end) \"{k}\"" for k in METRIC_KEYS)
    unp = " union all ".join(
        f"select notebook, model, '{k}' metric, " + (
            'coalesce("rmse", sqrt("mse"))' if k == "rmse" else 'coalesce("r2", "r2_train")' if k == "r2" else f'"{k}"')
        + " value from w" for k in METRIC_KEYS)
    return "with " + fx_cells_metrics_sql() + ", " + _kind_facts_sql() + f""",
 facts as (select notebook, cell_index, model, key, value from cm join kf using (kind)),
 fst as (select notebook, model, key, min(cell_index) fc from facts group by all),
 fl as (select notebook, model, min(fc) born, {fcols} from fst group by all),
 vn as (select notebook, model, cell_index, value from facts where key = 'var_name'),
 pairs as (select cm.notebook, cm.cell_index, cm.text, fl.* exclude (notebook) from cm join fl
           on cm.notebook = fl.notebook and fl.born <= cm.cell_index),
 pv as (select p.*, coalesce((select value from vn where vn.notebook = p.notebook and vn.model = p.model
           and vn.cell_index <= p.cell_index order by vn.cell_index desc limit 1), '') var from pairs p),
 vals as ({' union all '.join(free + [tf] + casc)}),
 lastv as (select notebook, model, metric, arg_max(value, cell_index * 100 + sub) v from vals
           where value is not null group by all),
 w as (select notebook, model, {piv} from lastv group by all),
 u as ({unp})
 select notebook, model, metric, round(value, 6) value from u where value is not null"""


@register("output_metrics", _output_metrics_sql())
def q_output_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per notebook and model, the last metric values its cell outputs report."""
    cells = fx_cells_metrics(spark, sf)
    facts = reliable_checkpoint(metric_facts(scan_events(cells, ("values",))))  # read by several branches
    out = model_metrics(cells.select("notebook", "cell_index", "text"), facts)
    return out.select("notebook", "model", "metric", r6(F.col("value")).alias("value"))


def notebook_metrics(outputs: DataFrame, facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Notebook result: history accuracy, TensorFlow accuracy, then the best model by the output
    rule (K2: f1 else accuracy highest; regression: lowest of mse, rmse, mae, -r2); ties keep the
    model that appeared first."""
    vals = reliable_checkpoint(output_values(outputs, facts))  # read twice below
    mm = model_metrics(outputs, facts, vals)
    wide = mm.groupBy("notebook", "model").pivot("metric", list(METRIC_KEYS)).agg(F.first("value"))
    # first appearance: code facts of a cell come before the values its output creates
    seen_f = facts.groupBy("notebook", "model").agg(F.min(F.struct("cell_index", F.lit(0).alias("ph"),
                                                                    "dfs")).alias("seen"))
    seen_v = vals.groupBy("notebook", "model").agg(F.min(F.struct("cell_index", F.lit(1).alias("ph"),
                                                                   F.col("sub").alias("dfs"))).alias("seen"))
    seen = seen_f.unionByName(seen_v).groupBy("notebook", "model").agg(F.min("seen").alias("seen"))
    w = wide.join(seen, ["notebook", "model"], "left")
    cls = w.groupBy("notebook").agg(F.max((F.col("accuracy").isNotNull() | F.col("f1").isNotNull()).cast("int"))
                                    .alias("_cls"))
    w = w.join(cls, "notebook")
    score = F.when(F.col("_cls") == 1, F.coalesce("f1", "accuracy")).otherwise(
        -F.coalesce("mse", "rmse", "mae", -F.col("r2")))
    key = F.struct(F.col("_score"), F.struct(-F.col("seen.cell_index"), -F.col("seen.ph"), -F.col("seen.dfs")))
    best = (w.withColumn("_score", score).filter(F.col("_score").isNotNull())
            .groupBy("notebook").agg(F.max_by(F.struct("model", *METRIC_KEYS[:8]), key).alias("b")))
    tf = mm.filter((F.col("model") == "tensorflow") & (F.col("metric") == "accuracy")).select(
        "notebook", F.col("value").alias("_tfacc"))
    hist = history_accuracy(cells)
    nbs = cells.select("notebook").distinct()
    j = nbs.join(hist, "notebook", "left").join(tf, "notebook", "left").join(best, "notebook", "left")
    out = [F.coalesce(F.col("b.accuracy"), F.col("_tfacc"), F.col("accuracy")).alias("accuracy")]
    out += [F.col(f"b.{k}").alias(k) for k in ("precision", "recall", "f1", "mse", "rmse", "r2", "mae")]
    return j.select("notebook", F.coalesce(F.col("b.model"), F.lit("tensorflow")).alias("best_model"), *out)


def _notebook_metrics_sql() -> str:
    base = _output_metrics_sql()
    head, tail = base.split(" select notebook, model, metric, round(value, 6) value from u where value is not null")
    hist = _hist_sql().split("with " + fx_cells_metrics_sql() + ",", 1)[1]
    hist_ctes, hist_sel = hist.rsplit(" select notebook, round(coalesce(acc, val_acc), 6) accuracy", 1)
    piv = ", ".join(f"max(case when metric = '{k}' then value end) \"{k}\"" for k in METRIC_KEYS)
    keys8 = ", ".join(f'"{k}"' for k in METRIC_KEYS[:8])
    return head + f""",
 um as (select * from u where value is not null),
 wm as (select notebook, model, {piv} from um group by all),
 sf as (select notebook, model, min(cell_index * 100000) s from facts group by all),
 sv as (select notebook, model, min(cell_index * 100000 + 50000 + sub) s from vals where value is not null group by all),
 seen as (select notebook, model, min(s) s from (select * from sf union all select * from sv) group by all),
 cls as (select notebook, bool_or(accuracy is not null or f1 is not null) c from wm group by all),
 sc as (select wm.*, seen.s, case when cls.c then coalesce(f1, accuracy) else -coalesce(mse, rmse, mae, -r2) end score
        from wm join cls using (notebook) left join seen using (notebook, model)),
 best as (select * from (select *, row_number() over (partition by notebook order by score desc, s) rk from sc
          where score is not null) where rk = 1),
 tfa as (select notebook, value tfacc from um where model = 'tensorflow' and metric = 'accuracy'),
 {hist_ctes.strip().lstrip(',').strip()},
 ha as (select notebook, coalesce(acc, val_acc) hacc from la full join lb using (notebook)),
 nbs as (select distinct notebook from cm)
 select nbs.notebook, coalesce(best.model, 'tensorflow') best_model,
   round(coalesce(best.accuracy, tfacc, hacc), 6) accuracy, round(best."precision", 6) "precision",
   round(best.recall, 6) recall, round(best.f1, 6) f1, round(best.mse, 6) mse, round(best.rmse, 6) rmse,
   round(best.r2, 6) r2, round(best.mae, 6) mae
 from nbs left join ha using (notebook) left join tfa using (notebook) left join best using (notebook)"""


@register("notebook_metrics", _notebook_metrics_sql())
def q_notebook_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metric record of every notebook from its code and outputs (history, TensorFlow, best model)."""
    cells = fx_cells_metrics(spark, sf)
    facts = reliable_checkpoint(metric_facts(scan_events(cells, ("values",))))  # read by several branches
    out = notebook_metrics(cells.select("notebook", "cell_index", "text"), facts, cells)
    return out.select("notebook", "best_model", *[r6(F.col(k)).alias(k) for k in
                                                  ("accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae")])
