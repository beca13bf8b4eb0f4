"""Metric-log parsing and metric-name canonicalisation (X3, X4) as Column expressions.

A log line ``METRIC_LOG: <name> = <value>`` may hold several entries.  Parsing is
``regexp_extract_all`` + ``posexplode``; values go through ``try_cast`` so a text
such as ``0.9.1`` or ``nan`` becomes NULL instead of failing the run.

Canonicalisation rules, applied in this order to every entry:

1. ``<model>_<metric>`` splits at the last underscore when the suffix is one of
   the eight metric names; otherwise the model is ``model``.
2. names containing mean_squared_error / mean_absolute_error / r2_score /
   accuracy_score / precision_score / recall_score / f1_score give mse (plus
   rmse = sqrt), mae, r2, accuracy, precision, recall, f1.
3. ``tf_*`` names with acc/accuracy and without ``val_`` give the accuracy of
   model ``tensorflow``.
4. other names containing ``_score`` give, for the model named by the text before
   ``_score``, accuracy when the name says accuracy, else r2; these never feed
   the run-level fallback.
5. bare metric names give that metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The log marker pattern and the metric vocabulary.
LOG_PATTERN = r"METRIC_LOG: ([^=]+) = ([^(\n]+)"
METRICS = ("accuracy", "precision", "recall", "f1", "mse", "rmse", "r2", "mae")
NAME_RULES = (
    ("mean_squared_error", "mse"),
    ("mean_absolute_error", "mae"),
    ("r2_score", "r2"),
    ("accuracy_score", "accuracy"),
    ("precision_score", "precision"),
    ("recall_score", "recall"),
    ("f1_score", "f1"),
)
SPLIT_PATTERN = r"^([a-zA-Z0-9_]+)_([a-zA-Z0-9_]+)"


def parse_metric_log(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("run_id", "line_no")) -> DataFrame:
    """(keys..., pos, name, value_text, value): one row per ``METRIC_LOG`` entry."""
    t = F.col(text)
    names = F.regexp_extract_all(t, F.lit(LOG_PATTERN), 1)
    vals = F.regexp_extract_all(t, F.lit(LOG_PATTERN), 2)
    z = df.select(*keys, F.posexplode(F.arrays_zip(names.alias("n"), vals.alias("v"))).alias("pos", "e"))
    vt = F.trim(F.col("e.v"))
    return z.select(*keys, "pos", F.trim(F.col("e.n")).alias("name"), vt.alias("value_text"),
                    F.expr("try_cast(trim(e.v) as double)").alias("value"))


def canonical_entries(parsed: DataFrame, keys: tuple[str, ...] = ("run_id", "line_no")) -> DataFrame:
    """Canonical rows (keys..., pos, sub, model, metric, value, is_global, tf_hit).

    Every entry also emits an insertion row (metric NULL) for the split model name so
    the order in which models first appear is kept (``sub`` orders rows of one entry).
    Unparseable values produce no rows.  The name split and the rule flags are
    materialised as columns first, so each regex runs once per entry.
    """
    name = F.col("name")
    split = parsed.select(*keys, "pos", "name", "value",
                          F.regexp_extract(name, SPLIT_PATTERN, 1).alias("_pm"),
                          F.regexp_extract(name, SPLIT_PATTERN, 2).alias("_pmt"))
    is_split = F.col("_pmt").isin(*METRICS)
    named = split.select(*keys, "pos", "value",
                         F.when(is_split, F.col("_pm")).otherwise(F.lit("model")).alias("model0"),
                         F.when(is_split, F.col("_pmt")).otherwise(name).alias("m"))
    m = F.col("m")
    sk_metric = F.lit(None).cast("string")
    for needle, metric in reversed(NAME_RULES):
        sk_metric = F.when(m.contains(needle), F.lit(metric)).otherwise(sk_metric)
    tf_rest = F.substring(m, 4, 1 << 30)
    flags = named.select(
        *keys, "pos", "value", "model0", "m", sk_metric.alias("sk"),
        (m.startswith("tf_") & (tf_rest.contains("accuracy") | tf_rest.contains("acc"))
         & ~tf_rest.contains("val_")).alias("_tfacc"),
        m.startswith("tf_").alias("_tf"), m.contains("_score").alias("_sc"),
        F.substring_index(m, "_score", 1).alias("score_model"),
        F.when(m.contains("accuracy"), F.lit("accuracy")).otherwise(F.lit("r2")).alias("score_metric"),
        m.isin(*METRICS).alias("_bare"))
    v, sk = F.col("value"), F.col("sk")
    rule = sk.isNotNull()
    is_tf = ~rule & F.col("_tf")
    tf_acc = is_tf & F.col("_tfacc")
    is_score = ~rule & ~F.col("_tf") & F.col("_sc")
    is_bare = ~rule & ~F.col("_tf") & ~F.col("_sc") & F.col("_bare")

    def row(sub, model, metric, value, is_global, tf_hit=False):
        return F.struct(F.lit(sub).alias("sub"), model.alias("model"), metric.alias("metric"),
                        value.alias("value"), F.lit(is_global).alias("is_global"), F.lit(tf_hit).alias("tf_hit"))

    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    cand = [
        row(0, F.col("model0"), none_s, none_d, False),  # insertion of the split model name
        F.when(rule, row(1, F.col("model0"), sk, v, True)),
        F.when(rule & (sk == "mse"), row(2, F.col("model0"), F.lit("rmse"), F.sqrt(v), True)),
        F.when(tf_acc, row(1, F.lit("tensorflow"), F.lit("accuracy"), v, True, True)),
        F.when(is_score, row(1, F.col("score_model"), F.col("score_metric"), v, False)),
        F.when(is_bare, row(1, F.col("model0"), m, v, True)),
    ]
    arr = F.filter(F.array(*cand), lambda e: e.isNotNull())
    out = flags.filter(v.isNotNull()).select(*keys, "pos", F.explode(arr).alias("e"))
    return out.select(*keys, "pos", "e.sub", "e.model", "e.metric", "e.value", "e.is_global", "e.tf_hit")


def safe_value_name(value_text: Column) -> Column:
    """Candidate value text -> file-name-safe token (drop brackets and blanks, comma -> _)."""
    return F.translate(value_text, ",[] ", "_")


def trial_id(stem: Column, method: Column, param: Column, value_text: Column) -> Column:
    return F.concat_ws("_", stem, F.lit("modified"), method, param, safe_value_name(value_text))
