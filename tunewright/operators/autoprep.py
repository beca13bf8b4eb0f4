"""Automatic preparation (A1-A4, A7): scaler choice, encoding choice, hash split.

``best_scaler`` ranks standard / minmax / robust by the population variance of
all scaled cells (NULLs filled with the column mean first).  Every scaler is an
affine map per column, so that variance comes in closed form from one aggregate
(mean, variance, min, max, non-null count) and the robust quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import categorical_columns, col, find_target, numeric_columns
from .base import replace_columns
from .encode import dense_codes, first_seen_codes, join_codes, sparse_onehot
from .scale import MinMaxScaler, RobustScaler, StandardScaler

SCALER_ORDER = ("standard", "minmax", "robust")
LOW_CARDINALITY = 0.05


def hash_bucket(c, salt: str = "") -> F.Column:
    key = c.cast("string") if not salt else F.concat(F.lit(salt), c.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100


def split(df: DataFrame, id_col: str, frac: float = 0.2, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Deterministic train/validation split by a hash of the id (partition independent)."""
    is_val = hash_bucket(col(id_col), salt) < F.lit(int(round(frac * 100)))
    return df.filter(~is_val), df.filter(is_val)


def scaler_variances(train: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(ord, scaler, variance, chosen): total variance of the mean-filled, scaled matrix per scaler.

    Filling with the mean keeps the mean, min and max of a column and scales its
    population variance by non-null/rows; each scaler is an affine map per column, so
    the scaled moments follow from one aggregate plus the robust quantiles of the
    filled column (three passes in all).  Total variance over all cells =
    mean(var + mean^2) - mean(mean)^2 across columns.
    """
    from ..functions.stats import exact_quantiles
    from .base import safe_scale
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"c{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = train.agg(*aggs).first()
    n = row["_n"]
    empty = any(row[f"c{i}"] == 0 for i in range(len(cols))) or not cols
    variances: dict[str, float | None] = {s: None for s in SCALER_ORDER}
    if not empty:
        filled = train.select(*[F.coalesce(col(c).cast("double"), F.lit(row[f"m{i}"])).alias(c)
                                for i, c in enumerate(cols)])
        q = exact_quantiles(filled, cols, [0.25, 0.5, 0.75], approx=approx)
        params = {s: [] for s in SCALER_ORDER}
        moments = []
        for i, c in enumerate(cols):
            mean, var_f = row[f"m{i}"], row[f"v{i}"] * row[f"c{i}"] / n
            moments.append((mean, var_f))
            params["standard"].append((mean, safe_scale(var_f ** 0.5)))
            params["minmax"].append((row[f"a{i}"], safe_scale(row[f"b{i}"] - row[f"a{i}"])))
            params["robust"].append((q[c][0.5], safe_scale(q[c][0.75] - q[c][0.25])))
        for s in SCALER_ORDER:
            ys = [((mean - center) / scale, var_f / (scale * scale))
                  for (mean, var_f), (center, scale) in zip(moments, params[s])]
            ev = sum(v + m * m for m, v in ys) / len(ys)
            em = sum(m for m, _ in ys) / len(ys)
            variances[s] = ev - em * em
    best = None
    for s in SCALER_ORDER:  # strictly greater wins: ties keep the earlier scaler
        if variances[s] is not None and (best is None or variances[s] > variances[best]):
            best = s
    rows = [(k, s, variances[s], s == best) for k, s in enumerate(SCALER_ORDER)]
    return train.sparkSession.createDataFrame(rows, "ord int, scaler string, variance double, chosen boolean")


def best_scaler(train: DataFrame, cols: Sequence[str]) -> str | None:
    rows = scaler_variances(train, cols).filter("chosen").collect()
    return rows[0]["scaler"] if rows else None


def encoding_choice(train: DataFrame, cols: Sequence[str], fill: str = "missing",
                    ratio: float = LOW_CARDINALITY) -> DataFrame:
    """(column, n_distinct, n_rows, ratio, encoding) with one fused aggregate over the train table."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.countDistinct(F.coalesce(col(c).cast("string"), F.lit(fill))).alias(f"d{i}"))
    row = train.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(cols)]
    long = row.select("_n", F.explode(F.array(*items)).alias("r")).select("r.*", F.col("_n").alias("n_rows"))
    r = F.col("n_distinct") / F.col("n_rows")
    return long.select("column", "n_distinct", "n_rows", r.alias("ratio"),
                       F.when(r < ratio, "onehot").otherwise("label").alias("encoding"))


def prepare(train: DataFrame, test: DataFrame, id_col: str, target: str | None = None,
            fill: str = "missing", max_columns: int = 1000) -> tuple[DataFrame, DataFrame, dict]:
    """Whole automatic preparation: best scaler on numeric columns, per-column encoding choice.

    One-hot columns are built from the union of train and test levels (``{col}_{value}``); a column with more
    than ``max_columns`` levels becomes one ``struct(size, index)``, its one-hot row in sparse form;
    label codes follow first appearance (train order, then test order, by ``id_col``).
    """
    target = target or find_target(train)
    skip = [x for x in (id_col, target) if x]
    num = numeric_columns(train, skip)
    cats = [c for c in categorical_columns(train, skip) if c in test.columns]
    params: dict[str, str] = {}
    tr, te = train, test
    if num:
        name = best_scaler(train, num)
        if name is not None:
            params["numeric_scaler"] = name
            scaler = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}[name]()
            model = scaler.fit(train, num)
            tr, te = model.transform(tr), model.transform(te)
    if cats:
        choice = {r["column"]: r["encoding"] for r in encoding_choice(train, cats, fill).collect()}
        for c in cats:
            params[f"encoding_{c}"] = choice[c]
            filled_tr = replace_columns(tr, {c: F.coalesce(col(c).cast("string"), F.lit(fill))})
            filled_te = replace_columns(te, {c: F.coalesce(col(c).cast("string"), F.lit(fill))})
            if choice[c] == "onehot":
                both = filled_tr.select(c).unionByName(filled_te.select(c)).distinct()
                levels = [r[0] for r in both.orderBy(c).limit(max_columns + 1).collect()]
                if len(levels) > max_columns:  # too many columns: the same rows in sparse form
                    codes, n = dense_codes(both, c)
                    tr, te = sparse_onehot(filled_tr, c, codes, n), sparse_onehot(filled_te, c, codes, n)
                    continue
                expand = {c: [(f"{c}_{v}", (col(c) == F.lit(v))) for v in levels]}
                tr = replace_columns(filled_tr, {}, expand=expand)
                te = replace_columns(filled_te, {}, expand=expand)
            else:
                codes, n = first_seen_codes([(train, id_col), (test, id_col)], c, fill=fill)
                tr = join_codes(filled_tr, c, codes, n)
                te = join_codes(filled_te, c, codes, n)
    return tr, te, params


__all__ = ["best_scaler", "dense_codes", "encoding_choice", "prepare", "scaler_variances", "split"]
