"""Sweeps: modifiable pairs x candidate values (J7, K4, M8, M9), hyper-parameter grids
(J8, M3) and the model search (M1-M7) over the fixtures.

The preprocessing sweep with a SQL objective (``sweep_variance``) evaluates every
trial in one fused aggregate over a single scan of the data: each trial is just a
different projection of the same rows, so trials add aggregate columns, not scans.
"""

from __future__ import annotations

import statistics
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import trial_id
from ..functions.stats import exact_quantiles
from ..operators.base import EPS10
from ..operators.search import HYPER_SPACE_CLASS, grid_frame, sample_grid
from ..session import scratch_path
from ..sources.cells import fx_cells
from .catalog import catalog_dict, catalog_rows, catalog_sql, typed_candidate, typed_sql
from .corpus import MODELS_SQL, USAGE_SQL, model_records, modifiable_params, scan_events, usage_table
from .fixtures import FX_SQL, fx, fx_split
from .registry import r6, register


def sweep_expand(pairs: DataFrame, catalog: DataFrame, stem: Column, include_placeholders: bool = False
                 ) -> DataFrame:
    """One trial row per (modifiable pair, candidate value) with its trial id."""
    vals = catalog.filter(F.col("ord").isNotNull())
    if not include_placeholders:
        vals = vals.filter(~F.col("is_placeholder"))
    vals = vals.select(F.col("method"), "param", "ord", "value_text", "value_json")
    j = pairs.join(F.broadcast(vals), ["method", "param"])  # catalog: fixed, 170 rows
    return j.withColumn("trial_id", trial_id(stem, F.col("method"), F.col("param"), F.col("value_text")))


def first_pairs(pairs: DataFrame, n: int, key: str = "notebook") -> DataFrame:
    """K4: the first ``n`` modifiable pairs of each notebook, usage order then catalog order."""
    w = Window.partitionBy(key).orderBy("cell_index", "part", "seq", "sub", "param_ord")  # one notebook
    return pairs.withColumn("pair_rank", F.row_number().over(w)).filter(F.col("pair_rank") <= n)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    u = usage_table(scan_events(fx_cells(spark, sf)))
    return modifiable_params(u, catalog_rows(spark))


def _stem_sql(col: str = "notebook") -> str:
    return f"regexp_extract({col}, '([^/]+?)(\\.[^.]*)?$', 1)"


def _stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+?)(\.[^.]*)?$", 1)


_PAIRS_SQL = USAGE_SQL + ", " + catalog_sql() + """,
 pc as (select distinct method, param, param_ord from catalog where has_values and not no_params),
 mp as (select notebook, cell_index, part, k, uu.function method, param, param_ord from u uu
        join pc on uu.function = pc.method
        where uu.function not in ('drop', 'dropna') and not starts_with(uu.function, 'Drop column ''')
          and not starts_with(uu.function, 'Create column ''') and not contains(custom_params, param))
"""


@register("sweep_expand", _PAIRS_SQL + f"""
 select notebook, cell_index, mp.method, mp.param, ord, value_text,
   {_stem_sql()} || '_modified_' || mp.method || '_' || mp.param || '_'
     || replace(replace(replace(replace(value_text, '[', ''), ']', ''), ',', '_'), ' ', '') trial_id
 from mp join catalog c on mp.method = c.method and mp.param = c.param
 where c.ord is not null and not c.is_placeholder""")
def q_sweep_expand(spark: SparkSession, sf: str) -> DataFrame:
    t = sweep_expand(_pairs(spark, sf), catalog_rows(spark), _stem(F.col("notebook")))
    return t.select("notebook", "cell_index", "method", "param", "ord", "value_text", "trial_id")


@register("typed_candidates", _PAIRS_SQL + ", " + typed_sql() + """
 select notebook, cell_index, mp.method, mp.param, ord, kind, number, flag, text, n_items, literal
 from mp join typed t on mp.method = t.method and mp.param = t.param""")
def q_typed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate (placeholders too) of every modifiable pair of the notebooks, typed."""
    vals = catalog_rows(spark).where("ord is not null").select("method", "param", "ord", "value_json")
    typed = typed_candidate(F.col("value_json"), F.col("param"))
    j = _pairs(spark, sf).join(F.broadcast(vals), ["method", "param"])  # catalog: fixed, 170 rows
    return j.select("notebook", "cell_index", "method", "param", "ord", *[
        typed[c].alias(c) for c in ("kind", "number", "flag", "text", "literal")],
        F.when(typed["items"].isNotNull(), F.size(typed["items"])).alias("n_items"))


@register("sweep_plan", _PAIRS_SQL + """
 select notebook, cell_index, method, param, pair_rank from (
   select *, row_number() over (partition by notebook order by cell_index, part, k, param_ord) pair_rank from mp)
 where pair_rank <= 2""")
def q_sweep_plan(spark: SparkSession, sf: str) -> DataFrame:
    """K4/M9: the first two modifiable pairs per notebook (multi-parameter mode)."""
    p = first_pairs(_pairs(spark, sf), 2)
    return p.select("notebook", "cell_index", "method", "param", F.col("pair_rank").cast("bigint"))


def _lr_settings() -> list[str]:
    from itertools import product
    space = HYPER_SPACE_CLASS["LogisticRegression"]
    return [", ".join(f"{k}={v}" for k, v in zip(space, combo)) for combo in product(*space.values())]


@register("grid_sample", "with " + MODELS_SQL + ", g(setting) as (values "
          + ", ".join(f"('{s}')" for s in _lr_settings()) + """)
 select notebook, cell_index, 'LogisticRegression' model_type, setting from s, g""")
def q_grid_sample(spark: SparkSession, sf: str) -> DataFrame:
    """J8 + M3: up to 20 sampled settings per recorded model (the LR grid has 8, so all)."""
    recs = model_records(scan_events(fx_cells(spark, sf)))
    s = sample_grid(recs, grid_frame(spark), n_iter=20)
    return s.select("notebook", "cell_index", "model_type", "setting")


# ----------------------------------------------------------------------------- M8 with a SQL objective

SWEEP_METHODS = ("StandardScaler", "MinMaxScaler", "RobustScaler", "Normalizer")
NUM = ["f1", "f2", "f3"]


def scaler_trials() -> list[tuple[str, str, str, dict]]:
    """(method, param, value_text, overridden params): baseline + one-at-a-time candidates."""
    cat = catalog_dict()
    out = []
    for m in SWEEP_METHODS:
        out.append((m, "baseline", "default", {}))
        for p, info in cat[m].items():
            for v in info.get("allowed_values", []):
                text = str(v) if not isinstance(v, list) else "[" + ", ".join(str(x) for x in v) + "]"
                out.append((m, p, text, {p: v}))
    return out


def _trial_expr(method: str, params: dict, c: str, S: dict, cols: list[str], dialect: str):
    """Scaled value of column ``c`` for one trial; S maps stat name -> Column or SQL text."""
    def lit(v):
        return F.lit(float(v)) if dialect == "spark" else repr(float(v))

    def z(x):  # zero scale -> 1
        if dialect == "spark":
            return F.when(F.abs(x) < EPS10, F.lit(1.0)).otherwise(x)
        return f"(case when abs({x}) < {EPS10!r} then 1 else {x} end)"

    def ex(fmt_spark, fmt_sql):
        return fmt_spark() if dialect == "spark" else fmt_sql()

    x = F.col(c) if dialect == "spark" else c
    if method == "StandardScaler":
        wm, ws = params.get("with_mean", True), params.get("with_std", True)
        center = S[f"avg_{c}"] if wm else (lit(0.0))
        scale = z(S[f"std_{c}"]) if ws else lit(1.0)
        return ex(lambda: (x - center) / scale, lambda: f"(({x} - {center}) / {scale})")
    if method == "MinMaxScaler":
        lo, hi = params.get("feature_range", [0.0, 1.0])
        rng = ex(lambda: z(S[f"max_{c}"] - S[f"min_{c}"]), lambda: z(f"({S['max_' + c]} - {S['min_' + c]})"))
        y = ex(lambda: (x - S[f"min_{c}"]) / rng * lit(hi - lo) + lit(lo),
               lambda: f"(({x} - {S['min_' + c]}) / {rng} * {float(hi - lo)!r} + {float(lo)!r})")
        if params.get("clip", False):
            y = ex(lambda: F.least(F.greatest(y, lit(lo)), lit(hi)), lambda: f"least(greatest({y}, {lo}), {hi})")
        return y
    if method == "RobustScaler":
        wc, wsc = params.get("with_centering", True), params.get("with_scaling", True)
        adj = 1.0
        if params.get("unit_variance", False):
            nd = statistics.NormalDist()
            adj = nd.inv_cdf(0.75) - nd.inv_cdf(0.25)
        center = S[f"q50_{c}"] if wc else lit(0.0)
        q75, q25 = S[f"q75_{c}"], S[f"q25_{c}"]
        if not wsc:
            scale = lit(1.0)
        elif dialect == "spark":
            scale = z(q75 - q25) / lit(adj)
        else:
            scale = f"({z(f'({q75} - {q25})')} / {adj!r})"
        return ex(lambda: (x - center) / scale, lambda: f"(({x} - {center}) / {scale})")
    if method == "Normalizer":
        norm = params.get("norm", "l2")
        if dialect == "spark":
            xs = [F.col(k) for k in cols]
            if norm == "l1":
                n = sum((F.abs(v) for v in xs[1:]), F.abs(xs[0]))
            elif norm == "l2":
                n = F.sqrt(sum((v * v for v in xs[1:]), xs[0] * xs[0]))
            else:
                n = F.greatest(*[F.abs(v) for v in xs])
            return x / F.when(n == 0, F.lit(1.0)).otherwise(n)
        if norm == "l1":
            n = " + ".join(f"abs({k})" for k in cols)
        elif norm == "l2":
            n = "sqrt(" + " + ".join(f"{k} * {k}" for k in cols) + ")"
        else:
            n = "greatest(" + ", ".join(f"abs({k})" for k in cols) + ")"
        return f"({x} / (case when ({n}) = 0 then 1 else ({n}) end))"
    raise KeyError(method)


def _affine(method: str, params: dict, c: str, st: dict) -> tuple[float, float, float] | None:
    """(center, scale, offset) when the trial maps x to (x - center) / scale + offset, else None."""
    def z(v):
        return 1.0 if abs(v) < EPS10 else v
    if method == "StandardScaler":
        center = st[f"avg_{c}"] if params.get("with_mean", True) else 0.0
        scale = z(st[f"std_{c}"]) if params.get("with_std", True) else 1.0
        return center, scale, 0.0
    if method == "MinMaxScaler" and not params.get("clip", False):
        lo, hi = (float(v) for v in params.get("feature_range", [0.0, 1.0]))
        return st[f"min_{c}"], z(st[f"max_{c}"] - st[f"min_{c}"]) / (hi - lo), lo
    if method == "RobustScaler":
        adj = 1.0
        if params.get("unit_variance", False):
            nd = statistics.NormalDist()
            adj = nd.inv_cdf(0.75) - nd.inv_cdf(0.25)
        center = st[f"q50_{c}"] if params.get("with_centering", True) else 0.0
        scale = z(st[f"q75_{c}"] - st[f"q25_{c}"]) / adj if params.get("with_scaling", True) else 1.0
        return center, scale, 0.0
    return None  # clipping and row-wise normalisation need a pass over the data


def sweep_variance(train: DataFrame, cols: list[str], trials=None, stem: str = "fx") -> DataFrame:
    """M8 with the A1 objective: total variance of the mean-filled, transformed matrix per trial.

    Fits share one aggregate (+ one exact-quantile search).  A trial that is an affine map
    of each column gets its mean and variance in closed form from the column's own
    (mean, variance); only clipped and row-normalised trials add aggregate columns, all of
    them in one aggregate over one scan of the filled table.
    """
    trials = trials or scaler_trials()
    means = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")).alias(c)
                            for c in cols])
    stats_row = filled.agg(*[e for c in cols for e in (
        F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.var_pop(c).alias(f"var_{c}"),
        F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]).first()
    q = exact_quantiles(filled, cols, [0.25, 0.5, 0.75])
    st = dict(stats_row.asDict())
    for c in cols:
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            st[f"{name}_{c}"] = q[c][p]
    S = {k: F.lit(v).cast("double") for k, v in st.items()}
    aggs, moments = [], {}
    for t, (m, p, v, params) in enumerate(trials):
        for c in cols:
            aff = None if st[f"avg_{c}"] is None else _affine(m, params, c, st)
            if aff is not None:
                center, scale, offset = aff
                moments[(t, c)] = (F.lit((st[f"avg_{c}"] - center) / scale + offset),
                                   F.lit(st[f"var_{c}"] / (scale * scale)))
            else:
                y = _trial_expr(m, params, c, S, cols, "spark")
                aggs += [F.avg(y).alias(f"m_{t}_{c}"), F.var_pop(y).alias(f"v_{t}_{c}")]
                moments[(t, c)] = (F.col(f"m_{t}_{c}"), F.col(f"v_{t}_{c}"))
    one = filled.agg(*aggs) if aggs else train.sparkSession.range(1)
    k = float(len(cols))
    rows = []
    for t, (m, p, v, params) in enumerate(trials):
        ev = sum((moments[(t, c)][1] + moments[(t, c)][0] ** 2 for c in cols), F.lit(0.0)) / k
        em = sum((moments[(t, c)][0] for c in cols), F.lit(0.0)) / k
        tid = trial_id(F.lit(stem), F.lit(m), F.lit(p), F.lit(v))
        rows.append(F.struct(F.lit(t).alias("trial"), tid.alias("trial_id"), F.lit(m).alias("method"),
                             F.lit(p).alias("param"), F.lit(v).alias("value"), (ev - em * em).alias("variance")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _sweep_variance_sql() -> str:
    trials = scaler_trials()
    fill = ", ".join(f"coalesce({c}, (select avg({c}) from train)) {c}" for c in NUM)
    stats = ", ".join(
        f"avg({c}) avg_{c}, stddev_pop({c}) std_{c}, min({c}) min_{c}, max({c}) max_{c}, "
        f"quantile_cont({c}, 0.25) q25_{c}, quantile_cont({c}, 0.5) q50_{c}, quantile_cont({c}, 0.75) q75_{c}"
        for c in NUM)
    S = {f"{s}_{c}": f"{s}_{c}" for c in NUM for s in ("avg", "std", "min", "max", "q25", "q50", "q75")}
    ys = []
    for t, (m, p, v, params) in enumerate(trials):
        for c in NUM:
            ys.append(f"{_trial_expr(m, params, c, S, NUM, 'sql')} y_{t}_{c}")
    aggs = ", ".join(f"avg(y_{t}_{c}) m_{t}_{c}, var_pop(y_{t}_{c}) v_{t}_{c}"
                     for t in range(len(trials)) for c in NUM)
    sel = []
    for t, (m, p, v, params) in enumerate(trials):
        ev = " + ".join(f"(v_{t}_{c} + m_{t}_{c} * m_{t}_{c})" for c in NUM)
        em = " + ".join(f"m_{t}_{c}" for c in NUM)
        safe = v.replace("[", "").replace("]", "").replace(",", "_").replace(" ", "")
        sel.append(f"select {t} trial, 'fx_modified_{m}_{p}_{safe}' trial_id, '{m}' method, '{p}' param, "
                   f"'{v}' value, (({ev}) / 3 - (({em}) / 3) * (({em}) / 3))::REAL variance from a")
    return (f"with {FX_SQL}, filled as (select {fill} from train), fs as (select {stats} from filled), "
            f"y as (select {', '.join(ys)} from filled, fs), a as (select {aggs} from y) "
            + " union all ".join(sel))


@register("sweep_variance", _sweep_variance_sql())
def q_sweep_variance(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    out = sweep_variance(train, NUM)
    # float32: a relative rounding, the variances span many orders of magnitude
    return out.select(F.col("trial").cast("int").alias("trial"), "trial_id", "method", "param", "value",
                      F.col("variance").cast("float").alias("variance"))


@register("sweep_best_value", "select method, value best_value, variance best_variance from (select *, "
          "row_number() over (partition by method order by variance desc, trial) rk from ("
          + _sweep_variance_sql() + ") t where param <> 'baseline') where rk = 1")
def q_sweep_best_value(spark: SparkSession, sf: str) -> DataFrame:
    """K3 with an objective argument: per method, the candidate with the highest variance."""
    from .trials import best_value
    train, _ = fx_split(spark, sf)
    t = sweep_variance(train, NUM).filter(F.col("param") != "baseline").withColumnRenamed("trial", "ord")
    b = best_value(t.withColumn("variance", F.col("variance").cast("float")), "variance", keys=("method",))
    return b.select("method", "best_value", F.col("best_variance").cast("float").alias("best_variance"))


# ----------------------------------------------------------------------------- M1-M7 (rows only)


def _lr_grid() -> list[tuple[str, float, str]]:
    out = []
    for text in _lr_settings():
        kv = dict(x.split("=") for x in text.split(", "))
        out.append((text, float(kv["C"]), kv["penalty"]))
    return out


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: many passes read it, each the columns that it needs."""
    path = scratch_path(df.sparkSession, f"rows-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _kept_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``fx_split`` for a search: its statistics, codes and folds take dozens of passes, which must not each join the
    tables anew (large tables are sorted and shuffled for that)."""
    rows = _kept(fx(spark, sf))
    return rows.filter(~F.col("is_test")), rows.filter(F.col("is_test"))


def _raw_table(split: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(training rows, others, features): imputed from train, categories as label codes."""
    from ..operators.encode import LabelEncoder
    from ..operators.impute import TrainStatImputer
    train, test = split
    imp = TrainStatImputer(exclude=("id", "target", "is_test")).fit(train)
    tr, te = imp.transform(train), imp.transform(test)
    for c in ("c1", "c2", "c3"):
        le = LabelEncoder().fit([tr, te], c)
        tr, te = le.transform(tr), le.transform(te)
    return tr, te, ["f1", "f2", "f3", "c1", "c2", "c3"]


def _prepared_table(split: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The automatically prepared version of the same rows (best scaler, encoding by share of levels)."""
    from ..operators.autoprep import prepare
    train, test = split
    tr, te, _ = prepare(train.drop("is_test"), test.drop("is_test"), id_col="id", target="target")
    feats = [c for c in tr.columns if c not in ("id", "target")]
    return tr.na.fill(0.0), te.na.fill(0.0), feats


def _searched(table: tuple[DataFrame, DataFrame, list[str]]):
    """The search of the LogisticRegression grid over 5 stratified folds; the other rows validate."""
    from ..operators.logistic import logistic_search
    from ..operators.metrics import stratified_folds
    tr, te, feats = table
    names = [f"x{i}" for i in range(len(feats))]

    def own(df: DataFrame) -> DataFrame:
        return df.select("id", F.col("target").cast("double").alias("y"), *[
            F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(feats, names)])

    # prepared once: the sort of the folds reads its rows twice
    ready = _kept(own(tr).withColumn("valid", F.lit(False)).unionByName(own(te).withColumn("valid", F.lit(True))))
    train, valid = (ready.where(F.col("valid") == v).drop("valid") for v in (False, True))
    rows = stratified_folds(train, "y", "id", 5).withColumn("part", F.col("fold").cast("int")).drop("fold")
    rows = _kept(rows.unionByName(valid.withColumn("part", F.lit(-1))))
    return logistic_search(rows, names, "y", "part", 5, _lr_grid()), rows


METRICS = ("accuracy", "precision", "recall", "f1")


@register("search_lr")
def q_search_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Model search for the recorded LogisticRegression: original vs best of the grid (objective accuracy)."""
    res, _ = _searched(_raw_table(_kept_split(spark, sf)))
    text, _, number = res.best("accuracy")
    rows = [("fx::LogisticRegression", version, m, float(res.scores[i, -1][m]))
            for version, i in (("original", len(res.fits) - 1), ("optimized", number)) for m in METRICS]
    return spark.createDataFrame(rows, "run_key string, version string, metric string, value double").withColumn(
        "best_setting", F.lit(text))


@register("submission")
def q_submission(spark: SparkSession, sf: str) -> DataFrame:
    """P10 / M6: the best model of the search predicts the test ids."""
    res, rows = _searched(_raw_table(_kept_split(spark, sf)))
    _, fit, _ = res.best("accuracy")
    return rows.where("part = -1").select("id", (fit.margin() > 0).cast("double").alias("Prediction"))


@register("search_trials")
def q_search_trials(spark: SparkSession, sf: str) -> DataFrame:
    """M4: one row per setting and fold of the search."""
    res, _ = _searched(_raw_table(_kept_split(spark, sf)))
    return spark.createDataFrame(res.trials("accuracy"), "setting string, fold int, score double")


@register("search_logistic")
def q_search_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M7 for every recorded LogisticRegression on both table versions: its objective's best setting, the metrics of
    the recorded and the best model, and the trials written by the S7 sink.  Records share the fits."""
    from ..operators.search import match_records
    from ..sources.sinks import write_trials
    from .modelloop import fx_records
    recs = match_records(fx_records(spark, sf)).where("model_type = 'LogisticRegression'").select(
        "notebook", "cell_index", "objective")
    found, trials = [], []
    split = _kept_split(spark, sf)
    for name, table in (("original", _raw_table(split)), ("transformed", _prepared_table(split))):
        res, _ = _searched(table)
        for objective in METRICS:
            text, _, number = res.best(objective)
            found.append((name, objective, text, *[float(res.scores[len(res.fits) - 1, -1][m]) for m in METRICS],
                          *[float(res.scores[number, -1][m]) for m in METRICS]))
            trials += [(name, objective, *t) for t in res.trials(objective)]
    kind = "dataset string, objective string"
    best = spark.createDataFrame(found, f"{kind}, best_setting string, " + ", ".join(
        f"{v}_{m} double" for v in ("original", "optimized") for m in METRICS))
    log = spark.createDataFrame(trials, f"{kind}, setting string, fold int, score double")
    out = recs.join(F.broadcast(best), "objective")  # two rows an objective
    path = scratch_path(spark, f"trials-{uuid.uuid4().hex}")
    write_trials(recs.join(F.broadcast(log), "objective").withColumn("stem", F.col("notebook")), path)
    written = spark.read.parquet(path).groupBy("notebook", "cell_index", "dataset").agg(F.count("*").alias("n_trials"))
    return out.join(written, ["notebook", "cell_index", "dataset"])


@register("raw_vs_prepared")
def q_raw_vs_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """M7: the search on both table versions (raw: train-stat imputation and label codes; prepared: best scaler and
    encoding choice), the recorded and the best model's metrics side by side."""
    rows = []
    split = _kept_split(spark, sf)
    for name, table in (("raw", _raw_table(split)), ("prepared", _prepared_table(split))):
        res, _ = _searched(table)
        text, _, number = res.best("accuracy")
        rows += [(name, version, text if version == "optimized" else "recorded", m, float(res.scores[i, -1][m]))
                 for version, i in (("original", len(res.fits) - 1), ("optimized", number)) for m in METRICS]
    return spark.createDataFrame(rows, "dataset string, version string, setting string, metric string, value double")
