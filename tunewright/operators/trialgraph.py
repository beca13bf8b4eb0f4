"""Preprocessing sweep as a graph of shared stages.

A spec is a list of stages (method, columns, parameters).  A sweep makes trials of it: the baseline, and one trial for
every candidate value of every parameter that the spec does not set itself.  Trials mostly agree: two trials whose
stages begin alike share these stages.  So the sweep runs *applications*, a stage on certain columns of the wide trial
table, each of them once whatever the number of trials that need it:

* Specs that share no first stage share no application: each group of specs runs on a table of its own columns, and the
  groups run side by side.  Rows get their position in the order once; fills go by it.
* Level by level, the distinct applications are fitted side by side on the training rows (a bounded thread pool), and
  the outputs of all of them are columns of one projection of the wide table (fills by order and code joins, which are
  no projections, add theirs one after the other).  The table holds only the columns that a trial still needs.  It is
  written once a level, by column and compressed, and the level before it is deleted.  Scalers of a level take their
  statistics from one aggregate, and quantiles of the same columns are found once.
* A trial ends as a list of columns.  One pass over a group's last table gives the second moments of all columns of its trials
  (``gram.py``); a trial's least-squares fit and its scores are a small solve on its own part of that matrix.
* A stage that cannot be fitted or applied fails the trials that run through it and no others; each trial ends as a
  score or as a row that tells the failure.

Stages keep the number and identity of rows (``drop`` and ``dropna`` are not swept, as in the notebooks).  Parameters
without effect on a DataFrame (``NO_EFFECT``) do not make another application.
"""

from __future__ import annotations

import dataclasses
import inspect
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles
from ..session import scratch_path
from ..sources.tables import col
from .base import replace_columns
from .encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, get_dummies
from .frame import fillna, map_values, replace
from .gram import least_squares, moments
from .impute import SimpleImputer
from .poly import PolynomialFeatures
from .scale import MinMaxScaler, Normalizer, RobustScaler, StandardScaler, column_stats
from .select import RFE, SelectFromModel, SelectKBest, VarianceThreshold, anova_f

# Catalog parameters that change nothing in a DataFrame's values.
NO_EFFECT = ("copy", "inplace", "order", "dtype", "sparse_output", "sparse", "ignore_index", "feature_name_combiner")
#: methods that a sweep does not touch
NOT_SWEPT = ("drop", "dropna")


@dataclass(frozen=True)
class Stage:
    method: str
    columns: tuple[str, ...] = ()          # none: all columns that the spec has at this stage
    params: tuple[tuple[str, object], ...] = ()

    def override(self, param: str, value) -> "Stage":
        """X11: the stage with one parameter set."""
        kept = tuple((k, v) for k, v in self.params if k != param)
        return dataclasses.replace(self, params=kept + ((param, value),))


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[str, ...]
    stages: tuple[Stage, ...]


@dataclass(frozen=True)
class Trial:
    spec: Spec                              # with the override
    stage: int                              # of the overridden parameter, -1 for the baseline
    method: str
    param: str
    ord: int
    value_text: str


def typed(value):
    """A catalog candidate as the value that a method takes: number words, lists as tuples."""
    if isinstance(value, str) and value.lower() in ("inf", "+inf", "-inf", "nan"):
        return float(value)
    return tuple(typed(v) for v in value) if isinstance(value, list) else value


def expand(specs: Sequence[Spec], candidates: Mapping[tuple[str, str], Sequence[tuple[int, str, object]]]) -> list[Trial]:
    """The baseline of each spec and its one-at-a-time trials, in stage, parameter and candidate order.
    ``candidates``: (method, parameter) -> (ord, text, value), in catalog order."""
    out = []
    for spec in specs:
        out.append(Trial(spec, -1, "", "baseline", 0, "default"))
        for i, stage in enumerate(spec.stages):
            if stage.method in NOT_SWEPT:
                continue
            given = {k for k, _ in stage.params}
            for (method, param), values in candidates.items():
                if method != stage.method or param in given:
                    continue
                for o, text, value in values:
                    stages = (*spec.stages[:i], stage.override(param, typed(value)), *spec.stages[i + 1:])
                    out.append(Trial(dataclasses.replace(spec, stages=stages), i, method, param, o, text))
    return out


# ----------------------------------------------------------------------------- stages


Transform = Callable[[DataFrame], DataFrame]


def _in_place(transform: Transform) -> Transform:
    """Marks a transform that is no projection (a join, a fill by order): it replaces its columns in place."""
    transform.in_place = True
    return transform


class Recorder:
    """Stands for a DataFrame in a transform that ends as one projection, and keeps its columns instead."""

    def __init__(self, df: DataFrame):
        self.df, self.made = df, None

    def __getattr__(self, name):
        return getattr(self.df, name)

    def __getitem__(self, name):
        return self.df[name]

    def select(self, *items):
        out = self.df.select(*items)
        if len(items) == len(out.columns):
            self.made = list(zip(out.columns, items, strict=True))
        return out


def _make(cls, params: dict):
    known = {f.name for f in dataclasses.fields(cls)}
    unknown = sorted(set(params) - known)
    if unknown:
        raise TypeError(f"{cls.__name__} has no parameter {', '.join(unknown)}")
    return cls(**params)


def _fitted(cls):
    def fit(train: DataFrame, cols: list[str], label: str, order_by: str, params: dict) -> Transform:
        return _make(cls, params).fit(train, cols).transform
    return fit


def _by_stats(cls):
    def fit(train, cols, label, order_by, params, shared):
        return _make(cls, params).fit(train, cols, stats=shared.stats(cols)).transform
    fit.shares = True
    return fit


def _robust(train, cols, label, order_by, params, shared):
    scaler = _make(RobustScaler, params)
    if scaler.approx:
        return scaler.fit(train, cols).transform
    return scaler.fit(train, cols, quantiles=shared.quantiles(train, cols, scaler.probs())).transform


_robust.shares = True


class Shared:
    """Statistics of the training rows that fits of a level have in common, computed when one first asks."""

    def __init__(self, train: DataFrame, scaled: Sequence[str]):
        self.train, self.scaled = train, sorted(set(scaled))
        self.guard, self.known = Lock(), {}

    def _once(self, key, make: Callable):
        with self.guard:
            lock, found = self.known.setdefault(key, (Lock(), []))
        with lock:
            if not found:
                found.append(make())
        return found[0]

    def stats(self, cols: list[str]) -> dict:
        def try_all():
            try:
                return column_stats(self.train, self.scaled)
            except Exception:  # noqa: BLE001  some column is no number: its own fit tells
                return None
        return self._once("stats", try_all) or column_stats(self.train, cols)

    def anova(self, train: DataFrame, cols: list[str], label: str) -> DataFrame:
        rows = self._once(("anova", tuple(cols)), lambda: anova_f(train, label, cols).collect())  # a row a column
        return train.sparkSession.createDataFrame(rows, "feature string, idx int, f_score double")

    def quantiles(self, train: DataFrame, cols: list[str], probs: list[float]) -> dict:
        return self._once((tuple(cols), tuple(probs)), lambda: exact_quantiles(train, cols, probs))


def _impute(train, cols, label, order_by, params):
    fill = params.get("fill_value")
    text = [f for f in train.schema.fields if f.name in cols and f.dataType.simpleString() == "string"]
    if params.get("strategy") == "constant" and isinstance(fill, str) and len(text) < len(cols):
        raise ValueError("fill_value of numeric columns is a number")
    return _make(SimpleImputer, params).fit(train, cols).transform


def _ordinal(train, cols, label, order_by, params):
    use, unknown = params.get("handle_unknown", "error") == "use_encoded_value", params.get("unknown_value")
    if use == (unknown is None):
        raise TypeError("unknown_value goes with handle_unknown='use_encoded_value', and only with it")
    missing = params.get("encoded_missing_value")
    if isinstance(missing, float) and math.isnan(missing):
        params = {**params, "encoded_missing_value": None}
    model = _make(OrdinalEncoder, params).fit(train, cols)
    return _in_place(lambda df: model.transform(df))


def _label(train, cols, label, order_by, params):
    models = [LabelEncoder().fit(train, c) for c in cols]

    def transform(df: DataFrame) -> DataFrame:
        for m in models:
            df = m.transform(df)
        return df
    return _in_place(transform)


def _polynomial(train, cols, label, order_by, params):
    poly = _make(PolynomialFeatures, params)
    poly.terms(cols)

    def transform(df: DataFrame) -> DataFrame:
        return poly.transform(df, cols, keep=[c for c in df.columns if c not in cols])
    return transform


def _fillna(train, cols, label, order_by, params):
    if params.get("value") is not None and params.get("method") is not None:
        raise ValueError("value or method, not both")
    if params.get("value") is not None and params.get("axis") == 1:
        params = {**params, "axis": 0}  # one value for all columns
    if params.get("value") is None and params.get("method") is None:
        raise ValueError("a value or a method is needed")
    if params.get("value") is not None and params.get("limit") is None:
        return lambda df: replace_columns(df, {c: F.coalesce(col(c), F.lit(params["value"])) for c in cols})
    return _in_place(lambda df: fillna(df, subset=cols, order_by=order_by, **params))


def _replace(train, cols, label, order_by, params):
    if params.get("value") is not None:
        params = {k: v for k, v in params.items() if k not in ("method", "limit")}  # both only fill
        if not params.get("regex") and not isinstance(params.get("to_replace"), (tuple, dict)):
            return lambda df: replace_columns(df, {c: F.when(col(c) == F.lit(params["to_replace"]), F.lit(
                params["value"])).otherwise(col(c)) for c in cols})
    return _in_place(lambda df: replace(df, subset=cols, order_by=order_by, **params))


def _map(train, cols, label, order_by, params):
    arg = dict(params["arg"]) if isinstance(params.get("arg"), tuple) else params.get("arg")

    def transform(df: DataFrame) -> DataFrame:
        for c in cols:
            df = map_values(df, c, arg, params.get("na_action"))
        return df
    return transform


def _dummies(train, cols, label, order_by, params):
    seen = Recorder(train)
    get_dummies(seen, cols, dtype="double", **params)  # levels are those of the training rows
    made = [(n, e) for n, e in seen.made if n not in train.columns]
    return lambda df: df.select(*[col(c) for c in df.columns if c not in cols], *[e.alias(n) for n, e in made])


def _selected(rows: DataFrame) -> list[str]:
    kept = [r["feature"] for r in rows.filter("selected").select("feature").collect()]
    if not kept:
        raise ValueError("no feature is left")
    return kept


def _k_best(train, cols, label, params, shared):
    best = _make(SelectKBest, params)
    return _selected(best.fit(train, cols, label, shared.anova(train, cols, label)))


def _variance(train, cols, label, params, stats):
    threshold = _make(VarianceThreshold, params).threshold
    t = stats.total()
    kept = [c for c, k in zip(cols, stats.at(cols), strict=True) if float(
        (t[k, k] / t[0, 0] - (t[0, k] / t[0, 0]) ** 2) * stats.scale[k - 1] ** 2) > threshold]
    if not kept:
        raise ValueError("no feature is left")
    return kept


def _from_model(train, cols, label, params, stats):
    most = params.get("max_features")
    if most is not None and most > len(cols):
        raise ValueError(f"max_features {most} of {len(cols)} features")
    return _selected(_make(SelectFromModel, {"estimator": "linear", **params}).fit(train, cols, label, stats=stats))


def _rfe(train, cols, label, params, stats):
    return _selected(_make(RFE, {"estimator": "linear", **params}).fit(train, cols, label, stats=stats))


#: method -> fit(train, columns, label, order_by, params) giving the transform of any rows
TRANSFORMS = {
    "StandardScaler": _by_stats(StandardScaler), "MinMaxScaler": _by_stats(MinMaxScaler),
    "RobustScaler": _robust, "Normalizer": _fitted(Normalizer), "OneHotEncoder": _fitted(OneHotEncoder),
    "OrdinalEncoder": _ordinal, "LabelEncoder": _label, "SimpleImputer": _impute, "PolynomialFeatures": _polynomial,
    "fillna": _fillna, "replace": _replace, "map": _map, "get_dummies": _dummies,
}
#: method -> fit(train, columns, label, params, moments of columns and label, or what is shared) giving the columns that stay
SELECTORS = {"SelectKBest": _k_best, "VarianceThreshold": _variance, "SelectFromModel": _from_model, "RFE": _rfe}
#: selectors that the moments suffice for: those of a level share one pass
BY_MOMENTS = ("VarianceThreshold", "SelectFromModel", "RFE")


# ----------------------------------------------------------------------------- run


@dataclass
class Score:
    trial: Trial
    status: str                              # ok or failed
    error: str | None = None                 # type and text of the failure
    n_features: int | None = None
    n_used: int | None = None                # without columns that others determine
    mse: float | None = None
    r2: float | None = None


@dataclass
class SweepResult:
    scores: list[Score]
    applications: int                        # stages that ran
    stages: int                              # stages of all trials


def _message(e: Exception) -> str:
    text = str(e).strip().splitlines()
    return f"{type(e).__name__}: {text[0][:200] if text else ''}"


def run_sweep(table: DataFrame, trials: Sequence[Trial], label: str, is_train: Column, order_by: str,
              parallelism: int = 8) -> SweepResult:
    """Score every trial: least squares of ``label`` on its last columns, fitted on the training rows, scored on the
    others.  ``order_by`` is a unique key that fills go by."""
    spark = table.sparkSession
    base = sorted({c for t in trials for c in t.spec.columns})
    frame = table.select(col(order_by).alias("_order"), is_train.alias("_train"), col(label).cast("double").alias("_label"), *[
        col(c) for c in base])
    at = [col("_order").asc_nulls_first(), F.xxhash64(*[col(f.name) for f in frame.schema.fields
                                                        if f.dataType.typeName() != "map"]).asc()]
    kept = Kept()
    frame = kept.put(frame.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *at)
                     .sortWithinPartitions(*at).withColumn("_order", F.monotonically_increasing_id()))
    of = _groups(trials)
    members = [[i for i, g in enumerate(of) if g == one] for one in dict.fromkeys(of)]

    def own(group: list[int]) -> SweepResult:
        mine = [trials[i] for i in group]
        names = ["_order", "_train", "_label", *[c for c in base if any(c in t.spec.columns for t in mine)]]
        own = Kept()
        try:
            return _run_group(frame.select(*[col(c) for c in names]), mine, parallelism, own)
        finally:
            own.drop(spark)

    # one generated method for many columns is longer than the JVM compiles; without whole-stage code it is split
    fields = spark.conf.get("spark.sql.codegen.maxFields")
    spark.conf.set("spark.sql.codegen.maxFields", str(min(int(fields), FIELDS)))
    try:
        with ThreadPool(max(1, min(GROUPS, len(members)))) as pool:
            done = pool.map(inheritable_thread_target(spark)(own), members, 1)
    finally:
        spark.conf.set("spark.sql.codegen.maxFields", fields)
        kept.drop(spark)
    scores: list[Score | None] = [None] * len(trials)
    for group, result in zip(members, done, strict=True):
        for i, score in zip(group, result.scores, strict=True):
            scores[i] = score
    return SweepResult(scores, sum(r.applications for r in done), sum(r.stages for r in done))


#: groups of specs that run side by side, and columns that Spark makes one generated method for
GROUPS, FIELDS = 4, 30


def _groups(trials: Sequence[Trial]) -> list[int]:
    """A number per trial: trials of a spec, and of specs with a first stage in common, are a group."""
    parent = list(range(len(trials)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, t in enumerate(trials):
        for mark in (("spec", t.spec.name), *[("stage", repr(s)) for s in t.spec.stages[:1]]):
            parent[root(i)] = root(first.setdefault(mark, i))
    return [root(i) for i in range(len(trials))]


class Kept:
    """A table in the shared folder, by column, which the next one takes the place of."""

    def __init__(self):
        self.path = None

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, f"sweep-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(path)
        self.drop(df.sparkSession)
        self.path = path
        return df.sparkSession.read.parquet(path)

    def drop(self, spark) -> None:
        if self.path is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.path = None


def _run_group(frame: DataFrame, trials: Sequence[Trial], parallelism: int, kept: Kept) -> SweepResult:
    """Score the trials on a frame of their columns with ``_order`` (unique), ``_train`` and ``_label``; the frames of
    the levels are in ``kept``."""
    spark = frame.sparkSession
    keys = ["_order", "_train", "_label"]
    layout: list[dict[str, str] | None] = [{c: c for c in t.spec.columns} for t in trials]  # name -> column of the frame
    failed: list[str | None] = [None] * len(trials)
    counter = total = 0

    for level in range(max((len(t.spec.stages) for t in trials), default=0)):
        wanted: dict[tuple, list[int]] = {}
        for i, t in enumerate(trials):
            if failed[i] is None and level < len(t.spec.stages):
                stage = t.spec.stages[level]
                names = stage.columns or tuple(layout[i])
                gone = [c for c in names if c not in layout[i]]
                if gone:
                    failed[i] = f"KeyError: {', '.join(gone)} not in the columns"
                    continue
                params = tuple(sorted(((k, v) for k, v in stage.params if k not in NO_EFFECT and (
                    k, v) != (k, _default(stage, k))), key=lambda kv: kv[0]))
                if stage.method == "SimpleImputer" and ("strategy", "constant") not in params:
                    params = tuple(kv for kv in params if kv[0] != "fill_value")
                key = stage.method, params, tuple((c, layout[i][c]) for c in names)
                wanted.setdefault(key, []).append(i)
                total += 1
        counter += len(wanted)
        train = frame.where("_train")

        shared = sorted({p for method, _, names in wanted if method in BY_MOMENTS for _, p in names})
        number = {f.name for f in frame.schema.fields if f.dataType.simpleString() not in ("string", "binary")}
        stats = moments(train, [*(c for c in shared if c in number), "_label"], missing_ok=True) if shared else None

        common = Shared(train, [p for method, _, names in wanted if method in ("StandardScaler", "MinMaxScaler")
                                for _, p in names if p in number])

        def own_stats(cols: list[str]):
            lost = [c for c in cols if c not in number or c in stats.missing]
            if lost:
                raise ValueError(f"{len(lost)} columns are no numbers or have missing values")
            return stats.take([*cols, "_label"])

        def fit(key: tuple):
            method, params, names = key
            cols = [p for _, p in names]
            try:
                if method in SELECTORS:
                    return SELECTORS[method](train.select("_label", *[col(p) for p in cols]), cols, "_label",
                                             dict(params), own_stats(cols) if method in BY_MOMENTS else common)
                if method not in TRANSFORMS:
                    raise KeyError(f"no stage {method}")
                more = [common] if getattr(TRANSFORMS[method], "shares", False) else []
                transform = TRANSFORMS[method](train.select("_order", *[col(p) for p in cols]), cols, "_label", "_order",
                                               dict(params), *more)
                if getattr(transform, "in_place", False):
                    return transform
                seen = Recorder(frame.select("_order", *[col(p) for p in cols]))
                out = transform(seen)
                if [n for n, _ in seen.made or []] != out.columns:
                    raise TypeError(f"{method} is no projection")
                return [(n, e) for n, e in seen.made if n != "_order"]
            except Exception as e:  # noqa: BLE001  a trial's failure is its result
                return e

        todo = list(wanted)
        with ThreadPool(min(parallelism, max(1, len(todo)))) as pool:  # each fit is Spark jobs of its own
            fitted = dict(zip(todo, pool.map(inheritable_thread_target(spark)(fit), todo, 1), strict=True)) if todo else {}

        made: dict[tuple, list[tuple[str, str]]] = {}   # key -> (name, column of the frame) of what it makes
        exprs: dict[tuple, list[tuple[str, Column]]] = {}  # of applications that are projections
        errors: dict[tuple, str] = {}
        before = frame

        def plan(key: tuple) -> None:
            names = {p: c for c, p in key[2]}  # replaced columns keep their name
            if getattr(fitted[key], "in_place", False):
                made[key] = [(n, f"a{level}_{numbers[key]}_{i}") for i, (n, _) in enumerate(key[2])]
                return
            made[key] = [(names.get(n, n), f"a{level}_{numbers[key]}_{i}") for i, (n, _) in enumerate(fitted[key])]
            exprs[key] = [(p, e) for (_, p), (_, e) in zip(made[key], fitted[key], strict=True)]

        def add(rows: DataFrame, key: tuple) -> DataFrame:
            """The frame with the columns of an application that is no projection."""
            have, inputs = rows.columns, [p for _, p in key[2]]
            hidden = rows.select(*[col(c).alias(f"_f{i}") for i, c in enumerate(have)], *[
                col(p) for p in dict.fromkeys(["_order", *inputs])])
            out = fitted[key](hidden)
            return out.select(*[F.col(f"_f{i}").alias(c) for i, c in enumerate(have)], *[
                col(c).alias(p) for c, (_, p) in zip(inputs, made[key], strict=True)])

        def table(keys_: list[tuple]) -> DataFrame:
            rows = before
            for key in keys_:
                if key in made and key not in exprs and key[0] not in SELECTORS:
                    rows = add(rows, key)
            own = [e.alias(p) for key in keys_ if key in exprs for p, e in exprs[key]]
            return rows.select(*[col(c) for c in rows.columns], *own)

        numbers = {key: n for n, key in enumerate(todo)}
        for key in todo:
            try:
                if isinstance(fitted[key], Exception):
                    raise fitted[key]
                if key[0] in SELECTORS:
                    made[key] = [(c, p) for c, p in key[2] if p in set(fitted[key])]
                else:
                    plan(key)
            except Exception as e:  # noqa: BLE001
                errors[key] = _message(e)
                made.pop(key, None)

        def following() -> list[dict[str, str] | None]:
            """The layouts after the level; None where its stage failed."""
            out = list(layout)
            for key, users in wanted.items():
                inputs = [c for c, _ in key[2]]
                for i in users:
                    if key in errors:
                        out[i] = None
                        continue
                    new = dict(made[key])
                    if key[0] in SELECTORS:
                        out[i] = {n: p for n, p in layout[i].items() if n not in inputs or n in new}
                    else:  # replaced columns keep their place, new ones come last
                        kept = {n: new.pop(n, p) for n, p in layout[i].items() if n not in inputs or n in new}
                        out[i] = {**kept, **new}
            return out

        def live(columns: list[str]) -> list[str]:
            used = {p for i, names in enumerate(following()) if failed[i] is None and names for p in names.values()}
            return [c for c in columns if c in keys or c in used]

        def settled(rows: DataFrame) -> DataFrame:
            """The frame after the level; an application that fails on a row fails here."""
            rows = rows.select(*[col(c) for c in live(rows.columns)])
            return kept.put(rows) if any(key in made and key[0] not in SELECTORS for key in todo) else rows

        try:
            frame = settled(table(todo))
        except Exception:  # noqa: BLE001  some application fails on its rows: find out which
            for key in [k for k in made if k[0] not in SELECTORS]:
                try:
                    table([key]).agg(*[F.count(col(p)) for _, p in made[key]]).collect()
                except Exception as e:  # noqa: BLE001
                    errors[key] = _message(e)
                    del made[key]
                    exprs.pop(key, None)
            frame = settled(table(todo))

        layout = following()
        for key, users in wanted.items():
            for i in users:
                if key in errors:
                    failed[i] = errors[key]

    text = {f.name for f in frame.schema.fields if f.dataType.simpleString() in ("string", "binary")}
    for i in range(len(trials)):
        if failed[i] is None:
            words = [n for n, p in layout[i].items() if p in text]
            if words:
                failed[i] = f"ValueError: could not convert {', '.join(words)} to numbers"
            elif not layout[i]:
                failed[i] = "ValueError: no feature is left"
    columns = sorted({p for i, names in enumerate(layout) if failed[i] is None for p in names.values()})
    m = moments(frame, [*columns, "_label"], F.col("_train").cast("int"), missing_ok=True) if columns else None
    scores = []
    for i, t in enumerate(trials):
        if failed[i] is None:
            lost = [n for n, p in layout[i].items() if p in m.missing]
            if lost:
                failed[i] = f"ValueError: missing values in {', '.join(lost)}"
        if failed[i] is not None:
            scores.append(Score(t, "failed", failed[i]))
            continue
        own = m.take([*layout[i].values(), "_label"])
        features = list(layout[i].values())
        fit = least_squares(own, own.total([1]), features, "_label")
        got = fit.score(own.total([0]))
        scores.append(Score(t, "ok", None, len(features), len(features) - len(fit.aliased), got["mse"], got["r2"]))
    return SweepResult(scores, counter, total)


_CLASSES = {"StandardScaler": StandardScaler, "MinMaxScaler": MinMaxScaler, "RobustScaler": RobustScaler,
            "Normalizer": Normalizer, "OneHotEncoder": OneHotEncoder, "OrdinalEncoder": OrdinalEncoder,
            "PolynomialFeatures": PolynomialFeatures, "SimpleImputer": SimpleImputer, "SelectKBest": SelectKBest,
            "VarianceThreshold": VarianceThreshold, "SelectFromModel": SelectFromModel, "RFE": RFE, "fillna": fillna,
            "replace": replace, "map": map_values, "get_dummies": get_dummies}


def _default(stage: Stage, param: str):
    """The parameter's default, so that naming it makes no other application."""
    known = inspect.signature(_CLASSES[stage.method]).parameters if stage.method in _CLASSES else {}
    return known[param].default if param in known else inspect.Parameter.empty
