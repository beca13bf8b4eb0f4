"""The sweep runner over all sweepable methods (M8, M9) and its DuckDB twin.

The twin writes one chain of common table expressions for every distinct sequence of stages (statistics of the training
rows, then a projection), the moments of every chain's last columns, the selectors' choices as flags, and solves all
chains together with the SQL sweeps of ``linear.py``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trialgraph import NO_EFFECT, Spec, Stage, SweepResult, Trial, expand, run_sweep
from ..sources.tables import read_table
from .catalog import PLACEHOLDERS, catalog_dict, catalog_rows
from .fixtures import FX_SQL, fx
from .linear import sweeps_sql
from .registry import register

NUM = ("f1", "f2", "f3")
MAPPING = (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3))
# The pipelines of the notebooks; notebook i of ``part`` uses number p_partkey % 8.
SPECS = (
    Spec("poly", NUM, (Stage("SimpleImputer", NUM), Stage("StandardScaler", NUM), Stage("PolynomialFeatures", ("f1",)),
                       Stage("VarianceThreshold"))),
    Spec("kbest", NUM, (Stage("fillna", ("f2",), (("value", 0.0),)), Stage("MinMaxScaler", NUM), Stage("SelectKBest"))),
    Spec("model", NUM, (Stage("SimpleImputer", NUM), Stage("RobustScaler", NUM), Stage("SelectFromModel"))),
    Spec("rfe", NUM, (Stage("SimpleImputer", NUM), Stage("StandardScaler", NUM), Stage("Normalizer", NUM), Stage("RFE"))),
    Spec("onehot", ("f1", "f3", "c1"), (Stage("OneHotEncoder", ("c1",)),
                                        Stage("replace", ("f3",), (("to_replace", 0.0), ("value", -1.0))))),
    Spec("ordinal", ("f1", "f3", "c1"), (Stage("OrdinalEncoder", ("c1",)), Stage("StandardScaler", ("f1", "f3")))),
    Spec("dummies", ("f1", "f3", "c2"), (Stage("get_dummies", ("c2",)),)),
    Spec("mapped", ("f1", "f3", "c1"), (Stage("map", ("c1",), (("arg", MAPPING),)),
                                        Stage("fillna", ("c1",), (("method", "ffill"),)), Stage("SimpleImputer", ("c1",)))),
)


def candidates(spark: SparkSession) -> dict[tuple[str, str], list[tuple[int, str, object]]]:
    """The catalog's candidates without placeholders, in catalog order (a fixed table of 170 values)."""
    rows = catalog_rows(spark).where("ord is not null and not is_placeholder and not no_params").orderBy(
        "method_ord", "param_ord", "ord").select("method", "param", "ord", "value_text", "value_json").collect()
    out: dict[tuple[str, str], list[tuple[int, str, object]]] = {}
    for r in rows:
        out.setdefault((r["method"], r["param"]), []).append((r["ord"], r["value_text"], json.loads(r["value_json"])))
    return out


def trial_name(t: Trial) -> str:
    value = "".join({"[": "", "]": "", ",": "_", " ": ""}.get(c, c) for c in t.value_text)
    return f"{t.spec.name}_modified_{t.method}_{t.param}_{value}" if t.stage >= 0 else f"{t.spec.name}_baseline"


def sweep_scores(spark: SparkSession, result: SweepResult) -> DataFrame:
    """A row per trial."""
    rows = [(s.trial.spec.name, trial_name(s.trial), s.trial.stage, s.trial.method, s.trial.param, s.trial.ord,
             s.trial.value_text, s.status, s.error, s.n_used, s.mse, s.r2) for s in result.scores]
    return spark.createDataFrame(rows, "spec string, trial_id string, stage int, method string, param string, ord int, "
                                 "value string, status string, error string, n_used int, mse double, r2 double")


def first_pairs(trials: Sequence[Trial], n: int) -> list[Trial]:
    """K4: the baselines and the trials of each pipeline's first ``n`` (stage, parameter) pairs, in stage and catalog
    order."""
    pairs: dict[str, list[tuple[int, str]]] = {}
    for t in trials:
        own = pairs.setdefault(t.spec.name, [])
        if t.stage >= 0 and (t.stage, t.param) not in own:
            own.append((t.stage, t.param))
    return [t for t in trials if t.stage < 0 or (t.stage, t.param) in pairs[t.spec.name][:n]]


def _sweep(spark: SparkSession, sf: str, trials: Sequence[Trial]) -> DataFrame:
    table = fx(spark, sf).select("id", *NUM, "c1", "c2", "target", "is_test")
    return sweep_scores(spark, run_sweep(table, trials, "target", ~F.col("is_test"), "id"))


def best_values(scores: DataFrame, first: int) -> DataFrame:
    """K4 + K3: of each spec the first ``first`` (stage, parameter) pairs, with the candidate of least mse (ties: the
    earlier one), the baseline's mse and the number of failed trials.  One row of scores a trial."""
    swept = scores.where("stage >= 0")
    pairs = swept.groupBy("spec", "stage", "method", "param").agg(
        F.min("trial_order").alias("at"), F.count("*").alias("n_trials"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.min(F.when(F.col("status") == "ok", F.struct(F.round("mse", 9).alias("near"), "ord", "value", "mse"))).alias(
            "best"))  # scores that differ by rounding only are ties
    ranked = pairs.withColumn("pair_rank", F.row_number().over(Window.partitionBy("spec").orderBy("at")))  # a spec's pairs
    base = scores.where("stage < 0").select("spec", F.col("mse").alias("baseline_mse"))
    return ranked.where(F.col("pair_rank") <= first).join(base, "spec").select(
        "spec", "method", "param", F.col("pair_rank").cast("bigint").alias("pair_rank"), "n_trials", "n_failed",
        F.col("best.value").alias("best_value"), F.col("best.mse").alias("best_mse"), "baseline_mse")


# ----------------------------------------------------------------------------- twin

LEVELS = {"c1": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
          "c2": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
EPS = "2.220446049250313e-15"
SELECTING = ("VarianceThreshold", "SelectKBest", "SelectFromModel", "RFE")


def _py_text(v) -> str:
    return "[" + ", ".join(_py_text(x) for x in v) + "]" if isinstance(v, list) else str(v)


def _sql_candidates() -> dict:
    out = {}
    for m, params in catalog_dict().items():
        for p, info in params.items():
            out[m, p] = [(o, _py_text(v), v) for o, v in enumerate(info.get("allowed_values", []))
                         if not (isinstance(v, str) and v in PLACEHOLDERS)]
    return {k: v for k, v in out.items() if v and k[0] != "LabelEncoder"}


def _failure(stage: Stage) -> str | None:
    """The failures that the parameters alone decide."""
    p = dict(stage.params)
    if stage.method == "fillna" and p.get("value") is not None and p.get("method") is not None:
        return "ValueError"
    if stage.method == "OrdinalEncoder" and (p.get("handle_unknown", "error") == "use_encoded_value") == (
            p.get("unknown_value") is None):
        return "TypeError"
    if stage.method == "SelectFromModel" and (p.get("prefit") or (p.get("max_features") or 0) > len(NUM)
                                              or p.get("threshold") == 1.0):
        return "ValueError"
    return None


class _Chain:
    """CTEs of the stages: every distinct prefix is written once."""

    def __init__(self):
        self.ctes: list[str] = []
        self.known: dict[tuple, tuple[str, list[str]]] = {}

    def root(self, columns: Sequence[str]) -> tuple[str, list[str]]:
        key = ("root", tuple(columns))
        if key not in self.known:
            name = f"n{len(self.known)}"
            items = ", ".join(f"{c} x{i}" for i, c in enumerate(columns))
            self.ctes.append(f"{name} as materialized (select id, not is_test tr, target::DOUBLE y, {items} from fx)")
            self.known[key] = name, list(columns)
        return self.known[key]

    def stage(self, at: tuple[str, list[str]], stage: Stage) -> tuple[str, list[str]]:
        params = {k: v for k, v in stage.params if k not in NO_EFFECT}
        key = (at[0], stage.method, stage.columns, json.dumps(params, sort_keys=True, default=str))
        if key not in self.known:
            stats, new = self.items(at, stage, params)
            name = f"n{len(self.known)}"
            items = ", ".join(f"{e} x{i}" for i, (_, e) in enumerate(new))
            joined = f", (select {', '.join(stats)} from {at[0]} where tr) st" if stats else ""
            self.ctes.append(f"{name} as materialized (select id, tr, y, {items} from (select *, row_number() over "
                             f"(order by id) rn from {at[0]}){joined})")
            self.known[key] = name, [n for n, _ in new]
        return self.known[key]

    def items(self, at: tuple[str, list[str]], stage: Stage, p: dict) -> tuple[list[str], list[tuple[str, str]]]:
        src, names = at
        place = {n: f"x{i}" for i, n in enumerate(names)}
        new = {n: x for n, x in place.items()}
        stats, last = [], {}
        xs = [place[c] for c in stage.columns]
        for c, x in zip(stage.columns, xs):
            m = stage.method
            if m == "SimpleImputer":
                how = p.get("strategy", "mean")
                stats.append({"mean": f"avg({x})", "median": f"quantile_cont({x}, 0.5)", "constant": "0.0",
                              "most_frequent": f"(select {x} from {src} where tr and {x} is not null group by 1 order by "
                                               "count(*) desc, 1 limit 1)"}[how] + f" s_{x}")
                new[c] = f"coalesce({x}, s_{x})::DOUBLE"
                if p.get("add_indicator") and c not in ("f1", "f3"):  # these two have no missing values
                    last[f"missing_{c}"] = f"({x} is null)::INT::DOUBLE"
            elif m == "StandardScaler":
                stats += [f"avg({x}) m_{x}", f"case when stddev_pop({x}) < {EPS} then 1 else stddev_pop({x}) end s_{x}"]
                new[c] = f"({x} - {f'm_{x}' if p.get('with_mean', True) else '0'}) / {f's_{x}' if p.get('with_std', True) else '1'}"
            elif m == "MinMaxScaler":
                lo, hi = p.get("feature_range", (0.0, 1.0))
                stats += [f"min({x}) m_{x}", f"case when max({x}) - min({x}) < {EPS} then 1 else max({x}) - min({x}) end s_{x}"]
                e = f"({x} - m_{x}) / s_{x} * ({hi} - ({lo})) + ({lo})"
                new[c] = f"least(greatest({e}, {lo}), {hi})" if p.get("clip") else e
            elif m == "RobustScaler":
                unit = "1.3489795003921634" if p.get("unit_variance") else "1"
                stats += [f"quantile_cont({x}, 0.5) m_{x}", f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) s_{x}"]
                scale = f"(case when s_{x} < {EPS} then 1 else s_{x} end / {unit})" if p.get("with_scaling", True) else "1"
                new[c] = f"({x} - {f'm_{x}' if p.get('with_centering', True) else '0'}) / {scale}"
            elif m == "Normalizer":
                n = {"l1": " + ".join(f"abs({k})" for k in xs), "l2": "sqrt(" + " + ".join(f"{k} * {k}" for k in xs) + ")",
                     "max": "greatest(" + ", ".join(f"abs({k})" for k in xs) + ")"}[p.get("norm", "l2")]
                new[c] = f"{x} / (case when ({n}) = 0 then 1 else ({n}) end)"
            elif m == "PolynomialFeatures":
                del new[c]
                degree = 1 if p.get("interaction_only") else p.get("degree", 2)
                for d in range(0 if p.get("include_bias", True) else 1, degree + 1):
                    last[f"{c}^{d}"] = " * ".join(["1.0::DOUBLE"] + [x] * d)
            elif m == "OneHotEncoder":
                del new[c]
                for v in LEVELS[c][1 if p.get("drop") == "first" else 0:]:
                    last[f"{c}_{v}"] = f"coalesce({x} = '{v}', false)::INT::DOUBLE"
            elif m == "get_dummies":
                del new[c]
                levels = [f"coalesce({x} = '{v}', false)::INT::DOUBLE" for v in LEVELS[c]]
                if p.get("dummy_na"):
                    levels.append(f"({x} is null)::INT::DOUBLE")
                last |= {f"{c}_{i}": e for i, e in enumerate(levels[1 if p.get("drop_first") else 0:])}
            elif m == "OrdinalEncoder":
                new[c] = f"(list_position({LEVELS[c]!r}, {x}) - 1)::DOUBLE"
            elif m == "map":
                new[c] = f"case {x} " + " ".join(f"when '{k}' then {v}" for k, v in p["arg"]) + " end"
            elif m == "replace":
                new[c] = x if p.get("regex") else f"case when {x} = {p['to_replace']} then {p['value']} else {x} end"
            elif m == "fillna" and p.get("method") == "ffill":
                far = (f"rn - max(case when {x} is not null then rn end) over (order by id rows unbounded preceding) "
                       f"<= {p['limit']}" if p.get("limit") else "true")
                if p.get("axis") != 1:
                    new[c] = (f"case when {far} then last_value({x} ignore nulls) over (order by id rows unbounded "
                              "preceding) end")
            elif m == "fillna":
                near = (f"count(case when {x} is null then 1 end) over (order by id rows unbounded preceding) <= {p['limit']}"
                        if p.get("limit") else "true")
                new[c] = f"case when {x} is null and {near} then {p['value']} else {x} end"
            else:
                raise KeyError(m)
        return stats, [*new.items(), *last.items()]


def _sweep_ctes() -> str:
    """CTE ``scores``: a row per trial."""
    trials = expand(SPECS, _sql_candidates())
    chain = _Chain()
    runs: dict[tuple, int] = {}
    rows, matrices = [], []
    for n, t in enumerate(trials):
        error = next((e for e in map(_failure, t.spec.stages) if e), None)
        g = "null"
        if error is None:
            at = chain.root(t.spec.columns)
            choose = None
            for s in t.spec.stages:
                if s.method in SELECTING:
                    choose = s
                else:
                    at = chain.stage(at, s)
            key = at[0], choose
            if key not in runs:
                runs[key] = len(runs)
                matrices.append((runs[key], at, choose))
            g = str(runs[key])
        value = t.value_text.replace("'", "''")
        rows.append(f"({n}, '{t.spec.name}', '{trial_name(t)}', {t.stage}, '{t.method}', '{t.param}', {t.ord}, '{value}', "
                    f"{g}, {'null' if error is None else repr(error)})")
    most = max(len(at[1]) for _, at, _ in matrices)
    y = most + 1
    cells, flags, pre, holes = [], [], [], []
    for g, (src, names), choose in matrices:
        xs = [f"x{i}" for i in range(len(names))]
        st = ", ".join(f"avg({x}) m_{x}, case when stddev_pop({x}) > 1e-12 * greatest(abs(avg({x})), 1e-300) then "
                       f"stddev_pop({x}) else 1 end s_{x}" for x in [*xs, "y"])
        parts = [("1.0::DOUBLE", 0)] + [(f"z{x}", i + 1) for i, x in enumerate(xs)] + [("zy", y)]
        pairs = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': sum({a} * {b})}}" for a, i in parts for b, j in parts)
        units = ", ".join(f"({i + 1}, s_y / s_{x})" for i, x in enumerate(xs))
        cells.append(f"select {g} run, tr, unnest([{pairs}]) c from (select tr, "
                     + ", ".join(f"({x} - m_{x}) / s_{x} z{x}" for x in [*xs, 'y']) + f" from {src}, (select {st} from {src})) group by tr")
        holes.append(f"select {g} run, unnest([{', '.join(str(i + 1) for i in range(len(xs)))}]) k, "
                     f"unnest([{', '.join(f'count({x}) < count(*)' for x in xs)}]) hole from {src}")
        p = dict(choose.params) if choose else {}
        ks = f"unnest(range(1, {len(xs) + 1}))"
        if choose is None or choose.method in ("SelectFromModel", "RFE"):
            (flags if choose is None else pre).append(f"select {g} run, {ks} k")
        if choose is None:
            continue
        if choose.method == "VarianceThreshold":
            flags += [f"select {g} run, {i + 1} k from {src} where tr having var_pop({x}) > {p.get('threshold', 0.0)}"
                      for i, x in enumerate(xs)]
        elif choose.method == "SelectKBest":
            one = " union all ".join(f"select {i + 1} k, y, {x}::DOUBLE x from {src} where tr" for i, x in enumerate(xs))
            flags.append(f"""select {g} run, k from (select k, row_number() over (order by f desc nulls last, k) rk from (
  select k, case when ssw = 0 then null else ssb / (ssw / (nn - 2)) end f from (select k, sum(n * v) ssw, sum(n) nn,
    sum(n * (m - gm) * (m - gm)) ssb from (select *, sum(n * m) over (partition by k) / sum(n) over (partition by k) gm
    from (select k, y, count(*) n, avg(x) m, var_pop(x) v from ({one}) group by 1, 2)) group by 1))) where rk <= {p.get('k', 10)}""")
        elif choose.method == "SelectFromModel":
            cut = {None: "avg(w) over ()", "mean": "avg(w) over ()", "median": "median(w) over ()"}.get(
                p.get("threshold"), str(p.get("threshold")))
            flags.append(f"select {g} run, k from (select k, w, {cut} cut from (select k, abs(coef * u) w from precoef "
                         f"join (values {units}) t(k, u) using (k) join (select {st} from {src}) on true where run = {g})) where w >= cut"
                         .replace(f"join (values {units}) t(k, u) using (k) join (select {st} from {src}) on true",
                                  f"join (select unnest([{', '.join(str(i + 1) for i in range(len(xs)))}]) k, "
                                  f"unnest([{', '.join(f's_y / s_{x}' for x in xs)}]) u from (select {st} from {src})) using (k)"))
        else:
            n_keep = len(xs) // 2 if p.get("n_features_to_select") is None else min(p["n_features_to_select"], len(xs))
            step = p.get("step", 1)
            step = max(1, int(step * len(xs))) if isinstance(step, float) and step < 1 else int(step)
            unit = (f"(select unnest([{', '.join(str(i + 1) for i in range(len(xs)))}]) k, unnest([{', '.join(f's_y / s_{x}' for x in xs)}]) u "
                    f"from (select {st} from {src}))")
            gone = min(step, len(xs) - n_keep)
            flags.append(f"select {g} run, k from rfe{1 if gone == len(xs) - n_keep else 2} where run = {g} and rk > "
                         f"{gone if gone == len(xs) - n_keep else len(xs) - n_keep - gone}")
            pre.append(f"select {g} run, -1 k where false")
            chain.rfe = [*getattr(chain, "rfe", []), (g, unit, gone)]
    rank = "row_number() over (partition by run order by (coef * u) * (coef * u), k) rk"
    units1 = " union all ".join(f"select {g} run, k, u from {unit}" for g, unit, _ in chain.rfe)
    gone1 = ", ".join(f"({g}, {gone})" for g, _, gone in chain.rfe)

    def coefs(swept: str, runs_: str) -> str:
        return (f"(select c.g run, c.i k, case when d.v < -1e-10 then c.v else 0 end coef from {swept} c join {swept} d "
                f"on d.g = c.g and d.i = c.i and d.j = c.i where c.j = {y} and c.i between 1 and {most} and c.g in (select run from {runs_}))")

    zero = "select distinct run g, 0 k from {0} union all select run, k from {0}"
    return ",\n".join([
        FX_SQL.strip(), *chain.ctes,
        f"cells as materialized (select run g, tr, c.i, c.j, c.v from ({' union all '.join(cells)}))",
        "fitcells as (select g, i, j, v from cells where tr)",
        f"pre as materialized ({' union all '.join(pre)})", f"preinc as ({zero.format('pre')})",
        sweeps_sql("(select * from fitcells where g in (select run from pre))", list(range(most + 1)), "preinc", "p"),
        f"precoef as materialized {coefs('p', 'pre')}",
        f"unit1 as materialized ({units1})",
        f"rfe1 as materialized (select run, k, {rank} from precoef join unit1 using (run, k))",
        f"left1 as materialized (select run, k from rfe1 join (values {gone1}) t(run, gone) using (run) where rk > gone)",
        f"leftinc as ({zero.format('left1')})",
        sweeps_sql("(select * from fitcells where g in (select run from left1))", list(range(5)), "leftinc", "q"),
        f"rfe2 as materialized (select run, k, {rank} from {coefs('q', 'left1')} join unit1 using (run, k) join left1 using (run, k))",
        f"chosen as materialized ({' union all '.join(flags)})",
        f"missing as materialized (select distinct run g from ({' union all '.join(holes)}) join chosen using (run, k) where hole)", f"inc as ({zero.format('chosen')})",
        sweeps_sql("fitcells", list(range(most + 1)), "inc", "s"),
        f"""w as materialized (select c.g, c.i, case when d.v < -1e-10 then c.v else 0 end w, d.v < -1e-10 used
  from s c join s d on d.g = c.g and d.i = c.i and d.j = c.i where c.j = {y} and c.i < {y}
  union all select distinct g, {y}, -1, false from s)""",
        "ev as (select * from cells where not tr)",
        "sse as (select e.g, sum(a.w * b.w * e.v) sse from ev e join w a on a.g = e.g and a.i = e.i join w b on b.g = e.g and b.i = e.j group by 1)",
        f"""fitted as (select sse.g, sse / n.v * (select var_pop(target) from fx) mse,
  1 - sse / (yy.v - sy.v * sy.v / n.v) r2, (select count(*) from w where w.g = sse.g and used and i between 1 and {most}) n_used
  from sse join ev n on n.g = sse.g and n.i = 0 and n.j = 0 join ev yy on yy.g = sse.g and yy.i = {y} and yy.j = {y}
  join ev sy on sy.g = sse.g and sy.i = 0 and sy.j = {y})""",
        f"""scores as materialized (select t.* exclude (error), coalesce(error, case when m.g is not null then 'ValueError' end) error,
   case when error is null and m.g is null then 'ok' else 'failed' end status,
   case when m.g is null then n_used end n_used, case when m.g is null then mse end mse, case when m.g is null then r2 end r2
  from (values {', '.join(rows)}) t(trial_order, spec, trial_id, stage, method, param, ord, value, g, error)
  left join fitted f on f.g = t.g left join missing m on m.g = t.g)"""])


_CTES = _sweep_ctes()


@register("sweep_run", f"""with {_CTES}
select spec, trial_id, method, param, ord, value, status, error, n_used::INT n_used, round(mse, 6) mse, round(r2, 6) r2 from scores""")
def q_sweep_run(spark: SparkSession, sf: str) -> DataFrame:
    """M8: every pipeline's baseline and one trial for each candidate of each parameter, failures recorded."""
    return _sweep(spark, sf, expand(SPECS, candidates(spark))).select(
        "spec", "trial_id", "method", "param", "ord", "value", "status", F.regexp_extract("error", r"^(\w+):", 1).alias("e"),
        "n_used", F.round("mse", 6).alias("mse"), F.round("r2", 6).alias("r2")).withColumn(
        "error", F.when(F.col("e") != "", F.col("e"))).drop("e")


@register("sweep_multi", f"""with {_CTES},
pairs as (select spec, stage, method, param, min(trial_order) first, count(*) n_trials, count(*) filter (status = 'failed') n_failed,
  arg_min(value, (round(mse, 9), ord)) filter (status = 'ok') best_value, arg_min(mse, (round(mse, 9), ord)) filter (status = 'ok') best_mse from scores where stage >= 0 group by all),
ranked as (select *, row_number() over (partition by spec order by first) pair_rank from pairs),
book as (select 'nb' || (p_partkey % 50) notebook, ([{', '.join(repr(s.name) for s in SPECS)}])[(p_partkey % {len(SPECS)} + 1)::INT] spec
  from part group by all)
select notebook, spec, method, param, pair_rank, n_trials, n_failed, best_value, round(best_mse, 6) best_mse,
  round(b.mse, 6) baseline_mse from book join ranked using (spec) join (select spec, mse from scores where stage < 0) b using (spec)
where pair_rank <= 2""")
def q_sweep_multi(spark: SparkSession, sf: str) -> DataFrame:
    """M9: for every notebook, the sweep of the first two modifiable pairs of its pipeline."""
    trials = first_pairs(expand(SPECS, candidates(spark)), 2)
    scores = _sweep(spark, sf, trials)
    order = {trial_name(t): i for i, t in enumerate(trials)}
    scores = scores.join(F.broadcast(spark.createDataFrame(list(order.items()), "trial_id string, trial_order int")), "trial_id")
    k = F.col("p_partkey")
    book = read_table(spark, sf, "part").select(
        F.concat(F.lit("nb"), (k % 50).cast("string")).alias("notebook"), F.element_at(F.array(*[
            F.lit(s.name) for s in SPECS]), (k % len(SPECS) + 1).cast("int")).alias("spec")).distinct()
    best = best_values(scores, 2)
    return book.join(F.broadcast(best), "spec").select(  # two rows a pipeline
        "notebook", "spec", "method", "param", "pair_rank", "n_trials", "n_failed", "best_value",
        F.round("best_mse", 6).alias("best_mse"), F.round("baseline_mse", 6).alias("baseline_mse"))
