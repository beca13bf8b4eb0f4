"""Linear models by additive statistics (M1, M4, M5, F11, F12) and their DuckDB twins.

The twins build the same second moments with SQL sums and solve them with sweeps, one common table expression a
column; they share no code with the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import LabelEncoder
from ..operators.gram import LinearSpec, moments, search_specs
from ..operators.impute import TrainStatImputer
from ..operators.select import RFE, SelectFromModel
from ..sources.tables import read_table
from .fixtures import FX_SQL, fx_split, md5_bucket
from .registry import register

TOL = "1e-9"


# ----------------------------------------------------------------------------- SQL least squares


def scaled_sql(src: str, cols: list[str], out: str = "z", raw: bool = False) -> str:
    """CTEs ``{out}st`` and ``{out}``: src(g, cols) centred (unless raw) and scaled by overall mean and deviation."""
    stats = ", ".join(f"avg({c}) m_{c}, case when stddev_pop({c}) > 1e-12 * greatest(abs(avg({c})), 1e-300) "
                      f"then stddev_pop({c}) else 1 end s_{c}" for c in cols)
    z = ", ".join(f"({c}{'' if raw else f' - m_{c}'}) / s_{c} {c}" for c in cols)
    return f"{out}st as materialized (select {stats} from {src}), {out} as (select g, {z} from {src}, {out}st)"


def cells_sql(src: str, cols: list[str], out: str = "cell") -> str:
    """CTE out(g, i, j, v): moments of (1, cols...) of every g."""
    names = ["1.0::DOUBLE", *cols]
    items = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': sum({a} * {b})}}" for i, a in enumerate(names)
                      for j, b in enumerate(names))
    return (f"{out} as materialized (select g, c.i, c.j, c.v from (select g, unnest([{items}]) c from {src} group by g))")


def sweeps_sql(src: str, ks: list[int], inc: str, name: str) -> str:
    """CTEs {name}0 .. {name}n from src(g, i, j, v): sweep every k in that inc(g, k) lists and whose pivot is large
    enough; the last one is ``{name}``."""
    parts = [f"{name}0 as materialized (select g, i, j, v from {src})"]
    for n, k in enumerate(ks):
        a, last = f"{name}{n}", n == len(ks) - 1
        parts.append(f"""{name if last else f'{name}{n + 1}'} as materialized (select a.g, a.i, a.j, case when p.g is null then a.v
   when a.i = {k} and a.j = {k} then -1 / p.v when a.i = {k} or a.j = {k} then a.v / p.v
   else a.v - r.v * c.v / p.v end v
  from {a} a left join (select s.g, s.v from {a} s join {name}0 o using (g, i, j) join {inc} inc on inc.g = s.g and inc.k = {k}
    where s.i = {k} and s.j = {k} and s.v > {TOL} * o.v) p on p.g = a.g
  left join {a} r on r.g = a.g and r.i = a.i and r.j = {k} left join {a} c on c.g = a.g and c.i = {k} and c.j = a.j)""")
    return ",\n".join(parts)


# ----------------------------------------------------------------------------- M1, M4, M5: every recorded linear model

LINEAR_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
FOLDS, VALID = 5, 9


def linear_records(spark: SparkSession, sf: str) -> DataFrame:
    """A LinearRegression record for every ``part`` row: the features that its notebook keeps (bits of p_size) and
    its recorded keyword arguments."""
    k, size = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("int")
    used = F.filter(F.array(*[F.when((size % 31 + 1).bitwiseAND(1 << i) > 0, F.lit(c))
                              for i, c in enumerate(LINEAR_FEATURES)]), lambda x: x.isNotNull())
    kwargs = F.when(k % 3 == 1, F.create_map(F.lit("fit_intercept"), F.lit("True"))).when(
        k % 3 == 2, F.create_map(F.lit("fit_intercept"), F.lit("False"), F.lit("n_jobs"), F.lit("-1"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return read_table(spark, sf, "part").select(
        F.concat(F.lit("nb"), (k % 30).cast("string")).alias("notebook"), k.alias("cell_index"),
        used.alias("features"), kwargs.alias("kwargs"))


def linear_search(data: DataFrame, records: DataFrame, label: str, part: str, folds: int, valid: int) -> DataFrame:
    """Every record's cross-validated and refitted scores.  ``part`` is the fold number of a training row, or
    ``valid``.  Records that mean the same fit share it; the rows of ``data`` are read three times (scales, moments,
    absolute errors) whatever the number of records, folds and settings."""
    intercept = F.coalesce(F.element_at("kwargs", F.lit("fit_intercept")), F.lit("True")) != "False"
    planned = records.withColumn("intercept", intercept)
    distinct = planned.select("features", "intercept").distinct().collect()  # at most 2 ** features * 2
    specs = sorted({LinearSpec(tuple(r["features"]), r["intercept"]) for r in distinct}, key=lambda s: (s.features, s.intercept))
    columns = sorted({f for s in specs for f in s.features})
    m = moments(data, [*columns, label], F.col(part))
    rows = search_specs(m, specs, label, range(folds), valid)
    refits = [r for r in rows if r["fold"] == -1]
    y = F.col(label).cast("double")
    errors = data.filter(F.col(part) == valid).agg(*[F.avg(F.abs(y - r["fit"].predict())).alias(f"e{r['spec']}")
                                                     for r in refits]).first()
    out = []
    for r in refits:
        own = [x for x in rows if x["spec"] == r["spec"] and x["fold"] >= 0]
        s = specs[r["spec"]]
        out.append((list(s.features), s.intercept, sum(x["r2"] for x in own) / len(own), sum(x["mse"] for x in own) / len(own),
                    r["mse"], errors[f"e{r['spec']}"], r["r2"]))
    found = data.sparkSession.createDataFrame(
        out, "features array<string>, intercept boolean, cv_r2 double, cv_mse double, mse double, mae double, r2 double")
    return planned.join(F.broadcast(found), ["features", "intercept"])  # one row a distinct fit


def _search_linear_sql() -> str:
    p = len(LINEAR_FEATURES)
    y, cols = p + 1, [*LINEAR_FEATURES, "y"]
    names = "[" + ", ".join(f"'{c}'" for c in LINEAR_FEATURES) + "]"
    weights = " + ".join(f"w{i} * {c}" for i, c in enumerate(LINEAR_FEATURES, 1))
    return f"""with d as (select case when ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 20 then {VALID}
    else ('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 8))::BIGINT % {FOLDS} end g,
   {', '.join(f'{c}::DOUBLE {c}' for c in LINEAR_FEATURES)}, l_extendedprice y from lineitem),
{scaled_sql('d', cols)}, {cells_sql('z', cols)},
{scaled_sql('d', cols, 'q', raw=True)}, {cells_sql('q', cols, 'rcell')},
rec as (select 'nb' || (p_partkey % 30) notebook, p_partkey::BIGINT cell_index, (p_size % 31 + 1)::INT mask,
   p_partkey % 3 <> 2 intercept from part),
spec as (select distinct mask, intercept, mask * 2 + intercept::INT s from rec),
run as (select *, s * 10 + f g from spec, (select unnest([0, 1, 2, 3, 4, 7]) f)),
typed as (select true intercept, * from cell union all select false, * from rcell),
a as (select run.g, t.i, t.j, sum(t.v) v from run join typed t on t.intercept = run.intercept and t.g < {FOLDS} and t.g <> run.f
  group by all),
inc as (select g, 0 k from run where intercept union all
  select g, k from run, (select unnest(range(1, {p + 1})) k) where (mask >> (k - 1)::INT) & 1 = 1),
{sweeps_sql('a', list(range(p + 1)), 'inc', 'swept')},
w as (select c.g, c.i, case when d.v < -1e-10 then c.v else 0 end w from swept c join swept d on d.g = c.g and d.i = c.i and d.j = c.i
  where c.j = {y} and c.i < {y} union all select g, {y}, -1 from run),
e as (select run.g, t.i, t.j, t.v from run join typed t on t.intercept = run.intercept
  and t.g = case when run.f = 7 then {VALID} else run.f end),
u as (select run.g, n.v n, yy.v - sy.v * sy.v / n.v tss from run, cell n, cell yy, cell sy where n.i = 0 and n.j = 0
  and yy.i = {y} and yy.j = {y} and sy.i = 0 and sy.j = {y} and n.g = case when run.f = 7 then {VALID} else run.f end
  and yy.g = n.g and sy.g = n.g),
sc as (select e.g, sum(a.w * b.w * e.v) sse from e join w a on a.g = e.g and a.i = e.i join w b on b.g = e.g and b.i = e.j group by 1),
s as (select run.s, f, sse / n * s_y * s_y mse, 1 - sse / tss r2 from sc join u using (g) join run using (g), zst),
wide as (select run.s, any_value(intercept) intercept, {', '.join(f'max(w) filter (i = {i}) z{i}' for i in range(p + 1))}
  from w join run using (g) where f = 7 group by 1),
coef as (select s, {', '.join(f'z{i} * s_y / s_{c} w{i}' for i, c in enumerate(LINEAR_FEATURES, 1))},
  case when intercept then m_y + s_y * z0 - ({' + '.join(f'z{i} * s_y / s_{c} * m_{c}' for i, c in enumerate(LINEAR_FEATURES, 1))})
    else 0 end w0 from wide, zst),
err as (select s, avg(abs(y - (w0 + {weights}))) mae from d, coef where g = {VALID} group by 1),
cv as (select s, avg(mse) cv_mse, avg(r2) cv_r2 from s where f <> 7 group by 1)
select notebook, cell_index, array_to_string(list_filter({names}, lambda x, i: (mask >> (i - 1)::INT) & 1 = 1), ',') features,
  rec.intercept, cv_r2::REAL cv_r2, cv_mse::REAL cv_mse, s.mse::REAL mse, mae::REAL mae, s.r2::REAL r2
from rec join spec using (mask, intercept) join cv using (s) join err using (s) join s using (s) where f = 7"""


@register("search_linear", _search_linear_sql())
def q_search_linear(spark: SparkSession, sf: str) -> DataFrame:
    """M1/M4/M5: the recorded linear models, cross-validated over 5 folds, refitted and scored on the validation rows."""
    d = read_table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    data = d.select(*LINEAR_FEATURES, F.col("l_extendedprice").alias("y"), F.when(
        md5_bucket(F.col("l_orderkey")) % 100 < 20, VALID).otherwise(md5_bucket(key) % FOLDS).cast("int").alias("part"))
    out = linear_search(data, linear_records(spark, sf), "y", "part", FOLDS, VALID)
    return out.select("notebook", "cell_index", F.array_join("features", ",").alias("features"), "intercept", *[
        F.col(c).cast("float").alias(c) for c in ("cv_r2", "cv_mse", "mse", "mae", "r2")])


# ----------------------------------------------------------------------------- F11, F12 on all rows and columns

NUM, CAT = ["f1", "f2", "f3"], ["c1", "c2", "c3"]


def coded_train(spark: SparkSession, sf: str) -> DataFrame:
    """The training rows, numbers and categories imputed from train, categories as label codes."""
    train, _ = fx_split(spark, sf)
    out = TrainStatImputer(exclude=("id", "target", "is_test")).fit(train).transform(train)
    for c in CAT:
        out = LabelEncoder().fit(out, c).transform(out)
    return out.select(*NUM, *CAT, "target")


def _coded_sql() -> str:
    modes = ", ".join(f"(select {c} from train where {c} is not null group by 1 order by count(*) desc, 1 limit 1) {c}" for c in CAT)
    filled = ", ".join([f"coalesce({c}, (select avg({c}) from train)) {c}" for c in NUM]
                       + [f"coalesce(train.{c}, k.{c}) {c}" for c in CAT])
    ranks = ", ".join(f"(dense_rank() over (order by {c}) - 1)::DOUBLE {c}" for c in CAT)
    cols = [*NUM, *CAT, "y"]
    return f"""{FX_SQL}, k as (select {modes}), filled as (select {filled}, target::DOUBLE y from train, k),
d as (select 0 g, {', '.join(NUM)}, y, {ranks} from filled), {scaled_sql('d', cols)}, {cells_sql('z', cols)},
inc as (select 0 g, unnest(range(0, 7)) k), {sweeps_sql('cell', list(range(7)), 'inc', 's0_')},
f as (select unnest({[*NUM, *CAT]!r}) feature, unnest(range(1, 7)) k, unnest([{', '.join(f's_y / s_{c}' for c in cols[:-1])}]) unit
  from zst)"""


@register("select_from_model", f"""with {_coded_sql()},
c as (select feature, abs(case when d.v < -1e-10 then s.v * unit else 0 end) importance from f join s0_ s on s.i = k and s.j = 7
  join s0_ d on d.i = k and d.j = k)
select feature, importance::REAL importance, importance >= avg(importance) over () selected from c""")
def q_select_from_model(spark: SparkSession, sf: str) -> DataFrame:
    """F11 over every training row and column: features whose least-squares weight is the mean weight at least."""
    out = SelectFromModel(threshold="mean", estimator="linear").fit(coded_train(spark, sf), NUM + CAT, "target")
    return out.withColumn("importance", F.col("importance").cast("float"))


def _rfe_sql() -> str:
    """Five eliminations, each a sweep out of the feature of smallest squared weight."""
    parts = ["s1_ as materialized (select * from s0_)", "gone0 as (select 0 k, 0 round where false)"]
    for n in range(1, 6):
        parts += [f"""out{n} as materialized (select k, {n} round, d.v d from f join s{n}_ s on s.i = k and s.j = 7
  join s{n}_ d on d.i = k and d.j = k where k not in (select k from gone{n - 1})
  order by case when d.v < -1e-10 then s.v * s.v * unit * unit else 0 end, k limit 1)""",
                  f"gone{n} as materialized (select k, round from gone{n - 1} union all select k, round from out{n})",
                  f"""s{n + 1}_ as materialized (select a.i, a.j, case when o.d >= -1e-10 then a.v
    when a.i = o.k and a.j = o.k then -1 / o.d when a.i = o.k or a.j = o.k then -a.v / o.d
    else a.v - r.v * c.v / o.d end v from s{n}_ a, out{n} o, s{n}_ r, s{n}_ c
  where r.i = a.i and r.j = o.k and c.i = o.k and c.j = a.j)"""]
    return f"""with {_coded_sql()}, {', '.join(parts)}
select feature, coalesce(7 - round, 1)::INT ranking, round is null selected from f left join gone5 using (k)"""


@register("rfe", _rfe_sql())
def q_rfe(spark: SparkSession, sf: str) -> DataFrame:
    """F12 over every training row and column, down to one feature, one a round."""
    return RFE(n_features_to_select=1, step=1, estimator="linear").fit(coded_train(spark, sf), NUM + CAT, "target")
