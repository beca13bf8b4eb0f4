"""Preprocessing queries (S1, P1-P4, F1-F19, A1-A7) over the fixtures, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, first_seen_codes, get_dummies, join_codes
from ..operators.frame import dropna, drop, fillna, map_values, replace
from ..operators.impute import SimpleImputer, TrainStatImputer
from ..operators.scale import MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from ..sources.tables import align_columns, drop_cols, read_table, select_dtypes
from .fixtures import FX_FRAME_SQL, FX_SQL, fx, fx_frame, fx_split
from .registry import long_form, r6, register

NUM = ["f1", "f2", "f3"]
EPS = "2.220446049250313e-15"


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


# --------------------------------------------------------------------------- step 1


@register("split_hash", f"with {FX_SQL} select id, is_test from fx")
def q_split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return fx(spark, sf).select("id", "is_test")


def _std_sql() -> str:
    stats = ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in NUM)
    cols = ", ".join(
        f"round(({c} - m_{c}) / case when s_{c} < {EPS} then 1 else s_{c} end, 6) {c}" for c in NUM)
    return f"with {FX_SQL}, s as (select {stats} from train) select id, is_test, {cols} from fx, s"


@register("scale_standard", _std_sql())
def q_scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf)
    train = d.filter(~F.col("is_test"))
    model = StandardScaler().fit(train, NUM)
    return _rounded(model.transform(d).select("id", "is_test", *NUM), NUM)


@register("select_dtypes", f"with {FX_SQL} select id, f1, f2, f3, target from train")
def q_select_dtypes(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    return select_dtypes(train, "number")


@register("select_dtypes_cat", f"with {FX_SQL} select c1, c2, c3, is_test from train")
def q_select_dtypes_cat(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    return select_dtypes(train, "category")


@register("align_columns", f"with {FX_SQL} select id, f1, f2, f3, c1, c2, c3 from test")
def q_align_columns(spark: SparkSession, sf: str) -> DataFrame:
    train, test = fx_split(spark, sf)
    features = drop_cols(train, ["target", "is_test", "not_there"])
    shuffled = test.select(*reversed(test.columns))
    return align_columns(shuffled, features)


@register("scan_nan_to_null",
          "select c_custkey, case when c_acctbal < 0 then null else c_acctbal end c_acctbal from customer")
def q_scan_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN cells read from a table come back as NULL."""
    from ..sources.tables import nan_to_null
    c = read_table(spark, sf, "customer")
    with_nan = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(float("nan")))
                        .otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return nan_to_null(with_nan)


# --------------------------------------------------------------------------- step 2: scalers


def _minmax_sql(lo: float, hi: float, clip: bool) -> str:
    stats = ", ".join(f"min({c}) a_{c}, max({c}) b_{c}" for c in NUM)
    cols = []
    for c in NUM:
        rng = f"case when b_{c} - a_{c} < {EPS} then 1 else b_{c} - a_{c} end"
        e = f"({c} - a_{c}) / ({rng} / ({hi} - ({lo}))) + ({lo})"
        if clip:
            e = f"least(greatest({e}, {lo}), {hi})"
        cols.append(f"round({e}, 6) {c}")
    return f"with {FX_SQL}, s as (select {stats} from train) select id, is_test, {', '.join(cols)} from fx, s"


def _minmax_query(lo: float, hi: float, clip: bool):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf)
        model = MinMaxScaler(feature_range=(lo, hi), clip=clip).fit(d.filter(~F.col("is_test")), NUM)
        return _rounded(model.transform(d).select("id", "is_test", *NUM), NUM)
    return q


for _name, _lo, _hi, _clip in (("scale_minmax_01", 0.0, 1.0, False), ("scale_minmax_pm1", -1.0, 1.0, False),
                               ("scale_minmax_pm100", -100.0, 100.0, False), ("scale_minmax_clip", 0.0, 1.0, True)):
    register(_name, _minmax_sql(_lo, _hi, _clip))(_minmax_query(_lo, _hi, _clip))


def _robust_sql(unit: bool) -> str:
    stats = ", ".join(
        f"quantile_cont({c}, 0.5) m_{c}, quantile_cont({c}, 0.25) p_{c}, quantile_cont({c}, 0.75) q_{c}"
        for c in NUM)
    adj = "1.3489795003921634" if unit else "1"
    cols = ", ".join(
        f"round(({c} - m_{c}) / ((case when q_{c} - p_{c} < {EPS} then 1 else q_{c} - p_{c} end) / {adj}), 6) {c}"
        for c in NUM)
    return f"with {FX_SQL}, s as (select {stats} from train) select id, is_test, {cols} from fx, s"


def _robust_query(unit: bool):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf)
        model = RobustScaler(unit_variance=unit).fit(d.filter(~F.col("is_test")), NUM)
        return _rounded(model.transform(d).select("id", "is_test", *NUM), NUM)
    return q


register("scale_robust", _robust_sql(False))(_robust_query(False))
register("scale_robust_unit_variance", _robust_sql(True))(_robust_query(True))


def _norm_sql(norm: str) -> str:
    if norm == "l1":
        n = " + ".join(f"abs({c})" for c in NUM)
    elif norm == "l2":
        n = "sqrt(" + " + ".join(f"{c} * {c}" for c in NUM) + ")"
    else:
        n = "greatest(" + ", ".join(f"abs({c})" for c in NUM) + ")"
    cols = ", ".join(f"round({c} / case when n = 0 then 1 else n end, 6) {c}" for c in NUM)
    return f"with {FX_SQL}, t as (select *, {n} n from fx) select id, {cols} from t"


def _norm_query(norm: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf)
        model = Normalizer(norm=norm).fit(d, NUM)
        return _rounded(model.transform(d).select("id", *NUM), NUM)
    return q


for _n in ("l1", "l2", "max"):
    register(f"normalize_{_n}", _norm_sql(_n))(_norm_query(_n))


# --------------------------------------------------------------------------- step 2: imputation


def _impute_query(strategy: str, cols: list[str], **kw):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf)
        model = SimpleImputer(strategy=strategy, **kw).fit(d.filter(~F.col("is_test")), cols)
        out = model.transform(d.select("id", *cols))
        return _rounded(out, [c for c in out.columns if c != "id" and out.schema[c].dataType.simpleString() == "double"])
    return q


register("impute_mean", f"with {FX_SQL}, s as (select avg(f2) m from train) "
         "select id, round(coalesce(f2, m), 6) f2 from fx, s")(_impute_query("mean", ["f2"]))
register("impute_median", f"with {FX_SQL}, s as (select quantile_cont(f2, 0.5) m from train) "
         "select id, round(coalesce(f2, m), 6) f2 from fx, s")(_impute_query("median", ["f2"]))
register("impute_mode", f"""with {FX_SQL},
 m2 as (select f2 v from train where f2 is not null group by f2 order by count(*) desc, f2 limit 1),
 mc as (select c2 v from train where c2 is not null group by c2 order by count(*) desc, c2 limit 1)
 select id, round(coalesce(f2, m2.v), 6) f2, coalesce(c2, mc.v) c2 from fx, m2, mc""")(
    _impute_query("most_frequent", ["f2", "c2"]))
register("impute_indicator", f"with {FX_SQL}, s as (select avg(f1) m1, avg(f2) m2 from train) "
         "select id, round(coalesce(f1, m1), 6) f1, round(coalesce(f2, m2), 6) f2, "
         "case when f2 is null then 1.0::DOUBLE else 0.0::DOUBLE end missingindicator_f2 from fx, s")(
    _impute_query("mean", ["f1", "f2"], add_indicator=True))


@register("impute_constant", f"with {FX_SQL} select id, round(coalesce(f2, -1.0), 6) f2, "
          "coalesce(c2, 'unknown') c2 from fx")
def q_impute_constant(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf).select("id", "f2", "c2")
    train = d  # constant strategy needs no statistics
    num = SimpleImputer(strategy="constant", fill_value=-1.0).fit(train, ["f2"])
    cat = SimpleImputer(strategy="constant", fill_value="unknown").fit(train, ["c2"])
    return _rounded(cat.transform(num.transform(d)), ["f2"])


# --------------------------------------------------------------------------- step 2: frame cleaning


@register("fill_value", f"with {FX_FRAME_SQL} select event_id, user_id, coalesce(v1, 0.0) v1, "
          "coalesce(v2, 'none') v2 from fxf")
def q_fill_value(spark: SparkSession, sf: str) -> DataFrame:
    return fillna(fx_frame(spark, sf), value={"v1": 0.0, "v2": "none"})


def _ffill_sql(backward: bool, limit: int | None) -> str:
    order = "event_id desc" if backward else "event_id"
    out = []
    for v in ("v1", "v2"):
        if limit is None:
            out.append(f"coalesce({v}, last_value({v} ignore nulls) over (partition by user_id order by {order} "
                       f"rows between unbounded preceding and current row)) {v}")
        else:
            out.append(f"case when {v} is not null then {v} when r_{v} <= {limit} then l_{v} end {v}")
    if limit is None:
        return f"with {FX_FRAME_SQL} select event_id, user_id, {', '.join(out)} from fxf"
    pre = ", ".join(
        f"count({v}) over (partition by user_id order by {order} rows between unbounded preceding and current row) g_{v}, "
        f"last_value({v} ignore nulls) over (partition by user_id order by {order} "
        f"rows between unbounded preceding and current row) l_{v}" for v in ("v1", "v2"))
    runs = ", ".join(f"row_number() over (partition by user_id, g_{v} order by {order}) - 1 r_{v}" for v in ("v1", "v2"))
    return (f"with {FX_FRAME_SQL}, a as (select *, {pre} from fxf), b as (select *, {runs} from a) "
            f"select event_id, user_id, {', '.join(out)} from b")


def _ffill_query(method: str, limit: int | None, chunks: int | None = None):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return fillna(fx_frame(spark, sf), method=method, order_by="event_id", partition_by="user_id",
                      limit=limit, chunks=chunks)
    return q


register("fill_ffill", _ffill_sql(False, None))(_ffill_query("ffill", None))
register("fill_bfill", _ffill_sql(True, None))(_ffill_query("bfill", None))
register("fill_limit", _ffill_sql(False, 1))(_ffill_query("ffill", 1))
# Same answers with chunks of 64 ids: exercises the carry between chunks of one user.
register("fill_ffill_chunked", _ffill_sql(False, None))(_ffill_query("ffill", None, 64))
register("fill_limit_chunked", _ffill_sql(False, 2))(_ffill_query("ffill", 2, 16))
register("fill_bfill_chunked", _ffill_sql(True, 1))(_ffill_query("bfill", 1, 16))


@register("fill_value_limit", f"""with {FX_FRAME_SQL},
 r as (select *, case when v1 is null then row_number() over (partition by user_id, v1 is null order by event_id) end r1,
               case when v2 is null then row_number() over (partition by user_id, v2 is null order by event_id) end r2
       from fxf)
 select event_id, user_id, case when v1 is null and r1 <= 2 then 0.0 else v1 end v1,
   case when v2 is null and r2 <= 2 then 'none' else v2 end v2 from r""")
def q_fill_value_limit(spark: SparkSession, sf: str) -> DataFrame:
    """fillna(value, limit=2): only the first two NULLs of each column per user are filled."""
    return fillna(fx_frame(spark, sf), value={"v1": 0.0, "v2": "none"}, limit=2, order_by="event_id",
                  partition_by="user_id", chunks=16)


@register("fill_axis1", f"with {FX_SQL} select id, f1, coalesce(f2, f1) f2, coalesce(f3, f2, f1) f3 from fx")
def q_fill_axis1(spark: SparkSession, sf: str) -> DataFrame:
    return fillna(fx(spark, sf).select("id", *NUM), method="ffill", axis=1, subset=NUM)


@register("dropna_any", f"with {FX_FRAME_SQL} select * from fxf where v1 is not null and v2 is not null")
def q_dropna_any(spark: SparkSession, sf: str) -> DataFrame:
    return dropna(fx_frame(spark, sf), how="any")


@register("dropna_all", f"with {FX_FRAME_SQL} select * from fxf where v1 is not null or v2 is not null")
def q_dropna_all(spark: SparkSession, sf: str) -> DataFrame:
    return dropna(fx_frame(spark, sf), how="all", subset=["v1", "v2"])


@register("dropna_thresh", f"with {FX_FRAME_SQL} select * from fxf "
          "where 2 + (v1 is not null)::int + (v2 is not null)::int >= 3")
def q_dropna_thresh(spark: SparkSession, sf: str) -> DataFrame:
    return dropna(fx_frame(spark, sf), thresh=3)


@register("dropna_axis1", f"with {FX_SQL} select id, f1, f3, c1, c3, target, is_test from train")
def q_dropna_axis1(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    return dropna(train, axis=1, how="any")


@register("replace_value", f"with {FX_FRAME_SQL} select event_id, user_id, v1, "
          "case v2 when 'click' then 'CLICK' when 'view' then 'VIEW' else v2 end v2 from fxf")
def q_replace_value(spark: SparkSession, sf: str) -> DataFrame:
    return replace(fx_frame(spark, sf), {"click": "CLICK", "view": "VIEW"}, subset=["v2"])


@register("replace_regex", f"with {FX_FRAME_SQL} select event_id, user_id, v1, "
          "regexp_replace(regexp_replace(v2, '[aeiou]', '*', 'g'), '^s', 'S', 'g') v2 from fxf")
def q_replace_regex(spark: SparkSession, sf: str) -> DataFrame:
    return replace(fx_frame(spark, sf), {"[aeiou]": "*", "^s": "S"}, regex=True)


@register("replace_pad", f"""with {FX_FRAME_SQL}, z as (select event_id, user_id, v2,
  case when v2 is distinct from 'view' then event_id end free from fxf),
  l as (select *, max(free) over (partition by user_id order by event_id) last from z)
  select l.event_id, l.user_id, case when l.last is null then l.v2 else z.v2 end v2
  from l left join z on z.user_id = l.user_id and z.event_id = l.last""")
def q_replace_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Deprecated method='pad': matches take the last value of the user that does not match, gaps stay."""
    d = fx_frame(spark, sf).select("event_id", "user_id", "v2")
    return replace(d, "view", None, method="pad", order_by="event_id", partition_by="user_id")


# --------------------------------------------------------------------------- step 3: encoders


def _onehot_sql(drop_first: bool) -> str:
    rank = "row_number() over (partition by col order by v nulls last)"
    keep = "where rk > 1" if drop_first else ""
    return f"""with {FX_SQL},
 cats as (select col, v, {rank} rk from (select distinct 'c1' col, c1 v from train
          union all select distinct 'c2', c2 from train) u),
 k as (select * from cats {keep})
 select id, col || '_' || coalesce(v, 'None') feature,
   case when (case col when 'c1' then fx.c1 else fx.c2 end) is not distinct from v then 1.0::DOUBLE else 0.0::DOUBLE end value
 from fx cross join k"""


def _onehot_query(**kw):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf)
        model = OneHotEncoder(handle_unknown="ignore", **kw).fit(d.filter(~F.col("is_test")), ["c1", "c2"])
        out = model.transform(d.select("id", "c1", "c2"))
        return long_form(out, ["id"], [c for c in out.columns if c != "id"])
    return q


register("onehot", _onehot_sql(False))(_onehot_query())
register("onehot_dropfirst", _onehot_sql(True))(_onehot_query(drop="first"))


@register("onehot_maxcat", f"""with {FX_SQL},
 cnt as (select c1 v, count(*) n from train group by c1),
 top as (select v from cnt order by n desc, v limit 2),
 feats as (select 'c1_' || v feature, v from top union all select 'c1_infrequent_sklearn', null)
 select id, feature, case when feats.v is null then (case when c1 not in (select v from top) then 1.0::DOUBLE else 0.0::DOUBLE end)
   when c1 = feats.v then 1.0::DOUBLE else 0.0::DOUBLE end value
 from fx cross join feats""")
def q_onehot_maxcat(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf)
    model = OneHotEncoder(handle_unknown="ignore", max_categories=3).fit(d.filter(~F.col("is_test")), ["c1"])
    out = model.transform(d.select("id", "c1"))
    return long_form(out, ["id"], [c for c in out.columns if c != "id"])


@register("onehot_minfreq", f"""with {FX_SQL},
 cnt as (select c1 v, count(*) n from train group by c1),
 freq as (select v from cnt where n >= 0.2 * (select count(*) from train)),
 feats as (select 'c1_' || v feature, v from freq union all select 'c1_infrequent_sklearn', null)
 select id, feature, case when feats.v is null then (case when c1 not in (select v from freq) then 1.0::DOUBLE else 0.0::DOUBLE end)
   when c1 = feats.v then 1.0::DOUBLE else 0.0::DOUBLE end value
 from fx cross join feats""")
def q_onehot_minfreq(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf)
    model = OneHotEncoder(handle_unknown="ignore", min_frequency=0.2).fit(d.filter(~F.col("is_test")), ["c1"])
    out = model.transform(d.select("id", "c1"))
    return long_form(out, ["id"], [c for c in out.columns if c != "id"])


@register("ordinal_unknown", f"""with {FX_SQL},
 codes as (select v, dense_rank() over (order by v) - 1 code from (select distinct c3 v from train) d)
 select id, coalesce(cast(code as double), -1.0) c3 from test left join codes on test.c3 = codes.v""")
def q_ordinal_unknown(spark: SparkSession, sf: str) -> DataFrame:
    train, test = fx_split(spark, sf)
    model = OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1).fit(train, ["c3"])
    return model.transform(test.select("id", "c3"))


@register("ordinal_maxcat", f"""with {FX_SQL},
 cnt as (select c2 v, count(*) n from train where c2 is not null group by c2),
 top as (select v, dense_rank() over (order by v) - 1 code from (select v from cnt order by n desc, v limit 3) t)
 select id, case when c2 is null then null when code is null then 3.0 else cast(code as double) end c2
 from fx left join top on fx.c2 = top.v""")
def q_ordinal_maxcat(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf)
    model = OrdinalEncoder(max_categories=4, handle_unknown="use_encoded_value", unknown_value=-1).fit(
        d.filter(~F.col("is_test")), ["c2"])
    return model.transform(d.select("id", "c2"))


def _dummies_sql(drop_first: bool, dummy_na: bool) -> str:
    rank = "row_number() over (partition by col order by v)"
    keep = "where rk > 1" if drop_first else ""
    na = "union all select 'c1', null, 999999 union all select 'c2', null, 999999" if dummy_na else ""
    return f"""with {FX_SQL},
 lv as (select col, v, {rank} rk from (select distinct 'c1' col, c1 v from fx where c1 is not null
        union all select distinct 'c2', c2 from fx where c2 is not null) u
        {na}),
 k as (select * from lv {keep})
 select id, col || '_' || coalesce(v, 'nan') feature,
   case when v is null then (case col when 'c1' then fx.c1 else fx.c2 end) is null
        else coalesce((case col when 'c1' then fx.c1 else fx.c2 end) = v, false) end value
 from fx cross join k"""


def _dummies_query(drop_first: bool, dummy_na: bool):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        d = fx(spark, sf).select("id", "c1", "c2")
        out = get_dummies(d, ["c1", "c2"], drop_first=drop_first, dummy_na=dummy_na)
        return long_form(out, ["id"], [c for c in out.columns if c != "id"], cast="boolean")
    return q


register("get_dummies", _dummies_sql(False, False))(_dummies_query(False, False))
register("get_dummies_dropfirst_na", _dummies_sql(True, True))(_dummies_query(True, True))


@register("label_encode", f"""with {FX_SQL},
 codes as (select v, dense_rank() over (order by v) - 1 code from (select distinct c3 v from fx) d)
 select id, code c3 from fx join codes on fx.c3 = codes.v""")
def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    train, test = fx_split(spark, sf)
    model = LabelEncoder().fit([train, test], "c3")
    return model.transform(fx(spark, sf).select("id", "c3"))


# The example mapping of the map_dict query.
PRIORITY_MAP = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@register("map_dict", f"""with {FX_SQL} select id, case c1 when '1-URGENT' then 1 when '2-HIGH' then 2
  when '3-MEDIUM' then 3 end c1 from fx""")
def q_map_dict(spark: SparkSession, sf: str) -> DataFrame:
    return map_values(fx(spark, sf).select("id", "c1"), "c1", PRIORITY_MAP)


@register("map_series", f"""with {FX_SQL} select id, n_name c1 from fx
  left join nation on cast(fx.f3 as bigint) = n_nationkey""")
def q_map_series(spark: SparkSession, sf: str) -> DataFrame:
    """map with a Series: nation key -> nation name through a mapping DataFrame."""
    d = fx(spark, sf).select("id", F.col("f3").cast("bigint").alias("c1"))
    nations = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"),
                                                     F.col("n_name").alias("value"))
    return map_values(d, "c1", nations)


@register("drop_rows", f"""with {FX_SQL} select id, f1 from fx
  where id not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def q_drop_rows(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey")
    return drop(fx(spark, sf).select("id", "f1"), index=labels, id_col="id")


@register("drop_columns", f"with {FX_SQL} select id, f1, c1 from fx")
def q_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = fx(spark, sf).select("id", "f1", "f2", "c1", "c2")
    return drop(d, columns=["f2", "c2"])


# --------------------------------------------------------------------------- step 4: automatic preparation


@register("impute_from_train", f"""with {FX_SQL},
 s as (select avg(f1) m1, avg(f2) m2, avg(f3) m3 from train),
 k1 as (select c1 v from train where c1 is not null group by c1 order by count(*) desc, c1 limit 1),
 k2 as (select c2 v from train where c2 is not null group by c2 order by count(*) desc, c2 limit 1),
 k3 as (select c3 v from train where c3 is not null group by c3 order by count(*) desc, c3 limit 1)
 select id, round(coalesce(f1, m1), 6) f1, round(coalesce(f2, m2), 6) f2, round(coalesce(f3, m3), 6) f3,
   coalesce(c1, k1.v) c1, coalesce(c2, k2.v) c2, coalesce(c3, k3.v) c3
 from test, s, k1, k2, k3""")
def q_impute_from_train(spark: SparkSession, sf: str) -> DataFrame:
    train, test = fx_split(spark, sf)
    model = TrainStatImputer(exclude=("id", "target", "is_test")).fit(train)
    out = model.transform(test.select("id", *NUM, "c1", "c2", "c3"))
    return _rounded(out, NUM)


@register("label_first_seen", f"""with {FX_SQL},
 u as (select coalesce(c3, 'missing') v, 0 side, id from train
       union all select coalesce(c3, 'missing'), 1, id from test),
 f as (select v, min(side * 10000000000 + id) k from u group by v)
 select v c3, dense_rank() over (order by k) - 1 code from f""")
def q_label_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    train, test = fx_split(spark, sf)
    codes, _ = first_seen_codes([(train, "id"), (test, "id")], "c3")
    return codes


# --------------------------------------------------------------------------- step 3/4: generated and selected features

from ..operators.autoprep import encoding_choice, prepare, scaler_variances  # noqa: E402
from ..operators.poly import PolynomialFeatures  # noqa: E402
from ..operators.select import SelectKBest, VarianceThreshold  # noqa: E402
from .fixtures import FX_NUM_SQL, fx_num  # noqa: E402

POLY_IN = ["l_quantity", "l_discount", "l_tax"]
KBEST_IN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "k"]


def _poly_sql(interaction_only: bool, include_bias: bool) -> str:
    pf = PolynomialFeatures(degree=2, interaction_only=interaction_only, include_bias=include_bias)
    cols = []
    for t in pf.terms(POLY_IN):
        e = " * ".join(POLY_IN[i] for i in t) if t else "1.0::DOUBLE"
        cols.append(f'round({e}, 6) "{pf.name(POLY_IN, t)}"')
    return f"with {FX_NUM_SQL} select l_orderkey, l_linenumber, {', '.join(cols)} from fxn"


def _poly_query(interaction_only: bool, include_bias: bool):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        pf = PolynomialFeatures(degree=2, interaction_only=interaction_only, include_bias=include_bias)
        out = pf.transform(fx_num(spark, sf), POLY_IN, keep=["l_orderkey", "l_linenumber"])
        return _rounded(out, [c for c in out.columns if c not in ("l_orderkey", "l_linenumber")])
    return q


register("poly_d2", _poly_sql(False, True))(_poly_query(False, True))
register("poly_interaction", _poly_sql(True, False))(_poly_query(True, False))


def _kbest_sql(k: int) -> str:
    unp = " union all ".join(f"select '{c}' feature, {i} idx, label, {c} x from fxn" for i, c in enumerate(KBEST_IN))
    return f"""with {FX_NUM_SQL}, u as ({unp}),
 g as (select feature, idx, label, count(*) n, avg(x) m, var_pop(x) v from u group by all),
 t as (select feature, sum(n) nn, count(*) k, sum(n * m) / sum(n) gm, sum(n * v) ssw from g group by feature),
 b as (select g.feature, g.idx, any_value(t.nn) nn, any_value(t.k) k, any_value(t.ssw) ssw,
         sum(g.n * (g.m - t.gm) * (g.m - t.gm)) ssb from g join t using (feature) group by g.feature, g.idx),
 f as (select feature, idx, case when ssw = 0 or k = 1 or nn = k then null
         else (ssb / (k - 1)) / (ssw / (nn - k)) end f_score from b)
 select feature, round(f_score, 6) f_score, row_number() over (order by f_score desc nulls last, idx) rank,
   row_number() over (order by f_score desc nulls last, idx) <= {k} selected from f"""


@register("select_kbest_f", _kbest_sql(2))
def q_select_kbest(spark: SparkSession, sf: str) -> DataFrame:
    out = SelectKBest(k=2).fit(fx_num(spark, sf), KBEST_IN, "label")
    return out.select("feature", r6(F.col("f_score")).alias("f_score"), F.col("rank").cast("bigint").alias("rank"),
                      "selected")


@register("variance_threshold", f"""with {FX_NUM_SQL} """ + " union all ".join(
    f"select '{c}' feature, var_pop({c})::REAL variance, var_pop({c}) > 0.2 selected from fxn" for c in KBEST_IN))
def q_variance_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = VarianceThreshold(threshold=0.2).fit(fx_num(spark, sf), KBEST_IN)
    # float32 keeps ~7 significant digits: a relative rounding for variances of any magnitude
    return out.select("feature", F.col("variance").cast("float").alias("variance"), "selected")


def _scaler_stats_sql(src: str, prefix: str) -> str:
    return ", ".join(
        f"avg({c}) {prefix}a_{c}, stddev_pop({c}) {prefix}s_{c}, min({c}) {prefix}lo_{c}, max({c}) {prefix}hi_{c}, "
        f"quantile_cont({c}, 0.5) {prefix}md_{c}, quantile_cont({c}, 0.25) {prefix}p_{c}, "
        f"quantile_cont({c}, 0.75) {prefix}q_{c}" for c in NUM) + f" from {src}"


def _scaled_sql(c: str, kind: str, prefix: str) -> str:
    z = lambda d: f"case when {d} < {EPS} then 1 else {d} end"
    if kind == "standard":
        return f"({c} - {prefix}a_{c}) / {z(prefix + 's_' + c)}"
    if kind == "minmax":
        return f"({c} - {prefix}lo_{c}) / {z(f'{prefix}hi_{c} - {prefix}lo_{c}')}"
    return f"({c} - {prefix}md_{c}) / {z(f'{prefix}q_{c} - {prefix}p_{c}')}"


def _best_scaler_ctes() -> str:
    fill = ", ".join(f"coalesce({c}, (select avg({c}) from train)) {c}" for c in NUM)
    ys = ", ".join(f"{_scaled_sql(c, k, '')} {k}_{c}" for k in ("standard", "minmax", "robust") for c in NUM)
    vs = ", ".join(f"avg({k}_{c}) {k}_m_{c}, var_pop({k}_{c}) {k}_v_{c}"
                   for k in ("standard", "minmax", "robust") for c in NUM)
    rows = []
    for o, k in enumerate(("standard", "minmax", "robust")):
        ev = " + ".join(f"({k}_v_{c} + {k}_m_{c} * {k}_m_{c})" for c in NUM)
        em = " + ".join(f"{k}_m_{c}" for c in NUM)
        rows.append(f"select {o} ord, '{k}' scaler, ({ev}) / {len(NUM)} - (({em}) / {len(NUM)}) * "
                    f"(({em}) / {len(NUM)}) variance from v")
    return f"""filled as (select {fill} from train),
 fs as (select {_scaler_stats_sql('filled', '')}),
 y as (select {ys} from filled, fs),
 v as (select {vs} from y),
 sv as ({' union all '.join(rows)}),
 ranked as (select *, row_number() over (order by variance desc nulls last, ord) = 1 and variance is not null chosen
            from sv)"""


@register("best_scaler", f"with {FX_SQL}, {_best_scaler_ctes()} "
          "select ord, scaler, round(variance, 6) variance, chosen from ranked")
def q_best_scaler(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    out = scaler_variances(train, NUM)
    return out.select(F.col("ord").cast("int").alias("ord"), "scaler", r6(F.col("variance")).alias("variance"),
                      "chosen")


CATS = ["c1", "c2", "c3"]


def _encode_choice_sql() -> str:
    parts = [f"select '{c}' column_name, count(distinct coalesce({c}, 'missing')) n_distinct, count(*) n_rows "
             "from train" for c in CATS]
    return f"""with {FX_SQL}, e as ({' union all '.join(parts)})
 select column_name, n_distinct, n_rows, round(n_distinct / n_rows, 6) ratio,
   case when n_distinct / n_rows < 0.05 then 'onehot' else 'label' end encoding from e"""


@register("encode_choice", _encode_choice_sql())
def q_encode_choice(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = fx_split(spark, sf)
    out = encoding_choice(train, CATS)
    return out.select(F.col("column").alias("column_name"), "n_distinct", "n_rows", r6(F.col("ratio")).alias("ratio"),
                      "encoding")


def _prepare_sql() -> str:
    num_rows = []
    for c in NUM:
        e = (f"case (select scaler from ranked where chosen) when 'standard' then {_scaled_sql(c, 'standard', 't')} "
             f"when 'minmax' then {_scaled_sql(c, 'minmax', 't')} else {_scaled_sql(c, 'robust', 't')} end")
        num_rows.append(f"select side, id, '{c}' feature, round({e}, 6) value from both_, ts")
    cat_rows = []
    for c in CATS:
        v = f"coalesce({c}, 'missing')"
        gate = f"(select encoding from enc where column_name = '{c}')"
        cat_rows.append(f"""select side, id, '{c}_' || lv feature,
            case when {v} = lv then 1.0::DOUBLE else 0.0::DOUBLE end value
          from both_ cross join (select distinct {v} lv from both_) l where {gate} = 'onehot'""")
        cat_rows.append(f"""select side, id, '{c}' feature, cast(code as double) value from both_
          join (select v, dense_rank() over (order by k) - 1 code from
                (select {v} v, min(side * 10000000000 + id) k from both_ group by 1) f) codes on {v} = codes.v
          where {gate} = 'label'""")
    enc = " union all ".join(
        f"select '{c}' column_name, case when count(distinct coalesce({c}, 'missing')) / count(*) < 0.05 "
        f"then 'onehot' else 'label' end encoding from train" for c in CATS)
    return f"""with {FX_SQL}, {_best_scaler_ctes()},
 ts as (select {_scaler_stats_sql('train', 't')}),
 enc as ({enc}),
 both_ as (select 0 side, * from train union all select 1 side, * from test)
 {' union all '.join(num_rows + cat_rows)}"""


@register("prepare_apply", _prepare_sql())
def q_prepare_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A4 end to end: scaler choice + per-column encoding, both sides, long form."""
    train, test = fx_split(spark, sf)
    train, test = train.drop("is_test", "target"), test.drop("is_test", "target")
    tr, te, _ = prepare(train, test, id_col="id")
    feats = [c for c in tr.columns if c != "id"]
    a = long_form(tr.withColumn("side", F.lit(0)), ["side", "id"], feats)
    b = long_form(te.withColumn("side", F.lit(1)), ["side", "id"], feats)
    u = a.unionByName(b)
    return u.select("side", "id", "feature", r6(F.col("value")).alias("value"))


# --------------------------------------------------------------------------- F20: ColumnTransformer

from ..operators.pipeline import ColumnTransformer  # noqa: E402


@register("column_transformer", f"""with {FX_SQL},
 s as (select avg(f1) a1, stddev_pop(f1) s1, avg(f3) a3, stddev_pop(f3) s3, quantile_cont(f2, 0.5) m2 from train),
 k1 as (select v, dense_rank() over (order by v) - 1 code from (select distinct c1 v from train where c1 is not null)),
 k2 as (select v, dense_rank() over (order by v) - 1 code from (select distinct c2 v from train where c2 is not null))
 select round((f1 - a1) / s1, 6) f1, round((f3 - a3) / s3, 6) f3, round(coalesce(f2, m2), 6) f2,
   cast(k1.code as double) c1, case when fx.c2 is null then null else coalesce(cast(k2.code as double), -1.0) end c2,
   id, target
 from fx cross join s left join k1 on fx.c1 = k1.v left join k2 on fx.c2 = k2.v""")
def q_column_transformer(spark: SparkSession, sf: str) -> DataFrame:
    """scale f1, f3; impute f2 by median; ordinal-code c1, c2; pass id and target through."""
    d = fx(spark, sf).select("id", "f1", "f2", "f3", "c1", "c2", "target")
    ct = ColumnTransformer([
        ("num", StandardScaler(), ["f1", "f3"]),
        ("imp", SimpleImputer(strategy="median"), ["f2"]),
        ("cat", OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1), ["c1", "c2"]),
    ], remainder="passthrough")
    train = fx(spark, sf).filter(~F.col("is_test")).select(*d.columns)
    out = ct.fit(train).transform(d)
    return _rounded(out, NUM)


@register("prepare_many_levels", """
 with l as (select l_orderkey * 10 + l_linenumber id, 'p' || l_partkey c from lineitem),
 k as (select c, row_number() over (order by c) - 1 code from (select distinct c from l) d)
 select id, (select count(*) from k) size, code "index" from l join k using (c)""")
def q_prepare_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic preparation of a low-ratio column with more levels than columns are wanted."""
    from ..operators.autoprep import prepare
    rows = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("p"), "l_partkey").alias("c"))
    tr, te, _ = prepare(rows.filter(F.col("id") % 5 != 0), rows.filter(F.col("id") % 5 == 0), "id", max_columns=50)
    return tr.unionByName(te).select("id", "c.size", "c.index")
