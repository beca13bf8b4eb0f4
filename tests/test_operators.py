"""Edge cases on literal frames and sequential-replay properties."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tunewright.functions.logs import canonical_entries, parse_metric_log
from tunewright.functions.stats import column_modes, exact_quantiles
from tunewright.operators.encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, dense_codes, get_dummies
from tunewright.operators.frame import dropna, fillna
from tunewright.operators.impute import SimpleImputer
from tunewright.operators import search
from tunewright.operators.metrics import classification_metrics, regression_metrics, stratified_folds
from tunewright.operators.poly import PolynomialFeatures
from tunewright.operators.scale import MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from tunewright.operators.select import VarianceThreshold
from tunewright.plans.catalog import catalog_rows


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rng = random.Random(7)
    vals = [rng.gauss(0, 1) for _ in range(3000)] + [2.5] * 1500 + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, bins=8, finish_rows=100)  # force several passes
    arr = np.array([v for v in vals if v is not None])
    for p in probs:
        assert got["x"][p] == pytest.approx(float(np.percentile(arr, p * 100)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    q = exact_quantiles(df, ["a", "b"], [0.5])
    assert q["a"][0.5] is None and q["b"][0.5] == 3.0


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("b", 1.0), ("a", 2.0), (None, None)], "s string, x double")
    assert column_modes(df, ["s", "x"]) == {"s": "a", "x": 1.0}


def test_standard_scaler_constant_and_null_columns(spark):
    df = spark.createDataFrame([(5.0, None, 1.0), (5.0, None, 3.0)], "c double, n double, x double")
    out = StandardScaler().fit(df, ["c", "n", "x"]).transform(df).collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert [r.n for r in out] == [None, None]
    assert sorted(r.x for r in out) == [-1.0, 1.0]  # population std


def test_minmax_constant_column_goes_to_lower_bound(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "c double")
    out = MinMaxScaler(feature_range=(-1, 1)).fit(df, ["c"]).transform(df).collect()
    assert [r.c for r in out] == [-1.0, -1.0]


def test_robust_scaler_matches_numpy(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r.x for r in RobustScaler().fit(df, ["x"]).transform(df).collect()]
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert out == pytest.approx([(v - med) / (q3 - q1) for v in vals])


def test_normalizer_zero_row(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double")
    out = Normalizer(norm="l2").fit(df, ["a", "b"]).transform(df).collect()
    assert (out[0].a, out[0].b) == (0.0, 0.0) and (out[1].a, out[1].b) == pytest.approx((0.6, 0.8))


def test_imputer_empty_feature_dropped_or_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "e double, x double")
    m = SimpleImputer().fit(df, ["e", "x"])
    assert m.transform(df).columns == ["x"]
    k = SimpleImputer(keep_empty_features=True, add_indicator=True).fit(df, ["e", "x"]).transform(df)
    assert k.columns == ["e", "x", "missingindicator_e", "missingindicator_x"]
    assert [r.e for r in k.collect()] == [0.0, 0.0]


def test_onehot_unknown_category(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("z",)], "c string")
    with pytest.raises(ValueError):
        OneHotEncoder().fit(train, ["c"]).transform(test)
    out = OneHotEncoder(handle_unknown="ignore").fit(train, ["c"]).transform(test).collect()[0]
    assert (out.c_a, out.c_b) == (0.0, 0.0)


def test_ordinal_unknown_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    m = OrdinalEncoder(handle_unknown="use_encoded_value", unknown_value=-1).fit(train, ["c"])
    assert sorted((r.c is None, r.c) for r in m.transform(test).collect()) == [(False, -1.0), (False, 0.0),
                                                                               (True, None)]


def test_dense_codes_equal_rank(spark):
    rng = random.Random(3)
    vals = sorted({rng.randint(0, 10**6) for _ in range(5000)})
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    codes, n = dense_codes(df, "v", num_partitions=7)
    got = {r.v: r.code for r in codes.collect()}
    assert n == len(vals) and all(got[v] == i for i, v in enumerate(vals))


def test_label_encoder_union(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("w",)], "c string")
    m = LabelEncoder().fit([a, b], "c")
    assert sorted((r.c) for r in m.transform(b.union(a)).collect()) == [0, 1, 2]


def test_get_dummies_names_and_dtype(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, c string")
    out = get_dummies(df, ["c"], dummy_na=True)
    assert out.columns == ["id", "c_a", "c_b", "c_nan"]
    assert dict(out.dtypes)["c_a"] == "boolean"


def test_poly_term_order_and_names():
    pf = PolynomialFeatures(degree=2)
    names = [pf.name(["a", "b"], t) for t in pf.terms(["a", "b"])]
    assert names == ["1", "a", "b", "a^2", "a b", "b^2"]
    pf = PolynomialFeatures(degree=3, interaction_only=True, include_bias=False)
    assert [pf.name(["a", "b", "c"], t) for t in pf.terms(["a", "b", "c"])] == [
        "a", "b", "c", "a b", "a c", "b c", "a b c"]


def test_variance_threshold_population(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, k double")
    rows = {r.feature: r for r in VarianceThreshold(0.5).fit(df, ["a", "k"]).collect()}
    assert rows["a"].variance == 1.0 and rows["a"].selected and not rows["k"].selected


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    r = classification_metrics(df, "t", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.0, 0.0, 0.0)
    c = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "t double, p double")
    assert regression_metrics(c, "t", "p").first().r2 == 1.0


@pytest.mark.parametrize("limit,chunk", [(None, 4), (1, 3), (2, 1000), (None, 1)])
def test_ffill_matches_pandas_with_hot_partition(spark, limit, chunk):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        key = 0 if i % 3 else rng.randint(1, 5)  # key 0 holds two thirds of the rows
        rows.append((i, key, None if rng.random() < 0.5 else float(i)))
    df = spark.createDataFrame(rows, "o long, k long, v double")
    got = {r.o: r.v for r in fillna(df, method="ffill", order_by="o", partition_by="k", limit=limit,
                                    chunks=chunk).collect()}
    pdf = pd.DataFrame(rows, columns=["o", "k", "v"]).sort_values("o")
    exp = pdf.groupby("k")["v"].ffill(limit=limit)
    for o, v in zip(pdf["o"], exp):
        assert (got[o] is None and (v is None or math.isnan(v))) or got[o] == v


def test_dropna_axis1(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "a int, b double, c double")
    assert dropna(df, axis=1, how="all").columns == ["a", "c"]
    assert dropna(df, axis=1).columns == ["a"]


def test_catalog_golden_counts(spark):
    c = catalog_rows(spark)
    assert c.select("method").distinct().count() == 19
    assert c.select("method", "param").distinct().count() == 75
    assert c.filter("ord is not null").count() == 170
    ph = {r.value_text for r in c.filter("is_placeholder").collect()}
    assert {"scalar", "dict", "list", "type"} <= ph
    fr = [r.value_text for r in c.filter("param = 'feature_range'").orderBy("ord").collect()]
    assert fr == ["[0.0, 1.0]", "[-1.0, 1.0]", "[-100, 100]"]


def test_log_canonicalisation_rules(spark):
    text = "\n".join([
        "METRIC_LOG: tf_val_accuracy = 0.5", "METRIC_LOG: accuracy_score = 0.7", "METRIC_LOG: rf_accuracy_score = 0.6",
        "METRIC_LOG: model_score = 0.4", "METRIC_LOG: svr_r2 = 0.3", "METRIC_LOG: mean_squared_error = 4",
        "METRIC_LOG: tf_acc = 0.9", "METRIC_LOG: bad = 0.9.1", "METRIC_LOG: x = nan (ignored)"])
    df = spark.createDataFrame([(1, 1, text)], "run_id long, line_no long, text string")
    c = canonical_entries(parse_metric_log(df, "text"), ("run_id", "line_no")).filter("metric is not null")
    got = sorted((r.model, r.metric, r.value, r.is_global) for r in c.collect())
    assert got == sorted([
        ("tf_val", "accuracy", 0.5, True), ("model", "accuracy", 0.7, True), ("model", "accuracy", 0.6, True),
        ("model", "r2", 0.4, False), ("svr", "r2", 0.3, True), ("model", "mse", 4.0, True),
        ("model", "rmse", 2.0, True), ("tensorflow", "accuracy", 0.9, True)])


def _replay_lineage(events):
    known, out = set(), []
    for kind, col in events:
        if kind == "assign":
            out.append("FE" if col in known else "FA")
            known.add(col)
        else:
            out.append("FS" if col in known else None)
            known.discard(col)
    return out


def test_lineage_window_equals_sequential_replay(spark):
    from tunewright.plans.corpus import lineage, scan_events
    rng = random.Random(5)
    cells, expected_events = [], []
    for i in range(300):
        col = f"c{rng.randint(0, 6)}"
        if rng.random() < 0.4:
            cells.append(("nb.ipynb", i, f'df = df.drop(columns=["{col}"])'))
            expected_events.append(("drop", col))
        else:
            cells.append(("nb.ipynb", i, f'df["{col}"] = df["a"] * 2'))
            expected_events.append(("assign", col))
    df = spark.createDataFrame(cells, "notebook string, cell_index long, source string")
    got = {r.cell_index: r.outcome for r in lineage(scan_events(df)).collect()}
    names = {"Feature Addition": "FA", "Feature Engineering": "FE", "Feature Selection": "FS", None: None}
    assert [names[got[i]] for i in range(300)] == _replay_lineage(expected_events)


def test_literal_asof_equals_replay(spark):
    from tunewright.plans.corpus import literal_asof, scan_events
    rng = random.Random(9)
    cells, current, expected = [], {}, {}
    for i in range(200):
        if rng.random() < 0.5:
            v = rng.randint(0, 100)
            cells.append(("nb", i, f"n = {v}"))
            current["n"] = v
        else:
            cells.append(("nb", i, "m = SVC(C=n)"))
            expected[i] = json.dumps(current["n"]) if "n" in current else '"n"'
    df = spark.createDataFrame(cells, "notebook string, cell_index long, source string")
    got = {r.cell_index: r.value for r in literal_asof(scan_events(df)).collect()}
    assert got == expected


def test_load_cells_string_and_list_sources(spark, tmp_path):
    from tunewright.sources.cells import load_cells
    nb = {"cells": [{"cell_type": "markdown", "source": "# t"},
                    {"cell_type": "code", "source": ["x = 1\n", "y = 2"]},
                    {"cell_type": "code", "source": "z = 3"}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.ipynb").write_text(json.dumps(nb))
    rows = sorted((r.cell_index, r.source) for r in load_cells(spark, str(tmp_path)).collect())
    assert rows == [(1, "x = 1\ny = 2"), (2, "z = 3")]


def test_load_model_records_both_shapes(spark, tmp_path):
    from tunewright.sources.models import load_model_records
    rec = {"notebook": "dir/titanic.ipynb", "models": [
        {"type": "SVC", "parameters": {"args": [], "kwargs": {"C": 1.0, "kernel": "rbf"}}, "score": "score"}]}
    (tmp_path / "a.json").write_text(json.dumps([rec]))
    (tmp_path / "b.json").write_text(json.dumps({"notebooks": [rec]}))
    for f in ("a.json", "b.json"):
        r = load_model_records(spark, str(tmp_path / f)).collect()
        assert len(r) == 1 and r[0].stem == "titanic" and r[0].kwargs == {"C": "1.0", "kernel": "rbf"}


def test_sinks_write_and_read(spark, tmp_path):
    from tunewright.sources.sinks import append_trials, write_prepared
    df = spark.createDataFrame([(1, 0.5)], "id int, x double")
    write_prepared(df, df, {"numeric_scaler": "robust"}, str(tmp_path / "prep"))
    p = spark.read.json(str(tmp_path / "prep" / "transformation_params")).collect()
    assert [(r.name, r.value) for r in p] == [("numeric_scaler", "robust")]
    append_trials(df, str(tmp_path / "t"))
    append_trials(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_spec_override_replaces_or_appends(spark):
    from tunewright.operators.pipeline import override_param, params_text
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({},)], "p map<string,string>")
    out = [r.t for r in df.select(params_text(override_param(F.col("p"), "a", "9")).alias("t")).collect()]
    assert out == ["a=9, b=2", "a=9"]


@pytest.mark.parametrize("limit,chunk", [(1, 3), (5, 7), (50, 1000)])
def test_value_fill_limit_matches_pandas_with_hot_partition(spark, limit, chunk):
    rng = random.Random(13)
    rows = []
    for i in range(300):
        key = 0 if i % 4 else rng.randint(1, 3)
        rows.append((i, key, None if rng.random() < 0.4 else float(i)))
    df = spark.createDataFrame(rows, "o long, k long, v double")
    got = {r.o: r.v for r in fillna(df, value={"v": -1.0}, limit=limit, order_by="o", partition_by="k",
                                    chunks=chunk).collect()}
    pdf = pd.DataFrame(rows, columns=["o", "k", "v"]).sort_values("o")
    exp = pdf.groupby("k")["v"].transform(lambda s: s.fillna(-1.0, limit=limit))
    for o, v in zip(pdf["o"], exp):
        assert (got[o] is None and (v is None or math.isnan(v))) or got[o] == v


def test_stream_rerun_appends_nothing_twice(spark, tmp_path):
    from tunewright.streaming.jobs import log_lines_stream, stream_trials
    from tunewright.plans.streams import EVENTS_SCHEMA
    sf = "/root/testdata/sf0.001"
    out, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    stream_trials(spark, log_lines_stream(spark, sf, EVENTS_SCHEMA), out, ck)
    n1 = spark.read.parquet(out).count()
    stream_trials(spark, log_lines_stream(spark, sf, EVENTS_SCHEMA), out, ck)  # same checkpoint: no new files
    assert n1 > 0 and spark.read.parquet(out).count() == n1


def test_cell_scan_runs_without_the_package_installed(tmp_path):
    """The scan function travels by value: a process that cannot import the package still runs it."""
    import subprocess
    import sys as _sys

    from pyspark import cloudpickle

    from tunewright.functions import codescan
    cloudpickle.register_pickle_by_value(codescan)
    blob = tmp_path / "scan.pkl"
    blob.write_bytes(cloudpickle.dumps(codescan.scan_cells))
    code = ("import pickle, sys, pandas as pd; f = pickle.load(open(sys.argv[1], 'rb')); "
            "b = pd.DataFrame({'notebook': ['n'], 'cell_index': [0], 'calls': ['df.drop(columns=[\"a\"])'], 'models': [''], 'values': ['']}); "
            "print(sum(len(x) for x in f(iter([b]))))")
    out = subprocess.run([_sys.executable, "-c", code, str(blob)], cwd=str(tmp_path), capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.strip()) >= 1


def test_fill_follows_fractional_and_text_order_keys(spark):
    rows = [(0.1, "a", 1.0), (0.2, "b", None), (0.3, "c", 5.0), (0.4, "d", None), (0.9, "e", None)]
    df = spark.createDataFrame(rows, "k double, s string, v double")
    for key in ("k", "s"):
        for method, want in (("ffill", [1.0, 1.0, 5.0, 5.0, 5.0]), ("bfill", [1.0, 5.0, 5.0, None, None])):
            got = fillna(df, method=method, order_by=key, subset=["v"], chunks=4)
            assert [r.v for r in sorted(got.collect())] == want


def test_pad_fills_matches_only(spark):
    from tunewright.operators.frame import replace
    df = spark.createDataFrame([(1, "x"), (2, "a"), (3, "x"), (4, None), (5, "x"), (6, "x"), (7, "b")], "i int, v string")
    got = [r.v for r in sorted(replace(df, "x", None, method="pad", order_by="i").collect())]
    assert got == ["x", "a", "a", None, None, None, "b"]


def test_first_seen_codes_with_text_ids(spark):
    from tunewright.operators.encode import first_seen_codes
    df = spark.createDataFrame([("id_b", "x"), ("id_a", "y"), ("id_c", None)], "id string, c string")
    codes, n = first_seen_codes([(df, "id")], "c")
    assert n == 3 and {r.c: r.code for r in codes.collect()} == {"y": 0, "x": 1, "missing": 2}


def test_wide_encoders_turn_sparse_beyond_their_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None), (5, "a")], "i int, c string")
    model = OneHotEncoder(handle_unknown="ignore", max_columns=2).fit(df, ["c"])
    new = spark.createDataFrame([(1, "c"), (2, "z"), (3, None)], "i int, c string")
    got = {r.i: (r.c.size, r.c["index"]) for r in model.transform(new).collect()}
    assert got[1][0] == 4 and got[2][1] is None and got[3][1] in (0, 3)
    with pytest.raises(ValueError):
        OneHotEncoder(max_columns=2).fit(df, ["c"]).transform(new).collect()
    few = OneHotEncoder(handle_unknown="ignore", max_columns=2, min_frequency=2).fit(df, ["c"]).transform(df)
    assert {r.i: r.c["index"] for r in few.collect()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    d = get_dummies(df, ["c"], max_columns=2)
    assert d.columns == ["i", "c"] and {r.i: (r.c.size, r.c["index"]) for r in d.collect()} == {
        1: (3, 1), 2: (3, 0), 3: (3, 2), 4: (3, None), 5: (3, 0)}


def test_rfe_ranks_count_rounds(spark):
    from tunewright.operators.select import RFE
    rng = random.Random(3)
    rows = [tuple(rng.gauss(0, 1) for _ in range(10)) for _ in range(200)]
    names = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame([(*r, int(sum(r[:4]) + 0.1 * r[5] > 0)) for r in rows],
                               ", ".join(f"{n} double" for n in names) + ", y int")
    for step, ranks in ((3, {1: 4, 2: 3, 3: 3}), (2, {1: 4, 2: 2, 3: 2, 4: 2}), (0.3, {1: 4, 2: 3, 3: 3})):
        got = {}
        for r in RFE(n_features_to_select=4, step=step).fit(df, names, "y").collect():
            got[r.ranking] = got.get(r.ranking, 0) + 1
        assert got == ranks


def test_stream_loses_no_line_of_many_files(spark, tmp_path):
    from tunewright.plans.streams import EVENTS_SCHEMA
    from tunewright.streaming.jobs import log_lines_stream, read_last_values, stream_last_values, stream_trials
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts", ascending=False).repartition(5).write.parquet(str(tmp_path / "many" / "events.parquet"))
    got = []
    for i, folder in enumerate(("/root/testdata/sf0.001", str(tmp_path / "many"))):
        lines = log_lines_stream(spark, folder, EVENTS_SCHEMA)
        stream_trials(spark, lines, f"{tmp_path}/t{i}", f"{tmp_path}/c{i}")
        stream_last_values(spark, lines, f"{tmp_path}/l{i}", f"{tmp_path}/d{i}")
        t = spark.read.parquet(f"{tmp_path}/t{i}").drop("epoch")
        got.append((sorted(map(str, t.collect())), sorted(map(str, read_last_values(spark, f"{tmp_path}/l{i}").collect()))))
    assert got[0] == got[1] and len(got[0][0]) > 100


def test_deep_cells_are_scanned_or_reported(spark):
    from tunewright.plans.corpus import scan_events
    deep = "x = " + "+".join(["1"] * 1500) + "\nm = SVC(C=2)"
    bad = "x = " + "(" * 3000 + "1" + ")" * 3000
    cells = spark.createDataFrame([("nb", 0, deep), ("nb", 1, bad), ("nb", 2, None), ("nb", 3, "a\x00b")],
                                  "notebook string, cell_index long, source string")
    ev = scan_events(cells).collect()
    assert any(r.func == "SVC" and r.cell_index == 0 for r in ev)
    assert {(r.cell_index, r.scan) for r in ev if r.kind == "error"} >= {(1, "calls"), (1, "models"), (3, "values")}


def test_load_cells_keeps_equal_names_and_list_literals_apart(spark, tmp_path):
    from tunewright.sources.cells import load_cells
    for folder, source in (("a", "[f(x) for x in y]"), ("b", '["p"]'), ("c", ["z = 1\n", "w"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": source}]}))
    rows = load_cells(spark, str(tmp_path)).collect()
    assert {r.name for r in rows} == {"x.ipynb"}
    assert {r.notebook: r.source for r in rows} == {
        "a/x.ipynb": "[f(x) for x in y]", "b/x.ipynb": '["p"]', "c/x.ipynb": "z = 1\nw"}


def test_report_keeps_trials_with_unknown_keys(spark):
    from tunewright.plans.trials import ranked_report
    rows = [("m", None, "1", i, 0.1 * i, 1.0, 1.0, 1.0, 1.0) for i in range(3)] + [("m", "p", "1", 9, 0.5, 1.0, 1.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "method string, parameter string, value string, ord long, accuracy double, f1 double, "
                                    "mse double, rmse double, r2 double")
    assert sorted((r.ord, r["rank"]) for r in ranked_report(t).collect()) == [(0, 3), (1, 2), (2, 1), (9, 1)]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
                min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_exact_quantiles_property(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [p], bins=4, finish_rows=5)["x"][p]
    arr = [v for v in vals if v is not None]
    if not arr:
        assert got is None
    else:
        assert got == pytest.approx(float(np.percentile(arr, p * 100)), rel=1e-9, abs=1e-9)


def test_scaler_variances_closed_form_matches_numpy(spark):
    from tunewright.operators.autoprep import scaler_variances
    rows = [(1.0, 5.0, None), (2.0, 5.0, 4.0), (3.0, 5.0, 10.0), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, k double, b double")
    got = {r.scaler: (r.variance, r.chosen) for r in scaler_variances(df, ["a", "k", "b"]).collect()}
    X = pd.DataFrame(rows, columns=["a", "k", "b"]).astype(float)
    X = X.fillna(X.mean())

    def z(v):
        return 1.0 if abs(v) < 1e-14 else v
    exp = {
        "standard": ((X - X.mean()) / X.std(ddof=0).map(z)).to_numpy(),
        "minmax": ((X - X.min()) / (X.max() - X.min()).map(z)).to_numpy(),
        "robust": ((X - X.median()) / (X.quantile(0.75) - X.quantile(0.25)).map(z)).to_numpy(),
    }
    for s, m in exp.items():
        assert got[s][0] == pytest.approx(float(np.var(m)), rel=1e-9)
    best = max(exp, key=lambda s: (np.var(exp[s]), -list(exp).index(s)))
    assert got[best][1] and sum(c for _, c in got.values()) == 1
    empty = spark.createDataFrame([(None, 1.0)], "e double, x double")
    assert all(not r.chosen and r.variance is None for r in scaler_variances(empty, ["e", "x"]).collect())


@pytest.mark.parametrize("model,label,objective,settings", [
    ("RandomForestClassifier", "cls", "f1", [{"n_estimators": "5", "max_depth": "2"}, {"n_estimators": "5"}]),
    ("GradientBoostingClassifier", "cls", "accuracy", [{"n_estimators": "3"}]),
    ("SVC", "cls", "accuracy", [{"C": "1", "kernel": "linear", "max_iter": "5"}]),
    ("GradientBoostingRegressor", "y", "neg_mean_squared_error", [{"n_estimators": "3"}]),
])
def test_search_fits_each_kind_of_model(spark, model, label, objective, settings):
    d = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"),
                                F.when(F.col("id") % 10 > 4, 1).otherwise(0).alias("cls"),
                                (F.col("id") % 10 * 3).cast("double").alias("y"))
    kwargs = {"kernel": "linear", "max_iter": "5"} if model == "SVC" else {"n_estimators": "3", "n_jobs": "-1"}
    named = [(", ".join(f"{k}={v}" for k, v in s.items()), s) for s in settings]
    r = search.random_search(d, d, ["x"], label, model, kwargs, named, objective, folds=2)
    assert r.trials.count() == 2 * len(settings) and r.summary.count() == len(settings)
    assert r.best_setting in dict(named) and r.ignored == (["kernel"] if model == "SVC" else ["n_jobs"])
    if label == "cls":
        assert r.optimized["accuracy"] > 0.9
    else:
        assert r.optimized["r2"] > 0.5


def test_kernels_without_an_estimator_are_refused_not_replaced():
    with pytest.raises(ValueError):
        search.translate("SVC", {"kernel": "rbf"}, 10)


def test_folds_of_repeated_ids_keep_every_row(spark):
    d = spark.range(100).select((F.col("id") % 25).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("y"))
    out = stratified_folds(d, "y", "id", 5)
    assert out.count() == 100 and out.columns == ["id", "y", "fold"]


def test_typed_candidates_of_every_kind(spark):
    from tunewright.plans.catalog import typed_candidate
    inf = float("inf")
    cases = [("null", "p", "null", None, None, None, None, "None"), (None, "p", "null", None, None, None, None, "None"),
             ("true", "p", "boolean", None, True, None, None, "True"), ('"inf"', "p", "number", inf, None, None, None, "float('inf')"),
             ('"-inf"', "p", "number", -inf, None, None, None, "float('-inf')"), ("-0.5", "p", "number", -0.5, None, None, None, "-0.5"),
             ('"np.float64"', "p", "name", None, None, "np.float64", None, "np.float64"),
             ('"l1"', "p", "string", None, None, "l1", None, "'l1'"), ('"it\'s"', "p", "string", None, None, "it's", None, "'it\\'s'"),
             ("[0.0, 1.0]", "feature_range", "tuple", None, None, None, 2, "(0.0, 1.0)"),
             ('["a", null, 2, true]', "p", "list", None, None, None, 4, "['a', None, 2, True]"), ("[]", "p", "list", None, None, None, 0, "[]"),
             ('{"a": 1}', "p", "map", None, None, None, None, '{"a": 1}'), ("nope", "p", "invalid", None, None, None, None, None)]
    d = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, j string, p string")
    t = typed_candidate(F.col("j"), F.col("p"))
    got = d.select("i", *[t[c].alias(c) for c in ("kind", "number", "flag", "text")], F.when(
        t["items"].isNotNull(), F.size(t["items"])).alias("n"), t["literal"].alias("literal"), t["entries"].isNotNull().alias("m")).orderBy("i").collect()
    assert [tuple(r[1:7]) for r in got] == [c[2:] for c in cases]
    assert [r["m"] for r in got] == [c[2] == "map" for c in cases]
    nan = spark.createDataFrame([('"NaN"',)], "j string")
    assert nan.select(typed_candidate(F.col("j"), F.lit("p"))["number"].alias("n")).where("isnan(n)").count() == 1


def test_search_records_share_the_trials_they_write(spark, tmp_path):
    from tunewright.sources.sinks import write_trials
    log = spark.createDataFrame([("nb1", "C=1", 0, 0.5), ("nb2", "C=1", 0, 0.5)], "stem string, setting string, fold int, score double")
    write_trials(log, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").where("stem = 'nb2'").collect())) == [("C=1", 0, 0.5, "nb2")]


def test_map_refuses_repeated_keys(spark):
    from tunewright.operators.frame import map_values
    d = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    one = spark.createDataFrame([("a", 1), (None, 7), (None, 8)], "key string, value int")
    assert [r["x"] for r in map_values(d, "x", one).collect()] == [1, None, None]
    with pytest.raises(ValueError, match="repeat"):
        map_values(d, "x", one.union(spark.createDataFrame([("a", 2)], "key string, value int")))
    assert map_values(d, "x", one.where("false")).where("x is null").count() == 3


def test_knn_many_tasks_ties_copies_and_rows_without_distance(spark, monkeypatch):
    """chunks, groups and tiles give what a plain comparison of all pairs gives; a row with a null component
    has no distance (before, a null vector drawn as a pivot ended the job, and a NaN emptied its cell)."""
    import math
    import random

    from tunewright.operators import knn

    for name, size in (("CHUNK", 64), ("GROUP", 16), ("MOST", 16), ("TILE", 32), ("TILE_Q", 8)):
        monkeypatch.setattr(knn, name, size)
    rnd = random.Random(1)
    point = lambda: [float(rnd.randint(0, 3)) for _ in range(3)]
    train = [(i, point()) for i in range(300)] + [(300 + i, [9.0, 9.0, 9.0]) for i in range(40)] + [
        (400, None), (401, [1.0, None, 2.0]), (402, [1.0, 2.0]), (403, [math.nan, 1.0, 1.0]), (5, [1.0, 1.0, 1.0])]
    asked = [(i, point()) for i in range(40)] + [(5, [0.0, 0.0, 0.0]), (50, None), (51, [9.0, 9.0, 9.0]), (52, [1.0, 2.0])]
    near = {}
    for qid, q in asked:
        for tid, t in train:
            if q and t and None not in t and len(t) == len(q):
                d = math.sqrt(sum((a - b) * (a - b) for a, b in zip(q, t, strict=True)))
                near.setdefault(qid, []).append((math.inf if math.isnan(d) else d, tid))
    want = {(q, r + 1, t, d) for q, found in near.items() for r, (d, t) in enumerate(sorted(found)[:5])}
    schema = "id long, vec array<double>"
    got = knn.knn_neighbors(spark.createDataFrame(train, schema), spark.createDataFrame(asked, schema), 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_knn_without_rows(spark):
    from tunewright.operators.knn import knn_neighbors

    none = spark.createDataFrame([], "id long, vec array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<float>")
    assert knn_neighbors(none, some, 5).collect() == [] and knn_neighbors(some, none, 5).collect() == []


def test_sample_grid_draws_before_rows_are_made(spark):
    """a record's draws are picked from its own grid; records of one key, or of none, still draw together."""
    import hashlib

    grid = [(m, f"a={i}", {"a": str(i)}) for m, n in (("A", 50), ("B", 7)) for i in range(n)]
    recs = [("x", 1, "A"), ("x", 2, "B"), ("y", 1, "A"), ("y", 1, "B"), ("y", 1, "A"), (None, None, "A"), (None, None, "B")]
    out = search.sample_grid(spark.createDataFrame(recs, "notebook string, cell_index long, model_type string"),
                             spark.createDataFrame(grid, "model string, setting string, params map<string,string>"), 20)
    want = []
    for nb, ci in {r[:2] for r in recs}:
        drawn = []
        for r in recs:
            if r[:2] == (nb, ci):
                for m, s, _ in grid:
                    if m == r[2]:
                        text = "|".join(["42", *[str(k) for k in (nb, ci) if k is not None], s])
                        drawn.append((hashlib.md5(text.encode()).hexdigest(), s))
        want += [(nb, ci, s, i + 1) for i, (_, s) in enumerate(sorted(drawn)[:20])]
    got = [(r["notebook"], r["cell_index"], r["setting"], r["draw"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()  # before: all settings were rows


def test_names_as_of_an_output_by_blocks_of_cells(spark, monkeypatch):
    """the name known at an output is found within blocks of cells; blocks without a name take the last one."""
    from tunewright.plans import nbmetrics

    facts = spark.createDataFrame(
        [(nb, c, 0, "gb", key, v) for nb, c, key, v in [
            ("a", 0, "mse_calc", "true"), ("a", 1, "var_name", "gb_one"), ("a", 6, "var_name", "gb_two"),
            ("b", 3, "mse_calc", "true"), ("b", 9, "var_name", "gb_one")]],
        "notebook string, cell_index long, dfs int, model string, key string, value string")
    outputs = spark.createDataFrame(
        [(nb, c, f"gb_one mse: {c}.5 gb_two mse: {c}.25") for nb in "ab" for c in range(12)],
        "notebook string, cell_index long, text string")

    def values():
        return sorted(tuple(r) for r in nbmetrics.output_values(outputs, facts).collect())

    whole = values()
    assert whole
    for size in (1, 2, 5):
        monkeypatch.setattr(nbmetrics, "NAME_BLOCK", size)
        assert values() == whole


def test_equal_texts_of_a_cell_are_parsed_once(monkeypatch):
    """One parse for the scans of equal texts, errors too; each scan still has its own rows."""
    from tunewright.functions import codescan

    parsed = []
    parse = codescan.ast.parse
    monkeypatch.setattr(codescan.ast, "parse", lambda text: parsed.append(text) or parse(text))
    texts = ["x = 1\nfit(x)", "def broken(:", None]
    cells = pd.DataFrame({"notebook": ["n"] * 3, "cell_index": range(3), "calls": texts, "models": texts, "values": texts})
    out = pd.concat(codescan.scan_cells([cells]))
    assert parsed == ["x = 1\nfit(x)", "def broken(:", ""]
    assert sorted(out.loc[out["kind"] == "error", "scan"]) == ["calls", "models", "values"]
    assert set(out.loc[out["cell_index"] == 0, "scan"]) == {"calls", "models", "values"}


def test_suffix_array_is_the_full_order_with_common_prefixes():
    """suffixes are ordered by all their tokens (before, by the first six), with exact common prefix lengths."""
    from tunewright.llm.html_extract import suffix_array

    rnd = random.Random(3)
    for tokens in ([], [7], [1] * 40, [rnd.randint(0, 2) for _ in range(200)], list(range(30)) * 4):
        order, lcp = suffix_array(np.array(tokens, np.uint64))
        want = sorted(range(len(tokens)), key=lambda i: tokens[i:])
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = tokens[want[k - 1]:], tokens[want[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same
