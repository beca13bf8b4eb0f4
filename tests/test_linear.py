"""Additive statistics, selectors by sweeps and the trial graph against numpy and step-by-step versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.operators import frame as frame_ops
from tunewright.operators import gram
from tunewright.operators import trialgraph as tg
from tunewright.operators.gram import LinearSpec, eliminate, least_squares, moments, search_specs
from tunewright.operators.select import RFE, SelectFromModel


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(1000, 3, (600, 4))
    x[:, 3] = 2 * x[:, 0] - 7  # determined by the first column
    y = x @ [0.5, -2, 1, 0] + rng.normal(0, 1, 600) + 4
    return x, y, np.arange(600) % 5


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y, fold = rows
    return spark.createDataFrame([(*map(float, a), float(b), int(f)) for a, b, f in zip(x, y, fold)],
                                 "a double, b double, c double, d double, y double, fold int").repartition(3)


def plain(x, y, keep, cols, intercept):
    a = x[:, cols]
    a = np.column_stack([np.ones(len(x)), a]) if intercept else a
    w = np.linalg.lstsq(a[keep], y[keep], rcond=None)[0]
    e = a @ w - y
    out = y[~keep] if (~keep).any() else y
    part = ~keep if (~keep).any() else keep
    return w, (e[part] ** 2).mean(), 1 - (e[part] ** 2).sum() / ((out - out.mean()) ** 2).sum()


@pytest.mark.parametrize("intercept", [True, False])
def test_folds_by_subtraction_equal_fits_on_rows(frame, rows, intercept):
    x, y, fold = rows
    m = moments(frame, ["a", "b", "c", "d", "y"], F.col("fold"))
    specs = [LinearSpec(("a", "b", "c"), intercept), LinearSpec(("c", "a"), intercept)]
    got = {(r["spec"], r["fold"]): r for r in search_specs(m, specs, "y", range(4), 4)}
    for i, cols in enumerate(([0, 1, 2], [2, 0])):
        for f in range(4):
            keep = (fold != f) & (fold != 4)
            a = np.column_stack([np.ones(600), x[:, cols]]) if intercept else x[:, cols]
            w = np.linalg.lstsq(a[keep], y[keep], rcond=None)[0]
            e = (a @ w - y)[fold == f]
            assert got[i, f]["mse"] == pytest.approx((e ** 2).mean(), rel=1e-8) and got[i, f]["n"] == 120
        _, mse, r2 = plain(x, y, fold != 4, cols, intercept)
        assert got[i, -1]["mse"] == pytest.approx(mse, rel=1e-8) and got[i, -1]["r2"] == pytest.approx(r2, rel=1e-7)


def test_determined_and_constant_columns_are_left_out(frame, rows):
    x, y, _ = rows
    d = frame.withColumn("one", F.lit(5.0))
    m = moments(d, ["one", "a", "b", "c", "d", "y"])
    fit = least_squares(m, m.total(), ["one", "a", "b", "c", "d"], "y")
    assert fit.aliased == ["one", "d"]
    w, _, _ = plain(x, y, np.ones(600, bool), [0, 1, 2], True)
    assert [fit.intercept, *fit.coefficients[[1, 2, 3]]] == pytest.approx(w.tolist(), rel=1e-6)
    assert d.select(F.max(F.abs(fit.predict() - (F.lit(w[0]) + F.col("a") * w[1] + F.col("b") * w[2] + F.col("c") * w[3])))
                    ).first()[0] < 1e-6


def test_missing_values_and_empty_tables(spark, frame):
    holes = frame.withColumn("b", F.when(F.col("a") > 1000, F.col("b")))
    with pytest.raises(ValueError, match="missing values in b"):
        moments(holes, ["a", "b", "y"])
    m = moments(holes.withColumn("e", F.lit(float("nan"))), ["a", "b", "e", "y"], missing_ok=True)
    assert m.missing == {"b", "e"}
    assert least_squares(m, m.total(), ["a"], "y").coefficients[0] == pytest.approx(
        least_squares(moments(frame, ["a", "y"]), moments(frame, ["a", "y"]).total(), ["a"], "y").coefficients[0])
    with pytest.raises(ValueError, match="no rows"):
        moments(frame.where("a < 0"), ["a", "y"])


@pytest.mark.parametrize("step", [1, 2])
def test_elimination_equals_refits(frame, rows, step):
    x, y, _ = rows
    alive, want = [0, 1, 2], []
    while len(alive) > 1:
        w, _, _ = plain(x, y, np.ones(600, bool), alive, True)
        gone = [alive[j] for j in sorted(range(len(alive)), key=lambda j: w[j + 1] ** 2)[:min(step, len(alive) - 1)]]
        want.append(["abc"[g] for g in gone])
        alive = [a for a in alive if a not in gone]
    m = moments(frame, ["a", "b", "c", "y"])
    assert eliminate(m, m.total(), list("abc"), "y", 1, step) == want
    ranked = {r["feature"]: r["ranking"] for r in RFE(1, step, estimator="linear").fit(frame, list("abc"), "y").collect()}
    assert ranked == {"abc"[alive[0]]: 1} | {f: i + 2 for i, g in enumerate(reversed(want)) for f in g}


def test_prefit_needs_and_takes_given_importances(frame):
    with pytest.raises(ValueError, match="prefit"):
        SelectFromModel(prefit=True).fit(frame, ["a", "b"], "y")
    got = SelectFromModel(prefit=True, threshold=0.5).fit(frame, ["a", "b"], "y", importances=[0.4, 0.6]).collect()
    assert [(r["feature"], r["selected"]) for r in got] == [("a", False), ("b", True)]


# trial graph


def small(spark):
    rows = [(i, float(i % 9), None if i % 4 == 0 else float(i * i % 23), "ab"[i % 2], float(i % 5 + (i % 2)), i % 3 > 0)
            for i in range(90)]
    return spark.createDataFrame(rows, "id long, p double, q double, w string, y double, train boolean")


def run(spark, specs, candidates=None):
    trials = tg.expand(specs, candidates or {})
    return tg.run_sweep(small(spark), trials, "y", F.col("train"), "id", parallelism=3)


def test_shared_stages_run_once_and_scores_are_those_of_single_runs(spark):
    head = tg.Stage("SimpleImputer", ("q",))
    specs = [tg.Spec("one", ("p", "q"), (head, tg.Stage("StandardScaler", ("p", "q")))),
             tg.Spec("two", ("p", "q"), (head, tg.Stage("Normalizer", ("p", "q")), tg.Stage("RFE")))]
    candidates = {("Normalizer", "norm"): [(0, "l1", "l1"), (1, "l2", "l2")], ("StandardScaler", "copy"): [
        (0, "False", False)], ("SimpleImputer", "strategy"): [(0, "median", "median")]}
    got = run(spark, specs, candidates)
    assert len(got.scores) == 7 and got.stages == 3 * 2 + 4 * 3
    # imputer: mean, median; scaler on each; normaliser l2 on each and l1; selector on each of the three
    assert got.applications == 2 + 2 + 3 + 3
    for s in got.scores:
        alone = tg.run_sweep(small(spark), [s.trial], "y", F.col("train"), "id").scores[0]
        assert (s.status, alone.status) == ("ok", "ok") and s.mse == pytest.approx(alone.mse, rel=1e-9)


def test_a_failure_fails_its_trials_only(spark):
    spec = tg.Spec("s", ("p", "q", "w"), (tg.Stage("fillna", ("q",), (("value", 0.0),)), tg.Stage("OneHotEncoder", ("w",))))
    candidates = {("fillna", "method"): [(0, "ffill", "ffill")], ("OneHotEncoder", "drop"): [(0, "first", "first")],
                  ("OneHotEncoder", "nothing"): [(0, "1", 1)]}
    got = {(s.trial.param, s.trial.value_text): s for s in run(spark, [spec], candidates).scores}
    assert got["baseline", "default"].status == got["drop", "first"].status == "ok"
    assert got["baseline", "default"].n_features == 4 and got["baseline", "default"].n_used == 3
    assert got["method", "ffill"].error.startswith("ValueError") and got["nothing", "1"].error.startswith("TypeError")
    assert got["baseline", "default"].mse == pytest.approx(got["drop", "first"].mse, rel=1e-9)


def test_failures_in_rows_missing_columns_words_and_holes(spark):
    specs = [tg.Spec("holes", ("p", "q"), ()), tg.Spec("words", ("p", "w"), ()),
             tg.Spec("gone", ("p",), (tg.Stage("MinMaxScaler", ("q",)),)),
             tg.Spec("fine", ("p",), (tg.Stage("MinMaxScaler", ("p",)),))]
    errors = {s.trial.spec.name: s.error for s in run(spark, specs).scores}
    assert errors["fine"] is None and errors["holes"].endswith("missing values in q")
    assert errors["words"].endswith("could not convert w to numbers") and errors["gone"].startswith("KeyError")


def test_a_stage_that_fails_on_its_rows_is_found(spark, monkeypatch):
    def bad(train, cols, label, order_by, params):
        return lambda df: df.select(*[F.raise_error(F.lit("broken row")).cast("double").alias(c) if c in cols else
                                      F.col(c) for c in df.columns])
    monkeypatch.setitem(tg.TRANSFORMS, "Bad", bad)
    specs = [tg.Spec("bad", ("p",), (tg.Stage("Bad", ("p",)),)), tg.Spec("good", ("p",), (tg.Stage("MinMaxScaler", ("p",)),))]
    got = {s.trial.spec.name: s for s in run(spark, specs).scores}
    assert got["bad"].status == "failed" and got["good"].status == "ok"


def test_candidates_of_set_parameters_and_untouched_methods_make_no_trial():
    spec = tg.Spec("s", ("p",), (tg.Stage("dropna"), tg.Stage("StandardScaler", ("p",), (("with_mean", False),))))
    candidates = {("dropna", "how"): [(0, "all", "all")], ("StandardScaler", "with_mean"): [(0, "True", True)],
                  ("StandardScaler", "with_std"): [(0, "True", True), (1, "False", False)]}
    assert [(t.param, t.value_text) for t in tg.expand([spec], candidates)] == [
        ("baseline", "default"), ("with_std", "True"), ("with_std", "False")]
    assert tg.typed(["-inf", 1]) == (float("-inf"), 1)


# logistic models of a search together


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (500, 3)) * [1, 50, 0.01] + [0, 300, 5]
    z = (x - x.mean(0)) / x.std(0)
    y = (z @ [1.5, -0.8, 0.0] + rng.logistic(0, 1, 500) > 0.3).astype(float)
    part = np.where(np.arange(500) % 6 == 5, -1, np.arange(500) % 6 % 3)
    frame = spark.createDataFrame([(*map(float, a), float(b), int(p)) for a, b, p in zip(x, y, part)],
                                  "a double, b double, c double, y double, part int").repartition(4)
    return frame, x, y, part


def test_every_model_is_at_its_optimum(labelled):
    from tunewright.operators.logistic import LogisticSpec, fit_logistic
    frame, x, y, part = labelled
    specs = [LogisticSpec(c, p, f) for c in (0.01, 1.0, 10.0) for p in ("l1", "l2") for f in (-1, 0, 2)]
    fits = fit_logistic(frame, ["a", "b", "c"], "y", "part", specs)
    for s, f in zip(specs, fits):
        assert f.converged and f.steps < 30
        use = (part >= 0) & (part != s.without)
        z = np.column_stack([np.ones(500), (x - f.center) / f.scale])[use]
        slope = z.T @ (1 / (1 + np.exp(-z @ f.weights)) - y[use])
        w = f.weights[1:]
        assert abs(slope[0]) < 1e-3
        if s.penalty == "l2":
            assert np.abs(slope[1:] + w / s.C).max() < 1e-3
        else:  # zero weights: a slope within the penalty's kink
            assert all(abs(g + np.sign(v) / s.C) < 1e-3 if v else abs(g) <= 1 / s.C + 1e-3 for g, v in zip(slope[1:], w))
    a, w = fits[3].coefficients()
    assert np.allclose(a + x @ w, np.column_stack([np.ones(500), (x - fits[3].center) / fits[3].scale]) @ fits[3].weights)


def test_equals_the_library_model(spark, labelled):
    from pyspark.ml.classification import LogisticRegression

    from tunewright.operators.logistic import LogisticSpec, fit_logistic
    from tunewright.operators.search import assemble
    frame, x, y, part = labelled
    own = frame.where("part >= 0")
    n = own.count()
    fit, = fit_logistic(frame, ["a", "b", "c"], "y", "part", [LogisticSpec(0.5, "l2")])
    model = LogisticRegression(regParam=1 / (0.5 * n), maxIter=500, tol=1e-12, standardization=True).fit(
        assemble(own, ["a", "b", "c"], "y"))
    sample = np.sqrt(n / (n - 1))  # the library divides by n - 1
    assert fit.coefficients()[1] == pytest.approx(model.coefficients.toArray(), rel=2e-2 * sample)


def test_search_scores_are_those_of_the_rows(labelled):
    from tunewright.operators.logistic import logistic_search
    frame, x, y, part = labelled
    settings = [("C=1, penalty=l1", 1.0, "l1"), ("C=0.001, penalty=l2", 0.001, "l2")]
    res = logistic_search(frame, ["a", "b", "c"], "y", "part", 3, settings)
    z = np.column_stack([np.ones(500), (x - res.original.center) / res.original.scale])
    for number, f in enumerate(res.fits):
        for p in (-1, 0, 1, 2):
            own = part == p
            hit = z[own] @ f.weights > 0
            got = res.scores[number, p]
            tp = (hit & (y[own] == 1)).sum()
            assert got["n"] == own.sum() and got["accuracy"] == pytest.approx((hit == y[own]).mean())
            assert got["precision"] == pytest.approx(tp / hit.sum() if hit.sum() else 0.0)
            assert got["recall"] == pytest.approx(tp / y[own].sum())
    assert len(res.trials("f1")) == 6 and res.best("accuracy")[0] == "C=1, penalty=l1"
    with pytest.raises(ValueError, match="penalty"):
        logistic_search(frame, ["a"], "y", "part", 3, [("x", 1.0, "elasticnet")])


def test_l1_step_is_exact_where_columns_determine_each_other():
    from tunewright.operators.logistic import _step
    rng = np.random.default_rng(5)
    level, other = rng.integers(0, 5, 4000), rng.integers(0, 6, 4000)
    z = np.column_stack([level == i for i in range(5)] + [other == i for i in range(6)] + [rng.normal(size=4000)]).astype(float)
    z = np.column_stack([np.ones(4000), (z - z.mean(0)) / z.std(0)])
    y = rng.integers(0, 2, 4000) + 0.3 * (level == 2) + 0.1 * other
    h, g, strength = z.T @ z, -z.T @ y, 1e-3
    w = _step(np.zeros(13), g, h, strength, True)
    slope = g + h @ w
    assert abs(slope[0]) < 1e-5
    off = np.where(w[1:] == 0, np.maximum(np.abs(slope[1:]) - strength, 0), np.abs(slope[1:] + strength * np.sign(w[1:])))
    assert off.max() < strength / 100  # creeping along the columns that add up to one leaves slopes of its size
    assert (w[1:] == 0).sum() >= 2


def test_sums_of_models_are_those_of_their_rows():
    from tunewright.operators import logistic
    rng = np.random.default_rng(6)
    z, y = np.column_stack([np.ones(700), rng.normal(0, 3, (700, 3))]), rng.integers(0, 2, 700).astype(float)
    part, weights = rng.integers(0, 3, 700), rng.normal(0, 4, (4, 4))
    keep = part[:, None] != np.array([0, 1, 2, -1])
    got = logistic._batch_sums(z, y, keep, weights)
    for j, w in enumerate(weights):
        x, t = z[keep[:, j]], y[keep[:, j]]
        m = x @ w
        p = 1 / (1 + np.exp(-m))
        h = (x * (p * (1 - p))[:, None]).T @ x
        want = np.concatenate([[np.logaddexp(0, m).sum() - t @ m], x.T @ (p - t), h[np.triu_indices(4)]])
        assert np.allclose(got[j], want, rtol=1e-9, atol=1e-9)


def test_moments_keep_their_digits_when_the_first_rows_lie_far_from_the_mean(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr(
        "cast(id as int) % 3 k", "case when id < 1200 then 1e9 + id % 2 else id % 7 end a", "id % 5 + 0.5 b",
        "if(id % 9 = 0, null, id) c", "7.25D d")
    x = np.array([[1e9 + i % 2 if i < 1200 else i % 7, i % 5 + 0.5, 7.25] for i in range(4000)])
    calls, one = [], gram._pass
    try:
        gram._pass = lambda *a: calls.append(a) or one(*a)
        m = gram.moments(df, ["a", "b", "c", "d"], F.col("k"), missing_ok=True)
        gram.moments(df.select("b"), ["b"])
    finally:
        gram._pass = one
    assert len(calls) <= 3 and m.missing == {"c"}
    own = [0, 1, 3]
    assert np.allclose(m.center[own], x.mean(0), rtol=1e-12) and np.allclose(m.scale[[0, 1]], x.std(0)[:2], rtol=1e-9)
    z = np.column_stack([np.ones(4000), (x - m.center[own]) / m.scale[own]])
    for key in range(3):
        at = np.arange(4000) % 3 == key
        got = m.take(["a", "b", "d"]).parts[key]
        assert np.allclose(got, z[at].T @ z[at], atol=1e-7)
    assert not m.parts[0][3].any()


def test_a_sweep_orders_the_rows_once_and_parts_the_specs(spark):
    specs = [tg.Spec("fill", ("p", "q"), (tg.Stage("fillna", ("q",), (("value", 0.0), ("limit", 4))),)),
             tg.Spec("pad", ("q",), (tg.Stage("fillna", ("q",), (("method", "ffill"),)), tg.Stage("SimpleImputer", ("q",)))),
             tg.Spec("also", ("q",), (tg.Stage("fillna", ("q",), (("method", "ffill"),)), tg.Stage("MinMaxScaler", ("q",)),
                                      tg.Stage("SimpleImputer", ("q",))))]
    trials = tg.expand(specs, {})
    groups = tg._groups(trials)
    assert groups[0] != groups[1] == groups[2]
    got = {s.trial.spec.name: s for s in run(spark, specs).scores}
    assert got["fill"].status == "failed" and "missing values" in got["fill"].error
    assert got["pad"].mse == pytest.approx(got["also"].mse, rel=1e-9)


def test_a_sweep_leaves_no_table_behind(spark):
    """a level's table replaces the one before; before, each level stayed as a checkpoint of whole rows."""
    from pathlib import Path

    from tunewright.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {p for p in folder.rglob("*") if p.is_file()}
    spec = tg.Spec("two", ("p",), (tg.Stage("StandardScaler", ("p",)), tg.Stage("MinMaxScaler", ("p",))))
    assert [s.status for s in run(spark, [spec]).scores] == ["ok"]
    assert {p for p in folder.rglob("*") if p.is_file()} == before


def test_fills_of_a_whole_table_join_no_rows_by_one_key(spark):
    rows = [(i, None if i % 3 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double")
    first = frame_ops.fillna(df, value=-1.0, limit=5, order_by="id", subset=["v"], chunks=4)
    assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert [r["id"] for r in first.where("v = -1").orderBy("id").collect()] == [1, 2, 4, 5, 7]
    last = frame_ops.fillna(df, method="ffill", limit=1, order_by="id", subset=["v"], chunks=4)
    assert "SortMergeJoin" not in last._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in last.orderBy("id").collect()] == [None if i % 3 == 2 else float(i - i % 3) for i in range(60)]


def test_search_joins_its_tables_once(spark, tmp_path, monkeypatch):
    from tunewright.operators import autoprep, impute, logistic, metrics
    from tunewright.plans import sweep
    spark.createDataFrame([(i, i % 6, 100.0 + i * 37 % 53, f"P{i % 3}", "FO"[i % 5 < 3]) for i in range(120)],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, "
                          "o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, f"Customer#{i}", i, i * 1.5, f"S{i % 2}") for i in range(6)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(str(tmp_path / "customer.parquet"))
    seen = []

    def watched(f, at):
        def call(*args, **kw):
            seen.append(args[at])
            return f(*args, **kw)
        return call

    monkeypatch.setattr(logistic, "MAX_STEPS", 1)  # the passes of the fits are not looked at
    monkeypatch.setattr(autoprep, "prepare", watched(autoprep.prepare, 0))
    monkeypatch.setattr(impute.TrainStatImputer, "fit", watched(impute.TrainStatImputer.fit, 1))
    monkeypatch.setattr(metrics, "stratified_folds", watched(metrics.stratified_folds, 0))
    out = sweep.q_raw_vs_prepared(spark, str(tmp_path))
    assert out.count() == 16 and len(seen) == 4
    for df in seen:  # a pass over any of them reads what was written, not the joined tables
        assert df.inputFiles() and not any(f"{tmp_path}/" in f for f in df.inputFiles())
