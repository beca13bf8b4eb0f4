"""Names resolved in calls, against a sequential replay, and the usual table names."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tunewright.plans.corpus import discover_tables, model_records, scan_events
from tunewright.plans.names import resolve_calls, resolve_names

CELLS = "notebook string, cell_index long, source string"


def events(spark, sources):
    return scan_events(spark.createDataFrame([("a.ipynb", i, s) for i, s in enumerate(sources)], CELLS))


def values(spark, sources, **kw):
    return {(r.cell_index, r.path): r.value for r in resolve_names(events(spark, sources), **kw).collect()}


def test_long_chain_is_followed_and_cut_by_later_assignments(spark):
    chain = ["v0 = 3"] + [f"v{i} = v{i - 1}" for i in range(1, 20)]
    got = values(spark, chain + ["v0 = 4", "m = SVC(v19, C=v0)", "v5 = v5", "m = SVC(v5, kernel=gone)"], chains=True)
    assert got == {(21, "0"): "3", (21, "C"): "4", (23, "0"): "3", (23, "kernel"): '"gone"'}
    assert values(spark, chain + ["m = SVC(v19)"]) == {(20, "0"): '"v19"'}


def test_chain_to_a_name_without_value_keeps_the_written_name(spark):
    assert values(spark, ["b = a", "c = b", "m = SVC(c)", "c = f(1)", "m = SVC(c)"], chains=True) == {
        (2, "0"): '"c"', (4, "0"): '"c"'}


def test_layers_positions_and_metrics_take_their_values(spark):
    ev = events(spark, ["u = 8; act = 'relu'; opt = 'adam'", "net = Sequential()",
                        "net.add(Dense(u, activation=act))\nnet.add(Dense(u + 1))",
                        "net.compile(opt, optimizer=opt, metrics=[opt, 'mae'])", "r = SVR(u, C=[u])"])
    rows = {r.model_type: r for r in model_records(resolve_calls(ev)).collect()}
    assert json.loads(rows["Sequential"].args_json) == ["[Dense(8, activation=relu), Dense(u + 1)]"]
    assert rows["Sequential"].kwargs == {"optimizer": '"adam"', "metrics": '["adam", "mae"]'}
    assert rows["SVR"].kwargs == {"C": '"[u]"'} and json.loads(rows["SVR"].args_json) == ["8"]


def test_no_names_and_no_cells(spark):
    ev = events(spark, ["m = SVC(C=1)"])
    assert model_records(resolve_calls(ev, chains=True)).first().kwargs == {"C": "1"}
    assert resolve_names(events(spark, []).limit(0), chains=True).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["a", "b", "c", "1", "2", "SVC"])), max_size=25))
def test_chains_equal_a_replay(spark, steps):
    sources, table, want = [], {}, {}
    for i, (name, what) in enumerate(steps):
        if what == "SVC":
            sources.append(f"m = SVC({name})")
            value = table.get(name)
            want[(i, "0")] = value if value is not None else f'"{name}"'
        else:
            sources.append(f"{name} = {what}")
            table[name] = table.get(what) if what in "abc" else what
    assert values(spark, sources, chains=True) == want


def test_usual_table_names(spark):
    rows = [("both", 0, "my_train = pd.read_csv('a')\nmy_test = pd.read_csv('b')\ntrain = 1"),
            ("half", 0, "my_train = pd.read_csv('a')"),
            ("half", 1, "raw = pd.read_csv('c')\nX_test = raw\ndf_test = raw\ndf_train == raw"),
            ("swap", 0, "my_train = pd.read_csv('a')\ntrain_df = pd.read_csv('t')"),
            ("none", 0, "pd.read_csv('x')"), ("other", 0, "train = 1")]
    got = {r[0]: tuple(r)[1:] for r in discover_tables(
        spark.createDataFrame(rows, CELLS), fallback=True).select(
            "notebook", "train_var", "train_path", "test_var", "test_path").collect()}
    assert got == {"both": ("my_train", "a", "my_test", "b"), "half": ("my_train", "a", "df_test", None),
                   "swap": ("train_df", "t", None, None), "none": (None, None, None, None)}
