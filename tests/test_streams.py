"""Interval-set deduplication, epochs with bases and the streaming best model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.plans.streams import EVENTS_SCHEMA
from tunewright.plans.trials import best_model
from tunewright.functions.logs import canonical_entries, parse_metric_log
from tunewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_ranges_hold_exactly_the_lines_seen():
    rng = random.Random(3)
    starts, ends, seen = np.empty(0, np.int64), np.empty(0, np.int64), set()
    for _ in range(60):
        lines = np.array([rng.randrange(120) for _ in range(rng.randrange(15))], np.int64)
        starts, ends, new = jobs.add_to_ranges(starts, ends, lines)
        fresh = set()
        for i, line in enumerate(lines.tolist()):
            assert new[i] == (line not in seen and line not in fresh)
            fresh.add(line)
        seen |= fresh
        assert sorted(seen) == [x for a, b in zip(starts, ends) for x in range(a, b)]
        assert (starts[1:] > ends[:-1]).all()  # as many ranges as the log has gaps
    a, b, _ = jobs.add_to_ranges(np.empty(0, np.int64), np.empty(0, np.int64), np.arange(10_000)[::-1].copy())
    assert (a.tolist(), b.tolist()) == ([0], [10_000])


def parts(spark, folder, rows, n, seed):
    """``rows`` of events as n part files in shuffled order, some rows in two files."""
    pdf = spark.read.parquet(f"{SF}/events.parquet").limit(rows).toPandas().sample(frac=1, random_state=seed)
    for i in range(n):
        part = pdf.iloc[i::n]
        if i:
            part = part._append(pdf.iloc[i - 1::n].head(5))
        part = spark.createDataFrame(part, spark.read.parquet(f"{SF}/events.parquet").schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    parts(spark, folder, 400, 7, 5)
    return folder


def batch_rows(spark, folder):
    from tunewright.plans.fixtures import fx_log_rich_columns
    lines = fx_log_rich_columns(spark.read.schema(EVENTS_SCHEMA).parquet(f"{folder}/events.parquet")).dropDuplicates(
        ["run_id", "line_no"])
    return canonical_entries(parse_metric_log(lines, "text", jobs.KEYS), jobs.KEYS)


def batch_best(spark, folder):
    return best_model(batch_rows(spark, folder), "logs")


def same(a, b):
    key = sorted(a.columns)
    return sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))


def test_best_model_of_shuffled_redelivered_files(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 3)
    lines = jobs.log_lines_stream(spark, folder, EVENTS_SCHEMA)
    winners = jobs.stream_best_model(spark, lines, f"{tmp_path}/t", f"{tmp_path}/c")
    assert same(winners.latest(), batch_best(spark, folder))
    assert jobs._exists(spark, f"{tmp_path}/t/winners/base=5") and not jobs._exists(spark, f"{tmp_path}/t/winners/epoch=0")
    again = jobs.log_lines_stream(spark, folder, EVENTS_SCHEMA)  # nothing new: the same checkpoint writes nothing
    assert same(jobs.stream_best_model(spark, again, f"{tmp_path}/t", f"{tmp_path}/c").latest(), batch_best(spark, folder))


def test_small_blocks_lose_and_repeat_nothing(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 16)
    lines = jobs.log_lines_stream(spark, folder, EVENTS_SCHEMA)
    jobs.stream_trials(spark, lines, f"{tmp_path}/t", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/t").drop("epoch")
    assert same(got, batch_rows(spark, folder).select(got.columns)) and got.count() > 300


def test_replayed_epoch_replaces_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    schema = spark.createDataFrame([], "k long, v string").schema
    table = jobs.Epochs(spark, f"{tmp_path}/e", schema, ["k"])
    def rows(*r):
        return spark.createDataFrame(list(r), schema)
    table.write(rows((1, "a"), (2, "a")), 0)
    table.write(rows((1, "wrong")), 1)
    table.write(rows((1, "b")), 1)
    table.write(rows((3, "c")), 2)
    assert sorted(map(tuple, table.latest().collect())) == [(1, "b"), (2, "a"), (3, "c")]
    table.write(rows((2, "d")), 3)
    assert sorted(map(tuple, table.newest(2).collect())) == [(1, "b"), (2, "a"), (3, "c")]  # a replay of epoch 3
    assert sorted(map(tuple, table.latest().collect())) == [(1, "b"), (2, "d"), (3, "c")]


def test_short_runs_share_groups_and_nulls_and_long_numbers_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 3, raising=False)
    long = 2 ** 53 + 1
    rows = [(r, n, "x") for r in range(40) for n in (0, 1, 5, long, -7)] + [(None, 1, "x"), (None, long, "x"), (long, 2, "x")]
    free = [(1, None, "a"), (1, None, "a"), (None, None, "b")]
    schema = "run_id long, line_no long, text string"
    for part in (rows + free, rows[::2] + rows[::3], rows + free):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = (jobs.drop_seen(lines).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
         .trigger(availableNow=True).start(f"{tmp_path}/out"))
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows + 2 * free))
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 3 * 4


def test_the_metric_table_is_aggregated_by_hash_and_keeps_the_order_of_lines(spark):
    from tunewright.plans.trials import metric_table
    lines = [None, -(2 ** 63), -11, 0, 7, 2 ** 63 - 1]
    rows = [(1, line, pos, sub, "m", metric, float(i), sub > 0, False) for i, (line, pos, sub, metric) in enumerate(
        (line, pos, sub, metric) for metric in ("r2", None) for line in lines for pos in (0, 2 ** 31 - 1) for sub in (0, 2))]
    canon = spark.createDataFrame(rows, "run_id long, line_no long, pos int, sub int, model string, metric string, "
                                  "value double, is_global boolean, tf_hit boolean").repartition(3)
    table = metric_table(canon)
    assert "SortAggregate" not in table._jdf.queryExecution().executedPlan().toString()
    got = {r["metric"]: r for r in table.collect()}
    assert got["r2"]["last"] == 23.0 and tuple(got["r2"]["first"]) == (None, 0, 0) and got["r2"]["glast"] == 23.0
    assert tuple(got["r2"]["gord"]) == (2 ** 63 - 1, 2 ** 31 - 1, 2)
    assert got[None]["gord"] is None and tuple(got[None]["first"]) == (None, 0, 0)
    for at in lines:
        one = metric_table(canon.where(F.col("line_no").eqNullSafe(at) & (F.col("pos") > 0) & (F.col("sub") > 0) & F.col(
            "metric").isNotNull())).first()
        assert tuple(one["first"]) == tuple(one["gord"]) == (at, 2 ** 31 - 1, 2)
