"""Streaming twins of the trial analytics (ST1, ST2).

ST1 ingests metric-log lines incrementally: re-delivered lines are dropped, the rest is parsed and
canonicalised per micro-batch and written through ``foreachBatch``.  The state of a run is the set of
line numbers seen as ranges, so it is as large as the log's gaps, not its lines; without a watermark,
file order and lateness lose no line.  A run's lines are cut into blocks of ``BLOCK`` line numbers and the
blocks of all runs dealt to ``GROUPS`` groups, so no run is one group and many short runs are not many groups.
ST2 keeps the last value of every (run, model, metric) as streaming state and writes the values
that a batch changed; ``stream_best_model`` also keeps what the best-model rule needs, and writes
a run's new winner when a batch changes it.  All write one folder per epoch and overwrite it, so a
batch that is replayed after a failure replaces itself; every ``COMPACT`` epochs the newest rows are
rewritten as one base, and readers need the base and the epochs after it.  Checkpoints lie under the
session's shared checkpoint folder, so a restarted job continues where it stopped.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.logs import canonical_entries, parse_metric_log
from ..session import scratch_path

KEYS = ("run_id", "line_no")
#: line numbers of a block of the deduplication, its groups (blocks of runs are dealt to them by hash), epochs of a base
BLOCK, GROUPS, COMPACT = 1 << 20, 1024, 16


def add_to_ranges(starts: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint ranges [start, end) with ``lines`` added, and which lines are new: the first of equal ones that
    lies in no range."""
    at = np.searchsorted(starts, lines, "right") - 1
    seen = at >= 0
    seen[seen] = lines[seen] < ends[at[seen]]
    first = np.zeros(len(lines), bool)
    first[np.unique(lines, return_index=True)[1]] = True
    new = first & ~seen
    own = lines[new]
    if not len(own):
        return starts, ends, new
    lo, hi = np.concatenate([starts, own]), np.concatenate([ends, own + 1])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    opens = np.concatenate([[True], lo[1:] > hi[:-1]])  # ranges that touch are one
    return lo[opens], np.maximum.reduceat(hi, np.flatnonzero(opens)), new


def drop_seen(lines: DataFrame, run: str = "run_id", line: str = "line_no") -> DataFrame:
    """The stream's rows without those whose (run, line) came before; rows with a null line number all pass.

    A pair of run and block has its own ``BLOCK + 1`` numbers on one axis, so the ranges of all pairs of a group are one
    sorted list and never touch across pairs."""
    schema = lines.schema

    def unseen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        _, no_run, no_line = key
        saved, *ranges = state.get if state.exists else (pickle.dumps([]), b"", b"")
        pairs = {pair: i for i, pair in enumerate(pickle.loads(saved))}
        starts, ends = (np.frombuffer(b, np.int64) for b in ranges)
        for rows in batches:
            if no_line:
                yield rows[list(schema.names)]
                continue
            number = rows[line].to_numpy().astype(np.int64)
            at = number % BLOCK
            both = pd.DataFrame({"run": 0 if no_run else rows[run].to_numpy(), "block": number - at})
            which = both.groupby(["run", "block"], sort=False).ngroup().to_numpy()
            own = [pairs.setdefault(pair, len(pairs)) for pair in both.drop_duplicates().itertuples(index=False, name=None)]
            starts, ends, new = add_to_ranges(starts, ends, np.array(own, np.int64)[which] * (BLOCK + 1) + at)
            yield rows[list(schema.names)][new]
        if not no_line:
            state.update((pickle.dumps(list(pairs)), starts.tobytes(), ends.tobytes()))

    block = F.col(line) - F.pmod(F.col(line), F.lit(BLOCK))
    keyed = lines.withColumns({"_group": F.pmod(F.xxhash64(run, block), F.lit(GROUPS)), "_no_run": F.col(run).isNull(),
                               "_no_line": F.col(line).isNull()})  # without nulls among them, numbers stay whole
    return keyed.groupBy("_group", "_no_run", "_no_line").applyInPandasWithState(
        unseen, schema, StructType.fromDDL("pairs binary, starts binary, ends binary"), "append", GroupStateTimeout.NoTimeout)


def log_lines_stream(spark: SparkSession, folder: str, schema: str, table: str = "events.parquet",
                     files_per_trigger: int = 1) -> DataFrame:
    """Metric-log lines derived from the table ``events`` of ``folder`` (one file, or a folder of part
    files), read as a file stream."""
    from ..plans.fixtures import fx_log_rich_columns
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(f"{folder.rstrip('/')}/[{table[0]}]{table[1:]}"))  # a pattern may name a file or a folder
    return fx_log_rich_columns(raw)


def _write_epoch(out_path: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return write


def stream_trials(spark: SparkSession, lines: DataFrame, out_path: str, checkpoint: str) -> None:
    """ST1: lines -> canonical metric rows below ``out_path``, every line once."""
    canon = canonical_entries(parse_metric_log(drop_seen(lines.select(*KEYS, "text")), "text", KEYS), KEYS)
    q = (canon.writeStream.foreachBatch(_write_epoch(out_path)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_last_values(spark: SparkSession, lines: DataFrame, out_path: str, checkpoint: str) -> None:
    """ST2: streaming state = last value per (run, model, metric); each batch writes what it changed."""
    canon = canonical_entries(parse_metric_log(lines, "text", KEYS), KEYS).filter(F.col("metric").isNotNull())
    last = canon.groupBy("run_id", "model", "metric").agg(
        F.max_by("value", F.struct("line_no", "pos", "sub")).alias("value"))
    q = (last.writeStream.outputMode("update").foreachBatch(_write_epoch(out_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_last_values(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest value of every (run, model, metric) that ``stream_last_values`` wrote."""
    return spark.read.parquet(out_path).groupBy("run_id", "model", "metric").agg(
        F.max_by("value", "epoch").alias("value"))


class Epochs:
    """A table of changing rows: a folder an epoch, and bases of the newest row of each key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def newest(self, epoch: int) -> DataFrame:
        """The newest row of each key, as of the end of ``epoch`` (which need not be written yet)."""
        base = epoch // COMPACT * COMPACT - 1
        paths = [f"{self.path}/epoch={e}" for e in range(base + 1, epoch + 1)]
        if base >= 0:
            paths.append(f"{self.path}/base={base}")
        have = [p for p in paths if _exists(self.spark, p)]
        wide = StructType([*self.schema.fields, *StructType.fromDDL("_epoch long").fields])
        if not have:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(wide).parquet(*have)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "_epoch").alias("r")).select("r.*")

    def latest(self) -> DataFrame:
        """The newest row of each key of a finished run of the stream."""
        epoch = 0
        while _exists(self.spark, f"{self.path}/base={(epoch // COMPACT + 1) * COMPACT - 1}"):
            epoch += COMPACT
        while _exists(self.spark, f"{self.path}/epoch={epoch + 1}"):
            epoch += 1
        return self.newest(epoch)

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.select(*self.schema.names, F.lit(epoch).cast("long").alias("_epoch")).write.mode("overwrite").parquet(
            f"{self.path}/epoch={epoch}")
        if epoch % COMPACT == COMPACT - 1:
            self.newest(epoch).withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(
                f"{self.path}/base={epoch}")
            for e in range(max(0, epoch - 2 * COMPACT + 1), epoch - COMPACT + 1):  # kept for a replay of the last base
                _delete(self.spark, f"{self.path}/epoch={e}")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stream_best_model(spark: SparkSession, lines: DataFrame, out_path: str, checkpoint: str, rule: str = "logs"
                      ) -> Epochs:
    """ST2 + K1: the winner of every run, written whenever a batch changes it.  The stream's state is the metric table;
    a batch reads only the tables of the runs that it touches."""
    from ..plans.trials import best_of_metrics, metric_table
    canon = canonical_entries(parse_metric_log(drop_seen(lines.select(*KEYS, "text")), "text", KEYS), KEYS)
    table = metric_table(canon)
    metrics = Epochs(spark, f"{out_path}/metrics", table.schema, ["run_id", "model", "metric"])
    winners = Epochs(spark, f"{out_path}/winners", best_of_metrics(spark.createDataFrame([], table.schema), rule).schema,
                     ["run_id"])

    def write(batch: DataFrame, epoch: int) -> None:
        metrics.write(batch, epoch)
        runs = spark.read.schema("run_id long").parquet(f"{metrics.path}/epoch={epoch}").distinct()
        now = best_of_metrics(metrics.newest(epoch).join(runs, "run_id", "left_semi"), rule)
        before = winners.newest(epoch - 1).alias("b") if epoch else spark.createDataFrame([], winners.schema).alias("b")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in winners.schema.names if c != "run_id"]
        changed = now.alias("n").join(before, [F.col("n.run_id") == F.col("b.run_id"), *same], "left_anti")
        winners.write(changed, epoch)

    q = (table.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return winners


def run_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
