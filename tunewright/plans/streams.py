"""Streaming and sink queries: the stream's final table is read back and compared with
the batch answer (same DuckDB twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_usage, write_usage
from ..streaming.jobs import log_lines_stream, read_last_values, run_folder, stream_best_model, stream_last_values, stream_trials
from .corpus import USAGE_SQL, scan_events, usage_table
from .registry import ORACLE, r6, register
from .trials import _round_metrics
from ..sources.cells import fx_cells

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@register("stream_trials", ORACLE["log_canonical"])
def q_stream_trials(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: incremental ingest into a trial table; the table equals the batch canonical rows."""
    base = run_folder(spark, "stream-trials")
    lines = log_lines_stream(spark, sf, EVENTS_SCHEMA)
    stream_trials(spark, lines, f"{base}/table", f"{base}/checkpoint")
    c = spark.read.parquet(f"{base}/table").filter(F.col("metric").isNotNull())
    return c.select("run_id", "line_no", F.col("pos").cast("bigint").alias("pos"), F.col("sub").cast("int"),
                    "model", "metric", r6(F.col("value")).alias("value"), "is_global")


@register("stream_last_metric", ORACLE["last_metric"])
def q_stream_last_metric(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: stateful last value per (run, model, metric), update mode."""
    base = run_folder(spark, "stream-last")
    lines = log_lines_stream(spark, sf, EVENTS_SCHEMA)
    stream_last_values(spark, lines, f"{base}/table", f"{base}/checkpoint")
    last = read_last_values(spark, f"{base}/table")
    return last.select("run_id", "model", "metric", r6(F.col("value")).alias("value"))


@register("stream_best_model", ORACLE["best_model_logs"])
def q_stream_best_model(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 + K1: the best model per run, kept by a stream that emits a run's winner when it changes."""
    base = run_folder(spark, "stream-best")
    lines = log_lines_stream(spark, sf, EVENTS_SCHEMA)
    winners = stream_best_model(spark, lines, f"{base}/table", f"{base}/checkpoint")
    return _round_metrics(winners.latest())


@register("usage_csv", USAGE_SQL + """
 select notebook "Notebook Name", category "Category", u.function "Function", uses_default "Uses Default Parameters?",
   custom_params "Custom Parameters",
   case when category in ('Feature Addition', 'Feature Engineering', 'Feature Selection')
         and (u.function in ('Feature Addition', 'Feature Engineering') or u.function like 'Drop column%') then 'N/A'
        else coalesce(all_defaults, '') end "All Parameters", line "Other Parameters"
 from u left join defaults d on u.function = d.function""")
def q_usage_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The usage table written as CSV with its header and read back."""
    path = run_folder(spark, "usage-csv")
    write_usage(usage_table(scan_events(fx_cells(spark, sf))), path)
    return read_usage(spark, path).na.fill("", ["Custom Parameters", "All Parameters"])
