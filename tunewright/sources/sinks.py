"""Sinks (S5-S8): usage table, prepared tables + chosen parameters, trial logs,
submissions, results and the appendable trial table.

All writes are Spark writers (CSV / JSON / parquet) that run on the executors;
nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usage-table header.
USAGE_HEADER = ("Notebook Name", "Category", "Function", "Uses Default Parameters?", "Custom Parameters",
                "All Parameters", "Other Parameters")


def write_usage(usage: DataFrame, path: str, fmt: str = "csv") -> None:
    """The 7-column usage table with its header, in notebook / cell / call order."""
    ordered = usage.orderBy("notebook", "cell_index", "part", "seq", "sub")
    out = ordered.select(*[F.col(c).alias(n) for c, n in zip(
        ("notebook", "category", "function", "uses_default", "custom_params", "all_params", "original_code"),
        USAGE_HEADER)])
    w = out.write.mode("overwrite")
    (w.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else w.parquet(path))


def read_usage(spark, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("escape", '"').csv(path)


def write_prepared(train: DataFrame, test: DataFrame, params: dict, path: str) -> None:
    """Train and test tables plus the chosen transformation parameters as JSON."""
    train.write.mode("overwrite").option("header", "true").csv(f"{path}/train_transformed")
    test.write.mode("overwrite").option("header", "true").csv(f"{path}/test_transformed")
    spark = train.sparkSession
    rows = [(k, v) for k, v in sorted(params.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(
        f"{path}/transformation_params")


def write_trials(trials: DataFrame, path: str, key: str = "stem") -> None:
    """Trial log partitioned by notebook stem (partition pruning on read)."""
    trials.write.mode("overwrite").partitionBy(key).parquet(path)


def write_submission(pred: DataFrame, id_col: str, path: str) -> None:
    pred.select(F.col(id_col), F.col("prediction").alias("Prediction")).write.mode("overwrite") \
        .option("header", "true").csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """One more batch of finished trials appended to the trial table (header-free parquet)."""
    trials.write.mode("append").parquet(path)
