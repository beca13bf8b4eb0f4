"""Tabular scan (S1) and the small schema helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType)

# Target column candidates, in priority order.
TARGET_CANDIDATES = ("Transported", "target", "Target", "label", "Label", "y", "Y")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL (Spark's avg/max treat NaN as a value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               **options) -> DataFrame:
    """Scan a train/test table. CSV gets a header and, without a schema, inference."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return nan_to_null(reader.load(path))


def drop_cols(df: DataFrame, cols: Iterable[str], errors: str = "ignore") -> DataFrame:
    cols = list(cols)
    if errors == "raise":
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, CATEGORICAL_TYPES) and f.name not in exclude]


def select_dtypes(df: DataFrame, include: str = "number", exclude: Sequence[str] = ()) -> DataFrame:
    """Keep the numeric ('number') or categorical ('category') columns, schema order."""
    if include == "number":
        cols = numeric_columns(df, exclude)
    elif include in ("category", "object"):
        cols = categorical_columns(df, exclude)
    else:
        raise ValueError(f"unknown include: {include}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def find_target(df: DataFrame, candidates: Sequence[str] = TARGET_CANDIDATES) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def align_columns(test: DataFrame, train: DataFrame) -> DataFrame:
    """Same columns as ``train``, same order (missing ones raise like pandas)."""
    return test.select(*[F.col(f"`{c}`") for c in train.columns])


def col(name: str) -> Column:
    return F.col(f"`{name}`")
