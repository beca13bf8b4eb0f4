"""Query registry shared by the plan modules and ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value",
              cast: str = "double") -> DataFrame:
    """Wide -> (ids..., feature, value); used where column names depend on the data."""
    w = df.select(*ids, *[F.col(f"`{v}`").cast(cast).alias(v) for v in values])
    return w.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{v}`") for v in values], name, value)
