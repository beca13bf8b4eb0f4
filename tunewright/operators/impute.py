"""Imputation (F8 SimpleImputer, A5 train-stat imputation)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import column_modes, exact_quantiles
from ..sources.tables import categorical_columns, col, numeric_columns
from .base import Model, replace_columns

STRATEGIES = ("mean", "median", "most_frequent", "constant")


@dataclass
class SimpleImputer:
    strategy: str = "mean"
    fill_value: object = None
    add_indicator: bool = False
    keep_empty_features: bool = False
    copy: bool = True
    approx: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "ImputerModel":
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        cols = list(cols)
        types = {f.name: f.dataType for f in df.schema.fields}
        numeric = [c for c in cols if not isinstance(types[c], (T.StringType, T.BooleanType))]
        if self.strategy in ("mean", "median") and len(numeric) != len(cols):
            raise ValueError(f"strategy {self.strategy} needs numeric columns")
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(cols):
            aggs.append(F.count(col(c)).alias(f"c{i}"))
            if self.strategy == "mean":
                aggs.append(F.avg(col(c).cast("double")).alias(f"m{i}"))
        row = df.agg(*aggs).first()
        n = row["_n"]
        nonnull = {c: row[f"c{i}"] for i, c in enumerate(cols)}
        if self.strategy == "mean":
            stat = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        elif self.strategy == "median":
            q = exact_quantiles(df, cols, [0.5], approx=self.approx)
            stat = {c: q[c][0.5] for c in cols}
        elif self.strategy == "most_frequent":
            stat = column_modes(df, cols)
        else:
            stat = {}
            for c in cols:
                if self.fill_value is not None:
                    stat[c] = self.fill_value
                else:
                    stat[c] = 0 if c in numeric else "missing_value"
        empty = [c for c in cols if nonnull[c] == 0]
        keep_empty = self.keep_empty_features or self.strategy == "constant"
        if keep_empty:
            for c in empty:
                if self.strategy != "constant":
                    stat[c] = 0 if c in numeric else "missing_value"
        missing = [c for c in cols if nonnull[c] < n]
        return ImputerModel(cols, stat, dropped=[] if keep_empty else empty,
                            indicator=missing if self.add_indicator else [], numeric=numeric)


@dataclass
class ImputerModel(Model):
    cols: list[str]
    stat: dict[str, object]
    dropped: list[str] = field(default_factory=list)
    indicator: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.cols:
            if c in self.dropped or c not in df.columns:
                continue
            v = self.stat[c]
            if c in self.numeric:
                new[c] = F.coalesce(col(c).cast("double"), F.lit(None if v is None else float(v)).cast("double"))
            else:
                new[c] = F.coalesce(col(c), F.lit(v))
        append = [(f"missingindicator_{c}", col(c).isNull().cast("double")) for c in self.indicator]
        return replace_columns(df, new, drop=self.dropped, append=append)


@dataclass
class TrainStatImputer:
    """Numeric columns get the train mean, categorical ones the train mode (A5)."""

    exclude: Sequence[str] = ()

    def fit(self, train: DataFrame) -> ImputerModel:
        num = numeric_columns(train, self.exclude)
        cat = [c for c in categorical_columns(train, self.exclude)
               if isinstance(train.schema[c].dataType, T.StringType)]
        row = train.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num)]).first() \
            if num else None
        stat = {c: row[f"m{i}"] for i, c in enumerate(num)}
        stat.update(column_modes(train, cat))
        return ImputerModel(num + cat, stat, numeric=num)
