"""Scalers and the row normaliser.

Semantics follow the scikit-learn estimators named in the catalog: population
standard deviation, zero scale replaced by 1, NULL ignored by fit and passed
through by transform.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles
from ..sources.tables import col
from .base import Model, lit_double, replace_columns, safe_scale


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """Mean, population deviation, minimum and maximum of each column, in one aggregate."""
    cols = list(dict.fromkeys(cols))
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    row = df.agg(*aggs).first() if cols else None
    return {c: {k: row[f"{k}{i}"] for k in ("mean", "std", "min", "max")} for i, c in enumerate(cols)}


@dataclass
class StandardScaler:
    with_mean: bool = True
    with_std: bool = True
    copy: bool = True  # accepted for parity, DataFrames are immutable

    def fit(self, df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> "AffineModel":
        """``stats``: the columns' ``column_stats``, if they are known."""
        cols = list(cols)
        if stats is None:
            stats = column_stats(df, cols)
        center = {c: stats[c]["mean"] if self.with_mean else 0.0 for c in cols}
        scale = {c: safe_scale(stats[c]["std"]) if self.with_std else 1.0 for c in cols}
        return AffineModel(cols, center, scale, name="standard")


@dataclass
class MinMaxScaler:
    feature_range: tuple[float, float] = (0.0, 1.0)
    clip: bool = False
    copy: bool = True

    def fit(self, df: DataFrame, cols: Sequence[str], stats: dict | None = None) -> "AffineModel":
        """``stats``: the columns' ``column_stats``, if they are known."""
        cols = list(cols)
        lo, hi = (float(v) for v in self.feature_range)
        if lo >= hi:
            raise ValueError(f"minimum of feature_range must be smaller than maximum: {self.feature_range}")
        if stats is None:
            stats = column_stats(df, cols)
        center, scale = {}, {}
        for c in cols:
            a, b = stats[c]["min"], stats[c]["max"]
            rng = None if a is None else safe_scale(b - a)
            center[c] = a
            # x' = (x - min) / range * (hi - lo) + lo
            scale[c] = None if rng is None else rng / (hi - lo)
        return AffineModel(cols, center, scale, offset=lo, clip=(lo, hi) if self.clip else None, name="minmax")


@dataclass
class RobustScaler:
    with_centering: bool = True
    with_scaling: bool = True
    quantile_range: tuple[float, float] = (25.0, 75.0)
    unit_variance: bool = False
    copy: bool = True
    approx: bool = False  # percentile_approx instead of the exact passes

    def probs(self) -> list[float]:
        q_lo, q_hi = (float(v) for v in self.quantile_range)
        if not 0 <= q_lo <= q_hi <= 100:
            raise ValueError(f"invalid quantile range: {self.quantile_range}")
        return sorted({0.5, q_lo / 100, q_hi / 100})

    def fit(self, df: DataFrame, cols: Sequence[str], quantiles: dict | None = None) -> "AffineModel":
        """``quantiles``: those of ``probs`` of the columns, if they are known."""
        cols, probs = list(cols), self.probs()
        q_lo, q_hi = (float(v) for v in self.quantile_range)
        q = exact_quantiles(df, cols, probs, approx=self.approx) if quantiles is None else quantiles
        adjust = 1.0
        if self.unit_variance:
            nd = statistics.NormalDist()
            adjust = nd.inv_cdf(q_hi / 100.0) - nd.inv_cdf(q_lo / 100.0)
        center, scale = {}, {}
        for c in cols:
            center[c] = q[c][0.5] if self.with_centering else 0.0
            if self.with_scaling:
                a, b = q[c][q_lo / 100], q[c][q_hi / 100]
                s = None if a is None else safe_scale(b - a)
                scale[c] = None if s is None else s / adjust
            else:
                scale[c] = 1.0
        return AffineModel(cols, center, scale, name="robust")


@dataclass
class AffineModel(Model):
    cols: list[str]
    center: dict[str, float | None]
    scale: dict[str, float | None]
    offset: float = 0.0
    clip: tuple[float, float] | None = None
    name: str = "affine"
    extra: dict = field(default_factory=dict)

    def expr(self, c: str):
        x = col(c).cast("double")
        if self.center[c] is None or self.scale[c] is None:  # all-NULL column at fit time
            return F.lit(None).cast("double")
        y = (x - lit_double(self.center[c])) / lit_double(self.scale[c])
        if self.offset:
            y = y + F.lit(self.offset)
        if self.clip is not None:
            y = F.least(F.greatest(y, F.lit(self.clip[0])), F.lit(self.clip[1]))
        return y

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: self.expr(c) for c in self.cols if c in df.columns})


@dataclass
class Normalizer(Model):
    """Row-wise scaling to unit norm; stateless, a zero norm leaves the row as is."""

    norm: str = "l2"
    copy: bool = True
    cols: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "Normalizer":
        return Normalizer(self.norm, self.copy, list(cols))

    def transform(self, df: DataFrame) -> DataFrame:
        xs = [col(c).cast("double") for c in self.cols]
        if self.norm == "l1":
            n = sum((F.abs(x) for x in xs[1:]), F.abs(xs[0]))
        elif self.norm == "l2":
            n = F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
        elif self.norm == "max":
            n = F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])
        else:
            raise ValueError(f"unsupported norm: {self.norm}")
        n = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return replace_columns(df, {c: x / n for c, x in zip(self.cols, xs)})


def make_scaler(name: str, **params):
    return {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}[name](**params)
