"""Shared shape of every preprocessing operator.

``fit`` runs distributed aggregates and keeps their small result (one number or
one category list per column, bounded by the column count / ``max_columns``) on
the driver, as Spark ML estimators do.  ``transform`` is a single ``select``
whose expressions carry those numbers as literals: a narrow projection inside
whole-stage codegen, no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col

EPS10 = 10 * 2.220446049250313e-16  # scale values below this count as zero


def replace_columns(df: DataFrame, new: Mapping[str, Column], drop: Iterable[str] = (),
                    append: Iterable[tuple[str, Column]] = (), expand: Mapping[str, list[tuple[str, Column]]] | None = None
                    ) -> DataFrame:
    """One projection: replace columns in place, drop some, expand some into many, append others."""
    drop = set(drop)
    expand = expand or {}
    out: list[Column] = []
    for c in df.columns:
        if c in expand:
            out += [e.alias(n) for n, e in expand[c]]
        elif c in drop:
            continue
        elif c in new:
            out.append(new[c].alias(c))
        else:
            out.append(col(c))
    out += [e.alias(n) for n, e in append]
    return df.select(*out)


def lit_double(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def safe_scale(v: float | None) -> float | None:
    if v is None:
        return None
    return 1.0 if abs(v) < EPS10 else float(v)


class Model:
    """A fitted operator: ``transform`` builds one projection."""

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def fit_transform_pair(self, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.transform(train), self.transform(test)
