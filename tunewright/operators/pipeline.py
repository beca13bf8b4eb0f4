"""ColumnTransformer (F20) and pipeline-spec override (X11).

Each transformer is fitted on the original training columns (one statistics pass
per transformer) and all transforms are applied as projections over disjoint
column sets, so the result equals running them side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col


@dataclass
class ColumnTransformer:
    transformers: Sequence[tuple[str, object, Sequence[str]]]
    remainder: str = "drop"  # or "passthrough"

    def fit(self, df: DataFrame) -> "ColumnTransformerModel":
        seen: set[str] = set()
        fitted = []
        for name, op, cols in self.transformers:
            cols = list(cols)
            if seen & set(cols):
                raise ValueError(f"transformer {name} reuses columns {sorted(seen & set(cols))}")
            seen |= set(cols)
            fitted.append((name, op.fit(df, cols), cols))
        rest = [c for c in df.columns if c not in seen] if self.remainder == "passthrough" else []
        return ColumnTransformerModel(fitted, rest)


@dataclass
class ColumnTransformerModel:
    fitted: list
    remainder: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        order: list[str] = []
        for _, model, cols in self.fitted:
            before = set(out.columns)
            out = model.transform(out)
            new = [c for c in out.columns if c not in before]
            order += [c for c in cols if c in out.columns] + new
        return out.select(*[col(c) for c in order + self.remainder])


def override_param(params: Column, param: str, value: str) -> Column:
    """X11: set one parameter of a spec's params map, replacing it or appending it."""
    kept = F.map_filter(params, lambda k, v: k != F.lit(param))
    return F.map_concat(kept, F.create_map(F.lit(param), F.lit(value)))


def params_text(params: Column) -> Column:
    """k=v pairs sorted by key, joined by ', '."""
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
