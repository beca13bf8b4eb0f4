"""PolynomialFeatures (F7): generated column products, scikit-learn term order and names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col


@dataclass
class PolynomialFeatures:
    degree: int = 2
    interaction_only: bool = False
    include_bias: bool = True
    order: str = "C"  # memory layout only
    max_columns: int = 10_000

    def terms(self, features: Sequence[str]) -> list[tuple[int, ...]]:
        n = len(features)
        count = (sum(comb(n, d) for d in range(0 if self.include_bias else 1, self.degree + 1))
                 if self.interaction_only else comb(n + self.degree, self.degree) - (0 if self.include_bias else 1))
        if count > self.max_columns:
            raise ValueError(f"{count} output columns exceed max_columns={self.max_columns}")
        gen = combinations if self.interaction_only else combinations_with_replacement
        out = [()] if self.include_bias else []
        for d in range(1, self.degree + 1):
            out += list(gen(range(n), d))
        return out

    @staticmethod
    def name(features: Sequence[str], term: tuple[int, ...]) -> str:
        if not term:
            return "1"
        parts = []
        for i in sorted(set(term)):
            p = term.count(i)
            parts.append(features[i] if p == 1 else f"{features[i]}^{p}")
        return " ".join(parts)

    def transform(self, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        features = list(features)
        xs = [col(c).cast("double") for c in features]
        out = []
        for t in self.terms(features):
            e = F.lit(1.0)
            for i in t:
                e = e * xs[i]
            out.append(e.alias(self.name(features, t)))
        return df.select(*[col(c) for c in keep], *out)
