"""Additive statistics of linear models.

One aggregate over the rows gives, for every key (fold, validation part, ...), the second moments of (1, columns...).
Moments of keys add and subtract, so the fit without a fold, the fit on a subset of the columns, the refit on all rows
and the score on any part are small solves on the driver (the number of columns squared), never another pass over the
rows.  Tasks multiply their batches with numpy and send one matrix a key; Spark adds the matrices up by element.

Columns are centred and scaled by their overall mean and deviation before they are multiplied, so large values lose no
digits.  Solves use the sweep operator: sweeping a column in adds it to the model, sweeping it out removes it, each in
the square of the number of columns.  A column that the ones before it determine (its pivot is ``TOLERANCE`` of its
second moment or less) is left out with coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col

TOLERANCE = 1e-9
#: rows that are multiplied at once
ROWS = 4096


@dataclass
class Moments:
    names: list[str]            # the columns
    center: np.ndarray
    scale: np.ndarray
    parts: dict[int, np.ndarray] = field(default_factory=dict)   # key -> moments of (1, scaled columns)
    missing: frozenset[str] = frozenset()   # columns with nulls or NaN, whose moments mean nothing

    def total(self, keys=None, without=()) -> np.ndarray:
        size = len(self.names) + 1
        keys = self.parts if keys is None else keys
        return sum((self.parts[k] for k in keys if k in self.parts and k not in without), np.zeros((size, size)))

    def take(self, names: Sequence[str]) -> "Moments":
        """The moments of some of the columns."""
        at = [0, *self.at(names)]
        own = np.array(at[1:], int) - 1
        return Moments(list(names), self.center[own], self.scale[own],
                       {k: t[np.ix_(at, at)] for k, t in self.parts.items()}, self.missing & frozenset(names))

    def at(self, names: Sequence[str]) -> list[int]:
        where = {n: i + 1 for i, n in enumerate(self.names)}
        return [where[n] for n in names]


#: rows that a provisional centre is taken from, and deviations that the mean may lie away from it
SAMPLE, FAR = 1000, 10.0


def _pass(rows: DataFrame, center: np.ndarray, scale: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Moments of (1, (columns - center) / scale) by key, nulls and NaN as 0, and the number of these by column."""
    size = len(center) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # key -> moments, and a last row of missing values
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            z = np.ones((size, b.num_rows))
            k = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(k, kind="stable")  # rows of a key follow each other
            for i in range(size - 1):
                np.subtract(b.column(i + 1).to_numpy(zero_copy_only=False)[order], center[i], out=z[i + 1])
            z[1:] /= scale[:, None]
            hole = np.isnan(z) if np.isnan(z.sum()) else None
            if hole is not None:
                z[hole] = 0.0
            kinds, first = np.unique(k[order], return_index=True)
            for one, lo, hi in zip(kinds, first, [*first[1:], len(k)], strict=True):
                own = z[:, lo:hi]
                if int(one) not in sums:
                    sums[int(one)] = np.zeros((size + 1, size))
                sums[int(one)][:size] += own @ own.T
                if hole is not None:
                    sums[int(one)][size] += hole[:, lo:hi].sum(1)
        for k, m in sums.items():
            yield pa.record_batch([pa.array(np.full(size + 1, k, np.int32)), pa.array(np.arange(size + 1, dtype=np.int32)),
                                   pa.array(list(m), pa.list_(pa.float64()))], names=["k", "i", "v"])

    cells = rows.mapInArrow(run, "k int, i int, v array<double>").select("k", "i", F.posexplode("v").alias("j", "v"))
    parts: dict[int, np.ndarray] = {}
    empty = np.zeros(size - 1)
    for r in cells.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():  # keys times columns squared
        if r["i"] < size:
            parts.setdefault(r["k"], np.zeros((size, size)))[r["i"], r["j"]] = r["v"]
        elif r["j"]:
            empty[r["j"] - 1] += r["v"]
    return parts, empty


def moments(df: DataFrame, columns: Sequence[str], key: Column | None = None, missing_ok: bool = False) -> Moments:
    """Moments of ``columns`` by an integer ``key``.  Nulls and NaN are an error: impute first.  With ``missing_ok``
    columns that have some are named in ``missing`` and count as 0.

    One pass adds up the moments about a provisional centre, that of a few rows, and they are moved to the mean.  Where
    the mean lies far from it, which would cost digits, a second pass goes by the mean itself."""
    columns = list(columns)
    x = [col(c).cast("double") for c in columns]
    rows = df.select((F.lit(0) if key is None else key).cast("int").alias("k"), *[e.alias(f"x{i}") for i, e in enumerate(x)])
    some = np.array([tuple(r) for r in rows.limit(SAMPLE).collect()], float).reshape(-1, len(columns) + 1)[:, 1:]
    center, scale = np.zeros(len(columns)), np.ones(len(columns))
    for i, v in enumerate(some.T):
        v = v[np.isfinite(v)]
        if len(v):
            center[i] = v.mean() if v.min() < v.max() else v[0]
            scale[i] = v.std() if v.std() > 1e-7 * abs(center[i]) else max(1e-7 * abs(center[i]), 1e-300)
    scale = np.where(scale > 1e-290, scale, 1.0)
    for _ in range(2):
        parts, empty = _pass(rows, center, scale)
        if not parts:
            raise ValueError("no rows to fit")
        bad = [c for c, e in zip(columns, empty, strict=True) if e]
        if bad and not missing_ok:
            raise ValueError("missing values in " + ", ".join(bad))
        whole = empty == 0
        t = sum(parts.values())
        off = t[0, 1:] / t[0, 0]                      # the mean in the pass's units
        spread = np.sqrt(np.maximum(0.0, t.diagonal()[1:] / t[0, 0] - off ** 2))
        mean, deviation = center + off * scale, spread * scale
        deviation = np.where(deviation > 1e-7 * np.abs(mean), deviation, np.maximum(1e-7 * np.abs(mean), 1e-300))
        deviation = np.where(deviation > 1e-290, deviation, 1.0)
        near = ~whole | ~np.isfinite(deviation) | (np.abs(off) * scale <= FAR * deviation)
        if near.all():
            break
        center, scale = np.where(near, center, mean), np.where(near, scale, deviation)
    mean, deviation = np.where(whole, mean, 0.0), np.where(whole, deviation, 1.0)
    move = np.diag(np.concatenate([[1.0], np.where(whole, scale / deviation, 0.0)]))
    move[1:, 0] = np.where(whole, (center - mean) / deviation, 0.0)
    return Moments(columns, mean, deviation, {k: move @ t @ move.T for k, t in parts.items()}, frozenset(bad))


def sweep(a: np.ndarray, k: int, out: bool = False) -> None:
    """Sweep index ``k`` of the symmetric matrix in (or out again), in place."""
    d, row = a[k, k], a[k].copy()
    a -= np.outer(row, row) / d
    a[k] = a[:, k] = (-row if out else row) / d
    a[k, k] = -1.0 / d


@dataclass
class LinearFit:
    features: list[str]
    intercept: float
    coefficients: np.ndarray     # of the raw columns
    scaled: np.ndarray           # weights of (1, scaled columns) of prediction minus label, scaled
    unit: float                  # one scaled unit of the label
    label_at: int
    aliased: list[str]

    def score(self, t: np.ndarray) -> dict[str, float]:
        """mse and r2 (1 or 0 for a constant label) on moments of the same columns."""
        n = t[0, 0]
        if not n:
            return {"n": 0.0, "mse": float("nan"), "r2": float("nan")}
        sse = max(0.0, float(self.scaled @ t @ self.scaled)) * self.unit ** 2
        y = self.label_at
        tss = max(0.0, float(t[y, y] - t[0, y] ** 2 / n)) * self.unit ** 2
        r2 = 1 - sse / tss if tss > 1e-12 * n * self.unit ** 2 else float(sse <= 1e-12 * n * self.unit ** 2)
        return {"n": float(n), "mse": float(sse / n), "r2": float(r2)}

    def predict(self) -> Column:
        return sum((col(c).cast("double") * F.lit(float(b)) for c, b in zip(self.features, self.coefficients, strict=True)),
                   F.lit(float(self.intercept)))


def normal_matrix(m: Moments, t: np.ndarray, intercept: bool) -> np.ndarray:
    """Moments that a fit sweeps: centred columns with an intercept, raw ones (in scaled units) without."""
    if intercept:
        return t.copy()
    shift = np.eye(len(t))
    shift[1:, 0] = m.center / m.scale
    return shift @ t @ shift.T


def least_squares(m: Moments, t: np.ndarray, features: Sequence[str], label: str, intercept: bool = True) -> LinearFit:
    at, (y,) = m.at(features), m.at([label])
    a = normal_matrix(m, t, intercept)
    diagonal = np.diag(a).copy()
    aliased = []
    if not t[0, 0]:
        raise ValueError("no rows to fit")
    if intercept:
        sweep(a, 0)
    used = []
    for k, name in zip(at, features, strict=True):
        if a[k, k] > TOLERANCE * diagonal[k]:
            sweep(a, k)
            used.append(k)
        else:
            aliased.append(name)
    weight = np.zeros(len(a))
    weight[used] = a[used, y]
    raw = weight[at] * m.scale[y - 1] / m.scale[np.array(at, int) - 1] if at else np.zeros(0)
    center = m.center[np.array(at, int) - 1] if at else np.zeros(0)
    constant = m.center[y - 1] + m.scale[y - 1] * a[0, y] - float(raw @ center) if intercept else 0.0
    # prediction minus label over (1, scaled columns): the same for both kinds of fit
    weight[0] = (constant + float(raw @ center) - m.center[y - 1]) / m.scale[y - 1]
    weight[y] = -1.0
    return LinearFit(list(features), constant, raw, weight, float(m.scale[y - 1]), y, aliased)


def eliminate(m: Moments, t: np.ndarray, features: Sequence[str], label: str, target: int, step: int
              ) -> list[list[str]]:
    """Backward elimination: rounds of the ``step`` features of smallest squared coefficient (ties: the earlier one)
    that leave until ``target`` are left.  One sweep in per feature, one sweep out per eliminated feature."""
    at, (y,) = m.at(features), m.at([label])
    a = normal_matrix(m, t, True)
    diagonal = np.diag(a).copy()
    sweep(a, 0)
    inside = set()
    for k in at:
        if a[k, k] > TOLERANCE * diagonal[k]:
            sweep(a, k)
            inside.add(k)
    alive, rounds = list(range(len(at))), []
    while len(alive) > target:
        def coefficient(j: int) -> float:
            return (a[at[j], y] * m.scale[y - 1] / m.scale[at[j] - 1]) ** 2 if at[j] in inside else 0.0
        gone = sorted(alive, key=lambda j: (coefficient(j), j))[:min(step, len(alive) - target)]
        for j in gone:
            if at[j] in inside:
                sweep(a, at[j], out=True)
                inside.discard(at[j])
        rounds.append([features[j] for j in gone])
        alive = [j for j in alive if j not in gone]
        for j in alive:  # a column that one now gone determined may come in
            k = at[j]
            if k not in inside and a[k, k] > TOLERANCE * diagonal[k]:
                sweep(a, k)
                inside.add(k)
    return rounds


@dataclass(frozen=True)
class LinearSpec:
    """A linear model to fit: its features and whether it has an intercept."""
    features: tuple[str, ...]
    intercept: bool = True


def search_specs(m: Moments, specs: Sequence[LinearSpec], label: str, folds: Sequence[int], valid: int
                 ) -> list[dict]:
    """For each spec, the score on every fold of the fit without it, and of the refit on all folds on the validation
    part: rows (spec, fold, n, mse, r2), fold -1 for the refit, which carries its fit."""
    out = []
    everything = m.total(folds)
    for i, s in enumerate(specs):
        for f in folds:
            if f not in m.parts:
                continue
            fit = least_squares(m, everything - m.parts[f], s.features, label, s.intercept)
            out.append({"spec": i, "fold": f, "fit": None, **fit.score(m.parts[f])})
        fit = least_squares(m, everything, s.features, label, s.intercept)
        out.append({"spec": i, "fold": -1, "fit": fit, **fit.score(m.total([valid]))})
    return out
