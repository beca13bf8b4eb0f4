"""All logistic models of a search in one iteration loop (M1, M4, M5).

A search fits many logistic models to one table: every setting without every fold, every setting on all folds, and the
recorded model.  They iterate together: one pass over the rows computes loss, gradient and Hessian of every model that
has not converged (a row counts for the models that do not leave its fold out), Spark adds the tasks' sums up by model,
and the driver makes one damped Newton step per model on matrices of the number of columns.  A search of any number of
settings and folds takes about ten passes, and the rows stay in the partitions that they have.

The objective is that of the notebooks: sum of log losses + (1 / C) * penalty(w) on standardised columns, the intercept
free; all models of a search standardise by the training rows of all folds.  An l1 penalty is met exactly by coordinate
descent on each step's quadratic model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import col
from .gram import moments

MAX_STEPS, GAIN = 60, 1e-9
#: rows that are multiplied at once, and most products of columns that are made for all models together
ROWS, PRODUCTS = 512, 1024


@dataclass(frozen=True)
class LogisticSpec:
    """A model: inverse strength and kind of its penalty, and the fold it leaves out (none: -1)."""
    C: float = 1.0
    penalty: str = "l2"
    without: int = -1


@dataclass
class LogisticFit:
    spec: LogisticSpec
    features: list[str]
    weights: np.ndarray      # of (1, standardised columns)
    center: np.ndarray
    scale: np.ndarray
    loss: float
    steps: int
    converged: bool

    def coefficients(self) -> tuple[float, np.ndarray]:
        """Intercept and coefficients of the raw columns."""
        w = self.weights[1:] / self.scale
        return float(self.weights[0] - w @ self.center), w

    def margin(self) -> Column:
        a, w = self.coefficients()
        return sum((col(c).cast("double") * F.lit(float(b)) for c, b in zip(self.features, w, strict=True)), F.lit(a))


def _batch_sums(z: np.ndarray, y: np.ndarray, keep: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian of every model over the rows that ``keep`` (rows, models) says; a row a model."""
    m = z @ weights.T * keep  # rows that do not count: margin 0, taken off again
    q = np.exp(-np.abs(m))
    over = 1 + q
    gone = len(z) - keep.sum(0)
    # sum of max(m, 0) - m * y + log(1 + q); the logs as one log of a product of at most 2 ** ROWS
    loss = np.maximum(m, 0).sum(0) - y @ m + np.log(over.prod(0)) - gone * np.log(2.0)
    p = np.where(m >= 0, 1, q) / over
    g = z.T @ ((p - y[:, None]) * keep)
    v = q / (over * over) * keep
    left, right = np.triu_indices(z.shape[1])
    if len(left) <= PRODUCTS:  # the products of columns are made once for all models
        h = (z[:, left] * z[:, right]).T @ v
    else:
        h = np.stack([((z * v[:, j, None]).T @ z)[left, right] for j in range(len(weights))], axis=1)
    return np.concatenate([loss[None], g, h]).T


def _batch_counts(y: np.ndarray, own: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Per model the counts (label, prediction) of the ``own`` rows: 00, 01, 10, 11."""
    of = np.stack([own & (y == a) for a in (0, 1)]).astype(float)
    yes = of @ hit
    return np.stack([of.sum(1)[:, None] - yes, yes], axis=1).reshape(4, -1).T


def _sums(rows: DataFrame, center: np.ndarray, scale: np.ndarray, todo: list[tuple[int, int]], weights: np.ndarray,
          score: bool) -> dict[int, np.ndarray]:
    """Per model (number, fold left out): loss, gradient and upper Hessian over its rows; or with ``score`` the counts
    (label, prediction) on the rows of each part: part -> 4 numbers."""
    size = len(center) + 1
    without = np.array([f for _, f in todo])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # part (0 without ``score``) -> a row a model
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            z = np.ones((b.num_rows, size))
            for i in range(size - 1):
                z[:, i + 1] = (b.column(i + 2).to_numpy(zero_copy_only=False) - center[i]) / scale[i]
            part, y = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            if score:
                hit = (z @ weights.T > 0).astype(float)
                for p in np.unique(part):
                    sums[int(p)] = sums.get(int(p), 0) + _batch_counts(y, part == p, hit)
            else:
                keep = (part[:, None] >= 0) & (part[:, None] != without)
                sums[0] = sums.get(0, 0) + np.concatenate([_batch_sums(z, y, keep, weights), keep.sum(0)[:, None]], axis=1)
        # a model without rows in the task has no sums
        keys = [(j, p) for p in sums for j in range(len(todo)) if score or sums[p][j, -1]]
        yield pa.record_batch([pa.array([todo[j][0] for j, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()),
                               pa.array([sums[p][j] if score else sums[p][j, :-1] for j, p in keys], pa.list_(pa.float64()))],
                              names=["m", "part", "v"])

    cells = rows.mapInArrow(run, "m int, part int, v array<double>").select("m", "part", F.posexplode("v").alias("j", "v"))
    out: dict = {}
    for r in cells.groupBy("m", "part", "j").agg(F.sum("v").alias("v")).collect():  # models times columns squared
        own = out.setdefault((r["m"], r["part"]) if score else r["m"], {})
        own[r["j"]] = r["v"]
    return {k: np.array([v[j] for j in range(len(v))]) for k, v in out.items()}


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, strength: float, l1: bool) -> np.ndarray:
    """Minimiser of the quadratic model of the penalised loss around w."""
    h = h + np.eye(len(w)) * 1e-10 * max(1.0, float(np.trace(h)))
    free = np.arange(len(w)) > 0
    if not l1:
        return w - np.linalg.solve(h + np.diag(strength * free), g + strength * w * free)
    new = w.copy()
    for _ in range(1000):
        slope, largest = g + h @ (new - w), 0.0  # slope: of the quadratic model at new
        for i in range(len(w)):
            at = new[i] - slope[i] / h[i, i]
            if free[i]:
                at = math.copysign(max(0.0, abs(at) - strength / h[i, i]), at)
            if at != new[i]:
                slope += h[:, i] * (at - new[i])
                largest = max(largest, abs(at - new[i]))
                new[i] = at
        if largest < 1e-11:
            break
        # columns that determine each other make the descent creep: go to the least value of these signs, or up to
        # where the first weight is 0
        on = np.flatnonzero(~free | (new != 0))
        move = np.linalg.solve(h[np.ix_(on, on)], -(slope + strength * np.sign(new) * free)[on])
        turns = free[on] & (np.sign(new[on] + move) != np.sign(new[on]))
        far = np.where(turns, -new[on] / np.where(turns, move, 1.0), 1.0)
        first = float(min(1.0, far.min()))
        new[on] = np.where(turns & (far <= first), 0.0, new[on] + first * move)
    return new


def _penalised(loss: float, w: np.ndarray, spec: LogisticSpec) -> float:
    v = w[1:]
    return loss + (np.abs(v).sum() if spec.penalty == "l1" else 0.5 * (v @ v)) / spec.C


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, part: str, specs: Sequence[LogisticSpec]
                 ) -> list[LogisticFit]:
    """Fit all ``specs`` to the rows with ``part`` (an integer fold) of 0 or more; label 0 or 1."""
    features = list(features)
    for s in specs:
        if s.penalty not in ("l1", "l2") or s.C <= 0:
            raise ValueError(f"no logistic model with penalty {s.penalty} and C {s.C}")
    m = moments(df.where(col(part) >= 0), [*features, label])
    center, scale = m.center[:-1], m.scale[:-1]
    rows = df.where(col(part) >= 0).select(col(part).cast("int").alias("part"), col(label).cast("double").alias("y"), *[
        col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    size = len(features) + 1
    upper = np.triu_indices(size)
    at = [np.zeros(size) for _ in specs]           # the weights that the next pass looks at
    best: list[tuple | None] = [None] * len(specs)  # (objective, weights, gradient, Hessian) of the last good step
    target: list[np.ndarray | None] = [None] * len(specs)
    damp, steps, done = [1.0] * len(specs), [0] * len(specs), [False] * len(specs)
    for _ in range(MAX_STEPS):
        todo = [i for i in range(len(specs)) if not done[i]]
        if not todo:
            break
        got = _sums(rows, center, scale, [(i, specs[i].without) for i in todo], np.array([at[i] for i in todo]), False)
        for i in todo:
            if i not in got:
                raise ValueError(f"no rows without fold {specs[i].without}")
            v, s = got[i], specs[i]
            h = np.zeros((size, size))
            h[upper] = v[1 + size:]
            h = h + np.triu(h, 1).T
            value = _penalised(v[0], at[i], s)
            steps[i] += 1
            if best[i] is not None and not value <= best[i][0] + 1e-12 * abs(best[i][0]):
                damp[i] /= 2  # too far: half the way
                done[i] = damp[i] < 1e-6
            else:
                gain = math.inf if best[i] is None else best[i][0] - value
                best[i] = value, at[i], v[1:1 + size], h
                target[i] = _step(at[i], v[1:1 + size], h, 1 / s.C, s.penalty == "l1")
                damp[i] = min(1.0, damp[i] * 2)
                done[i] = gain <= GAIN * (1 + abs(value)) and float(np.abs(target[i] - at[i]).max()) < 1e-6
            at[i] = best[i][1] + damp[i] * (target[i] - best[i][1])
    return [LogisticFit(s, features, best[i][1], center, scale, best[i][0], steps[i], done[i]) for i, s in enumerate(specs)]


def count_predictions(df: DataFrame, part: str, label: str, fits: Sequence[LogisticFit]) -> dict[tuple[int, int], dict]:
    """(model number, part) -> accuracy, precision, recall, f1 and the number of rows, all models in one pass.  Scores
    that divide by zero are 0."""
    one = fits[0]
    rows = df.select(col(part).cast("int").alias("part"), col(label).cast("double").alias("y"), *[
        col(c).cast("double").alias(f"x{i}") for i, c in enumerate(one.features)])
    got = _sums(rows, one.center, one.scale, [(i, -2) for i in range(len(fits))], np.array([f.weights for f in fits]), True)
    out = {}
    for key, (tn, fp, fn, tp) in got.items():
        n = tn + fp + fn + tp
        precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[key] = {"n": int(n), "accuracy": float((tn + tp) / n), "precision": float(precision), "recall": float(recall),
                    "f1": float(f1)}
    return out


@dataclass
class LogisticSearch:
    settings: list[tuple[str, float, str]]      # text, C, penalty
    folds: int
    fits: list[LogisticFit]                     # settings without folds, settings, original
    scores: dict[tuple[int, int], dict]
    original: LogisticFit

    def trials(self, objective: str) -> list[tuple[str, int, float]]:
        """(setting, fold, score) of every setting and fold that has rows."""
        return [(text, f, self.scores[i * self.folds + f, f][objective]) for i, (text, _, _) in enumerate(self.settings)
                for f in range(self.folds) if (i * self.folds + f, f) in self.scores]

    def best(self, objective: str) -> tuple[str, LogisticFit, int]:
        """Setting of highest mean score (the first of equal ones), its refit on all folds and that model's number."""
        mean: dict[str, list[float]] = {}
        for text, _, score in self.trials(objective):
            mean.setdefault(text, []).append(score)
        order = [text for text, _, _ in self.settings]
        top = max(order, key=lambda t: (round(sum(mean[t]) / len(mean[t]), 12), -order.index(t)))
        number = len(self.settings) * self.folds + order.index(top)
        return top, self.fits[number], number


def logistic_search(df: DataFrame, features: Sequence[str], label: str, part: str, folds: int,
                    settings: Sequence[tuple[str, float, str]], original: tuple[float, str] = (1.0, "l2")) -> LogisticSearch:
    """Cross-validate all ``settings`` over the folds 0..folds-1 of column ``part`` and fit them and the original on
    all folds; rows of part -1 are validation rows, scored like the folds."""
    specs = [LogisticSpec(c, p, f) for _, c, p in settings for f in range(folds)]
    specs += [LogisticSpec(c, p) for _, c, p in settings] + [LogisticSpec(*original)]
    fits = fit_logistic(df, features, label, part, specs)
    return LogisticSearch(list(settings), folds, fits, count_predictions(df, part, label, fits), fits[-1])
