"""Column statistics that stay distributed at any scale.

Spark's exact ``percentile`` / ``median`` / ``mode`` aggregates merge every
distinct value of a group into one buffer; for a *global* statistic that group is
the whole table.  The helpers here never do that:

* ``exact_quantiles`` narrows each wanted order statistic with histogram passes
  (one fused aggregate over all columns per pass, map-side combined), and only
  ranks the few rows left in the final bucket.  The result is exact and equals
  linear interpolation between the two neighbouring order statistics
  (``numpy.percentile`` / DuckDB ``quantile_cont``).
* ``column_modes`` counts ``(column, value)`` pairs with partial aggregation; a
  hot value only makes its own counter large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.tables import col


def _targets_for(n: int, probs: Sequence[float]) -> dict[float, tuple[int, int, float]]:
    out = {}
    for p in probs:
        pos = p * (n - 1)
        lo = int(math.floor(pos))
        hi = int(math.ceil(pos))
        out[p] = (lo, hi, pos - lo)
    return out


def _histograms(df: DataFrame, cols: Sequence[str], brackets: Mapping[tuple, int], bins: int) -> list[Row]:
    """Rows (t, b, n, mn, mx): count, least and largest value in each of ``bins`` buckets of every bracket (column number,
    lower and upper end) -> t."""
    used = sorted({i for i, _, _ in brackets})
    at = {i: n for n, i in enumerate(used)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(brackets), bins), np.int64)
        mn, mx = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for j, (i, lo, hi) in enumerate(brackets):
                v = x[at[i]]
                v = v[(v >= lo) & (v <= hi)]
                if not len(v):
                    continue
                b = np.minimum(np.floor((v - lo) / ((hi - lo) / bins)), bins - 1).astype(np.int64)
                n[j] += np.bincount(b, minlength=bins)
                np.minimum.at(mn[j], b, v)
                np.maximum.at(mx[j], b, v)
        j, b = np.nonzero(n)
        yield pa.record_batch([pa.array(np.array(list(brackets.values()), np.int32)[j]), pa.array(b.astype(np.int32)),
                               pa.array(n[j, b]), pa.array(mn[j, b]), pa.array(mx[j, b])], names=["t", "b", "n", "mn", "mx"])

    rows = df.select(*[col(cols[i]).cast("double").alias(f"x{i}") for i in used])
    return (rows.mapInArrow(run, "t int, b int, n long, mn double, mx double").groupBy("t", "b")
            .agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx")).collect())


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], *,
                    bins: int = 1024, finish_rows: int = 200_000, approx: bool = False,
                    accuracy: int = 100_000) -> dict[str, dict[float, float | None]]:
    """Quantiles of each column (NULLs ignored), linear interpolation.

    ``approx=True`` switches to ``percentile_approx`` (one pass, bounded sketch).
    """
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(col(c).cast("double"), list(probs), accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: {p: (None if row[f"q{i}"] is None else row[f"q{i}"][j]) for j, p in enumerate(probs)}
                for i, c in enumerate(cols)}

    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    head = df.agg(*aggs).first()

    # One search state per (column, rank): values in [L, U], `below` values < L.
    state: dict[tuple[int, int], dict] = {}
    plan: dict[str, dict[float, tuple[int, int, float]]] = {}
    for i, c in enumerate(cols):
        n = head[f"n{i}"]
        if n == 0:
            plan[c] = {}
            continue
        plan[c] = _targets_for(n, probs)
        for lo, hi, _ in plan[c].values():
            for r in (lo, hi):
                state.setdefault((i, r), {"L": head[f"lo{i}"], "U": head[f"hi{i}"], "below": 0, "cnt": n,
                                          "value": None})
    for s in state.values():
        if s["L"] == s["U"]:
            s["value"] = s["L"]

    def open_targets(big: bool):
        return [(k, s) for k, s in state.items()
                if s["value"] is None and ((s["cnt"] > finish_rows) == big)]

    # Histogram passes: each shrinks every open bracket to one bucket.  Targets that share
    # a column and a bracket (all ranks of a column in the first pass) share a histogram.
    while True:
        todo = open_targets(True)
        if not todo:
            break
        brackets: dict[tuple, int] = {}
        for (i, r), s in todo:
            brackets.setdefault((i, s["L"], s["U"]), len(brackets))
        finite = {k: t for k, t in brackets.items() if math.isfinite(k[1]) and math.isfinite(k[2])
                  and math.isfinite(k[2] - k[1]) and (k[2] - k[1]) / bins > 0}
        tid_cols = []
        for (i, lo, hi), t in brackets.items():
            if (i, lo, hi) in finite:
                continue
            x = col(cols[i]).cast("double")
            width = (hi - lo) / bins
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
            tid_cols.append(F.when(x.between(lo, hi), F.struct(F.lit(t).alias("t"), b.alias("b"), x.alias("x"))))
        hist = []  # bounded: at most bins rows per open bracket
        if tid_cols:
            hist += (df.select(F.explode(F.filter(F.array(*tid_cols), lambda e: e.isNotNull())).alias("e"))
                     .groupBy(F.col("e.t").alias("t"), F.col("e.b").alias("b"))
                     .agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("mn"), F.max("e.x").alias("mx")).collect())
        if finite:
            hist += _histograms(df, cols, finite, bins)
        by_t: dict[int, list] = {}
        for row in hist:
            by_t.setdefault(row["t"], []).append(row)
        for (i, r), s in todo:
            t = brackets[(i, s["L"], s["U"])]
            need = r - s["below"]
            acc = 0
            for row in sorted(by_t.get(t, []), key=lambda z: z["b"]):
                if acc + row["n"] > need:
                    s["below"] += acc
                    s["L"], s["U"], s["cnt"] = row["mn"], row["mx"], row["n"]
                    if s["L"] == s["U"]:
                        s["value"] = s["L"]
                    break
                acc += row["n"]

    # Final pass: rank the rows left in each small bracket (one sort per distinct bracket).
    todo = open_targets(False)
    if todo:
        brackets = {}
        for (i, r), s in todo:
            brackets.setdefault((i, s["L"], s["U"]), (len(brackets), set()))[1].add(r - s["below"])
        tid_cols = []
        for (i, lo, hi), (t, _) in brackets.items():
            x = col(cols[i]).cast("double")
            tid_cols.append(F.when(x.between(lo, hi), F.struct(F.lit(t).alias("t"), x.alias("x"))))
        w = Window.partitionBy("t").orderBy("x")  # each bracket holds at most finish_rows rows
        want = F.create_map(*[v for t, ranks in brackets.values()
                              for v in (F.lit(t), F.array(*[F.lit(k) for k in sorted(ranks)]))])
        picked = (df.select(F.explode(F.filter(F.array(*tid_cols), lambda e: e.isNotNull())).alias("e"))
                  .select("e.t", "e.x")
                  .withColumn("rk", F.row_number().over(w) - 1)
                  .filter(F.array_contains(F.element_at(want, F.col("t")), F.col("rk")))
                  .collect())  # one row per wanted rank
        found = {(row["t"], row["rk"]): row["x"] for row in picked}
        for (i, r), s in todo:
            t = brackets[(i, s["L"], s["U"])][0]
            s["value"] = found[(t, r - s["below"])]

    out: dict[str, dict[float, float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = {}
        for p in probs:
            if p not in plan[c]:
                out[c][p] = None
                continue
            lo, hi, frac = plan[c][p]
            a, b = state[(i, lo)]["value"], state[(i, hi)]["value"]
            out[c][p] = a if frac == 0 else a + (b - a) * frac
    return out


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest value."""
    cols = list(cols)
    if not cols:
        return {}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out: dict[str, object] = {}
    # Group columns by type so one stack covers each group.
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(types[c], []).append(c)
    for typ, group in by_type.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), col(c).alias("value")) for c in group])
        counts = (df.select(F.explode(pairs).alias("p"))
                  .filter(F.col("p.value").isNotNull())
                  .groupBy(F.col("p.name").alias("name"), F.col("p.value").alias("value"))
                  .agg(F.count(F.lit(1)).alias("n")))
        top = counts.groupBy("name").agg(F.max("n").alias("n"))
        best = (counts.join(F.broadcast(top), ["name", "n"])  # one row per column
                .groupBy("name").agg(F.min("value").alias("value")).collect())
        for row in best:
            out[row["name"]] = row["value"]
    for c in cols:
        out.setdefault(c, None)
    return out
