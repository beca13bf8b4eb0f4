"""Exact k-nearest neighbours (J9) without comparing every query with every row.

Pivot partitioning with triangle-inequality pruning, in blocks:

1. ``P`` pivots are drawn by a seeded hash order (their vectors are P x dim numbers);
   every training row goes to the cell of its nearest pivot, and each cell keeps its
   radius (largest distance to its pivot): P numbers.
2. Queries are dealt to groups and training rows to chunks; each pair of them is a task.
   The pivots are training rows, so a query's k-th distance to them bounds its true k-th
   neighbour distance ``tau``; the bound falls with each tile of rows that is read.
3. A row ``x`` in cell ``c`` satisfies ``d(q, x) >= d(q, pivot_c) - radius_c``, so only
   cells with ``d(q, pivot_c) - radius_c <= tau`` can hold a neighbour.  A tile's distances
   to the rows of these cells are one matrix product; rows within ``tau`` and the product's
   rounding error are measured exactly, and the top ``k`` by (distance, id) are kept.
4. Each task gives ``k`` rows a query, which one window ranks.

The answer is exact; pruning decides only how much work it takes.  A task holds one group and
one chunk, whatever the table's size; the number of tasks grows with rows times queries where
cells prune nothing.  Rows and queries with a null vector or component have no distance and
take no part; vectors of different lengths are no neighbours; NaN is the largest distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..session import reliable_checkpoint

#: training rows of a chunk; least and most queries of a group, groups until these grow
CHUNK, GROUP, MOST, GROUPS = 1 << 15, 1 << 13, 1 << 16, 24
#: queries and rows of a tile
TILE_Q, TILE = 512, 2048


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by one product, right up to rounding."""
    with np.errstate(all="ignore"):
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, summed in the order of the components."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            out += d * d
        return np.sqrt(out)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the rounding error of ``_squares``."""
    with np.errstate(all="ignore"):
        worst = float((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))
    return 1e-14 * (a.shape[1] + 16) * worst


def _first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of equal rows: of equal vectors no others can be among the ``k`` nearest."""
    raw = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    _, code = np.unique(raw, return_inverse=True)
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.sort(order[nth < k])


def nearest_rows(queries: np.ndarray, rows: np.ndarray, cell: np.ndarray, pivots: np.ndarray, radius: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` rows nearest to each finite query, ties by place; ``cell`` is a row's pivot,
    the number of pivots for rows in no cell.  Non-finite rows and queries are in no cell."""
    order = np.argsort(cell, kind="stable")  # tiles hold neighbouring cells
    out = []
    for at in range(0, len(queries), TILE_Q):
        q = queries[at:at + TILE_Q]
        best = np.full((len(q), k), np.inf)
        place = np.full((len(q), k), -1, np.int64)
        tau = np.full(len(q), np.inf)
        alive = np.ones((len(pivots) + 1,), bool)
        if len(pivots):
            to = np.sqrt(np.maximum(_squares(q, pivots), 0.0))
            error = math.sqrt(_slack(q, pivots)) + math.sqrt(_slack(pivots, pivots))
            if len(pivots) >= k:
                tau = np.partition(to, k - 1, axis=1)[:, k - 1] + error
        for lo in range(0, len(rows), TILE):
            at_rows = order[lo:lo + TILE]
            if len(pivots):
                alive[:-1] = ~((to - radius[None, :]) > tau[:, None] + 2 * error).all(0)
                at_rows = at_rows[alive[cell[at_rows]]]
            if not len(at_rows):
                continue
            x = rows[at_rows]
            with np.errstate(all="ignore"):
                hit, col = np.nonzero(~(_squares(q, x) > (tau * tau + _slack(q, x))[:, None]))
            dist = np.concatenate([_exact(q[hit[i:i + (1 << 16)]], x[col[i:i + (1 << 16)]])
                                   for i in range(0, max(1, len(hit)), 1 << 16)])
            near = ~(dist > tau[hit])
            hit, dist, found = hit[near], dist[near], at_rows[col[near]]
            if not len(hit):
                continue
            held, slot = np.nonzero(place >= 0)
            hit, dist = np.concatenate([held, hit]), np.concatenate([best[held, slot], dist])
            found = np.concatenate([place[held, slot], found])
            by = np.lexsort((found, dist, hit))  # NaN sorts last
            hit, dist, found = hit[by], dist[by], found[by]
            start = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 0]))
            nth = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
            top = nth < k
            best[hit[top], nth[top]], place[hit[top], nth[top]] = dist[top], found[top]
            full = (place[:, -1] >= 0) & ~np.isnan(best[:, -1])
            tau = np.where(full, np.fmin(tau, best[:, -1]), tau)
        hit, slot = np.nonzero(place >= 0)
        out.append((hit + at, place[hit, slot], best[hit, slot]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def knn_neighbors(train: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
                  n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """(query_id, rank, neighbor_id, dist): the k nearest training rows of every query."""
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    doubles = lambda v: v if train.schema[vec_col].dataType.simpleString() == "array<float>" else (
        v.cast("array<double>"))
    tr = train.select(F.col(id_col).alias("_tid"), doubles(F.col(vec_col)).alias("_v")).where(whole(F.col("_v")))
    q = queries.select(F.col(id_col).alias("_qid"), doubles(F.col(vec_col)).alias("_v")).where(
        whole(F.col("_v")) & F.col("_qid").isNotNull())
    n = tr.count()
    P = n_pivots or max(1, min(512, int(math.sqrt(n))))
    drawn = [r["_v"] for r in tr.orderBy(F.xxhash64(F.lit(seed), F.col("_tid")), "_tid").limit(P).collect()]
    pivots = {d: np.array([v for v in drawn if len(v) == d and np.isfinite(v).all()], np.float64).reshape(-1, d)
              for d in {len(v) for v in drawn}}
    vectors = tr.schema["_v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("_v")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            cell, far = np.full(len(size), -1, np.int32), np.full(len(size), np.nan)
            for d, p in pivots.items():
                at = np.flatnonzero(size == d)
                x = _matrix(v.take(pa.array(at)), d)
                if not len(p) or not len(at):
                    continue
                to = _squares(x, p)
                own = to.argmin(1)
                own_dist = _exact(x, p[own])
                good = np.isfinite(x).all(1) & np.isfinite(own_dist)
                cell[at[good]], far[at[good]] = own[good], own_dist[good]
            yield pa.record_batch([b.column("_tid"), v, pa.array(size.astype(np.int32)), pa.array(cell), pa.array(far)],
                                  names=["_tid", "_v", "dim", "cell", "far"])

    kind = tr.schema["_tid"].dataType.simpleString()
    cells = reliable_checkpoint(tr.mapInArrow(assign, f"_tid {kind}, _v {vectors}, dim int, cell int, far double"))
    radius = {d: np.zeros(len(p)) for d, p in pivots.items()}
    for r in cells.where("cell >= 0").groupBy("dim", "cell").agg(F.max("far").alias("radius")).collect():
        radius[r["dim"]][r["cell"]] = r["radius"]
    q = reliable_checkpoint(q)  # read by the count and the pairs, dealt by its rows' places
    n_queries = q.count()
    groups = math.ceil(max(1, n_queries) / min(MOST, max(GROUP, math.ceil(n_queries / GROUPS))))
    chunks = math.ceil(max(1, n) / CHUNK)
    place = F.monotonically_increasing_id()  # of a checkpoint: the same in every run of a task
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.withColumn("group", (place % groups).cast("int")).withColumn("chunk", each(chunks))
    right = cells.drop("far").withColumn("chunk", (place % chunks).cast("int")).withColumn("group", each(groups))

    def pair(qs: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_tid", "ascending")], null_placement="at_start"))
        ids, tids = [], []
        dists: list[np.ndarray] = []
        q_size = pc.list_value_length(qs["_v"]).to_numpy()
        dims = rows["dim"].to_numpy()
        for d in np.unique(q_size):
            mine = qs.filter(pa.array(q_size == d))
            own = rows.filter(pa.array(dims == d))
            if not own.num_rows:
                continue
            a = _matrix(mine["_v"].combine_chunks(), d)
            x = _matrix(own["_v"].combine_chunks(), d)
            kept = _first_copies(x, k) if d else np.arange(min(k, len(x)))
            x, own = x[kept], own.take(pa.array(kept))
            cell = own["cell"].to_numpy().astype(np.int64)
            p = pivots.get(int(d), np.empty((0, d)))
            cell = np.where(cell < 0, len(p), cell)
            good = np.isfinite(a).all(1)
            for part, piv in ((np.flatnonzero(good), p), (np.flatnonzero(~good), p[:0])):
                if not len(part):
                    continue
                if len(piv):  # a tile's queries share neighbouring cells
                    part = part[np.argsort(_squares(a[part], piv).argmin(1), kind="stable")]
                hit, found, dist = nearest_rows(
                    a[part], x, cell if len(piv) else np.zeros(len(x), np.int64), piv,
                    radius.get(int(d), np.empty(0)), k)
                ids.append(mine["_qid"].take(pa.array(part[hit])))
                tids.append(own["_tid"].take(pa.array(found)))
                dists.append(dist)
        flat = lambda parts, like: pa.chunked_array([c for p in parts for c in p.chunks], like.type)
        return pa.table({"_qid": flat(ids, qs["_qid"]), "_tid": flat(tids, rows["_tid"]),
                         "dist": pa.array(np.concatenate(dists) if dists else np.empty(0))})

    found = left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk")).applyInArrow(
        pair, f"_qid {q.schema['_qid'].dataType.simpleString()}, _tid {kind}, dist double")
    wq = Window.partitionBy("_qid").orderBy("dist", "_tid")
    top = found.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k)
    return top.select(F.col("_qid").alias("query_id"), "rank", F.col("_tid").alias("neighbor_id"), "dist")


def knn_vote(neighbors: DataFrame, train: DataFrame, id_col: str, label_col: str, weights: str = "uniform"
             ) -> DataFrame:
    """Class vote of the neighbours: uniform counts or 1/distance (exact matches win); ties -> smallest label."""
    lab = train.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("label"))
    j = neighbors.join(lab, "neighbor_id")
    if weights == "uniform":
        w = F.lit(1.0)
    else:
        has_zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("query_id")) == 1
        w = F.when(has_zero, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    votes = j.withColumn("w", w).groupBy("query_id", "label").agg(F.sum("w").alias("score"))
    best = votes.groupBy("query_id").agg(F.max_by("label", F.struct(F.col("score"), -F.col("label"))).alias("prediction"))
    return best


def knn_regress(neighbors: DataFrame, train: DataFrame, id_col: str, target_col: str) -> DataFrame:
    lab = train.select(F.col(id_col).alias("neighbor_id"), F.col(target_col).alias("y"))
    return neighbors.join(lab, "neighbor_id").groupBy("query_id").agg(F.avg("y").alias("prediction"))
