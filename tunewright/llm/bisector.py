"""Centroid clustering by a bisector tournament, in exact integers.

Vectors become integers floor(scale * x), written once as packed binaries; nothing is shuffled but k rows of sums a
task.  For centroids i < j the bisecting plane has the integer normal 2 (c_j - c_i) and threshold |c_j|^2 - |c_i|^2;
x lies nearer to j exactly if x . normal > threshold, and zero favours i, the smaller number.  A vector's nearest
centroid is found by k - 1 such sign tests, each of which eliminates one of two centroids; only the winner's distance
is computed.  Arithmetic is in 64-bit integers where bounds prove that it fits, else in Python's integers.

Per round, tasks add up their vectors by cluster, one aggregate merges these k rows a task into k rows, and the driver
takes the componentwise floor of sum / count.

Defined results: vectors that are null, of another length, or have a null or non-finite component are not kept and
have no row; equal vectors and repeated vec_ids are rows of their own (start centroids of equal hash: by the packed
vector); a null vec_id starts only after all others; fewer kept vectors than k give that many centroids; an empty
table gives no rows; extra columns are ignored.  A distance or inertia that no 64-bit integer holds is null; a
component of 2^62 or more after scaling is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.session import reliable_checkpoint

LONG = 1 << 63


def packed(vectors: DataFrame, id_column: str, column: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the kept vectors, v their integers in 4 or 8 bytes each."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.size(v) == dims).where(~bad).select(F.col(id_column).alias("id"), v.alias("v"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.floor(flat * float(scale))
            if (np.abs(x) >= 2.0 ** 62).any():
                raise ValueError("a component of 2^62 or more after scaling")
            x = x.astype("<i8")
            wide = (np.abs(x) >= 1 << 31).any(axis=1)
            yield pa.record_batch([b.column("id"), pa.array(
                [(r if w else r.astype("<i4")).tobytes() for r, w in zip(x, wide, strict=True)], pa.binary())],
                names=["id", "v"])

    return kept.mapInArrow(run, f"id {kind}, v binary")


def unpacked(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integers) of the vectors of a batch, those of one width together."""
    data = column.to_pylist()
    width = np.array([len(x) for x in data])
    for w in (4, 8):
        at = np.flatnonzero(width == w * dims)
        if len(at):
            yield at, np.frombuffer(b"".join(data[i] for i in at), f"<i{w}").astype(np.int64).reshape(-1, dims)


class Tournament:
    """Normals and thresholds of all pairs of centroids, and their sign tests."""

    def __init__(self, centroids: list[list[int]]):
        self.k, self.dims = len(centroids), len(centroids[0])
        c = np.array(centroids, dtype=object).reshape(self.k, self.dims)
        square = (c * c).sum(axis=1)
        self.largest = max(1, max(abs(x) for row in centroids for x in row))
        self.exact = c, 2 * (c[None] - c[:, None]), square[None] - square[:, None]
        self.small = [a.astype(np.int64) for a in self.exact] if self.fits(self.largest) else None

    def fits(self, largest: int) -> bool:
        """No step on components up to ``largest`` leaves 64 bits."""
        top = max(self.largest, largest)
        return self.dims * 8 * top * top < LONG

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance (64-bit, or Python's integers) of each row."""
        if self.small is not None and self.fits(int(np.abs(x).max(initial=0))):
            centroid, normal, threshold = self.small
        else:
            x = x.astype(object)
            centroid, normal, threshold = self.exact
        winner = np.zeros(len(x), np.int64)
        for j in range(1, self.k):
            side = (x * normal[winner, j]).sum(axis=1) - threshold[winner, j]
            winner[(side > 0).astype(bool)] = j
        apart = x - centroid[winner]
        return winner, (apart * apart).sum(axis=1)


def sums(vectors: DataFrame, test: Tournament) -> dict[int, tuple[int, list[int]]]:
    """count and component sums of each non-empty cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((test.k, test.dims), dtype=object)
        n = np.zeros(test.k, np.int64)
        for b in batches:
            for _, x in unpacked(b.column("v"), test.dims):
                winner, _ = test.nearest(x)
                if int(np.abs(x).max()) * len(x) >= LONG:
                    x = x.astype(object)
                for c in np.unique(winner):
                    own = x[winner == c]
                    n[c] += len(own)
                    total[c] += own.sum(axis=0).astype(object)
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(
            [[int(s) for s in total[c]] for c in used], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "s"])

    rows = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>").groupBy("cluster").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(test.dims))).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(test.dims)]) for r in rows}  # k rows at most


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", scale: int = 1024, dims: int = 64,
            id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids.  Start: the k vectors of smallest
    lower-case hex SHA-256 of seed + decimal id."""
    rows = reliable_checkpoint(packed(vectors, id_column, column, dims, scale))
    kind = rows.schema["id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), F.hex("v")).limit(k).select("v").toArrow()
    start = [x.tolist()[0] for v in first.column("v").to_pylist()
             for _, x in unpacked(pa.array([v], pa.binary()), dims)]
    if not start:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    centroids = start
    for _ in range(rounds):
        got = sums(rows, Tournament(centroids))
        centroids = [[s // got[c][0] for s in got[c][1]] if c in got else old for c, old in enumerate(centroids)]
    test = Tournament(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, dtype=object)
            for at, x in unpacked(b.column("v"), dims):
                number[at], far[at] = test.nearest(x)
            yield pa.record_batch([b.column("id"), pa.array(number), pa.array(
                [int(d) if d < LONG else None for d in far], pa.int64())], names=["id", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_table(vectors: DataFrame, id_column: str = "vec_id", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found, centroids = cluster(vectors, id_column=id_column, **options)
    if not centroids:
        return found.select(F.col("id").alias(id_column), "cluster", "distance", F.col("distance").alias("cluster_inertia"),
                            F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    rows = reliable_checkpoint(found)
    total: list[int | None] = [0] * len(centroids)
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                         F.count_if(F.col("distance").isNull()).alias("lost")).collect():
        total[r["cluster"]] = None if r["lost"] else int(r["s"])
    every = None if None in total else sum(total)

    def lit(x: int | None):
        return F.lit(x if x is not None and x < LONG else None).cast("long")

    def own(values):
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    return rows.select(F.col("id").alias(id_column), "cluster", "distance", own([lit(t) for t in total]).alias(
        "cluster_inertia"), lit(every).alias("inertia"), own([F.lit(digest(c)) for c in centroids]).alias("centroid_sha256"))
