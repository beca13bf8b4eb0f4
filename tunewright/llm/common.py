"""Helpers shared by the operators of this subpackage: safe column names, vectorised word hashes over
Arrow text, and a distributed connected-components job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.session import reliable_checkpoint

#: bytes of text that one vectorised step handles at most (one longer text is a step of its own)
STEP_BYTES = 1 << 20

# Odd 64-bit multipliers of the word and shingle hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has in no spelling (extra columns may clash)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``limit`` bytes of ``column`` (at least one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each closed by a line feed, and the n + 1 offsets."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64)[joined.offset:joined.offset + len(joined) + 1]
    if not len(joined):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of bytes of a word."""
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def word_hashes(data: np.ndarray, is_word: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.empty(0, np.uint64)
    inside = data[is_word].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, length)
    inside *= powers(BYTE_BASE, int(length.max()))[place]
    return mix64(np.add.reduceat(inside, first) + length.astype(np.uint64))


def connected_components(edges: DataFrame, max_rounds: int = 60, rows_a_task: int | None = None) -> DataFrame:
    """(u, v) -> (node, label): label is the smallest node of the component.

    Large-star and small-star steps: every step only needs the smallest neighbour of each node, an aggregate
    with map-side combine, so no neighbour list is ever gathered; a hub's edges stay spread by the skew join.
    Null ends are ignored; an empty edge table gives an empty result.  ``rows_a_task`` bounds the number of tasks that
    write shuffle files by the number of edges (they are as many as shuffle partitions without it)."""
    def few(df: DataFrame) -> DataFrame:
        return df if tasks is None else df.coalesce(tasks)

    tasks = None
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = reliable_checkpoint(e)
    if rows_a_task:
        tasks = 1 + e.count() // rows_a_task
        e = few(e)

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        near = pairs.select("u", "v")
        if both:
            near = near.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = few(near.join(least, "u"))
        if both:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                few(least).select("u", F.col("m").alias("v")))
        return few(out.where("u <> v").distinct())

    before = None
    for _ in range(max_rounds):
        e = reliable_checkpoint(star(star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")),
                          F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
