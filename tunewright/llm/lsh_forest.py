"""MinHash near-dedup by an LSH forest: several sorted orders of one signature.

1. A document's set holds its distinct word shingles (64-bit hashes); equal sets (128-bit digest) are one node.  A node
   has a signature of ``HASHES`` min-hashes, 16 bits each.
2. Order l sorts all nodes by the signature rotated by 3 l places, so nodes that agree in the first values of an order
   stand side by side.  Orders are range-sorted over the cluster, a region of any size is just a stretch of rows.
3. A stream over the sorted rows takes the longest common prefixes of neighbours.  Depth adapts to the region: rows
   that agree in ``DEPTH`` values are a region; one of more than ``CROWD`` rows is looked at one value deeper, and so
   on.  Candidates are all pairs of a region that is not crowded, and all neighbours with a common prefix of ``DEPTH``.
   Pairs whose signatures agree in under ``AGREE`` places are dropped.
4. Candidates are confirmed on the full sets, in rounds, so that sets move as little as possible: first the most
   similar partner of each node, then, for each two components still apart, their most similar pair, at last all pairs
   between components that are still apart.  A group of near copies is one component after the first rounds, and its
   other pairs are never compared.
5. Deeper prefixes part copies that differ each in its own place from one text.  So in a crowded region (also one cut by
   the edge of a task or of a step) every row outside of its largest component is at last held against all its rows:
   first the signatures, in blocks of ``REGION`` rows, for the components that can belong together; then the full
   sets of these components, in blocks of ``BLOCK`` shingles, all pairs.

A pair of similarity 0.8 shares a region of depth 2 in an order with probability 0.64 (the 16 orders start on values
of their own): it is missed in all with probability 1e-7; below 22 of 48 equal values it falls with probability 1e-8.
Step 5 is the number of rows still apart in a region times the region's rows, whatever these are.

Defined results: null or wordless text has the empty set, links with nothing and is its own component; a null doc_id
links as any other and is nobody's smallest id unless all are null; rows with one doc_id are separate documents (kept
alike); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import (WORD_BASE, connected_components, flat_bytes, mix64, powers, steps, text_or_empty,
                                   word_hashes, words)
from tunewright.llm.url_filter import bloom_filter, may_contain
from tunewright.session import reliable_checkpoint

#: values of a signature, sorted orders (order l starts at value STRIDE * l)
HASHES, ORDERS, STRIDE = 48, 16, 3
#: common prefix that makes candidates, rows of a region that is not crowded, equal values of a candidate
DEPTH, CROWD, AGREE = 2, 8, 22
#: rows of a step over a sorted order, and rows of small tables (pairs, labels) a task writes
ROWS, EDGES = 1 << 16, 200_000
#: rows of a crowded region's block, shingles of a block of components that can belong together
REGION, BLOCK = 4_096, 500_000
# Fixed value: seed of the min-hash functions.
SEED = 0x1F83D9ABFB41BD6B


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and the n + 1 bounds of the texts in it: A-Z
    lower-cased, words split at ASCII white space; a text of fewer words has its whole sequence as one shingle."""
    data, at = flat_bytes(column)
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    start, length = words(data, inside)
    h = word_hashes(data, inside, start, length)
    cut = np.searchsorted(start, at)
    place = powers(WORD_BASE, width)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k:k + len(rolled)] * place[k]
    rolled = mix64(rolled)
    sets = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi - lo >= width:
            sets.append(np.unique(rolled[lo:hi - width + 1]))
        elif hi > lo:
            sets.append(mix64(np.array([np.sum(h[lo:hi] * place[:hi - lo]) + np.uint64(hi - lo)])))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of 16-bit min-hashes for each non-empty set."""
    start = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(start), HASHES), ">u2")  # bytes in the order that they sort by
    if len(start):
        for i, k in enumerate(mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(SEED))):
            least = np.minimum.reduceat((flat ^ k) * (k | np.uint64(1)), start)
            out[:, i] = mix64(least) >> np.uint64(48)
    return out


def digests(flat: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(flat[lo:hi].tobytes()) if hi > lo else None
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def common_prefix(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row the values it shares, from the first on, with the row before (-1: the first row of an order)."""
    out = np.full(len(values), -1, np.int64)
    same = values[1:] == values[:-1]
    out[1:] = np.where(same.all(axis=1), values.shape[1], same.argmin(axis=1))
    out[1:][order[1:] != order[:-1]] = -1
    return out


def neighbours(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (places) in sorted rows, and their number of equal values."""
    prefix = common_prefix(values, order)
    region = np.full(len(values), -1, np.int64)  # the region that is not crowded
    rows = np.arange(len(values))
    for depth in range(DEPTH, values.shape[1] + 1):
        begins = prefix[rows] < depth
        begins[0] = True
        begins[1:] |= rows[1:] != rows[:-1] + 1
        at = np.flatnonzero(begins)
        size = np.diff([*at, len(rows)])
        small = np.repeat(size <= CROWD, size)
        region[rows[small]] = np.repeat(rows[at], size)[small]
        rows = rows[~small]
        if not len(rows):
            break
    left, right = [], []
    for apart in range(1, min(CROWD, len(values))):
        together = (region[apart:] >= 0) & (region[apart:] == region[:-apart])
        if apart == 1:
            together |= prefix[1:] >= DEPTH
        i = np.flatnonzero(together)
        left.append(i)
        right.append(i + apart)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    alike = (values[i] == values[j]).sum(axis=1)
    keep = alike >= AGREE
    return i[keep], j[keep], alike[keep]


def crowded(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of crowded regions, and of the first and the last one, which may go on elsewhere."""
    begins = common_prefix(values, order) < DEPTH
    at = np.flatnonzero(begins)
    size = np.diff([*at, len(values)])
    many = size > CROWD
    many[[0, -1]] = True
    return np.repeat(many, size)


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(u, v, alike) with u < v from nodes (node, n, s); set sizes too different for the similarity are no pair.  A
    row of a crowded region has its node as u, no v and its order as alike."""
    turned = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    rows = nodes.select("node", "n", "s", turned.alias("o")).select("o", F.concat(
        F.expr(f"substring(s, o * {2 * STRIDE} + 1)"), F.expr(f"substring(s, 1, o * {2 * STRIDE})")).alias("s"),
        "node", "n")
    rows = rows.repartitionByRange("o", "s", "node").sortWithinPartitions("o", "s", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[tuple]) -> pa.RecordBatch:
            order, values, node, size = (np.concatenate(x) for x in zip(*held, strict=True))
            i, j, alike = neighbours(values, order)
            near = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
            u, v, alike = node[i[near]], node[j[near]], alike[near]
            many = crowded(values, order)
            none = np.arange(len(u) + many.sum()) >= len(u)
            u, v = (np.concatenate((f(u, v), node[many])) for f in (np.minimum, np.maximum))
            return pa.record_batch([pa.array(u), pa.array(v, mask=none), pa.array(np.concatenate(
                (alike, order[many])).astype(np.int32))], names=["u", "v", "alike"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            values = np.frombuffer(b"".join(b.column("s").to_pylist()), ">u2").reshape(-1, HASHES)
            held.append((b.column("o").to_numpy(), values, b.column("node").to_numpy(), b.column("n").to_numpy()))
            n += b.num_rows
            if n >= ROWS:
                yield pairs(held)
                held, n = [tuple(x[-CROWD:] for x in held[-1])], CROWD  # the next step begins with the last rows
        if held:
            yield pairs(held)

    return rows.mapInArrow(run, "u long, v long, alike int").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v, ...) whose full sets are similar enough; sets (node, n, members)."""
    def of(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n").alias("n" + name), F.col("members").alias("m" + name))

    both = F.size(F.array_intersect("mu", "mv"))
    return pairs.join(of("u"), "u").join(of("v"), "v").where(
        both * 100 >= (F.col("nu") + F.col("nv") - both) * percent).select(*pairs.columns)


def between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components, with the components' labels (a, b), a < b."""
    def of(name: str, out: str) -> DataFrame:
        return label.select(F.col("node").alias(name), F.col("label").alias(out))

    return pairs.join(of("u", "lu"), "u").join(of("v", "lv"), "v").where("lu <> lv").select(
        "u", "v", "alike", F.least("lu", "lv").alias("a"), F.greatest("lu", "lv").alias("b"))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) after the components a and b of links are joined."""
    new = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), rows_a_task=EDGES)
    new = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return compact(label.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def compact(rows: DataFrame) -> DataFrame:
    """A checkpoint of small rows in tasks of ``EDGES`` rows."""
    rows = reliable_checkpoint(rows)
    return rows.coalesce(1 + rows.count() // EDGES)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all nodes of ``sets``: components of the confirmed candidates (u, v, alike)."""
    label = compact(sets.select("node", F.col("node").alias("label")))
    ends = pairs.select("u", "v", "alike", F.col("u").alias("node")).union(
        pairs.select("u", "v", "alike", F.col("v").alias("node")))
    best = compact(ends.groupBy("node").agg(F.max(F.struct("alike", "u", "v")).alias("p")).select("p.u", "p.v").distinct())
    links = compact(confirmed(best.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")), sets, percent))
    label = merged(label, links)

    rest = compact(between(pairs, label).join(best, ["u", "v"], "left_anti"))
    best = compact(rest.groupBy("a", "b").agg(F.max(F.struct("alike", "u", "v")).alias("p")).select("a", "b", "p.u", "p.v"))
    links = compact(confirmed(best, sets, percent))
    if links.isEmpty():
        last = rest.join(best.select("u", "v"), ["u", "v"], "left_anti")
    else:
        label = merged(label, links)
        last = between(rest.select("u", "v", "alike"), label).join(best.select("u", "v"), ["u", "v"], "left_anti")
    links = compact(confirmed(last.select("u", "v", "a", "b"), sets, percent))
    return label if links.isEmpty() else merged(label, links)


def meetings(rows: DataFrame, key: list[str], weight: Column, limit: int) -> DataFrame:
    """Rows (key, node, label, ...) of groups of several components in blocks (i, j) of about ``limit``: each row that is
    not of its group's largest component (asks) meets every row of the group in one block."""
    parts = rows.groupBy(*key, "label").agg(F.sum(weight).alias("w"))
    size = parts.groupBy(*key).agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("w"),
                                   F.count("*").alias("parts")).where("parts > 1").select(
        *key, F.col("most.label").alias("main"), F.ceil((F.col("w") - F.col("most.w")) / limit).alias("above"),
        F.ceil(F.col("w") / limit).alias("across"))

    def place(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))

    def each(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)

    asks = F.when(F.col("label") != F.col("main"), each("across", lambda x: F.struct(
        place("above").alias("i"), x.alias("j"), F.lit(True).alias("asks"))))
    told = each("above", lambda x: F.struct(x.alias("i"), place("across").alias("j"), F.lit(False).alias("asks")))
    return rows.join(size, key).withColumn("at", F.explode(F.when(asks.isNull(), told).otherwise(F.concat(
        asks, told)))).select(*rows.columns, "at.*")


def _components(labels: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    """(a, b), a < b: the components that a block's pairs join (place of a row, places of the rows it belongs to), each
    with the smallest one that it is joined with, so no more rows than components."""
    names, code = np.unique(labels, return_inverse=True)
    root = np.arange(len(names))
    for x, at in found:
        ends = np.unique(root[np.append(code[at], code[x])])
        if len(ends) > 1:
            root[np.isin(root, ends)] = ends[0]
    far = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"a": pa.array(names[root[far]], pa.int64()), "b": pa.array(names[far], pa.int64())})


def alike_components(table: pa.Table, percent: int) -> pa.Table:
    """Components of a block that have a candidate pair: rows (s, n, label, asks)."""
    values = np.frombuffer(b"".join(table.column("s").to_pylist()), ">u2").reshape(-1, HASHES)
    n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
    asks = table.column("asks").to_numpy()
    right = np.flatnonzero(~asks)
    against, size = values[right], n[right]
    found = []
    for x in np.flatnonzero(asks):
        near = ((against == values[x]).sum(axis=1) >= AGREE) & (
            np.minimum(size, n[x]) * 100 >= np.maximum(size, n[x]) * percent)
        found.append((x, right[near]))
    return _components(label, found)


def similar_components(table: pa.Table, percent: int) -> pa.Table:
    """Components of a block that have a pair of similar sets: rows (members, label, asks)."""
    lists = table.column("members").combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    _, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    label, asks, n = table.column("label").to_numpy(), table.column("asks").to_numpy(), np.diff(bounds)
    right = np.flatnonzero(~asks)
    if not len(right):
        return _components(label, [])
    against = np.concatenate([code[bounds[x]:bounds[x + 1]] for x in right])
    start, size = np.cumsum(n[right]) - n[right], n[right]
    mine = np.zeros(code.max() + 1, np.int32)
    found = []
    for x in np.flatnonzero(asks):
        own = code[bounds[x]:bounds[x + 1]]
        mine[own] = 1
        both = np.add.reduceat(mine[against], start)
        mine[own] = 0
        found.append((x, right[both * 100 >= (size + n[x] - both) * percent]))
    return _components(label, found)


def whole_regions(crowd: DataFrame, nodes: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """label (node, label) after the components are joined that have a pair in a crowded region: crowd (node, o)."""
    first = F.expr(f"substring(concat(s, s), o * {2 * STRIDE} + 1, {2 * DEPTH})")
    rows = crowd.join(nodes.select("node", "n", "s"), "node").join(label, "node").select(
        "o", first.alias("p"), "node", "n", "s", "label")
    near = compact(meetings(rows, ["o", "p"], F.lit(1), REGION).groupBy("o", "p", "i", "j").applyInArrow(
        lambda t: alike_components(t, percent), "a long, b long").distinct())
    if near.isEmpty():
        return label
    family = connected_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), rows_a_task=EDGES).select(
        F.col("node").alias("label"), F.col("label").alias("family"))
    whole = sets.join(label.join(family, "label"), "node").select("family", "node", "n", "members", "label")
    links = compact(meetings(whole, ["family"], F.col("n"), BLOCK).groupBy("family", "i", "j").applyInArrow(
        lambda t: similar_components(t, percent), "a long, b long").distinct())
    return label if links.isEmpty() else merged(label, links)


def near_dedup(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), kept (doc_id = component_id) of every
    row."""
    if not 0 < percent < 100:
        raise ValueError("percent lies between 0 and 100")
    text = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            flat, bounds = shingles(b.column("text"), width)
            rows = iter(signatures(flat, bounds))
            n = np.diff(bounds)
            yield pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(digests(flat, bounds), pa.binary()),
                                   pa.array([next(rows).tobytes() if x else None for x in n], pa.binary())],
                                  names=["doc_id", "n", "k", "s"])

    rows = reliable_checkpoint(text.mapInArrow(signed, f"doc_id {kind}, n long, k binary, s binary"))
    nodes = reliable_checkpoint(rows.where("n > 0").groupBy("k").agg(
        F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("s").alias("s")).withColumn(
        "node", F.monotonically_increasing_id()))
    found = compact(candidates(nodes.select("node", "n", "s"), percent))
    pairs, crowd = found.where("v is not null"), found.where("v is null").select(
        F.col("u").alias("node"), F.col("alike").alias("o"))

    ends = found.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    alive = compact(nodes.select("node", "k").join(ends, "node"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(alive, "k"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a task sends equal sets once
        for b in steps(batches, "text"):
            flat, bounds = shingles(b.column("text"), width)
            k = digests(flat, bounds)
            hit = may_contain(sent.value, np.array([xxhash.xxh64_intdigest(x or b"", 42) for x in k], np.uint64).view(
                np.int64))
            new = [i for i, x in enumerate(k) if x and hit[i] and not (x in seen or seen.add(x))]
            yield pa.record_batch([pa.array([k[i] for i in new], pa.binary()), pa.array(
                [flat[bounds[i]:bounds[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))],
                names=["k", "members"])

    sets = text.select("text").mapInArrow(whole, "k binary, members array<long>").join(alive, "k").dropDuplicates(
        ["node"]).select("node", F.size("members").cast("long").alias("n"), "members")
    sets = reliable_checkpoint(sets)
    sent.unpersist()
    label = whole_regions(crowd, nodes, sets, linked(pairs, sets, percent), percent)

    joined = nodes.select("node", "k", "least").join(label, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "label").select("k", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "k").join(of, "k", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
