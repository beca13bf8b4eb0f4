"""Conversation prefix trie by ROLLUP over positional turn-id columns.

1. Distinct turns (role, text) get dense ids: texts move nowhere, only a 128-bit digest and the byte length do.  The
   turns of a conversation are numbered, and conversations rebuilt (``rebuilt``) as rows (conv_id, pos, turn id).
2. A conversation's ids are laid out in blocks, the first ``FIRST`` positions, then ``NEXT`` positions each.  One
   ROLLUP over a block's columns t1..tw aggregates all its prefixes together (partial sums before the shuffle, so a
   prefix of a third of all conversations is a few rows a task); grouping_id tells a column rolled up from a
   conversation that has ended.  A longer conversation continues in the next block, keyed by its node of the block
   before.  A node is named by (depth, smallest member): members of different nodes of one depth are different.
3. Subtree sums go the other way, from the last block to the first: a ROLLUP of the nodes over the same columns, each
   block's totals handed to the node that the block is keyed by.
4. Digests of members' ids: ranges of the sorted ids become pieces of text, and a stream over the pieces of a node
   feeds the hash, so a node with any number of members takes no memory.

Work is one pass over conversations of the first block; each further block only touches conversations that long (jobs
grow with the longest conversation / ``NEXT``).

Defined results: null role or text is empty; turns with equal number go by digest, a null turn first; repeated rows
are turns of their own; rows with a null conv_id belong to no conversation and are ignored; c - c % 5 takes the
remainder's sign from c; a rebuilt conversation without turns is a member of the root only; an empty table has no
nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunewright.llm.common import text_or_empty
from tunewright.session import reliable_checkpoint, scratch_path

#: turns of the first block and of each further one
FIRST, NEXT = 8, 16
#: ids of a piece at most
PIECE = 50_000


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t) of all turns, pos from 1, and (t, bytes) of the distinct turns."""
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    body = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("d"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "d")
    rows = reliable_checkpoint(rows.withColumn("pos", F.row_number().over(order).cast("long")).drop("turn"))
    ids = reliable_checkpoint(rows.groupBy("d").agg(F.max("bytes").alias("bytes")).withColumn(
        "t", F.monotonically_increasing_id()))
    return rows.join(ids.select("d", "t"), "d").select("conv_id", "pos", "t"), ids.select("t", "bytes")


def rebuilt(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c gets the first h = crc32(c) % most turns of conversation c - c % share, then its own after its
    first h: (conv_id, pos, t) of turns, and conv_id of all."""
    head = turns.where(F.col("pos") < most)
    convs = reliable_checkpoint(turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % share).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")))
    size = head.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("there"))
    convs = convs.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    shared = convs.select("conv_id", "base", "h").join(head.withColumnRenamed("conv_id", "base"), "base").where(
        F.col("pos") <= F.col("h")).select("conv_id", "pos", "t")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t")
    return shared.union(own), convs.select("conv_id")


def rolled(rows: DataFrame, width: int, *sums: Column) -> DataFrame:
    """One ROLLUP over the ids in ``key`` within ``prior``: (prior, key, *sums) of every prefix that occurs."""
    names = [f"t{i}" for i in range(1, width + 1)]
    wide = rows.select("*", *[F.get("key", F.lit(i)).alias(n) for i, n in enumerate(names)])
    level = F.lit(width) - F.bit_count("g")  # -1: the total of all
    return wide.rollup("prior", *names).agg(F.grouping_id().alias("g"), *sums).withColumn(
        "key", F.array_compact(F.array(*names))).where(level == F.size("key")).drop("g", *names)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) from (depth, conv_id, member): members ascending, joined by commas."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            if n:
                ids = np.concatenate(held).tolist()
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (*key, ids[0])] + [
                    pa.array([",".join(map(str, ids))])], names=["depth", "conv_id", "first", "ids"])

        for b in batches:
            depth, node, member = (b.column(c).to_numpy() for c in ("depth", "conv_id", "member"))
            at = np.flatnonzero((np.diff(depth, prepend=-1) != 0) | (np.diff(node, prepend=0) != 0) | (
                np.arange(len(depth)) == 0))
            for lo, hi in zip(at, [*at[1:], len(depth)], strict=True):
                own = int(depth[lo]), int(node[lo])
                if own != key or n >= PIECE:
                    yield from cut()
                    key, held, n = own, [], 0
                held.append(member[lo:hi])
                n += hi - lo
        yield from cut()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        names = ["depth", "conv_id", "ends_sha256"]

        def row(done: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in done], (pa.int64(), pa.int64(), pa.string())[i])
                                    for i in range(3)], names=names)

        for b in batches:
            done = []
            for depth, node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "conv_id", "ids")), strict=True):
                if (depth, node) == key:
                    h.update(b",")
                else:
                    if key:
                        done.append((*key, h.hexdigest()))
                    key, h = (depth, node), hashlib.sha256()
                h.update(ids.encode())
            yield row(done)
        if key:
            yield row([(*key, h.hexdigest())])

    cut = ends.repartitionByRange("depth", "conv_id", "member").sortWithinPartitions("depth", "conv_id", "member")
    text = cut.mapInArrow(pieces, "depth long, conv_id long, first long, ids string")
    return text.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(
        hashed, "depth long, conv_id long, ends_sha256 string")


class Tables:
    """Tables of one run in the shared scratch folder, a sub-folder a block: the plan of a block reads only its own, is
    the same for all blocks, and the last plans read all blocks at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = scratch_path(spark, f"trie-{uuid.uuid4().hex}")

    def write(self, rows: DataFrame, name: str, block: int) -> None:
        rows.write.parquet(f"{self.folder}/{name}/block={block}")

    def read(self, name: str, block: int | None = None) -> DataFrame:
        schema, path = SCHEMAS[name], f"{self.folder}/{name}"
        if block is not None:
            return self.spark.read.schema(schema).parquet(f"{path}/block={block}")
        return self.spark.read.schema(f"{schema}, block int").parquet(path)


SCHEMAS = {
    "keys": "conv_id long, key array<long>, more boolean",
    "here": "conv_id long, prior long, key array<long>, more boolean",
    "nodes": "prior long, key array<long>, conv_id long, n_convs long",
    "at": "member long, conv_id long, n int, more boolean",
    "sums": "prior long, key array<long>, conv_id long, saved long, leaves long",
    "totals": "prior long, key array<long>, conv_id long, saved long, leaves long",
}


def trie(turns: DataFrame, convs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations ``convs`` (conv_id) with ``turns`` (conv_id, pos from 1 on, t);
    ``sizes`` (t, bytes)."""
    spark = turns.sparkSession
    disk = Tables(spark)
    after = F.col("pos") - FIRST - 1
    block = F.when(after < 0, 0).otherwise(F.floor(after / NEXT) + 1).cast("int")
    long = turns.groupBy("conv_id").agg(F.max(block).alias("last"))
    keys = turns.groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("x")).select("conv_id", "block", F.col("x.t").alias("key"))
    keys = keys.join(long, "conv_id").select("conv_id", "key", (F.col("block") < F.col("last")).alias("more"), "block")
    silent = convs.join(long, "conv_id", "left_anti").select(
        "conv_id", F.array().cast("array<bigint>").alias("key"), F.lit(False).alias("more"), F.lit(0).alias("block"))
    keys.unionByName(silent).write.partitionBy("block").parquet(f"{disk.folder}/keys")
    root, last = disk.read("keys").agg(F.min("conv_id"), F.max("block")).first()
    if root is None:
        return disk.read("keys").selectExpr("conv_id", *(f"0L as {c}" for c in (
            "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "'' as ends_sha256")

    for b in range(last + 1):
        own = disk.read("keys", b)
        if b:
            above = disk.read("at", b - 1).where("more").select(F.col("member").alias("conv_id"), F.col("conv_id").alias(
                "prior"))
            disk.write(above.join(own, "conv_id").select("conv_id", "prior", "key", "more"), "here", b)
        else:
            disk.write(own.select("conv_id", F.lit(root).alias("prior"), "key", "more"), "here", b)
        here = disk.read("here", b)
        nodes = rolled(here, NEXT if b else FIRST, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        disk.write((nodes.where(F.size("key") > 0) if b else nodes).select("prior", "key", "conv_id", "n_convs"),
                   "nodes", b)
        disk.write(here.withColumnRenamed("conv_id", "member").join(
            disk.read("nodes", b).select("prior", "key", "conv_id"), ["prior", "key"]).select(
            "member", "conv_id", F.size("key").alias("n"), "more"), "at", b)

    before = F.when(F.col("block") == 0, 0).otherwise(FIRST + NEXT * (F.col("block") - 1))
    nodes = disk.read("nodes").withColumn("up", F.slice("key", 1, F.greatest(F.size("key") - 1, F.lit(0))))
    upper = disk.read("nodes").select("block", "prior", F.col("key").alias("up"), F.col("conv_id").alias("upper"))
    size = F.size("key")
    nodes = reliable_checkpoint(nodes.join(upper, ["block", "prior", "up"], "left").select(
        "block", "prior", "key", "conv_id", "n_convs", (size + before).cast("long").alias("depth"),
        F.when(size > 1, F.col("upper")).when(size == 1, F.col("prior")).alias("parent_conv_id")))
    under = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias(
        "conv_id")).agg(F.count("*").alias("n_children"))
    nodes = reliable_checkpoint(nodes.withColumn("t", F.get("key", size - 1)).join(sizes, "t", "left").join(
        under, ["depth", "conv_id"], "left").select(
        "block", "prior", "key", "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved")))
    nodes.select("prior", "key", "conv_id", "saved", (F.col("n_children") == 0).cast("long").alias("leaves"),
                 "block").write.partitionBy("block").parquet(f"{disk.folder}/sums")

    for b in range(last, -1, -1):
        width, own = NEXT if b else FIRST, disk.read("sums", b)
        if b < last:
            below = disk.read("totals", b + 1).where(F.size("key") == 0).select(
                F.col("prior").alias("conv_id"), "saved", "leaves")
            own = own.unionByName(own.where(F.size("key") == width).select("prior", "key", "conv_id").join(
                below, "conv_id"))
        disk.write(rolled(own, width, F.min("conv_id").alias("conv_id"), F.sum("saved").alias("saved"),
                          F.sum("leaves").alias("leaves")), "totals", b)

    totals = disk.read("totals").where((F.col("block") == 0) | (F.size("key") > 0)).select(
        (size + before).cast("long").alias("depth"), "conv_id", F.col("saved").alias("saved_tokens"),
        F.col("leaves").alias("n_leaves"))
    ends = disk.read("at").where("not more").select((F.col("n") + before).cast("long").alias("depth"), "conv_id", "member")
    return nodes.join(totals, ["depth", "conv_id"]).join(ends_digest(ends), ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the
    trie of the rebuilt conversations."""
    turns, sizes = numbered(conversations)
    turns, convs = rebuilt(reliable_checkpoint(turns))
    return trie(turns, convs, sizes)
