"""URL filter: host and path rules, then a listed-URL filter of a blocked Bloom filter and an exact hash join.

Listed canonical URLs set 8 bits in one 256-bit block of a Bloom filter (one bit in each 32-bit word).  The filter
is made by an aggregate of partial filters and has ``MAX_BLOCKS`` blocks (32 MB) at most, so it may be sent to every
task whatever the list's size; a crowded filter only passes more URLs on.  URLs that miss are allowed without moving;
possible hits go to an exact hash join with the list, which removes the false positives.

Rules are a short configured list (they become one CASE expression); a rule fits its host and all subdomains if the
path starts with the rule's, and the longest rule wins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, is never listed and so is
allowed; repeated rows are judged alike; extra columns are ignored; an empty table or list works.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.session import reliable_checkpoint

BITS_PER_URL, MAX_BLOCKS = 16, 1 << 20
# Odd 32-bit multipliers, one for each word of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31],
                 np.uint32)
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
#: query parameters that name no page
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""
    action: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without default port and final dot, path without final slashes, the other query parameters sorted;
    scheme and fragment go.  Null without a host."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"\.+$", "")
    p = F.regexp_replace(path, r"/+$", "")
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), QUERY, 1), "&"),
                     lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(h != "", F.concat(h, F.when(p == "", F.lit("/")).otherwise(p),
                                    F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text (host + path) and action of the longest rule that fits, nulls if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bit in each of the block's words."""
    u = h.astype(np.int64).view(np.uint64)
    block = ((u >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    low = (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return block, np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))


def bloom_filter(listed: DataFrame, column: str, bits: int = BITS_PER_URL) -> np.ndarray:
    """The filter of the URLs' xxhash64 as an array of shape (blocks, 8)."""
    n = max(1, listed.count())
    blocks = 1 << min(MAX_BLOCKS.bit_length() - 1, max(0, (n * bits // 256).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((blocks, 8), np.uint32)
        for b in batches:
            block, bit = places(b.column("h").to_numpy(zero_copy_only=False), blocks)
            np.bitwise_or.at(words, block, bit)
        used = np.flatnonzero(words.any(axis=1))
        yield pa.record_batch([pa.array(used), *(pa.array(words[used, i].astype(np.int64)) for i in range(8))],
                              names=["block", *(f"w{i}" for i in range(8))])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = listed.select(F.xxhash64(column).alias("h")).mapInArrow(part, schema).groupBy("block").agg(
        *(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    words = np.zeros((blocks, 8), np.uint32)
    at = rows.column("block").to_numpy()
    for i in range(8):
        words[at, i] = rows.column(f"w{i}").to_numpy().astype(np.uint32)
    return words


def may_contain(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, bit = places(h, len(words))
    return ((words[block] & bit) == bit).all(axis=1)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict of every row.  ``listed`` has canonical URLs in its column url."""
    spark = pages.sparkSession
    # written once: the filter and the join read the same list, and the join may split its skewed side
    list_ = reliable_checkpoint(listed.where("url is not null").select(F.col("url").alias("listed_url")).distinct())
    sent = spark.sparkContext.broadcast(bloom_filter(list_, "listed_url"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(may_contain(sent.value, h.to_numpy(np.int64)))

    url = F.col("url").cast("string")
    rows = pages.select(F.col(id_column).alias("id"), url.alias("url"), host_of(url).alias("host"),
                        path_of(url).alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), action.alias("action"),
                       canonical(F.col("url"), F.col("host"), F.col("path")).alias("canonical"))
    undecided = F.col("rule").isNull() & F.col("canonical").isNotNull()
    flagged = rows.withColumn("hit", F.when(undecided, maybe(F.xxhash64(F.coalesce("canonical", F.lit(""))))).otherwise(
        F.lit(False)))
    out = [F.col("id").alias(id_column), "host", "path", "rule"]
    free = flagged.where(~F.col("hit")).select(*out, F.coalesce("action", F.lit("allow")).alias("verdict"))
    hits = flagged.where("hit").join(list_.hint("shuffle_hash"), F.col("canonical") == F.col("listed_url"), "left")
    return free.unionByName(hits.select(
        *out, F.when(F.col("listed_url").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))
