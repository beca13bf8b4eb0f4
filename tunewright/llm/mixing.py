"""Mixing sources to target weights by Poisson replication.

A source with weight w of the wanted total gets the mean repetition rate w * total / rows.  Every row draws its
count by inverting the Poisson distribution of that mean at a point hashed from (seed, doc_id, text), so a
recomputed task draws the same; the row is exploded by its count and every copy goes to the partition and the place
in it that a hash of (seed, row, copy) names, one exchange of the whole output.

Means above ``PART`` are drawn as a sum of independent parts, so exp(-mean) never underflows and a row's table of
probabilities stays short.

Defined results: a null source is a source of its own; null text counts as empty; repeated rows draw the same
count (they are one observation); a source without weight gets none; an empty table gives an empty one; extra
columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import fresh, text_or_empty

#: largest mean of one draw
PART = 64.0
#: number of sources up to which their rates are broadcast (some 100 bytes each)
BROADCAST_SOURCES = 20_000


def unit(*parts: Column) -> Column:
    """A hashed point in (0, 1): 52 bits of an MD5 sum."""
    hexed = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= 0), P(X <= 1), ... far into the tail, for 0 < mean <= PART."""
    upto = (mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("s"), F.array(F.exp(-mean)).alias("c"))

    def add(acc: Column, j: Column) -> Column:
        p = acc["p"] * mean / j
        s = acc["s"] + p
        return F.struct(p.alias("p"), s.alias("s"), F.concat(acc["c"], F.array(s)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), upto), zero, add, lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: DataFrame | None, total: int | None, power: float) -> DataFrame:
    """source, rows, rate.  Without ``weights`` (source, weight) a source's weight is rows ** power."""
    n = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        w = n.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("ws"), F.col("weight").cast("double").alias("weight"))
        w = n.join(given, F.col("source").eqNullSafe(F.col("ws")), "left").drop("ws")
    w = w.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = w.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    want = float(total if total is not None else (sums["n"] or 0))
    scale = want / sums["w"] if sums["w"] else 0.0
    return w.select("source", "rows", (F.col("weight") * F.lit(scale) / F.col("rows")).alias("rate"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, power: float = 0.5,
              seed: str = "mix", out: tuple[str, str, str] = ("rate", "copy", "n_copies")) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, globally shuffled, with rate, copy (from 1) and n_copies."""
    rate, copy, n_copies = out
    parts, cdf, mine, order, digest = fresh(
        docs, "mix_parts", "mix_cdf", "mix_source", "mix_order", "mix_digest")
    rates = source_rates(docs, weights, total, power).where("rate > 0")
    rates = rates.select(F.col("source").alias(mine), F.col("rate").alias(rate)).withColumn(
        parts, F.ceil(F.col(rate) / F.lit(PART)).cast("int")).withColumn(
        cdf, poisson_cdf(F.col(rate) / F.col(parts)))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.join(rates, docs["source"].eqNullSafe(F.col(mine)))

    rows = rows.withColumn(digest, F.md5(text_or_empty(F.col("text")).cast("binary")))
    row = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col(digest)]
    points = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda part: unit(*row, part.cast("string")))
    count = F.aggregate(points, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c < u)))
    rows = rows.withColumn(n_copies, count).where(F.col(n_copies) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    rows = rows.withColumn(order, F.md5(F.concat_ws("|", *row, F.lit("order"), F.col(copy).cast("string"))))
    rows = rows.drop(parts, cdf, mine, digest)
    return rows.repartition(order).sortWithinPartitions(order).drop(order)
