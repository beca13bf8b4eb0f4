"""Exact dedup by content-defined chunk recipes (DataFrame and SQL functions only).

A text, white space runs made one space, is cut at places that its own characters choose; each chunk gets a
128-bit identifier.  Identifiers are verified once per distinct chunk: the distinct chunks of the corpus are
gathered (each map task sends a repeated chunk once) and an identifier that stands for two different chunks is
an exception.  From then on a text is its ordered list of identifiers, so long texts never move again: equal
lists of verified identifiers are equal texts.  If there is an exception, the recipes hold the chunks themselves.

Defined results: null text counts as empty; empty texts are equal to each other; a null doc_id comes after every
other; of rows that agree in doc_id and text exactly one stays; extra columns are ignored by ``dedup_groups``
and carried by ``drop_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import fresh, text_or_empty
from tunewright.session import reliable_checkpoint

#: what needs a change to become one space (a lone space needs none)
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: a chunk: at least 512 characters up to the first sentence end, 4,096 at most
CHUNK = r"(?s).{512,4094}?[.!?:;] |.{1,4096}"
#: parts that the rows of one large group are dealt to
SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def recipes(docs: DataFrame, ident: Callable[[Column], Column] = identifier) -> DataFrame:
    """One row per document: row (unique), doc_id, recipe, text_sha256."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    cut = text.select("doc_id", "t", chunks(F.col("t")).alias("parts"))
    table = reliable_checkpoint(cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.transform("parts", ident).alias("recipe"),
        F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")))
    distinct = text.select(F.explode(chunks(F.col("t"))).alias("part")).distinct()
    doubtful = distinct.select(ident(F.col("part")).alias("id")).groupBy("id").count().where("count > 1")
    if not doubtful.isEmpty():  # two chunks with one identifier: the recipe lists the chunks themselves
        return reliable_checkpoint(cut.select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.transform("parts", lambda c: c.cast("binary")).alias("recipe"),
            F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")))
    return table


def dedup_groups(docs: DataFrame, ident: Callable[[Column], Column] = identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rec = recipes(docs, ident)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = (rec.groupBy("recipe").agg(F.count("*").alias("n"), first.alias("f")).where("n > 1")
              .select("recipe", "n", F.col("f.doc_id").alias("keep"), F.col("f.row").alias("keep_row"),
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    joined = rec.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(
        groups, ["recipe", "salt"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dedup_groups`` does not keep; all columns stay.  Of rows that agree in
    doc_id and text any one stays."""
    key, = fresh(docs, "dedup_key")

    def name(doc_id: Column, sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), sha)

    kept = dedup_groups(docs).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias(key))
    mine = docs.withColumn(key, name(F.col("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256)))
    return mine.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
