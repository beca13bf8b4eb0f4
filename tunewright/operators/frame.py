"""Frame cleaning: fillna (F13), dropna (F14), drop (F15), replace (F16), map.

Row order has no meaning in a DataFrame, so every order-dependent option takes
an explicit ``order_by`` column (and optionally ``partition_by``).

Forward/backward fill is a *segmented scan* that stays parallel when one partition key
holds a large share of the rows: rows are range-partitioned by (partition, order key), every
partition is a chunk and is filled locally with a window, and the value that enters a chunk
from earlier chunks comes from a one-row-per-chunk summary table.  Chunks follow the rows, so
sparse, dense, fractional and text order keys cost the same; equal keys are ordered by a hash
of the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.tables import col
from .base import replace_columns


def _positions(df: DataFrame, order_by: str, partition_by: str | None, backward: bool, chunks: int | None) -> DataFrame:
    """``df`` with _p (partition), _k (chunk) and _o (position); fixed by a checkpoint."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = F.coalesce(F.concat(F.lit("="), col(partition_by).cast("string")), F.lit("null")) if partition_by else F.lit("")
    o = col(order_by).desc_nulls_last() if backward else col(order_by).asc_nulls_first()
    plain = [col(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"]
    keys = [F.col("_p").asc(), o, F.xxhash64(*plain).asc()]
    ranked = df.withColumn("_p", p).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return reliable_checkpoint(ranked.select("*", F.spark_partition_id().alias("_k"),
                                             F.monotonically_increasing_id().alias("_o")))


def _scan_fill(df: DataFrame, cols: Sequence[str], order_by: str, partition_by: str | None,
               limit: int | None, backward: bool, chunks: int | None) -> DataFrame:
    base = _positions(df, order_by, partition_by, backward, chunks)
    # One row per (partition, chunk): last value, its position, trailing NULL count.  The positions of a partition's rows
    # in a chunk follow each other, so the number of a row is its distance from the first.
    summ_aggs = [F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first")]
    for j, c in enumerate(cols):
        v = col(c)
        summ_aggs += [
            F.max_by(v, F.when(v.isNotNull(), F.col("_o"))).alias(f"_cv{j}"),
            F.count(v).alias(f"_cn{j}"),
            (F.max(F.when(v.isNotNull(), F.col("_o"))) - F.min("_o") + 1).alias(f"_ci{j}"),
        ]
    summary = base.groupBy("_p", "_k").agg(*summ_aggs)
    wk = Window.partitionBy("_p").orderBy("_k")
    wk_prev = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary
    keep = ["_p", "_k", "_first"]
    for j in range(len(cols)):
        has = F.col(f"_cn{j}") > 0
        # NULLs after the last value of the chunk (the whole chunk when it has none)
        contrib = F.when(has, F.col("_n") - F.col(f"_ci{j}")).otherwise(F.col("_n"))
        carry = (carry
                 .withColumn(f"_in{j}", F.last(F.col(f"_cv{j}"), ignorenulls=True).over(wk_prev))
                 .withColumn(f"_g{j}", F.count(F.when(has, 1)).over(wk.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn(f"_c{j}", contrib))
        wg = Window.partitionBy("_p", f"_g{j}").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
        carry = carry.withColumn(f"_s{j}", F.sum(f"_c{j}").over(wg))
        carry = carry.withColumn(f"_gap{j}", F.lag(f"_s{j}").over(wk))
        keep += [f"_in{j}", f"_gap{j}"]
    carry = carry.select(*keep)

    if partition_by is None:  # a row a chunk
        carry = F.broadcast(carry)
    joined = base.join(carry, ["_p", "_k"], "left").withColumn("_i", F.col("_o") - F.col("_first") + 1)
    w_run = Window.partitionBy("_p", "_k").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumns({f"_at{j}": F.last(F.when(col(c).isNotNull(), F.struct(col(c).alias("v"), F.col("_i").alias(
        "i"))), ignorenulls=True).over(w_run) for j, c in enumerate(cols)})
    new: dict[str, Column] = {}
    for j, c in enumerate(cols):
        v = col(c)
        inside = F.col(f"_at{j}.v")
        gap_inside = F.col("_i") - F.col(f"_at{j}.i")
        gap_carry = F.coalesce(F.col(f"_gap{j}"), F.lit(0)) + F.col("_i")
        if limit is None:
            filled = F.when(v.isNotNull(), v).when(inside.isNotNull(), inside).otherwise(F.col(f"_in{j}"))
        else:
            filled = (F.when(v.isNotNull(), v)
                      .when(inside.isNotNull(), F.when(gap_inside <= limit, inside))
                      .otherwise(F.when(gap_carry <= limit, F.col(f"_in{j}"))))
        new[c] = filled
    out = replace_columns(joined, new)
    return out.select(*df.columns)


def _fill_first_n(df: DataFrame, value, limit: int, order_by: str, partition_by: str | None, cols: Sequence[str],
                  chunks: int | None) -> DataFrame:
    """Fill only the first ``limit`` NULLs of each column (per partition) in ``order_by`` order.

    The cut-off is the ``limit``-th position among NULL rows: first the
    ``limit`` first positions of every chunk (a window over one chunk), then the first
    ``limit`` of those per group, so no window ever holds a whole group.
    """
    values = dict(value) if isinstance(value, Mapping) else {c: value for c in cols}
    targets = [c for c in cols if c in values and c not in (order_by, partition_by)]
    base = _positions(df, order_by, partition_by, False, chunks)
    cut_cols, cuts = [], {}
    for j, c in enumerate(targets):
        nulls = base.filter(col(c).isNull()).select("_p", "_k", "_o")
        w_chunk = Window.partitionBy("_p", "_k").orderBy("_o")
        head = nulls.withColumn("_r", F.row_number().over(w_chunk)).filter(F.col("_r") <= limit)
        w_group = Window.partitionBy("_p").orderBy("_o")  # at most limit rows per chunk of the group
        cut = (head.select("_p", "_o").withColumn("_r", F.row_number().over(w_group)).filter(F.col("_r") <= limit)
               .groupBy("_p").agg(F.max("_o").alias(f"_cut{j}")))
        if partition_by is None:  # one number: a join by the only group would bring all rows into one task
            row = cut.first()
            cuts[j] = F.lit(None if row is None else row[f"_cut{j}"]).cast("long")
        else:
            cuts[j] = F.col(f"_cut{j}")
            cut_cols.append(cut)
    out = base
    for cut in cut_cols:
        out = out.join(cut, "_p", "left")
    new = {}
    for j, c in enumerate(targets):
        fill = F.lit(values[c])
        new[c] = F.when(col(c).isNull() & (F.col("_o") <= cuts[j]), fill).otherwise(col(c))
    return replace_columns(out, new).select(*df.columns)


def fillna(df: DataFrame, value=None, method: str | None = None, axis: int = 0, limit: int | None = None,
           order_by: str | None = None, partition_by: str | None = None, subset: Sequence[str] | None = None,
           chunks: int | None = None, inplace: bool = False) -> DataFrame:
    cols = list(subset) if subset is not None else list(df.columns)
    if method is None:
        if value is None:
            raise ValueError("must specify a fill value or method")
        if limit is not None:
            if order_by is None:
                raise ValueError("value fill with a limit needs order_by")
            return _fill_first_n(df, value, limit, order_by, partition_by, cols, chunks)
        if axis in (1, "columns"):
            raise NotImplementedError("value fill along columns equals axis=0 for scalars")
        if isinstance(value, Mapping):
            return df.na.fill(dict(value))
        return df.na.fill(value, subset=cols)
    if method in ("ffill", "pad", "bfill", "backfill"):
        backward = method in ("bfill", "backfill")
        if axis in (1, "columns"):
            order = list(reversed(cols)) if backward else cols
            new = {}
            for i, c in enumerate(order):
                prev = order[max(0, i - limit):i] if limit is not None else order[:i]
                new[c] = F.coalesce(col(c), *[col(x) for x in reversed(prev)]) if prev else col(c)
            return replace_columns(df, new)
        if order_by is None:
            raise ValueError("ffill/bfill need order_by")
        cols = [c for c in cols if c not in (order_by, partition_by)]
        return _scan_fill(df, cols, order_by, partition_by, limit, backward, chunks)
    raise ValueError(f"unknown method {method}")


def dropna(df: DataFrame, axis: int = 0, how: str = "any", thresh: int | None = None,
           subset: Sequence[str] | None = None, inplace: bool = False, ignore_index: bool = False) -> DataFrame:
    if how not in ("any", "all"):
        raise ValueError(f"invalid how {how}")
    if axis in (0, "index"):
        if thresh is not None:
            return df.na.drop(thresh=thresh, subset=list(subset) if subset else None)
        return df.na.drop(how=how, subset=list(subset) if subset else None)
    # axis=1: one aggregate counts the non-NULL cells of every column
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = row["_n"]
    keep = []
    for i, c in enumerate(df.columns):
        nn = row[f"c{i}"]
        if thresh is not None:
            ok = nn >= thresh
        elif how == "any":
            ok = nn == n
        else:
            ok = nn > 0 or n == 0
        if ok:
            keep.append(c)
    return df.select(*[col(c) for c in keep])


def drop(df: DataFrame, labels=None, axis: int = 0, index=None, columns=None, level=None,
         id_col: str | None = None, inplace: bool = False, errors: str = "raise") -> DataFrame:
    """Drop columns (axis=1 / columns=) or rows by label (axis=0 / index=) via an anti join."""
    if level is not None:
        raise NotImplementedError("DataFrames have no multi-index levels")
    if columns is not None or axis in (1, "columns"):
        names = columns if columns is not None else labels
        names = [names] if isinstance(names, str) else list(names)
        if errors == "raise":
            missing = [c for c in names if c not in df.columns]
            if missing:
                raise KeyError(f"{missing} not found in axis")
        return df.drop(*names)
    rows = index if index is not None else labels
    if id_col is None:
        raise ValueError("row drop needs id_col")
    if isinstance(rows, DataFrame):
        keys = rows.select(F.col(rows.columns[0]).alias(id_col)).distinct()
        return df.join(keys, id_col, "left_anti")
    rows = [rows] if not isinstance(rows, (list, tuple, set)) else list(rows)
    return df.filter(~col(id_col).isin(rows))


def replace(df: DataFrame, to_replace=None, value=None, regex: bool = False, subset: Sequence[str] | None = None,
            method: str | None = None, order_by: str | None = None, partition_by: str | None = None,
            limit: int | None = None, inplace: bool = False) -> DataFrame:
    cols = list(subset) if subset is not None else list(df.columns)
    if regex:
        string_cols = [c for c in cols if df.schema[c].dataType.simpleString() == "string"]
        pairs = to_replace.items() if isinstance(to_replace, Mapping) else [(to_replace, value)]
        new = {}
        for c in string_cols:
            e = col(c)
            for pat, rep in pairs:
                e = F.regexp_replace(e, pat, rep)
            new[c] = e
        return replace_columns(df, new)
    if value is None and method is not None:
        # deprecated pad/bfill form: a match takes the value of the last row that does not match (a NULL is
        # such a value and stays), a match without one keeps its own
        targets = to_replace if isinstance(to_replace, (list, tuple)) else [to_replace]
        names = [c for c in cols if c not in (order_by, partition_by)]
        hit = {c: F.coalesce(col(c).isin(targets), F.lit(False)) for c in names}
        wrapped = replace_columns(df, {c: F.when(~hit[c], F.struct(col(c).alias("v"))) for c in names},
                                  append=[(f"_own{i}", col(c)) for i, c in enumerate(names)])
        filled = fillna(wrapped, method="bfill" if method in ("bfill", "backfill") else "ffill", order_by=order_by,
                        partition_by=partition_by, limit=limit, subset=names)
        return replace_columns(filled, {c: F.when(col(c).isNotNull(), col(c)["v"]).otherwise(F.col(f"_own{i}"))
                                        for i, c in enumerate(names)}, drop=[f"_own{i}" for i in range(len(names))])
    if isinstance(to_replace, Mapping) and value is None:
        return df.na.replace(dict(to_replace), subset=cols)
    return df.na.replace(to_replace, value, subset=cols)


def map_values(df: DataFrame, column: str, arg, na_action: str | None = None, key_col: str = "key",
               value_col: str = "value", broadcast_rows: int = 100_000) -> DataFrame:
    """pandas ``Series.map``: dict, mapping DataFrame ("Series", its keys unique) or Column function; unmapped -> NULL."""
    c = col(column)
    if callable(arg) and not isinstance(arg, (DataFrame, Mapping)):
        e = arg(c)
        if na_action == "ignore":
            e = F.when(c.isNotNull(), e)
        return replace_columns(df, {column: e})
    if isinstance(arg, Mapping):
        if not arg:
            return replace_columns(df, {column: F.lit(None)})
        m = F.create_map(*[F.lit(x) for kv in arg.items() for x in kv])
        return replace_columns(df, {column: F.when(c.isNotNull(), F.element_at(m, c))})
    if isinstance(arg, DataFrame):
        size = arg.groupBy(F.col(key_col)).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.max(
            F.when(F.col(key_col).isNotNull(), F.col("c"))).alias("most")).first()
        if (size["most"] or 0) > 1:
            raise ValueError(f"keys of the mapping repeat: {column} cannot be mapped to one value")
        n = size["n"] or 0
        mapping = arg.select(F.col(key_col).alias("_mk"), F.col(value_col).alias("_mv"))
        if n <= broadcast_rows:
            mapping = F.broadcast(mapping)
        j = df.join(mapping, c == F.col("_mk"), "left")
        return replace_columns(j, {column: F.col("_mv")}).drop("_mk", "_mv")
    raise TypeError(f"unsupported map argument {type(arg)}")
