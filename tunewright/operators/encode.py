"""Categorical encoders (F5 OneHotEncoder, F6 OrdinalEncoder, F18 get_dummies,
F19 LabelEncoder) and the shared dense-code builder.

Wide encoders (one-hot, dummies) turn categories into columns while a column has at most
``max_columns`` of them; beyond that nothing is collected and the column becomes the same
row in sparse form, ``struct(size, index)`` (index NULL: no category set).  Code encoders (ordinal, label,
first-seen) never collect values: the distinct values get dense codes through a
range-partitioned sort with per-partition offsets, and rows are coded by a join
that is broadcast only when the counted size of the code table allows it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..session import reliable_checkpoint

from ..sources.tables import col
from .base import Model, replace_columns

BROADCAST_CODES = 1_000_000  # code tables up to this many rows are broadcast


def dense_codes(values: DataFrame, value_col: str, order_cols: Sequence[str] | None = None,
                num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Give each row of ``values`` (one row per distinct value) a 0-based code in sort order.

    Range partitioning splits the sort over all tasks; the offset of every partition is the
    row count of the partitions before it (one small number per partition).  The coded
    table is checkpointed to the shared checkpoint folder so codes stay fixed on recompute.
    """
    order_cols = list(order_cols or [value_col])
    spark = values.sparkSession
    n_parts = num_partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = (values.repartitionByRange(n_parts, *[col(c) for c in order_cols])
              .sortWithinPartitions(*[col(c) for c in order_cols])
              .select("*", F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid")))
    ranked = reliable_checkpoint(ranked)
    sizes = sorted((r["_pid"], r["n"]) for r in ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for pid, n in sizes:
        offsets.append((pid, total))
        total += n
    # one row per partition: a table of a bounded size, joined once
    off = F.broadcast(spark.createDataFrame(offsets, "_pid int, _off long"))
    code = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    coded = ranked.join(off, "_pid").select(*[col(c) for c in values.columns], code.cast("long").alias("code"))
    return coded, total


def join_codes(df: DataFrame, column: str, codes: DataFrame, n_codes: int, out: str | None = None,
               default: Column | None = None) -> DataFrame:
    """Replace ``column`` by its code; broadcast the code table only below the checked size."""
    m = codes.select(col(column).alias("_ck"), F.col("code").alias("_cv"))
    if n_codes <= BROADCAST_CODES:
        m = F.broadcast(m)
    j = df.join(m, col(column).eqNullSafe(F.col("_ck")), "left")
    e = F.col("_cv") if default is None else F.coalesce(F.col("_cv"), default)
    name = out or column
    res = replace_columns(j, {column: e} if name == column else {}, append=[] if name == column else [(name, e)])
    return res.drop("_ck", "_cv")


def sparse_onehot(df: DataFrame, column: str, codes: DataFrame, n_codes: int, shift: int = 0) -> DataFrame:
    """Replace ``column`` by its one-hot row in sparse form; ``shift`` leading categories are dropped."""
    coded = join_codes(df, column, codes, n_codes)
    index = F.when(col(column) >= shift, col(column) - shift)
    return replace_columns(coded, {column: F.struct(F.lit(n_codes - shift).cast("long").alias("size"),
                                                    index.cast("long").alias("index"))})


def _categories(df: DataFrame, column: str, max_columns: int, with_counts: bool = False):
    """The sorted categories, or None if there are more than ``max_columns``."""
    rows = (df.groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("v").asc_nulls_last()).limit(max_columns + 1).collect())
    if len(rows) > max_columns:
        return None
    return [(r["v"], r["n"]) for r in rows] if with_counts else [r["v"] for r in rows]


def _name(v) -> str:
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    return str(v)


@dataclass
class OneHotEncoder:
    categories: str | dict = "auto"
    drop: str | None = None
    handle_unknown: str = "error"
    min_frequency: int | float | None = None
    max_categories: int | None = None
    feature_name_combiner: str = "concat"
    sparse_output: bool = True  # wide double columns are produced either way
    dtype: str = "double"
    max_columns: int = 1000

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "OneHotModel":
        n_rows = None
        per_col: dict[str, tuple[list, list]] = {}
        sparse: dict[str, tuple[DataFrame, int]] = {}
        for c in cols:
            if isinstance(self.categories, dict):
                cats = [(v, None) for v in self.categories[c]]
            else:
                cats = _categories(df, c, self.max_columns, with_counts=True)
            if cats is None:
                sparse[c] = self._code_table(df, c)
                continue
            frequent, infrequent = [v for v, _ in cats], []
            if self.min_frequency is not None or self.max_categories is not None:
                if n_rows is None:
                    n_rows = sum(n for _, n in cats) if cats and cats[0][1] is not None else df.count()
                thr = self.min_frequency
                if isinstance(thr, float) and thr < 1:
                    thr = thr * n_rows
                keep = [(v, n) for v, n in cats if thr is None or n >= thr]
                if self.max_categories is not None and len(keep) > self.max_categories - 1:
                    keep = sorted(keep, key=lambda t: (-t[1], frequent.index(t[0])))[: self.max_categories - 1]
                kept = {v for v, _ in keep}
                infrequent = [v for v in frequent if v not in kept]
                frequent = [v for v in frequent if v in kept]
            per_col[c] = (frequent, infrequent)
        return OneHotModel(list(cols), per_col, self.drop, self.handle_unknown, self.dtype, sparse)

    def _code_table(self, df: DataFrame, c: str) -> tuple[DataFrame, int]:
        """Codes of a column with many categories; infrequent ones share the last code."""
        counts = df.groupBy(col(c)).agg(F.count(F.lit(1)).alias("_n"))
        thr = self.min_frequency or 0
        if isinstance(thr, float) and thr < 1:
            thr = thr * df.count()
        frequent = counts.filter(F.col("_n") >= thr)
        if self.max_categories is not None:
            frequent = frequent.orderBy(F.col("_n").desc(), col(c)).limit(self.max_categories - 1)
        codes, n = dense_codes(frequent.select(c), c)
        if not thr and self.max_categories is None:
            return codes, n
        rest = counts.join(codes, counts[c].eqNullSafe(codes[c]), "left_anti").select(c, F.lit(n).cast("long").alias("code"))
        return codes.unionByName(rest), n + (0 if rest.isEmpty() else 1)


@dataclass
class OneHotModel(Model):
    cols: list[str]
    per_col: dict[str, tuple[list, list]]
    drop: str | None = None
    handle_unknown: str = "error"
    dtype: str = "double"
    sparse: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def feature_names(self) -> dict[str, list[tuple[str, object]]]:
        out = {}
        for c in self.per_col:
            frequent, infrequent = self.per_col[c]
            names = [(f"{c}_{_name(v)}", ("eq", v)) for v in frequent]
            if infrequent:
                names.append((f"{c}_infrequent_sklearn", ("in", infrequent)))
            if self.drop == "first" or (self.drop == "if_binary" and len(names) == 2):
                names = names[1:]
            out[c] = names
        return out

    def check_unknown(self, df: DataFrame) -> None:
        for c, (codes, _) in self.sparse.items():
            if not df.join(codes, df[c].eqNullSafe(codes[c]), "left_anti").isEmpty():
                raise ValueError(f"Found unknown categories in column {c} during transform")
        for c in self.per_col:
            known = self.per_col[c][0] + self.per_col[c][1]
            bad = df.filter(~col(c).isin([v for v in known if v is not None]) &
                            ~(col(c).isNull() & F.lit(None in known))).limit(1).count()
            if bad:
                raise ValueError(f"Found unknown categories in column {c} during transform")

    def transform(self, df: DataFrame) -> DataFrame:
        if self.handle_unknown == "error":
            self.check_unknown(df)
        expand = {}
        for c, names in self.feature_names().items():
            items = []
            for name, (kind, v) in names:
                if kind == "eq":
                    cond = col(c).isNull() if v is None else col(c) == F.lit(v)
                else:
                    vals = [x for x in v if x is not None]
                    cond = col(c).isin(vals) if vals else F.lit(False)
                    if None in v:
                        cond = cond | col(c).isNull()
                items.append((name, F.when(cond, 1.0).otherwise(0.0).cast(self.dtype)))
            expand[c] = items
        for c, (codes, n) in self.sparse.items():
            df = sparse_onehot(df, c, codes, n, int(self.drop == "first"))
        return replace_columns(df, {}, expand=expand)


def get_dummies(df: DataFrame, columns: Sequence[str] | None = None, prefix: str | Sequence[str] | None = None,
                prefix_sep: str = "_", dummy_na: bool = False, drop_first: bool = False, sparse: bool = False,
                dtype: str = "boolean", max_columns: int = 1000) -> DataFrame:
    """pandas ``get_dummies``: sorted levels, columns appended after the kept ones."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "boolean")]
    columns = list(columns)
    if prefix is None:
        prefixes = columns
    elif isinstance(prefix, str):
        prefixes = [prefix] * len(columns)
    else:
        prefixes = list(prefix)
    append = []
    for c, p in zip(columns, prefixes):
        levels = _categories(df, c, max_columns)
        if levels is None:
            values = df.select(col(c)).distinct()
            codes, n = dense_codes(values if dummy_na else values.filter(col(c).isNotNull()), c, order_cols=None)
            df = sparse_onehot(df, c, codes, n, int(drop_first))
            append.append((p, col(c)))
            continue
        levels = [v for v in levels if v is not None]
        items = [(f"{p}{prefix_sep}{_name(v)}", col(c) == F.lit(v)) for v in levels]
        if dummy_na:
            items.append((f"{p}{prefix_sep}nan", col(c).isNull()))
        if drop_first:
            items = items[1:]
        append += [(n, F.coalesce(e, F.lit(False)).cast(dtype)) for n, e in items]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[col(c) for c in kept], *[e.alias(n) for n, e in append])


@dataclass
class OrdinalEncoder:
    categories: str | dict = "auto"
    handle_unknown: str = "error"
    unknown_value: int | None = None
    encoded_missing_value: float | None = None
    min_frequency: int | float | None = None
    max_categories: int | None = None
    dtype: str = "double"

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "CodeModel":
        if self.handle_unknown == "use_encoded_value" and self.unknown_value is None:
            self.unknown_value = None  # NULL stands for NaN
        tables = {}
        for c in cols:
            counts = df.filter(col(c).isNotNull()).groupBy(col(c)).agg(F.count(F.lit(1)).alias("_n"))
            if isinstance(self.categories, dict):
                allowed = counts.sparkSession.createDataFrame([(v,) for v in self.categories[c]], [c])
                counts = allowed.join(counts, c, "left").fillna(0, ["_n"])
            if self.min_frequency is not None or self.max_categories is not None:
                counts = reliable_checkpoint(counts)  # a row a category, read several times
                thr = self.min_frequency or 0
                if isinstance(thr, float) and thr < 1:
                    thr = thr * df.count()
                freq = counts.filter(F.col("_n") >= thr)
                if self.max_categories is not None:
                    top = freq.orderBy(F.col("_n").desc(), col(c)).limit(self.max_categories - 1)
                    freq = top
                coded, n = dense_codes(freq.select(c), c)
                infrequent = counts.join(freq.select(c), c, "left_anti").select(c, F.lit(n).cast("long").alias("code"))
                total = n + (1 if infrequent.limit(1).count() else 0)
                tables[c] = (coded.unionByName(infrequent), total)
            else:
                tables[c] = dense_codes(counts.select(c), c)
        return CodeModel(list(cols), tables, self.handle_unknown, self.unknown_value,
                         self.encoded_missing_value, self.dtype)


@dataclass
class CodeModel(Model):
    cols: list[str]
    tables: dict[str, tuple[DataFrame, int]]
    handle_unknown: str = "error"
    unknown_value: int | None = None
    encoded_missing_value: float | None = None
    dtype: str = "double"
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """NULL input becomes ``encoded_missing_value``; values outside the table ``unknown_value``."""
        out = df
        for c in self.cols:
            codes, n = self.tables[c]
            if self.handle_unknown == "error":
                known = codes.select(c)
                unknown = (out.filter(col(c).isNotNull()).select(c)
                           .join(F.broadcast(known) if n <= BROADCAST_CODES else known, c, "left_anti")
                           .limit(1).count())
                if unknown:
                    raise ValueError(f"Found unknown categories in column {c} during transform")
            m = codes.select(col(c).alias("_ck"), F.col("code").alias("_cv"))
            if n <= BROADCAST_CODES:
                m = F.broadcast(m)
            j = out.join(m, col(c) == F.col("_ck"), "left")
            e = (F.when(col(c).isNull(), F.lit(self.encoded_missing_value).cast(self.dtype))
                 .when(F.col("_cv").isNull(), F.lit(self.unknown_value).cast(self.dtype))
                 .otherwise(F.col("_cv").cast(self.dtype)))
            out = replace_columns(j, {c: e}).drop("_ck", "_cv")
        return out


@dataclass
class LabelEncoder:
    """Codes are ranks of the sorted distinct strings; ``fit`` may take several frames (union)."""

    def fit(self, frames: DataFrame | Sequence[DataFrame], column: str) -> "LabelModel":
        frames = [frames] if isinstance(frames, DataFrame) else list(frames)
        vals = None
        for f in frames:
            v = f.select(col(column).cast("string").alias(column)).filter(col(column).isNotNull())
            vals = v if vals is None else vals.unionByName(v)
        distinct = vals.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n")).select(column)
        codes, n = dense_codes(distinct, column)
        return LabelModel(column, codes, n)


@dataclass
class LabelModel(Model):
    column: str
    codes: DataFrame
    n: int

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.column
        src = replace_columns(df, {c: col(c).cast("string")})
        return join_codes(src, c, self.codes, self.n)


def first_seen_codes(frames: Sequence[tuple[DataFrame, str]], column: str, fill: str | None = "missing"
                     ) -> tuple[DataFrame, int]:
    """Code values by first appearance: frame order, then ``order_by`` inside each frame (A3)."""
    vals = None
    for side, (f, order_by) in enumerate(frames):
        v = col(column) if fill is None else F.coalesce(col(column), F.lit(fill))
        part = f.select(v.alias(column), F.lit(side).alias("_side"), col(order_by).alias("_ord"))
        vals = part if vals is None else vals.unionByName(part)
    first = vals.groupBy(column).agg(F.min(F.struct("_side", "_ord")).alias("_first"))
    first = first.select(column, F.col("_first._side").alias("_side"), F.col("_first._ord").alias("_ord"))
    coded, n = dense_codes(first, column, order_cols=["_side", "_ord"])
    return coded.select(column, "code"), n
