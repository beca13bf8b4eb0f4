"""Pipeline-corpus scan (S2): notebooks -> one row per code cell.

``load_cells`` reads every ``*.ipynb`` under a folder (recursively) as whole-text
files, parses the JSON with ``from_json`` and explodes the cells in order.  The
``source`` of a cell may be a string or a list of lines; both become one string.
``fx_cells`` derives a deterministic code-cell table from the ``part`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

NOTEBOOK_SCHEMA = "struct<cells: array<struct<cell_type: string, source: string, outputs: array<string>>>>"
#: the same cells with sources as lists of lines: a source that is one string reads as NULL
LINES_SCHEMA = "struct<cells: array<struct<source: array<string>>>>"


def load_cells(spark: SparkSession, path: str, code_only: bool = True) -> DataFrame:
    """One row per cell: notebook (path below the folder, so equal file names stay apart), name (the file's),
    path, cell_index, cell_type, source, outputs."""
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.ipynb").text(path)
           .select(F.input_file_name().alias("path"), F.col("value")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    root = path.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    below = F.when(F.instr("path", root) > 0, F.substring_index("path", root, -1)).otherwise(F.col("path"))
    nb = raw.select(below.alias("notebook"), name.alias("name"), "path",
                    F.arrays_zip(F.from_json("value", NOTEBOOK_SCHEMA)["cells"].alias("cell"),
                                 F.from_json("value", LINES_SCHEMA)["cells"].alias("lines")).alias("cells"))
    cells = nb.select("notebook", "name", "path", F.posexplode("cells").alias("cell_index", "c"))
    out = cells.select("notebook", "name", "path", F.col("cell_index").cast("long").alias("cell_index"),
                       F.col("c.cell.cell_type").alias("cell_type"),
                       F.coalesce(F.array_join("c.lines.source", ""), F.col("c.cell.source")).alias("source"),
                       F.col("c.cell.outputs").alias("outputs"))
    return out.filter(F.col("cell_type") == "code") if code_only else out


# The second line of each generated cell, chosen by p_partkey % 8.
CELL_VARIANTS = (
    "n = {size}",
    "m = LogisticRegression(C=n)",
    "m.score(X, y)",
    "accuracy_score(y, p)",
    "StandardScaler(with_mean=False)",
    "df.fillna(value=0)",
    "df.fillna(value=X_test)",
    "def broken(:",
)


def fx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code cells from ``part``: notebook = partkey % 50, cell order = partkey.

    Line 1 drops the column named by ``p_brand`` (size % 3 = 0) or assigns it
    (``df["<brand>"] = df["a"] + <size>``); line 2 is a variant by partkey % 8; every
    cell with partkey % 16 = 5 starts with a magic line.
    """
    p = read_table(spark, sf_dir, "part")
    k, size, brand = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_brand")
    line1 = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('df = df.drop(columns=["'), brand, F.lit('"])'))) \
        .otherwise(F.concat(F.lit('df["'), brand, F.lit('"] = df["a"] + '), size))
    variant = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(CELL_VARIANTS))):
        text = F.concat(F.lit(v.split("{size}")[0]), size) if "{size}" in v else F.lit(v)
        variant = F.when(k % 8 == i, text).otherwise(variant)
    magic = F.when(k % 16 == 5, F.lit("%matplotlib inline\n")).otherwise(F.lit(""))
    return p.select(F.concat(F.lit("nb"), (k % 50).cast("string"), F.lit(".ipynb")).alias("notebook"),
                    k.alias("cell_index"), F.concat(magic, line1, F.lit("\n"), variant).alias("source"))


def fx_cells_sql() -> str:
    cases = " ".join(
        f"when {i} then " + (f"'{v.split('{size}')[0]}' || cast(p_size as varchar)" if "{size}" in v else f"'{v}'")
        for i, v in enumerate(CELL_VARIANTS))
    return f"""
cells as (
  select 'nb' || cast(p_partkey % 50 as varchar) || '.ipynb' notebook, p_partkey cell_index, p_partkey, p_size,
         p_brand, p_partkey % 8 variant, p_size % 3 = 0 is_drop,
         case when p_partkey % 16 = 5 then '%matplotlib inline' || chr(10) else '' end
         || case when p_size % 3 = 0 then 'df = df.drop(columns=["' || p_brand || '"])'
                 else 'df["' || p_brand || '"] = df["a"] + ' || cast(p_size as varchar) end
         || chr(10) || case p_partkey % 8 {cases} end source
  from part)
"""


# Variable names of the generated data-loading cells, chosen by p_size % 3.
TRAIN_NAMES = ("train", "df_train", "train_df")
TEST_NAMES = ("test", "df_test", "test_df")


def fx_cells_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-loading / split / fit / evaluate cells from ``part`` (notebook = partkey % 40, 6 kinds by partkey % 6)."""
    p = read_table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    tr = F.element_at(F.array(*[F.lit(n) for n in TRAIN_NAMES]), (F.col("p_size") % 3 + 1).cast("int"))
    te = F.element_at(F.array(*[F.lit(n) for n in TEST_NAMES]), (F.col("p_size") % 3 + 1).cast("int"))
    kind = k % 6
    src = (F.when(kind == 0, F.concat(tr, F.lit(' = pd.read_csv("'), F.col("p_brand"), F.lit('.csv")')))
           .when(kind == 1, F.concat(te, F.lit(' = pd.read_csv("'), F.col("p_type"), F.lit('.csv")')))
           .when(kind == 2, F.concat(F.lit("X_tr"), size, F.lit(", X_te"), size, F.lit(", y_tr"), size,
                                     F.lit(", y_te"), size, F.lit(" = train_test_split(X, y, test_size=0.2)")))
           .when(kind == 3, F.concat(F.lit("reg"), size, F.lit(" = RandomForestRegressor(n_estimators="), size,
                                     F.lit(")")))
           .when(kind == 4, F.concat(F.lit("reg"), (F.col("p_size") % 5).cast("string"), F.lit(".fit(X, y)")))
           .otherwise(F.lit("print(r2_score(y, p))")))
    return p.select(F.concat(F.lit("io"), (k % 40).cast("string"), F.lit(".ipynb")).alias("notebook"),
                    k.alias("cell_index"), src.alias("source"))


def fx_cells_io_sql() -> str:
    tr = "[" + ", ".join(f"'{n}'" for n in TRAIN_NAMES) + "][p_size % 3 + 1]"
    te = "[" + ", ".join(f"'{n}'" for n in TEST_NAMES) + "][p_size % 3 + 1]"
    s = "cast(p_size as varchar)"
    return f"""
cio as (select 'io' || cast(p_partkey % 40 as varchar) || '.ipynb' notebook, p_partkey cell_index,
  case p_partkey % 6
    when 0 then {tr} || ' = pd.read_csv("' || p_brand || '.csv")'
    when 1 then {te} || ' = pd.read_csv("' || p_type || '.csv")'
    when 2 then 'X_tr' || {s} || ', X_te' || {s} || ', y_tr' || {s} || ', y_te' || {s}
                || ' = train_test_split(X, y, test_size=0.2)'
    when 3 then 'reg' || {s} || ' = RandomForestRegressor(n_estimators=' || {s} || ')'
    when 4 then 'reg' || cast(p_size % 5 as varchar) || '.fit(X, y)'
    else 'print(r2_score(y, p))' end source
  from part)
"""


def fx_cells_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keras-style cells from ``part`` (notebook = partkey % 30, 5 kinds by partkey % 5)."""
    p = read_table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = k % 5
    src = (F.when(kind == 0, F.concat(F.lit("model = Sequential([Dense("), size, F.lit(", activation='relu')])")))
           .when(kind == 1, F.concat(F.lit("model.add(Dense("), (F.col("p_size") % 7 + 1).cast("string"), F.lit("))")))
           .when(kind == 2, F.lit("model.compile(optimizer='adam', metrics=['accuracy'])"))
           .when(kind == 3, F.concat(F.lit("history = model.fit(X, y, epochs="), (F.col("p_size") % 5 + 1)
                                     .cast("string"), F.lit(")")))
           .otherwise(F.lit("model.add(Dropout(0.5))")))
    return p.select(F.concat(F.lit("nn"), (k % 30).cast("string"), F.lit(".ipynb")).alias("notebook"),
                    k.alias("cell_index"), src.alias("source"), kind.alias("kind"), F.col("p_size"))


FX_CELLS_NN_SQL = """
cnn as (select 'nn' || cast(p_partkey % 30 as varchar) || '.ipynb' notebook, p_partkey cell_index,
  p_partkey % 5 kind, p_size from part)
"""


def fx_cells_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose models, layers and compile calls are given names (notebook = partkey % 25, 7 kinds by partkey % 7)."""
    p = read_table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = k % 7
    src = (F.when(kind == 0, F.concat(F.lit("n = "), size))
           .when(kind == 1, F.lit("k = n"))
           .when(kind == 2, F.concat(F.lit("act = 'a"), (F.col("p_size") % 4).cast("string"), F.lit("'")))
           .when(kind == 3, F.lit("model = Sequential()"))
           .when(kind == 4, F.lit("model.add(Dense(n, activation=act))"))
           .when(kind == 5, F.lit("m = LogisticRegression(j, n, C=k)"))
           .otherwise(F.lit("j = k\nmodel.compile(optimizer=act, metrics=[act, 'mae'])")))
    return p.select(F.concat(F.lit("rf"), (k % 25).cast("string"), F.lit(".ipynb")).alias("notebook"),
                    k.alias("cell_index"), src.alias("source"))


def fx_cells_refs_sql() -> str:
    return """
crf as (select 'rf' || cast(p_partkey % 25 as varchar) || '.ipynb' notebook, p_partkey cell_index,
  p_partkey % 7 kind, p_size from part)
"""


def fx_cells_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading cells from ``part`` (notebook = partkey % 140, 3 kinds by partkey % 3); some tables have usual names
    only by a second assignment."""
    p = read_table(spark, sf_dir, "part")
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 3
    read = F.concat(F.lit(' = pd.read_csv("'), F.col("p_type"), F.lit('.csv")'))
    src = (F.when(kind == 0, F.concat(F.lit('my_train = pd.read_csv("'), F.col("p_brand"), F.lit('.csv")')))
           .when(kind == 2, F.lit("test = my_train"))
           .when(F.col("p_size") % 3 == 0, F.concat(F.lit("raw"), read, F.lit("\ndf_test = raw")))
           .when(F.col("p_size") % 3 == 1, F.concat(F.lit("raw"), read, F.lit("\nX_train = raw")))
           .otherwise(F.concat(F.lit("my_test"), read)))
    return p.select(F.concat(F.lit("ld"), (k % 140).cast("string"), F.lit(".ipynb")).alias("notebook"),
                    k.alias("cell_index"), src.alias("source"))


def fx_cells_load_sql() -> str:
    return """
cld as (select 'ld' || cast(p_partkey % 140 as varchar) || '.ipynb' notebook, p_partkey cell_index,
  p_partkey % 3 kind, p_size, p_brand, p_type from part)
"""
