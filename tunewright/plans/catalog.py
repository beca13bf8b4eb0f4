"""Parameter catalog (S3), candidate typing (X2) and sweep expansion.

The catalog maps method -> parameter -> {allowed_values, default, ...}.  It is read
with ``from_json`` into ``map<string, map<string, struct<...>>>`` whose candidate
values are ``variant``s, then exploded to one row per candidate.  ``load_catalog``
reads a catalog file; ``catalog_rows`` parses the built-in copy below.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("map<string, map<string, struct<allowed_values: array<variant>, default: variant, "
                  "range: variant, type: string, note: string>>>")
# Same document with candidates as raw JSON text: keeps number spelling such as 0.0.
RAW_SCHEMA = "map<string, map<string, struct<allowed_values: array<string>>>>"
NO_PARAMS_MARKER = "No parameters required for initialization"
# Catalog strings that name a kind of argument rather than a value.
PLACEHOLDERS = ("scalar", "dict", "list", "type", "array", "str", "function", "Series")

# The candidate parameter catalog (19 methods, 75 parameters, 170 values).
CATALOG_JSON = """{
    "StandardScaler": {
        "copy": {"allowed_values": [true, false], "default": true},
        "with_mean": {"allowed_values": [true, false], "default": true},
        "with_std": {"allowed_values": [true, false], "default": true}
    },
    "MinMaxScaler": {
        "feature_range": {"allowed_values": [[0.0, 1.0], [-1.0, 1.0], [-100, 100]], "range": ["float", "float"], "default": [0.0, 1.0]},
        "copy": {"allowed_values": [true, false], "default": true},
        "clip": {"allowed_values": [true, false], "default": false}
    },
    "RobustScaler": {
        "with_centering": {"allowed_values": [true, false], "default": true},
        "with_scaling": {"allowed_values": [true, false], "default": true},
        "quantile_range": {"type": "tuple_of_numbers", "range": [0.0, 100.0], "default": [25.0, 75.0]},
        "copy": {"allowed_values": [true, false], "default": true},
        "unit_variance": {"allowed_values": [true, false], "default": false}
    },
    "Normalizer": {
        "norm": {"allowed_values": ["l1", "l2", "max"], "default": "l2"},
        "copy": {"allowed_values": [true, false], "default": true}
    },
    "OneHotEncoder": {
        "categories": {"allowed_values": ["auto", "list"], "default": "auto"},
        "drop": {"allowed_values": [null, "first", "if_binary"], "default": null},
        "sparse_output": {"allowed_values": [true, false], "default": true},
        "dtype": {"allowed_values": ["type"], "default": "np.float64"},
        "handle_unknown": {"allowed_values": ["error", "ignore"], "default": "error"},
        "min_frequency": {"allowed_values": [null, 1, 10], "range": ["int", "float", null], "default": null},
        "max_categories": {"allowed_values": [10], "range": ["int"], "default": null},
        "feature_name_combiner": {"allowed_values": ["concat"], "range": ["concat", "callable"], "default": "concat"}
    },
    "OrdinalEncoder": {
        "categories": {"allowed_values": ["auto", "list"], "default": "auto"},
        "dtype": {"allowed_values": ["type"], "default": "np.float64"},
        "handle_unknown": {"allowed_values": ["error", "use_encoded_value"], "default": "error"},
        "unknown_value": {"allowed_values": [null, -1, 0, 1], "default": null},
        "encoded_missing_value": {"allowed_values": ["Nan", 0], "default": "NaN"},
        "min_frequency": {"allowed_values": [null, 5], "default": null},
        "max_categories": {"allowed_values": [null, 10], "default": null}
    },
    "PolynomialFeatures": {
        "degree": {"allowed_values": [1, 10], "default": 2},
        "interaction_only": {"allowed_values": [true, false], "default": false},
        "include_bias": {"allowed_values": [true, false], "default": true},
        "order": {"allowed_values": ["C", "F"], "default": "C"}
    },
    "SimpleImputer": {
        "strategy": {"allowed_values": ["mean", "median", "most_frequent", "constant"], "default": "mean"},
        "fill_value": {"allowed_values": ["string", 0], "range": ["string", "float"], "default": null},
        "copy": {"allowed_values": [true, false], "default": true},
        "add_indicator": {"allowed_values": [true, false], "default": false},
        "keep_empty_features": {"allowed_values": [true, false], "default": false}
    },
    "SelectKBest": {
        "k": {"allowed_values": [1, 10, 100], "default": 10}
    },
    "VarianceThreshold": {
        "threshold": {"allowed_values": [0.0, 0.2], "default": 0.0}
    },
    "SelectFromModel": {
        "threshold": {"allowed_values": [null, "mean", "median", 0.0, 1.0], "default": null},
        "prefit": {"allowed_values": [true, false], "default": false},
        "norm_order": {"allowed_values": [1, "inf", "-inf"], "default": 1},
        "max_features": {"allowed_values": [null, 10, 100], "default": null}
    },
    "RFE": {
        "n_features_to_select": {"allowed_values": [null, 1, 100], "default": null},
        "step": {"allowed_values": [0.3, 0.7, 1, 2], "default": 1}
    },
    "fillna": {
        "value": {"allowed_values": [null, "scalar", "dict"], "default": null},
        "method": {"allowed_values": [null, "ffill", "bfill"], "default": null},
        "axis": {"allowed_values": [0, 1], "default": 0},
        "inplace": {"allowed_values": [true, false], "default": false},
        "limit": {"allowed_values": [null, 1, 100], "default": null}
    },
    "drop": {
        "labels": {"allowed_values": [null, "list", "array"], "default": null},
        "axis": {"allowed_values": [0, 1], "default": 0},
        "index": {"allowed_values": [null], "range": ["string", "list"], "default": null},
        "columns": {"allowed_values": [null], "range": ["string", "list"], "default": null},
        "level": {"allowed_values": [0], "range": ["int", "string"], "default": null},
        "inplace": {"allowed_values": [true, false], "default": false}
    },
    "dropna": {
        "axis": {"allowed_values": [0, 1], "default": 0},
        "how": {"allowed_values": ["any", "all"], "default": "any"},
        "thresh": {"allowed_values": [null, 1, 100], "default": null},
        "inplace": {"allowed_values": [true, false], "default": false},
        "ignore_index": {"allowed_values": [true, false], "default": false}
    },
    "replace": {
        "to_replace": {"allowed_values": [null, "scalar", "list", "dict"], "default": null},
        "value": {"allowed_values": [null, "scalar", "list", "dict"], "default": null},
        "inplace": {"allowed_values": [true, false], "default": false},
        "limit": {"allowed_values": [null, 1, 100], "default": null, "note": "deprecated"},
        "regex": {"allowed_values": [true, false], "default": false},
        "method": {"allowed_values": ["pad", "ffill", "bfill"], "default": "no default", "note": "deprecated"}
    },
    "map": {
        "arg": {"allowed_values": ["dict", "function", "Series"], "default": null},
        "na_action": {"allowed_values": [null, "ignore"], "default": null}
    },
    "get_dummies": {
        "prefix": {"allowed_values": [null, "str", "list"], "default": null},
        "prefix_sep": {"allowed_values": ["_", ","], "default": "_"},
        "dummy_na": {"allowed_values": [true, false], "default": false},
        "sparse": {"allowed_values": [true, false], "default": false},
        "drop_first": {"allowed_values": [true, false], "default": false}
    },
    "LabelEncoder": {
        "note": {"allowed_values": ["No parameters required for initialization"], "default": "No parameters required for initialization"}
    }
}"""


def catalog_dict() -> dict:
    return json.loads(CATALOG_JSON)


def parse_catalog(text_df: DataFrame, text_col: str = "value") -> DataFrame:
    """Rows (method, method_ord, param, param_ord, has_values, no_params, ord, value_json, value_type,
    value_text, default_json, is_placeholder); parameters without candidates keep one row with ord NULL."""
    raw = F.from_json(F.col(text_col), RAW_SCHEMA)
    cat = text_df.select(F.posexplode(F.from_json(F.col(text_col), CATALOG_SCHEMA)).alias("method_ord", "method", "params"),
                         raw.alias("raw"))
    par = cat.select("method_ord", "method", "raw",
                     F.posexplode("params").alias("param_ord", "param", "info"))
    raw_vals = F.col("raw")[F.col("method")][F.col("param")]["allowed_values"]
    vals = par.select("method", "method_ord", "param", "param_ord",
                      F.col("info.allowed_values").isNotNull().alias("has_values"),
                      F.to_json(F.col("info.default")).alias("default_json"),
                      F.posexplode_outer(F.arrays_zip(F.col("info.allowed_values").alias("v"),
                                                      raw_vals.alias("t"))).alias("ord", "z"))
    vals = vals.select("*", F.col("z.v").alias("v"), F.col("z.t").alias("t")).drop("z")
    vtype = F.when(F.col("v").isNotNull(), F.schema_of_variant(F.col("v")))
    vj = F.when(vtype.startswith("STRING"), F.to_json(F.col("v"))).otherwise(F.coalesce(F.col("t"), F.lit("null")))
    no_params = F.exists(F.coalesce(F.col("_all"), F.array().cast("array<string>")),
                         lambda x: x == F.lit(json.dumps(NO_PARAMS_MARKER)))
    out = vals.select("*", vj.alias("value_json"), vtype.alias("value_type"))
    allv = out.groupBy("method", "param").agg(F.collect_list("value_json").alias("_all"))  # per parameter: its few values
    out = out.join(allv, ["method", "param"]).withColumn("no_params", no_params).drop("_all", "v", "t", "raw")
    return out.select("method", "method_ord", "param", "param_ord", "has_values", "no_params",
                      F.col("ord").cast("int").alias("ord"), "value_json", "value_type",
                      python_text(F.col("value_json"), F.col("value_type")).alias("value_text"),
                      "default_json", is_placeholder(F.col("value_json"), F.col("value_type")).alias("is_placeholder"))


def python_text(value_json: Column, value_type: Column) -> Column:
    """How Python prints a candidate: True/False/None, strings bare, lists with ', '."""
    j = value_json
    unq = F.regexp_replace(F.regexp_replace(j, '^"', ""), '"$', "")
    lst = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(j, ",", ", "), "true", "True"),
                                            "false", "False"), "null", "None")
    return (F.when(j.isNull() | (j == "null"), F.lit("None"))
            .when(j == "true", F.lit("True")).when(j == "false", F.lit("False"))
            .when(value_type.startswith("STRING"), unq)
            .when(value_type.startswith("ARRAY"), F.regexp_replace(lst, '"', "'"))
            .otherwise(j))


def is_placeholder(value_json: Column, value_type: Column) -> Column:
    return F.coalesce(value_type.startswith("STRING") & F.regexp_replace(value_json, '"', "").isin(*PLACEHOLDERS),
                      F.lit(False))


def _scalar_literal(text: Column, kind: Column) -> Column:
    """Python source of a scalar: ``text`` its spelling (strings bare), ``kind`` its variant type."""
    word = F.lower(text)
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    string = (F.when(text.isin("inf", "-inf") | (word == "nan"), F.concat(F.lit("float('"), word, F.lit("')")))
              .when(text.startswith("np.") | (text.contains(".") & ~text.rlike("^['\"]")), text).otherwise(quoted))
    return (F.when(kind.isNull() | (kind == "VOID"), F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(text)).when(kind == "STRING", string).otherwise(text))


def typed_candidate(value_json: Column, param: Column) -> dict[str, Column]:
    """A candidate's JSON as typed columns, for the operator that takes it to read what it needs.

    ``variant`` the value itself; ``kind`` null, boolean, number, string, name (a dotted name such as a numpy type),
    list, tuple (of a range parameter) or map; ``number`` numbers and the words inf, -inf and nan; ``flag`` booleans;
    ``text`` strings; ``items`` the elements of lists and tuples; ``entries`` of maps; ``literal`` its Python source (of
    a map: the JSON).  Text that is no JSON is a null variant of kind invalid."""
    v = F.try_parse_json(value_json)
    t = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number_word = F.lower(text).isin("inf", "+inf", "-inf", "nan")
    items = F.when(t.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    raw = F.from_json(value_json, "array<string>")
    tuple_ = param.isin("feature_range", "quantile_range")
    named = (t == "STRING") & text.contains(".") & ~text.rlike("^['\"]")
    kind = (F.when(v.isNull() & value_json.isNull(), "null").when(v.isNull(), "invalid").when(t == "VOID", "null")
            .when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY") & tuple_, "tuple").when(t.startswith("ARRAY"), "list")
            .when(t.startswith("OBJECT"), "map").when((t == "STRING") & number_word, "number").when(named, "name")
            .when(t == "STRING", "string").otherwise("number"))
    parts = F.transform(F.arrays_zip(raw.alias("r"), items.alias("v")),
                        lambda x: _scalar_literal(x["r"], F.schema_of_variant(x["v"])))
    listed = F.array_join(parts, ", ")
    return {
        "variant": v, "kind": kind,
        "number": F.when(kind == "number", F.when((t == "STRING") & number_word, F.regexp_replace(
            F.regexp_replace(F.lower(text), r"^\+", ""), "inf", "Infinity").cast("double")).otherwise(
            F.try_variant_get(v, "$", "double"))),
        "flag": F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        "text": F.when(kind.isin("string", "name"), text),
        "items": items,
        "entries": F.when(t.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")),
        "literal": F.when(kind == "tuple", F.concat(F.lit("("), listed, F.lit(")")))
        .when(kind == "list", F.concat(F.lit("["), listed, F.lit("]"))).when(kind == "map", value_json)
        .when(kind != "invalid", _scalar_literal(F.when(t == "STRING", text).otherwise(value_json), t)),
    }


def catalog_rows(spark: SparkSession, text: str | None = None) -> DataFrame:
    return parse_catalog(spark.range(1).select(F.lit(text or CATALOG_JSON).alias("value")))


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S3: a catalog file (whole-text JSON) -> candidate rows."""
    return parse_catalog(spark.read.option("wholetext", "true").text(path))


def _py_text(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(_py_text(x) if not isinstance(x, str) else repr(x) for x in v) + "]"
    return str(v)


def _literal(v, param: str = "") -> str:
    if isinstance(v, str):
        if v in ("inf", "-inf") or v.lower() == "nan":
            return f"float('{v.lower()}')"
        return v if v.startswith("np.") or ("." in v and v[:1] not in "'\"") else f"'{v}'"
    if isinstance(v, list):
        inner = ", ".join(_literal(x) for x in v)
        return f"({inner})" if param in ("feature_range", "quantile_range") else f"[{inner}]"
    return str(v)


def typed_sql(name: str = "typed") -> str:
    """DuckDB twin of the typed columns of all candidates as a VALUES table."""
    rows = []
    for m, params in catalog_dict().items():
        for p, info in params.items():
            for o, v in enumerate(info.get("allowed_values") or []):
                word = isinstance(v, str) and v.lower() in ("inf", "-inf", "nan")
                kind = ("null" if v is None else "boolean" if isinstance(v, bool) else "number" if word or isinstance(
                    v, (int, float)) else "list" if isinstance(v, list) else "string")
                if kind == "list" and p in ("feature_range", "quantile_range"):
                    kind = "tuple"
                number = f"'{float(v)}'::DOUBLE" if kind == "number" else "null::DOUBLE"
                text = "'" + v.replace("'", "''") + "'" if kind == "string" else "null::VARCHAR"
                rows.append(f"('{m}', '{p}', {o}, '{kind}', {number}, {str(v).lower() if kind == 'boolean' else 'null::BOOLEAN'}, "
                            f"{text}, {len(v) if isinstance(v, list) else 'null::INT'}, '{_literal(v, p).replace(chr(39), chr(39) * 2)}')")
    return f"{name}(method, param, ord, kind, number, flag, text, n_items, literal) as (values {', '.join(rows)})"


def catalog_sql(name: str = "catalog") -> str:
    """DuckDB twin of ``catalog_rows`` as a VALUES table built from the same text."""
    rows = []
    cat = catalog_dict()
    for mo, (m, params) in enumerate(cat.items()):
        for po, (p, info) in enumerate(params.items()):
            vals = info.get("allowed_values")
            no_params = vals == [NO_PARAMS_MARKER]
            if vals is None:
                rows.append(f"('{m}', {mo}, '{p}', {po}, false, false, null, null, null)")
                continue
            for o, v in enumerate(vals):
                placeholder = isinstance(v, str) and v in PLACEHOLDERS
                text = _py_text(v).replace("'", "''")
                rows.append(f"('{m}', {mo}, '{p}', {po}, true, {str(no_params).lower()}, {o}, "
                            f"'{text}', {str(placeholder).lower()})")
    return (f"{name}(method, method_ord, param, param_ord, has_values, no_params, ord, value_text, is_placeholder) "
            f"as (values {', '.join(rows)})")
