"""Model-record scan (S4): a JSON list of notebooks, or an object with key ``notebooks``,
-> one row per recorded model keyed by notebook stem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTEBOOK = ("struct<notebook: string, models: array<struct<type: string, "
            "parameters: struct<args: array<string>, kwargs: map<string, string>>, score: string>>>")


def file_stem(path) -> F.Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^.]*)?$", 1)


def load_model_records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", "true").text(path)
    as_list = F.from_json("value", f"array<{NOTEBOOK}>")
    as_obj = F.from_json("value", f"struct<notebooks: array<{NOTEBOOK}>>").getField("notebooks")
    # an object parsed with the list schema comes back as a one-element list, so test the object form first
    nbs = raw.select(F.explode(F.coalesce(as_obj, as_list)).alias("nb"))
    models = nbs.select(F.col("nb.notebook").alias("notebook"), F.posexplode("nb.models").alias("model_pos", "m"))
    return models.select(file_stem(F.col("notebook")).alias("stem"), "notebook", "model_pos",
                         F.col("m.type").alias("model_type"), F.col("m.parameters.args").alias("args"),
                         F.col("m.parameters.kwargs").alias("kwargs"), F.col("m.score").alias("score"))
