"""Output-text functions as Column expressions: metric-line filter (P8), last
matching line per metric (W4) and free-text metric extraction (X5).

Values are read with ``[0-9.]+`` like the patterns they mirror and go through
``try_cast``, so ``.`` or ``0.9.1`` become NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a metric line.
METRIC_WORDS = ("accuracy", "precision", "recall", "f1", "roc_auc", "loss", "score")
# Per scoring method, the pattern of a line that reports it.
BEST_LINE_PATTERNS = {
    "accuracy_score": r"(accuracy|acc)[\s:=]+[0-9]*\.?[0-9]+",
    "precision_score": r"(precision)[\s:=]+[0-9]*\.?[0-9]+",
    "recall_score": r"(recall)[\s:=]+[0-9]*\.?[0-9]+",
    "f1_score": r"(f1[\s_-]*score)[\s:=]+[0-9]*\.?[0-9]+",
    "score": r"(score)[\s:=]+[0-9]*\.?[0-9]+",
    "classification_report": r"classification\s*report",
}
FLOAT_LINE = r"\d\.\d{2,}"
# Free-text patterns and model prefixes of R2 lines.
VALIDATION_ACCURACY = r"(?i)Validation Accuracy:?\s*([0-9.]+)"
OOB_SCORE = r"(?i)oob score:?\s*([0-9.]+)"
RMSE = r"(?i)rmse\s*(?::|=)\s*([0-9.]+)"
R2_TRAIN = r"(?i)R2 Train Score:?\s*([0-9.]+)"
R2_TEST = r"(?i)R2 Test Score:?\s*([0-9.]+)"
R2_PREFIXES = ("svr", "rf", "lr", "xgb")


def is_metric_line(line: Column) -> Column:
    low = F.lower(line)
    cond = F.lit(False)
    for w in METRIC_WORDS:
        cond = cond | low.contains(w)
    return cond


def output_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Split output text into (keys..., line_no, line)."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def last_matching_line(lines: DataFrame, keys: list[str], method: str) -> DataFrame:
    """The last line (by line order) that reports ``method``; ``None`` method -> last float line."""
    pat = FLOAT_LINE if method is None else "(?i)" + BEST_LINE_PATTERNS[method]
    hit = lines.filter(F.col("line").rlike(pat))
    return hit.groupBy(*keys).agg(F.max_by(F.trim("line"), F.col("line_no")).alias("line"))


def free_text_metrics(text: Column) -> Column:
    """struct(validation_accuracy, oob_score, rmse, r2_train, r2_train_model, r2_test, r2_test_model)."""
    def num(p):
        return F.regexp_extract(text, p, 1)

    low = F.lower(text)

    def model_for(kind):
        m = F.lit("model")
        for pre in reversed(R2_PREFIXES):
            m = F.when(low.contains(f"r2_{pre}_{kind}"), F.lit(pre)).otherwise(m)
        return m

    has = lambda p: text.rlike(p)
    return F.struct(
        F.when(has(VALIDATION_ACCURACY), num(VALIDATION_ACCURACY)).alias("validation_accuracy"),
        F.when(has(OOB_SCORE), num(OOB_SCORE)).alias("oob_score"),
        F.when(has(RMSE), num(RMSE)).alias("rmse"),
        F.when(has(R2_TRAIN), num(R2_TRAIN)).alias("r2_train"),
        F.when(has(R2_TRAIN), model_for("train")).alias("r2_train_model"),
        F.when(has(R2_TEST), num(R2_TEST)).alias("r2_test"),
        F.when(has(R2_TEST), model_for("test")).alias("r2_test_model"),
    )


def to_double(c: Column) -> Column:
    """Text -> double, NULL when it is not a number."""
    return c.try_cast("double")
