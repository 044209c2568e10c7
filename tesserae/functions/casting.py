"""Types of loosely typed text: inference and failure-tolerant conversion, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that are booleans, and the forms that are dates.
TRUE, FALSE = ("true", "yes", "1", "t", "y"), ("false", "no", "0", "f", "n")
DATES = (r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\w+ \d{1,2},? \d{4}$", r"^\d{1,2} \w+ \d{4}$")


def infer_type(c: Column) -> Column:
    """boolean, number, date or string; the booleans come first, so 1 and 0 are boolean. Null for null or blank."""
    t = F.trim(c)
    number = F.regexp_replace(t, ",", "").try_cast("double").isNotNull()
    date = F.lit(False)
    for form in DATES:
        date = date | t.rlike(f"(?U){form}")
    return F.when(c.isNull() | (t == ""), None).when(F.lower(t).isin(*TRUE, *FALSE), "boolean").when(number, "number").when(date, "date").otherwise("string")


def coerce(c: Column, kind: str) -> Column:
    """The value as a number (double), boolean, or text; null where it can't be one."""
    t = F.trim(c)
    if kind == "number":
        return F.regexp_replace(t, ",", "").try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(t).isin(*TRUE), True).when(F.lower(t).isin(*FALSE), False)
    return c


def profile(df: DataFrame, share: float = 0.9) -> DataFrame:
    """(column, n, n_distinct, type) for each column, over all rows in one pass; a type holds if ``share`` of the filled
    values have it (number before date before boolean), else string."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns))).alias("x")).select("x.column", "x.value", infer_type(F.col("x.value")).alias("t"))
    counts = cells.groupBy("column").agg(F.count("t").alias("n"), F.count_distinct("value").alias("n_distinct"), *(F.count_if(F.col("t") == k).alias(k) for k in ("number", "date", "boolean")))
    kind = F.lit("string")
    for k in ("boolean", "date", "number"):
        kind = F.when((F.col("n") > 0) & (F.col(k) >= share * F.col("n")), k).otherwise(kind)
    return counts.select("column", "n", "n_distinct", kind.alias("type"))
