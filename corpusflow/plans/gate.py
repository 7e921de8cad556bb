"""The gate before a publication: measures against thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least values of the default gate. Fixed values.
THRESHOLDS = {"sources": 5, "success_rate": 80, "document_count": 10, "completeness": 70, "quality": 60}


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables (global aggregates) of different columns as one row: a union and a maximum, no join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def checks(measures: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(name, measured, least, passed, error) from a row of measures."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("measured"), F.lit(float(v)).alias("least")) for n, v in thresholds.items()))
    long = measures.select(F.explode(each).alias("c")).select("c.*").withColumn("passed", F.coalesce(F.col("measured") >= F.col("least"), F.lit(False)))
    return long.withColumn("error", F.when(~F.col("passed"), F.concat(F.col("name"), F.lit(" is below "), F.col("least").cast("int").cast("string"))))


def passed(checked: DataFrame) -> bool:
    """Whether every check passed; one row comes to the driver."""
    return bool(checked.agg(F.bool_and("passed")).first()[0])
