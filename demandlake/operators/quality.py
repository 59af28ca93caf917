"""Row validation against range rules: split valid rows from quarantined ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RANGE_RULES, rule_violations


def validate_rows(df: DataFrame, rules=RANGE_RULES) -> DataFrame:
    """Adds ``violations`` (array of failed rule columns) and ``is_valid``."""
    v = rule_violations(rules)
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame, rules=RANGE_RULES) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(df, rules)
    return (checked.filter("is_valid").drop("violations", "is_valid"),
            checked.filter(~F.col("is_valid")).drop("is_valid"))
