"""S9 applied: the items a clothing-rules table names for each row's
conditions (temperature phrase, sky, rules for every outing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.operators.joins import join_dimension


def outfit_from_rules(df: DataFrame, rules: DataFrame, activity: str, conditions: Column, key: str = "row_id") -> DataFrame:
    """``(key, condition, body_part, item)`` for every condition name in the
    array column ``conditions``: the exploded conditions are equi-joined with
    the activity's rules."""
    rows = df.select(key, F.explode(conditions).alias("condition")).filter(F.col("condition").isNotNull())
    r = rules.filter(F.col("activity") == activity).select("condition", "body_part", "item")
    return join_dimension(rows, r, on="condition", how="inner")
