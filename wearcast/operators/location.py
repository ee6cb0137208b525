"""T1-T3 as a table operator and J1, the coordinate lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.functions.parsing import location_key, location_name, parse_location
from wearcast.operators.joins import join_dimension


def parse_locations(df: DataFrame, text_col: str, sep: str = "/") -> DataFrame:
    """Adds ``city, state, zipcode`` (T1), ``location_key`` with ``sep``
    and ``location_name`` (T3)."""
    loc = parse_location(text_col)
    out = df.withColumn("_loc", loc)
    return out.select(
        *df.columns,
        F.col("_loc.city").alias("city"),
        F.col("_loc.state").alias("state"),
        F.col("_loc.zipcode").alias("zipcode"),
        location_key("_loc", sep).alias("location_key"),
        location_name("_loc").alias("location_name"),
    )


def with_coordinates(
    df: DataFrame,
    coords: DataFrame,
    key_col: str = "coord_key",
    strict: bool = False,
) -> DataFrame:
    """latitude/longitude of each row's location (``coords`` has
    ``location, latitude, longitude``).  ``found`` flags hits; with
    ``strict`` a miss fails the job, like a missing key."""
    dim = coords.select(
        F.col("location").alias(key_col), "latitude", "longitude", F.lit(True).alias("_hit")
    )
    out = join_dimension(df, dim, on=key_col, how="left")
    found = F.coalesce(F.col("_hit"), F.lit(False))
    if strict:
        found = F.when(found, found).otherwise(
            F.raise_error(F.concat(F.lit("no coordinates for location "), F.col(key_col).cast("string")))
        )
    return out.withColumn("found", found).drop("_hit")
