"""Hour points -> observations, with sentinels nulled, units
checked, humidity normalised, compass direction and condition derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import parsing as P
from wearcast.functions import weather as W


_POINT_FIELDS = [f.name for f in S.HOURLY_POINT.fields]


def observations_from_points(
    points: DataFrame,
    location_col: str = "location",
    units: str = "english",
    tz: str = "UTC",
    compat: bool = False,
    sentinel: float = S.READING_SENTINEL,
) -> DataFrame:
    """Hour points (``time, icon, temperature, apparentTemperature, windSpeed,
    windBearing, precipProbability, humidity``) -> observation rows.

    * readings at or below the sentinel become NULL;
    * feels-like is the apparent temperature;
    * humidity is normalised to a fraction; a missing bearing counts as north;
    * daylight is the points' ``is_light`` where they carry it, else true;
    * the epoch is read as wall-clock time in ``tz``;
    * ``units`` must be one of imperial/english/metric;
    * other document columns (envelope fields, source file) pass through."""
    if units not in S.UNITS:
        raise ValueError(f"units must be one of {S.UNITS}, got {units!r}")
    ts = W.epoch_to_local("time", tz)
    humidity = P.sentinel_null(F.col("humidity"), sentinel)
    return points.select(
        F.col(location_col).alias("location_key"),
        W.truncate_hour(ts).alias("obs_hour"),
        F.to_date(ts).alias("obs_date"),
        F.col("time").alias("epoch"),
        W.icon_condition("icon", compat=compat).alias("condition"),
        P.sentinel_null(F.col("temperature"), sentinel).alias("temp_f"),
        P.sentinel_null(F.col("apparentTemperature"), sentinel).alias("feels_like"),
        P.sentinel_null(F.col("windSpeed"), sentinel).alias("wind_speed"),
        W.compass_point(P.sentinel_null(F.col("windBearing"), sentinel)).alias("wind_dir"),
        P.sentinel_null(F.col("precipProbability"), sentinel).alias("precip_chance"),
        W.humidity_fraction(humidity).alias("pct_humidity"),
        F.lit(units).alias("units"),
        (F.coalesce(F.col("is_light"), F.lit(True)) if "is_light" in points.columns else F.lit(True)).alias("is_light"),
        *[c for c in points.columns if c not in _POINT_FIELDS and c not in (location_col, "point_pos", "is_light")],
    )


def units_valid(units_col) -> F.Column:
    """V1 as a flag (for a quarantine split instead of failing the job)."""
    c = F.col(units_col) if isinstance(units_col, str) else units_col
    return F.coalesce(c.isin(S.UNITS), F.lit(False))


def quarantine(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """V1/V2 as a split instead of a failure: (rows where ``valid`` holds,
    rows where it is false or NULL).  Both halves read the same input; cache
    it first if it is expensive."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def with_reasons(df: DataFrame, rules: dict, name: str = "reasons") -> DataFrame:
    """V1/V2 with the reason told: adds an array of the names of the ``rules``
    (name -> condition) that a row breaks; a NULL condition is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def write_checked(df: DataFrame, rules: dict, path: str, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Split good rows from bad ones in one pass: every row is tagged and
    written once, under ``path`` in a folder for its outcome.  Returns (good
    rows as they came, bad rows with their reasons), each reading its folder
    only.  ``path`` must be new."""
    if name in df.columns or "_good" in df.columns:
        raise ValueError(f"the rows have a column {name!r} or '_good' of their own")
    tagged = with_reasons(df, rules, name)
    tagged.withColumn("_good", F.size(name) == 0).write.partitionBy("_good").parquet(path)
    read = df.sparkSession.read.schema(tagged.withColumn("_good", F.lit(True)).schema).parquet(path)
    return read.where("_good").drop("_good", name), read.where("NOT _good").drop("_good")


def reason_counts(bad: DataFrame, name: str = "reasons") -> DataFrame:
    """``(reason, n_rows)``: how many rows break each rule."""
    return bad.select(F.explode(name).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
