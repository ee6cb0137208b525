"""Random weather scenarios for building labelled data.

``random_scenarios`` turns each row of an id table into one random forecast
plus an activity length, distance and pace, with the distributions of the
original generator.  Everything is a projection (no shuffle), and draws are
hashed from the row id, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import draws as D
from wearcast.functions import phrases as T
from wearcast.functions.weather import feels_like, humidity_fraction


def random_scenarios(ids: DataFrame, seed: int = 7, year: int = 2024, row_id: str = "row_id") -> DataFrame:
    """One random scenario per row of ``ids``.

    * time: month 1-11, day 1-27, hour 5-20 of ``year`` (G1);
    * precipitation chance 0..90 by 10, below 20 -> 0, above 80 -> 100 (G2);
    * temperature round(N(55, 20)); wind min(30, max(0, round(N(8, 8))));
      humidity round(N(55, 20)) then normalised to a fraction (G3, M1, M5);
    * condition weighted 70 (frequent) / 30 (rare) (G4);
    * wind direction uniform over the 12 named codes, daylight a coin (G5);
    * duration max(20, round(N(45, 45))); distance = duration /
      Triangular(8, 15, mode 10.5) at 2 dp; pace = duration / distance (G6, M6);
    * wind chill below 50 F, heat index from 50 F, giving feels-like (G7, M2).
    Rounding is half-to-even, as in Python."""
    r = F.col(row_id)
    month = D.randrange(r, seed, 0, 1, 12)
    day = D.randrange(r, seed, 1, 1, 28)
    hour = D.randrange(r, seed, 2, 5, 21)
    pchance = D.randrange(r, seed, 3, 0, 100, 10)
    temp = D.python_round(D.normal(r, seed, 4, 55.0, 20.0))
    wind = D.clamp(D.python_round(D.normal(r, seed, 6, 8.0, 8.0)), 0, 30)
    humidity = D.python_round(D.normal(r, seed, 8, 55.0, 20.0))
    weights = [S.HIGH_WEIGHT] * len(S.HIGH_CONDITIONS) + [S.LOW_WEIGHT] * len(S.LOW_CONDITIONS)
    condition = D.weighted_choice(r, seed, 10, S.WEATHER_CONDITIONS, weights)
    wind_dir = D.choice(r, seed, 11, list(S.WIND_DIRECTION_NAMES_COMPAT))
    is_light = D.uniform(r, seed, 12) < 0.5
    duration = F.greatest(F.lit(20.0), D.python_round(D.normal(r, seed, 13, 45.0, 45.0)))
    pace_draw = D.triangular(r, seed, 15, 8.0, 15.0, 10.5)

    base = ids.select(
        r.alias("row_id"),
        F.make_timestamp_ntz(F.lit(year), month, day, hour, F.lit(0), F.lit(0)).alias("ts"),
        F.when(pchance < 20, 0).when(pchance > 80, 100).otherwise(pchance).cast("double").alias("precip_chance"),
        temp.alias("temp_f"),
        wind.alias("wind_speed"),
        humidity_fraction(humidity).alias("pct_humidity"),
        condition.alias("condition"),
        wind_dir.alias("wind_dir"),
        is_light.alias("is_light"),
        duration.alias("duration"),
        D.distance_for(duration, pace_draw).alias("distance"),
    )
    sentinel = float(S.OBSERVATION_SENTINEL)
    return base.select(
        "*",
        feels_like(
            D.heat_index_or_sentinel("temp_f", sentinel=sentinel),
            D.wind_chill_or_sentinel("temp_f", sentinel=sentinel),
            sentinel,
        ).alias("feels_like"),
        D.pace("duration", "distance").alias("pace"),
        F.lit("Anytown, US").alias("location"),
        T.pick(S.OPENING_STATEMENTS, T.hashed_index("row_id", seed + 100)).alias("opening"),
        T.pick(S.CLOTHING_STATEMENTS, T.hashed_index("row_id", seed + 101)).alias("clothing_lead"),
    )
