"""Queries over weather and phrase column functions (T4-T9, T12, M1-M6,
D1-D8, J5, V1, V2) and the hourly JSON source (S4, P14, D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import parsing as P
from wearcast.functions import phrases as T
from wearcast.functions import weather as W
from wearcast.operators.observations import observations_from_points, reason_counts, units_valid, write_checked
from wearcast.plans.catalog import register, sql_list
from wearcast.plans.inputs import _case, event_scenarios, event_scenarios_sql, spark_view, sql_view
from wearcast.session import read_table, shared_path

_SCEN = event_scenarios_sql()

# Extra stand-in columns over events (text forms the operators parse).
_ICONS = ["clear-day", "clear-night", "partly-cloudy-day", "partly-cloudy-night", "rain", "wind", "cloudy", "fog",
          "sleet", "snow", None]
_WORDS = ["today", "tomorrow", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
_HOURS = ["10am", "10Am", "10 AM", "10PM", "10pM", "22:00", "22", "12am", "7:30 pm", "noon"]
_UNITS = ["imperial", "english", "metric", "kelvin", None]
_KINDS = ["feels_like", "wind_speed", "condition", "pct_precip", "pct_humidity"]
TEXT_INPUTS = [
    ("row_id", "event_id"),
    ("ts", "ts"),
    ("value", "value"),
    ("icon", _case("event_id % 11", _ICONS)),
    ("bearing", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END"),
    ("feels_like", "CAST((event_id * 7) % 120 - 5 AS DOUBLE)"),
    ("wind_speed", "CAST((event_id * 13) % 35 AS DOUBLE)"),
    ("pct_humidity", "CAST((event_id * 29) % 103 AS DOUBLE)"),
    ("duration", "CAST(20 + (event_id * 17) % 160 AS DOUBLE)"),
    (
        "reading",
        "CASE event_id % 8 WHEN 0 THEN '-9999' WHEN 1 THEN 'n/a' WHEN 2 THEN '-999' WHEN 3 THEN '-998.5' "
        "WHEN 4 THEN NULL ELSE CAST(value AS STRING) END",
    ),
    ("units", _case("event_id % 5", _UNITS)),
    ("word", _case("event_id % 9", _WORDS)),
    ("hour_text", _case("event_id % 10", _HOURS)),
    ("kind", _case("event_id % 5", _KINDS)),
    (
        "value_text",
        "CASE event_id % 5 WHEN 0 THEN CAST((event_id * 7) % 120 - 5 AS STRING) "
        "WHEN 1 THEN CAST((event_id * 13) % 35 AS STRING) WHEN 2 THEN 'rain' "
        "WHEN 3 THEN CAST(value AS STRING) ELSE CAST((event_id * 29) % 103 AS STRING) END",
    ),
]
_TXT = sql_view("events", TEXT_INPUTS)


def _text_inputs(spark, sf_dir):
    return spark_view(read_table(spark, sf_dir, "events"), TEXT_INPUTS)


# -- T4 ---------------------------------------------------------------------
@register(
    "icon_condition",
    f"""WITH s AS ({_TXT})
SELECT row_id, icon,
  regexp_replace(COALESCE(icon, ''), '-(day|night)$', '') AS condition,
  regexp_replace(regexp_replace(COALESCE(icon, ''), '[daynight]+$', ''), '-+$', '') AS condition_compat
FROM s""",
)
def icon_condition(spark, sf_dir):
    """T4: weather icon -> condition, intended and character-strip forms."""
    s = _text_inputs(spark, sf_dir)
    return s.select(
        "row_id",
        "icon",
        W.icon_condition("icon").alias("condition"),
        W.icon_condition("icon", compat=True).alias("condition_compat"),
    )


# -- M3 / J5 ----------------------------------------------------------------
def _names_sql(code: str, names: dict) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_POINTS = "[" + sql_list(S.COMPASS_POINTS) + "]"


@register(
    "wind_direction",
    f"""WITH s AS ({_TXT}),
d AS (SELECT row_id, bearing,
  {_POINTS}[CAST(trunc(COALESCE(bearing, 0.0) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind_dir FROM s)
SELECT row_id, bearing, wind_dir,
  {_names_sql('wind_dir', S.WIND_DIRECTION_NAMES)} AS direction,
  {_names_sql('wind_dir', S.WIND_DIRECTION_NAMES_COMPAT)} AS direction_compat
FROM d""",
)
def wind_direction(spark, sf_dir):
    """M3 + J5: bearing -> 16-point compass code -> direction name."""
    s = _text_inputs(spark, sf_dir)
    d = s.select("row_id", "bearing", W.compass_point("bearing").alias("wind_dir"))
    return d.select(
        "row_id",
        "bearing",
        "wind_dir",
        W.direction_name("wind_dir").alias("direction"),
        W.direction_name("wind_dir", compat=True).alias("direction_compat"),
    )


# -- M1 / M2 / M4 -----------------------------------------------------------
@register(
    "numeric_readings",
    f"""WITH s AS ({_TXT}),
h AS (SELECT *, CASE WHEN feels_like >= 50 THEN feels_like ELSE -9999.0 END AS heat_index,
             feels_like - 3 AS wind_chill, TRY_CAST(reading AS DOUBLE) AS r FROM s)
SELECT row_id,
  CASE WHEN value < 1 THEN value ELSE value / 100 END AS humidity,
  CASE WHEN heat_index = -9999 THEN wind_chill ELSE heat_index END AS feels_like,
  reading,
  CASE WHEN r > -999 THEN r END AS reading_value,
  CASE WHEN r > -9999 THEN r END AS reading_value_obs
FROM h""",
)
def numeric_readings(spark, sf_dir):
    """M1 humidity fraction, M2 feels-like fallback, M4 sentinel nulling at
    both thresholds (-999 for raw readings, -9999 for observations)."""
    from wearcast.functions.draws import heat_index_or_sentinel

    s = _text_inputs(spark, sf_dir)
    return s.select(
        "row_id",
        W.humidity_fraction("value").alias("humidity"),
        W.feels_like(heat_index_or_sentinel("feels_like"), F.col("feels_like") - 3).alias("feels_like"),
        "reading",
        P.sentinel_null(F.col("reading")).alias("reading_value"),
        P.sentinel_null(F.col("reading"), S.OBSERVATION_SENTINEL).alias("reading_value_obs"),
    )


# -- D1-D5 ------------------------------------------------------------------
@register(
    "calendar_keys",
    """SELECT event_id AS row_id, ts,
  dayname(ts) AS dow, CAST(month(ts) AS INTEGER) AS mth, CAST(day(ts) AS INTEGER) AS month_day,
  strftime(ts, '%H:00') AS civil_time,
  concat_ws('_', year(ts), month(ts), day(ts)) AS day_key,
  date_trunc('hour', ts) AS obs_hour,
  CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS epoch,
  TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(epoch(date_trunc('hour', ts)) AS BIGINT)) AS from_epoch
FROM events""",
)
def calendar_keys(spark, sf_dir):
    """Day name, month, day, civil hour, day key, hour truncation and
    the epoch round trip of the hour."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "ts")
    hour = W.truncate_hour("ts")
    epoch = W.local_to_epoch(hour)
    return e.select(
        "row_id",
        "ts",
        W.day_name("ts").alias("dow"),
        F.month("ts").alias("mth"),
        F.dayofmonth("ts").alias("month_day"),
        W.civil_hour("ts").alias("civil_time"),
        W.day_key("ts").alias("day_key"),
        hour.alias("obs_hour"),
        epoch.alias("epoch"),
        W.epoch_to_local(epoch).alias("from_epoch"),
    )


# -- D6-D8 ------------------------------------------------------------------
_HOUR_RE = "^([0-9]{1,2})(:[0-9]{2})?(AM|PM)?$"
_DOW = {"Sun": 0, "Mon": 1, "Tue": 2, "Wed": 3, "Thu": 4, "Fri": 5, "Sat": 6}


def _resolve_sql() -> str:
    s = "upper(regexp_replace(hour_text, '\\s+', '', 'g'))"
    h0 = f"TRY_CAST(regexp_extract({s}, '{_HOUR_RE}', 1) AS INTEGER)"
    m = f"regexp_extract({s}, '{_HOUR_RE}', 3)"
    hour = (
        f"CASE WHEN regexp_full_match({s}, '{_HOUR_RE}') THEN "
        f"CASE WHEN {m} = 'AM' THEN CASE WHEN {h0} BETWEEN 1 AND 12 THEN {h0} % 12 END "
        f"WHEN {m} = 'PM' THEN CASE WHEN {h0} BETWEEN 1 AND 12 THEN {h0} % 12 + 12 END "
        f"ELSE CASE WHEN {h0} <= 23 THEN {h0} END END END"
    )
    ref = "CAST(ts AS DATE)"
    wd = " ".join(
        f"WHEN '{k}' THEN {ref} + CAST(({v} - dayofweek({ref}) + 7) % 7 AS INTEGER)" for k, v in _DOW.items()
    )
    day = f"CASE word WHEN 'today' THEN {ref} WHEN 'tomorrow' THEN {ref} + 1 {wd} END"
    return f"""WITH s AS ({_TXT}),
r AS (SELECT row_id, word, hour_text, {ref} AS ref_date, CAST({day} AS DATE) AS day, CAST({hour} AS INTEGER) AS hour FROM s)
SELECT *, CAST(day AS TIMESTAMP) + to_hours(hour) AS at FROM r"""


@register("resolve_dates", _resolve_sql())
def resolve_dates(spark, sf_dir):
    """Relative day words and free-form hours resolved against each
    event's own date, then combined into a timestamp."""
    s = _text_inputs(spark, sf_dir)
    r = s.select(
        "row_id",
        "word",
        "hour_text",
        F.to_date("ts").alias("ref_date"),
        P.resolve_date("word", F.to_date("ts")).alias("day"),
        P.parse_hour("hour_text").alias("hour"),
    )
    return r.withColumn("at", P.combine_date_hour("day", "hour"))


# -- M5 / M6 ----------------------------------------------------------------
@register(
    "python_round",
    f"""WITH s AS ({_TXT}),
d AS (SELECT row_id, value, duration, round_even(duration / (8 + value / 70), 2) AS distance FROM s)
SELECT row_id, LEAST(30.0, GREATEST(0.0, round_even(value / 10 - 5, 0))) AS wind_draw,
  distance, round_even(duration / distance, 2) AS pace
FROM d""",
)
def python_round(spark, sf_dir):
    """M5 clamp of a half-to-even rounded draw; M6 distance and pace at 2 dp
    (the value column stands in for the draws)."""
    from wearcast.functions import draws as D

    s = _text_inputs(spark, sf_dir)
    d = s.select("row_id", "value", "duration", D.distance_for("duration", 8 + F.col("value") / 70).alias("distance"))
    return d.select(
        "row_id",
        D.clamp(D.python_round(F.col("value") / 10 - 5), 0, 30).alias("wind_draw"),
        "distance",
        D.pace("duration", "distance").alias("pace"),
    )


# -- V1 / V2 ----------------------------------------------------------------
@register(
    "quality_flags",
    f"""WITH s AS ({_TXT})
SELECT row_id, units, COALESCE(units IN ({sql_list(S.UNITS)}), false) AS units_ok,
  reading, TRY_CAST(reading AS DOUBLE) IS NOT NULL AS reading_ok
FROM s""",
)
def quality_flags(spark, sf_dir):
    """V1 units domain flag and V2 numeric-input flag (quarantine split keys)."""
    s = _text_inputs(spark, sf_dir)
    return s.select(
        "row_id",
        "units",
        units_valid("units").alias("units_ok"),
        "reading",
        P.try_number("reading").isNotNull().alias("reading_ok"),
    )


_OK = {"units": f"COALESCE(units IN ({sql_list(S.UNITS)}), false)", "reading": "TRY_CAST(reading AS DOUBLE) IS NOT NULL", "positive": "COALESCE(TRY_CAST(reading AS DOUBLE) > 0, false)"}


@register(
    "checked_split",
    f"WITH s AS ({_TXT}) SELECT 'good' AS reason, count(*) FILTER ({' AND '.join(_OK.values())}) AS n_rows, count(*) FILTER ({' AND '.join(_OK.values())}) AS n_only FROM s"
    + "".join(
        f" UNION ALL SELECT '{rule}', count(*) FILTER (NOT {ok}), count(*) FILTER (NOT {ok} AND {' AND '.join(o for r, o in _OK.items() if r != rule)}) FROM s"
        for rule, ok in _OK.items()),
)
def checked_split(spark, sf_dir):
    """V1 + V2 as a quarantine: every reading is tagged with the rules it
    breaks and written once, good rows and bad ones to their own folders;
    counted per reason from there, and those that break one rule only."""
    s = _text_inputs(spark, sf_dir)
    number = P.try_number("reading")
    rules = {"units": units_valid("units"), "reading": number.isNotNull(), "positive": number > 0}
    good, bad = write_checked(s, rules, shared_path(spark, "checked"))
    only = reason_counts(bad.where(F.size("reasons") == 1)).withColumnRenamed("n_rows", "n_only")
    named = spark.createDataFrame([(r,) for r in rules], "reason string")
    counts = named.join(reason_counts(bad), "reason", "left").join(only, "reason", "left").na.fill(0)
    return good.agg(F.lit("good").alias("reason"), F.count("*").alias("n_rows"), F.count("*").alias("n_only")).unionByName(counts)


# -- T5-T8 ------------------------------------------------------------------
def _temp_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN '{w}'" for b, w in S.TEMP_PHRASES)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{S.TEMP_PHRASE_ABOVE}' END"


def _wind_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN '{w}'" for b, w in S.WIND_PHRASES)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{S.WIND_PHRASE_ABOVE}' END"


def _wind_dir_sql(x: str, code: str) -> str:
    name = _names_sql(code, S.WIND_DIRECTION_NAMES_COMPAT)
    return (
        f"CASE WHEN ({name}) IS NOT NULL THEN {_wind_sql(x)} || ', ' || CAST({x} AS VARCHAR) "
        f"|| ' miles per hour out of the ' || ({name}) ELSE {_wind_sql(x)} END"
    )


@register(
    "condition_phrases",
    f"""WITH s AS ({_TXT}),
d AS (SELECT *, {_POINTS}[CAST(trunc(COALESCE(bearing, 0.0) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind_dir,
             regexp_replace(COALESCE(icon, ''), '-(day|night)$', '') AS condition,
             TRY_CAST(value_text AS DOUBLE) AS num FROM s)
SELECT row_id, {_temp_sql('feels_like')} AS temp_phrase, {_wind_sql('wind_speed')} AS wind_phrase,
  {_wind_dir_sql('wind_speed', 'wind_dir')} AS wind_phrase_dir,
  condition AS condition_phrase, CAST(NULL AS VARCHAR) AS precip_phrase,
  kind, value_text,
  CASE WHEN kind = 'feels_like' THEN {_temp_sql('num')} WHEN kind = 'wind_speed' THEN {_wind_sql('num')}
       WHEN kind = 'condition' THEN value_text END AS phrase
FROM d""",
)
def condition_phrases(spark, sf_dir):
    """T5 temperature, T6 wind (with and without direction), T7 condition and
    precipitation, T8 dispatch on a condition-type column."""
    s = _text_inputs(spark, sf_dir)
    d = s.withColumn("wind_dir", W.compass_point("bearing")).withColumn("condition", W.icon_condition("icon"))
    return d.select(
        "row_id",
        T.temp_phrase("feels_like").alias("temp_phrase"),
        T.wind_phrase("wind_speed").alias("wind_phrase"),
        T.wind_phrase("wind_speed", "wind_dir", compat=True).alias("wind_phrase_dir"),
        T.condition_phrase("condition").alias("condition_phrase"),
        T.precipitation_phrase().alias("precip_phrase"),
        "kind",
        "value_text",
        T.phrase_for("kind", "value_text").alias("phrase"),
    )


# -- T9 ---------------------------------------------------------------------
_LIST_ITEMS = ["outer_layer", "base_layer", "jacket", "lower_body", "shoe_cover"]


@register(
    "english_list",
    f"""WITH s AS ({_SCEN}),
j AS (SELECT row_id, trim(concat_ws(', ', outer_layer, base_layer, jacket, lower_body,
        CASE WHEN row_id % 13 = 0 THEN 'socks, shoes' ELSE shoe_cover END), ', ') AS t FROM s)
SELECT row_id, CASE WHEN contains(t, ',') THEN replace(regexp_replace(t, ',([^,]*)$', ' and\\1'), 'and and', 'and') ELSE t END AS items_text FROM j""",
)
def english_list(spark, sf_dir):
    """Label values (NULLs skipped) joined as an English list."""
    s = event_scenarios(spark, sf_dir)
    last = F.when(F.col("row_id") % 13 == 0, F.lit("socks, shoes")).otherwise(F.col("shoe_cover"))
    items = [F.col(c) for c in _LIST_ITEMS[:-1]] + [last]
    return s.select("row_id", T.english_list(items).alias("items_text"))


# -- T12 --------------------------------------------------------------------
def _shown(x: str) -> str:
    return f"COALESCE(CAST({x} AS VARCHAR), 'None')"


@register(
    "observation_report",
    f"""WITH s AS ({_SCEN}),
o AS (SELECT row_id, 'Town' || CAST(user_id % 50 AS VARCHAR) || ',AR' AS location, ts, feels_like, wind_speed,
  {_POINTS}[CAST(trunc(bearing / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind_dir,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS condition,
  CAST((row_id % 11) * 10 AS DOUBLE) AS precip_chance,
  CAST((row_id * 29) % 100 AS DOUBLE) / 100 AS pct_humidity FROM s)
SELECT row_id, 'Observation for ' || location || ' on ' || dayname(ts) || ' (Month-Day): ' ||
  CAST(month(ts) AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) || ' at ' || strftime(ts, '%H:00') ||
  '. ' || chr(10) || chr(9) || 'Temperature (feels like): ' || {_shown('feels_like')} || ' °F' || chr(10) || chr(9) ||
  'Wind ' || {_shown('wind_speed')} || ' mph from ' || {_shown('wind_dir')} || chr(10) || chr(9) ||
  'Conditions: ' || {_shown('condition')} || ' ' || chr(10) || chr(9) || 'Chance of precipitation: ' ||
  {_shown('precip_chance')} || ' %' || chr(10) || chr(9) || 'Humidity: ' || {_shown('pct_humidity * 100')} || '%'
  AS report
FROM o""",
)
def observation_report(spark, sf_dir):
    """The multi-line text report of an observation."""
    s = event_scenarios(spark, sf_dir)
    o = s.select(
        "row_id",
        F.concat(F.lit("Town"), (F.col("user_id") % 50).cast("string"), F.lit(",AR")).alias("location"),
        "ts",
        "feels_like",
        "wind_speed",
        W.compass_point("bearing").alias("wind_dir"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("condition"),
        ((F.col("row_id") % 11) * 10).cast("double").alias("precip_chance"),
        (((F.col("row_id") * 29) % 100).cast("double") / 100).alias("pct_humidity"),
    )
    return o.select(
        "row_id",
        T.observation_report(
            "location", "ts", "feels_like", "wind_speed", "wind_dir", "condition", "precip_chance", "pct_humidity"
        ).alias("report"),
    )


# -- S4 / P14 / D5 ----------------------------------------------------------
# Each event carries a forecast document with two hour points (its own hour
# and the next), every 17th event a document without "hourly" at all.
def _doc_points_sql() -> str:
    base = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT)"
    icon = _case("event_id % 11", _ICONS)
    rows = []
    for k in (0, 1):
        rows.append(
            f"""SELECT CAST(user_id AS VARCHAR) AS location, {base} + {3600 * k} AS time,
  {icon} AS icon, value - 20 * {k} AS temperature,
  CASE WHEN event_id % 9 = 0 THEN -9999.0 ELSE value - 3 END AS apparentTemperature,
  CAST((event_id * 13) % 35 AS DOUBLE) AS windSpeed,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((event_id * 37 + 90 * {k}) % 360 AS DOUBLE) END AS windBearing,
  CAST((event_id % 11) AS DOUBLE) / 10 AS precipProbability,
  CAST((event_id * 29) % 103 AS DOUBLE) AS humidity
FROM events WHERE event_id % 17 <> 0"""
        )
    return " UNION ALL ".join(rows)


def _nested_sql() -> str:
    pts = _doc_points_sql()
    feels = "CASE WHEN apparentTemperature > -999 THEN apparentTemperature END"
    hum = "CASE WHEN humidity > -999 THEN humidity END"
    ts = "TIMESTAMP '1970-01-01 00:00:00' + to_seconds(time)"
    return f"""WITH p AS ({pts})
SELECT location AS location_key, date_trunc('hour', {ts}) AS obs_hour, CAST({ts} AS DATE) AS obs_date,
  time AS epoch, regexp_replace(COALESCE(icon, ''), '-(day|night)$', '') AS condition,
  CASE WHEN temperature > -999 THEN temperature END AS temp_f,
  CASE WHEN ({feels}) = -9999 THEN 0.0 ELSE ({feels}) END AS feels_like,
  CASE WHEN windSpeed > -999 THEN windSpeed END AS wind_speed,
  {_POINTS}[CAST(trunc(COALESCE(windBearing, 0.0) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind_dir,
  CASE WHEN precipProbability > -999 THEN precipProbability END AS precip_chance,
  CASE WHEN ({hum}) < 1 THEN ({hum}) ELSE ({hum}) / 100 END AS pct_humidity,
  'english' AS units, true AS is_light
FROM p"""


def event_hourly():
    """Stand-in hourly payload of an event (a struct column over ``events``):
    two hour points, or NULL (no ``hourly``) for every 17th event."""
    base = W.local_to_epoch(W.truncate_hour("ts"))
    icon = F.expr(_case("event_id % 11", _ICONS))

    def point(k: int):
        bearing = F.when(F.col("event_id") % 6 != 0, ((F.col("event_id") * 37 + 90 * k) % 360).cast("double"))
        return F.struct(
            (base + 3600 * k).alias("time"),
            icon.alias("icon"),
            (F.col("value") - 20 * k).alias("temperature"),
            F.when(F.col("event_id") % 9 == 0, F.lit(-9999.0)).otherwise(F.col("value") - 3).alias(
                "apparentTemperature"
            ),
            ((F.col("event_id") * 13) % 35).cast("double").alias("windSpeed"),
            bearing.alias("windBearing"),
            ((F.col("event_id") % 11).cast("double") / 10).alias("precipProbability"),
            ((F.col("event_id") * 29) % 103).cast("double").alias("humidity"),
        )

    return F.when(F.col("event_id") % 17 != 0, F.struct(F.array(point(0), point(1)).alias("data")))


@register("nested_weather", _nested_sql())
def nested_weather(spark, sf_dir):
    """S4 + P14 + D5: forecast JSON documents (built per event as text and
    written to the shared folder) read back with a fixed schema, exploded to
    hour points and turned into observations."""
    from wearcast.session import shared_path
    from wearcast.sources.weather_json import explode_hourly, read_hourly_json

    e = read_table(spark, sf_dir, "events")
    docs = e.select(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("location"), event_hourly().alias("hourly"))).alias(
            "value"
        )
    )
    path = shared_path(spark, "forecast_docs")
    docs.write.mode("overwrite").text(path)
    # one in 23 documents also arrives cut off, as after a broken transfer
    cut = docs.filter(F.pmod(F.xxhash64("value"), F.lit(23)) == 0).select(F.expr("left(value, length(value) - 3)").alias("value"))
    cut.write.mode("append").text(path)
    read = read_hourly_json(spark, path)
    return observations_from_points(explode_hourly(read, ["location"])).drop("source_file")
