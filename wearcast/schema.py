"""Schemas, column order and the fixed values the results depend on.

Everything below the "fixed values" marker must equal the values of the
original tool for results to match: option domains, phrase thresholds,
sentence banks, descriptions, compass names, weather condition weights.
They are stated here once, plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the original tool's)
# --------------------------------------------------------------------------

# Option domains of the categorical outfit labels, in their declared order.
LAYER_OPTIONS = ["None", "Sleeveless", "Short-sleeve", "Long-sleeve", "Sweatshirt-Heavy"]
JACKET_OPTIONS = ["None", "Vest", "Rain", "Warm", "Wind", "Rain-Wind", "Rain-Warm", "Wind-Warm", "Warm-Rain-Wind"]
LEG_OPTIONS = ["Shorts", "Shorts-calf cover", "Capri", "Long tights", "Insulated tights"]
SHOE_COVER_OPTIONS = ["None", "Toe Cover", "Boots"]

# Boolean labels are offered as these two options.
BOOLEAN_OPTIONS = ["n", "y"]

# Model inputs and outputs, in order.
FEATURES = ["feels_like", "wind_speed", "pct_humidity", "duration", "is_light"]
CATEGORICAL_LABELS = ["outer_layer", "base_layer", "jacket", "lower_body", "shoe_cover"]
BOOLEAN_LABELS = ["ears_hat", "gloves", "heavy_socks", "arm_warmers", "face_cover"]
LABELS = CATEGORICAL_LABELS + BOOLEAN_LABELS

CATEGORICAL_DOMAINS = {
    "outer_layer": LAYER_OPTIONS,
    "base_layer": LAYER_OPTIONS,
    "jacket": JACKET_OPTIONS,
    "lower_body": LEG_OPTIONS,
    "shoe_cover": SHOE_COVER_OPTIONS,
}

# Text spellings of booleans in activity logs.
TRUE_WORDS = ["Yes", "yes", "y", "Y"]
FALSE_WORDS = ["No", "no", "n", "N"]
# Native CSV spellings also accepted.
TRUE_NATIVE = ["TRUE", "True", "true"]
FALSE_NATIVE = ["FALSE", "False", "false"]

# Activity length bins, right-closed: (0,31] (31,61] (61,121] (121,720].
LENGTH_BIN_EDGES = [0, 31, 61, 121, 720]
LENGTH_BIN_NAMES = ["short", "medium", "long", "extra long"]

# Temperature phrase: upper bound (exclusive) -> phrase; above the last bound: "hot".
TEMP_PHRASES = [(40, "cold"), (48, "cool"), (58, "mild"), (68, "warm"), (75, "very warm")]
TEMP_PHRASE_ABOVE = "hot"

# Wind phrase: upper bound (exclusive) -> phrase; above the last bound: "very windy".
WIND_PHRASES = [(10, "calm"), (15, "breezy"), (20, "windy")]
WIND_PHRASE_ABOVE = "very windy"

# 16-point compass, clockwise from north (bearing / 22.5 rounded half up, mod 16).
COMPASS_POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

# Direction names the original tool knows (12 of the 16 points).
WIND_DIRECTION_NAMES_COMPAT = {
    "N": "North",
    "NNE": "North-Northeast",
    "NNW": "North-Northwest",
    "ENE": "East-Northeast",
    "WNW": "West-Northwest",
    "E": "East",
    "W": "West",
    "S": "South",
    "SSE": "South-Southeast",
    "SSW": "South-Southwest",
    "ESE": "East-Southeast",
    "WSW": "West-Southwest",
}
# Our default adds the four intercardinal points the original lacks.
WIND_DIRECTION_NAMES = {
    **WIND_DIRECTION_NAMES_COMPAT,
    "NE": "Northeast",
    "SE": "Southeast",
    "SW": "Southwest",
    "NW": "Northwest",
}

# Random weather conditions: frequent ones drawn with weight 70, rare ones with 30.
HIGH_CONDITIONS = ["clear", "wind", "fog", "cloudy", "partly-cloudy"]
LOW_CONDITIONS = ["rain", "snow", "sleet"]
HIGH_WEIGHT = 70
LOW_WEIGHT = 30
WEATHER_CONDITIONS = HIGH_CONDITIONS + LOW_CONDITIONS

# Missing-value sentinels: -9999 in observations, anything <= -999 in raw readings.
OBSERVATION_SENTINEL = -9999
READING_SENTINEL = -999

# Accepted unit systems of an observation.
UNITS = ["imperial", "english", "metric"]

# Forecast snapshots older than this are stale.
FORECAST_TTL_HOURS = 12

# Default coordinate rows used when no coordinate table exists.
DEFAULT_COORDINATES = [("72712", 36.37233, -94.20949), ("AR-Bentonville", 36.37233, -94.20949)]

# Sentence banks.
OPENING_STATEMENTS = ["It looks like", "Oh my,", "Well,"]
CLOTHING_STATEMENTS = [
    "I suggest wearing",
    "Based on the weather conditions, you should consider",
    "Looks like today would be a good day to wear",
    "If I were going out I'd wear",
]

# Base item descriptions: item -> (description, alternative description).
BASE_DESCRIPTIONS = {
    "Sleeveless": ("a sleeveless top", None),
    "Short-sleeve": ("a short-sleeved shirt", None),
    "Long-sleeve": ("a long-sleeved top", None),
    "Sweatshirt-Heavy": ("a sweatshirt or heavier long-sleeve outwear", None),
    "Rain": ("a rain jacket", None),
    "Warmth": ("a warm jacket", None),
    "Wind": ("a windbreaker", None),
    "Rain-Wind": ("a water repellent windbreaker", None),
    "Warmth-Rain": ("a warm water repellent jacket", None),
    "Warmth-Wind": ("an insulated windbreaker", None),
    "Warmth-Rain-Wind": ("an water repellent, insulated windbreaker", None),
    "Shorts": ("shorts", None),
    "Shorts-calf cover": ("shorts with long socks or calf sleeves", None),
    "Capri": ("capri tights", None),
    "Long tights": ("full length tights", None),
    "Insulated tights": ("Insulated tights", None),
    "ears_hat": ("ear covers", None),
    "gloves": ("full fingered gloves", None),
    "heavy_socks": ("wool or insulated socks", "regular socks"),
    "arm_warmers": ("arm warmers", None),
    "face_cover": ("face cover", None),
    "Toe Cover": ("toe covers", None),
}

# Activity overrides as written in the original (None deletes an item).
RUN_OVERRIDES_COMPAT = {
    "Short-sleeve": ("singlet", None),
    "Toe cover": None,
    "Boot": None,
    "face_cover": None,
}
ROADBIKE_OVERRIDES_COMPAT = {
    "ears_hat": ("ear covers", None),
    "Boot": ("insulated cycling boot", None),
}

# Workbook headers -> canonical column names.
WORKBOOK_RENAMES = {
    "Date": "activity_date",
    "Time": "activity_hour",
    "Activity": "activity",
    "Distance": "distance",
    "Length of activity (min)": "duration",
    "Condition": "condition",
    "Light": "is_light",
    "Wind": "wind_speed",
    "Wind Dir": "wind_dir",
    "Temp": "temp_f",
    "Feels like": "feels_like",
    "Humidity": "pct_humidity",
    "Hat-Ears": "ears_hat",
    "Outer Layer": "outer_layer",
    "Base Layer": "base_layer",
    "Arm Warmers": "arm_warmers",
    "Jacket": "jacket",
    "Gloves": "gloves",
    "LowerBody": "lower_body",
    "Shoe Covers": "shoe_cover",
    "Face Cover": "face_cover",
    "Heavy Socks": "heavy_socks",
}
WORKBOOK_DROPS = ["Feel", "Notes", "Hat", "Ears", "activity_hour"]
SAMPLE_DROPS = ["Athlete", "activity", "activity_date"]

# Activity names.
RUN = "Run"
ROADBIKE = "Roadbike"

# --------------------------------------------------------------------------
# Aligned description keys (our default): the original's description keys do
# not match some option names (Warm vs Warmth, Boots vs Boot, Toe Cover vs Toe
# cover).  The aligned tables key the same descriptions by the option names.
# --------------------------------------------------------------------------

ALIGNED_KEY = {
    "Warmth": "Warm",
    "Warmth-Rain": "Rain-Warm",
    "Warmth-Wind": "Wind-Warm",
    "Warmth-Rain-Wind": "Warm-Rain-Wind",
    "Toe cover": "Toe Cover",
    "Boot": "Boots",
}

# --------------------------------------------------------------------------
# Spark schemas
# --------------------------------------------------------------------------

ACTIVITY_LOG_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("wind_dir", T.StringType()),
        T.StructField("dow", T.StringType()),
        T.StructField("civil_time", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("feels_like", T.DoubleType()),
        T.StructField("heat_index", T.DoubleType()),
        T.StructField("temp_f", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("precip_chance", T.DoubleType()),
        T.StructField("pct_humidity", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("tod", T.IntegerType()),
        T.StructField("month_day", T.IntegerType()),
        T.StructField("mth", T.IntegerType()),
        T.StructField("is_light", T.BooleanType()),
        T.StructField("is_daylight", T.BooleanType()),
        T.StructField("arm_warmers", T.BooleanType()),
        T.StructField("ears_hat", T.BooleanType()),
        T.StructField("face_cover", T.BooleanType()),
        T.StructField("gloves", T.BooleanType()),
        T.StructField("heavy_socks", T.BooleanType()),
        T.StructField("base_layer", T.StringType()),
        T.StructField("outer_layer", T.StringType()),
        T.StructField("jacket", T.StringType()),
        T.StructField("lower_body", T.StringType()),
        T.StructField("shoe_cover", T.StringType()),
    ]
)

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("feels_like", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("pct_humidity", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("is_light", T.BooleanType()),
        T.StructField("outer_layer", T.StringType()),
        T.StructField("base_layer", T.StringType()),
        T.StructField("jacket", T.StringType()),
        T.StructField("lower_body", T.StringType()),
        T.StructField("shoe_cover", T.StringType()),
        T.StructField("ears_hat", T.BooleanType()),
        T.StructField("gloves", T.BooleanType()),
        T.StructField("heavy_socks", T.BooleanType()),
        T.StructField("arm_warmers", T.BooleanType()),
        T.StructField("face_cover", T.BooleanType()),
    ]
)

HOURLY_POINT = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("icon", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("apparentTemperature", T.DoubleType()),
        T.StructField("windSpeed", T.DoubleType()),
        T.StructField("windBearing", T.DoubleType()),
        T.StructField("precipProbability", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
    ]
)

WEATHER_JSON_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("hourly", T.StructType([T.StructField("data", T.ArrayType(HOURLY_POINT))])),
    ]
)

COORDINATE_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
