"""Queries over sources, sinks, sample rows, rules and the scenario generator
(S1-S3, S5, S6, S9, S10, S11, O1, P11-P13, U1, U2, G1-G7, T11, X2)."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast import schema as S
from wearcast.functions.phrases import temp_phrase
from wearcast.operators.cleaning import union_all_by_name
from wearcast.operators.generate import random_scenarios
from wearcast.operators.rules import outfit_from_rules
from wearcast.operators.samples import append_samples, merge_samples, observation_row
from wearcast.plans.catalog import register, sql_list, sql_str
from wearcast.plans.inputs import EVENT_SCENARIO, event_scenarios, event_scenarios_sql, spark_view
from wearcast.plans.q_weather import _temp_sql
from wearcast.session import read_table, shared_path
from wearcast.sources import files as FS

_SCEN = event_scenarios_sql()
_EXPR = dict(EVENT_SCENARIO)
_LOG_TYPES = "('view', 'click', 'purchase')"


def _bool_text(c: str, true: str, false: str) -> str:
    return f"CASE WHEN {c} THEN {true} WHEN NOT {c} THEN {false} END"


# Activity-log family: the log layout with TRUE/FALSE booleans.
LOG_SCHEMA = T.StructType([T.StructField("row_id", T.LongType())] + list(S.ACTIVITY_LOG_SCHEMA.fields))
_LOG_FILE = [
    ("row_id", _EXPR["row_id"]),
    ("location", "CAST(NULL AS STRING)"),
    ("condition", "event_type"),
    ("wind_dir", "CAST(NULL AS STRING)"),
    ("dow", "CAST(NULL AS STRING)"),
    ("civil_time", "CAST(NULL AS STRING)"),
    ("timestamp", "CAST(NULL AS STRING)"),
    ("feels_like", _EXPR["feels_like"]),
    ("heat_index", "CAST(0 AS DOUBLE)"),
    ("temp_f", _EXPR["feels_like"]),
    ("wind_speed", _EXPR["wind_speed"]),
    ("precip_chance", "CAST(0 AS DOUBLE)"),
    ("pct_humidity", _EXPR["pct_humidity"]),
    ("duration", _EXPR["duration"]),
    ("tod", "CAST(NULL AS INT)"),
    ("month_day", "CAST(NULL AS INT)"),
    ("mth", "CAST(NULL AS INT)"),
    ("is_light", _bool_text(_EXPR["is_light"], "'TRUE'", "'FALSE'")),
    ("is_daylight", _bool_text(_EXPR["is_light"], "'TRUE'", "'FALSE'")),
] + [(b, _bool_text(_EXPR[b], "'TRUE'", "'FALSE'")) for b in ["arm_warmers", "ears_hat", "face_cover", "gloves", "heavy_socks"]] + [
    (c, _EXPR[c]) for c in ["base_layer", "outer_layer", "jacket", "lower_body", "shoe_cover"]
]

# Workbook family: sheet headers, Yes/No and y/n booleans, 26 columns (the
# reader keeps A..Y), plus fully empty rows.
_YES = "CASE event_id % 2 WHEN 0 THEN 'Yes' ELSE 'y' END"
_NO = "CASE event_id % 2 WHEN 0 THEN 'No' ELSE 'n' END"
_WB = {v: k for k, v in S.WORKBOOK_RENAMES.items()}
_WORKBOOK_FILE = [
    ("Row", _EXPR["row_id"]),
    ("Date", "CAST(CAST(ts AS DATE) AS STRING)"),
    ("Time", "CAST(NULL AS STRING)"),
    ("Activity", "'Run'"),
    ("Distance", "CAST(NULL AS STRING)"),
    (_WB["duration"], _EXPR["duration"]),
    ("Condition", "event_type"),
    (_WB["is_light"], _bool_text(_EXPR["is_light"], _YES, _NO)),
    (_WB["wind_speed"], _EXPR["wind_speed"]),
    ("Wind Dir", "CAST(NULL AS STRING)"),
    ("Temp", _EXPR["feels_like"]),
    (_WB["feels_like"], _EXPR["feels_like"]),
    (_WB["pct_humidity"], _EXPR["pct_humidity"]),
] + [(_WB[b], _bool_text(_EXPR[b], _YES, _NO)) for b in S.BOOLEAN_LABELS] + [
    (_WB[c], _EXPR[c]) for c in S.CATEGORICAL_LABELS
] + [("Notes", "'ok'"), ("Feel", "'fine'"), ("Extra", "'cut'")]

_CLEAN = [f.name for f in S.CLEAN_SCHEMA.fields]


def _quoted(spec):
    return [(f"`{n}`", e) for n, e in spec]


def _text_sources_sql() -> str:
    cols = ", ".join(_CLEAN)
    return f"""WITH s AS ({_SCEN})
SELECT row_id, 'log' AS source, {cols} FROM s WHERE event_type IN {_LOG_TYPES}
UNION ALL
SELECT row_id, 'workbook' AS source, {cols} FROM s WHERE (event_type IN {_LOG_TYPES}) IS NOT TRUE"""


@register("text_sources", _text_sources_sql())
def text_sources(spark, sf_dir):
    """S1-S3 + U1: event scenarios written as an activity-log CSV family and
    as a workbook export (sheet headers, Yes/No, empty rows, extra columns),
    each in files of several column orders, then read back through the log reader (all CSVs of the family) and the
    workbook reader, and unioned by name."""
    e = read_table(spark, sf_dir, "events")
    base = shared_path(spark, "text_sources")
    is_log = F.coalesce(F.col("event_type").isin("view", "click", "purchase"), F.lit(False))
    log_rows = e.filter(is_log)
    # three files of the family: as declared, reversed, and with a column more
    # and columns less; and another table in the same folder
    part = F.pmod(F.col("event_id"), F.lit(3))
    layouts = [_LOG_FILE, _LOG_FILE[::-1], [("note", "'extra'"), *[c for c in _LOG_FILE if c[0] not in ("location", "dow")]]]
    for i, layout in enumerate(layouts):
        spark_view(log_rows.filter(part == i), layout).write.option("header", True).csv(f"{base}/logs/training_{i}.csv")
    e.select("event_id", "value").write.option("header", True).csv(f"{base}/logs/readings.csv")
    wb_rows = spark_view(e.filter(~is_log), _quoted(_WORKBOOK_FILE))
    empty = e.filter(F.col("event_id") % 50 == 0).select(
        *[F.lit(None).cast("string").alias(n) for n, _ in _WORKBOOK_FILE]
    )
    sheet = wb_rows.unionByName(empty, allowMissingColumns=True)
    turned = sheet.select(*[F.col(f"`{c}`") for c in [*sheet.columns[:25][::-1], *sheet.columns[25:]]])
    odd = F.coalesce(F.col("Row") % 2 == 1, F.lit(False))
    sheet.filter(~odd).write.option("header", True).csv(f"{base}/workbook")
    turned.filter(odd).write.mode("append").option("header", True).csv(f"{base}/workbook")

    logs = FS.read_all_logs(spark, [(f"{base}/logs/*.csv", LOG_SCHEMA)]).withColumn("source", F.lit("log"))
    wb = FS.read_workbook_export(spark, f"{base}/workbook").withColumnRenamed("Row", "row_id")
    wb = wb.withColumn("row_id", F.col("row_id").cast("long")).withColumn("source", F.lit("workbook"))
    return union_all_by_name(logs, wb).select("row_id", "source", *_CLEAN)


@register("workbook_source", f"SELECT row_id, {', '.join(_CLEAN)} FROM ({_SCEN})")
def workbook_source(spark, sf_dir):
    """S3 + P1: every event scenario as a row of the activity sheet of .xlsx
    workbooks (numbers as numbers, Yes/No as text, empty rows between), stored
    as files' bytes and read back through the workbook reader."""
    from wearcast.sources import workbook as WB

    e = read_table(spark, sf_dir, "events")
    columns = [c for c, _ in _WORKBOOK_FILE][:25]
    sheet = spark_view(e, _quoted(_WORKBOOK_FILE)).select(*[f"`{c}`" for c in columns])
    empty = e.filter(F.col("event_id") % 50 == 0).select(*[F.lit(None).cast("string").alias(c) for c in columns])
    path = shared_path(spark, "workbooks")
    WB.pack_workbooks(sheet.unionByName(empty), rows_per_file=5000).write.parquet(path)
    rows = WB.activity_log(WB.parse_workbooks(spark.read.parquet(path), columns=columns))
    return rows.select(F.col("Row").cast("long").alias("row_id"), *_CLEAN)


# -- S6 / S11 / O1 / P11-P13 / U2 -------------------------------------------
_SAMPLE_COLS = ["row_id", *S.LABELS, *S.FEATURES, "Athlete", "activity"]


def _sample_sql() -> str:
    sel = []
    for c in [*S.LABELS, *S.FEATURES]:
        if c == "gloves":
            sel.append("CASE WHEN event_type = 'click' THEN CAST(NULL AS BOOLEAN) ELSE gloves END AS gloves")
        elif c == "duration":
            sel.append("CASE WHEN event_type = 'click' THEN 45.0 ELSE duration END AS duration")
        else:
            sel.append(c)
    return f"""WITH s AS ({_SCEN})
SELECT row_id, {", ".join(sel)}, 'default' AS Athlete, 'Run' AS activity FROM s"""


@register("sample_sink", _sample_sql())
def sample_sink(spark, sf_dir):
    """P11-P13 + U2 + S11 + S6: sample rows merged from outfits, forecasts
    (observation structs flattened to columns) and explicit overrides (clicks
    set the duration to 45 and clear gloves), appended to the empty template,
    written as CSV and read back."""
    s = event_scenarios(spark, sf_dir)
    outfits = s.select("row_id", *S.LABELS)
    observed = s.select("row_id", F.struct(*S.FEATURES, "bearing", "value").alias("obs"))
    forecasts = observation_row(observed)
    overrides = s.filter(F.col("event_type") == "click").select(
        "row_id", F.lit(45.0).alias("duration"), F.lit(None).cast("boolean").alias("gloves")
    )
    merged = merge_samples(outfits, forecasts, overrides)
    template = FS.sample_template(spark, [T.StructField("row_id", T.LongType())]).limit(0)
    table = append_samples(template, merged).select(*_SAMPLE_COLS)
    path = FS.write_sample_data(table, shared_path(spark, "samples"))
    schema = T.StructType(
        [T.StructField("row_id", T.LongType())]
        + [S.CLEAN_SCHEMA[c] for c in [*S.LABELS, *S.FEATURES]]
        + [T.StructField("Athlete", T.StringType()), T.StructField("activity", T.StringType())]
    )
    return FS.read_activity_csv(spark, path, schema).select(*_SAMPLE_COLS)


@register("sample_append", _sample_sql())
def sample_append(spark, sf_dir):
    """U2 on files: the sample rows of one half of the events are written,
    those of the other half appended to the same table, and all read back."""
    s = event_scenarios(spark, sf_dir)
    late = F.coalesce(F.col("event_type") == "click", F.lit(False))
    outfits = s.select("row_id", "event_type", *S.LABELS, *S.FEATURES)
    changed = outfits.withColumns({
        "duration": F.when(late, 45.0).otherwise(F.col("duration")),
        "gloves": F.when(late, F.lit(None).cast("boolean")).otherwise(F.col("gloves")),
        "Athlete": F.lit("default"),
        "activity": F.lit("Run"),
    })
    folder = shared_path(spark, "samples")
    FS.write_sample_data(changed.filter(~late).select(*_SAMPLE_COLS), folder, "kept")
    path = FS.write_sample_data(changed.filter(late).select(*_SAMPLE_COLS), folder, "kept", append=True)
    schema = T.StructType(
        [T.StructField("row_id", T.LongType())]
        + [S.CLEAN_SCHEMA[c] for c in [*S.LABELS, *S.FEATURES]]
        + [T.StructField("Athlete", T.StringType()), T.StructField("activity", T.StringType())]
    )
    return FS.read_activity_csv(spark, f"{path}/", schema).select(*_SAMPLE_COLS)


# -- S9 ---------------------------------------------------------------------
RULES_FILE = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "clothing_rules.json")
_SKY = "CASE event_id % 3 WHEN 0 THEN 'bright' WHEN 1 THEN 'overcast' END"


def _rules_values() -> str:
    with open(RULES_FILE, encoding="utf-8") as fh:
        doc = json.load(fh)
    rows = []
    for act, conds in doc.items():
        for cond, parts in conds.items():
            for part, val in parts.items():
                for item in val if isinstance(val, list) else [val]:
                    if item:
                        rows.append(f"({sql_str(act)}, {sql_str(cond)}, {sql_str(part)}, {sql_str(item)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(activity, condition, body_part, item)"


def _rules_sql() -> str:
    return f"""WITH s AS ({_SCEN}),
c AS (SELECT row_id, {_temp_sql('feels_like')} AS condition FROM s
      UNION ALL SELECT row_id, 'every outing' FROM s
      UNION ALL SELECT row_id, {_SKY.replace("event_id", "row_id")} FROM s),
r AS ({_rules_values()})
SELECT c.row_id, c.condition, r.body_part, r.item FROM c JOIN r ON c.condition = r.condition
WHERE r.activity = 'run'"""


@register("clothing_rules", _rules_sql())
def clothing_rules(spark, sf_dir):
    """The nested rules asset read from the shared folder and flattened,
    then applied to every scenario's temperature phrase, the rules for every outing
    and its sky condition."""
    with open(RULES_FILE, encoding="utf-8") as fh:
        text = fh.read()
    path = shared_path(spark, "rules")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rules = FS.read_clothing_rules(spark, path)
    s = event_scenarios(spark, sf_dir).withColumn("sky", F.expr(_SKY.replace("event_id", "row_id")))
    conds = F.array(temp_phrase("feels_like"), F.lit("every outing"), F.col("sky"))
    return outfit_from_rules(s, rules, "run", conds).select("row_id", "condition", "body_part", "item")


# -- S10 / G1-G7 / T11 / X2 -------------------------------------------------
def _scenarios_sql(seed: int = 7) -> str:
    def u(k: int, s: int = seed) -> str:
        return f"(CAST(('0x' || substr(sha256(row_id || ':{s}:{k // 8}'), {1 + 8 * (k % 8)}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"

    def between(k: int, lo: int, n: int, step: int = 1) -> str:
        return f"(CAST(floor({u(k)} * {n}) AS BIGINT) * {step} + {lo})"

    def normal(k: int, mean: float, sd: float) -> str:
        return f"round_even(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(k)})) * cos(6.283185307179586::DOUBLE * {u(k + 1)}) * {sd} + {mean}, 0) + 0.0::DOUBLE"  # no negative zero

    def one_of(options, k: int) -> str:
        return f"[{sql_list(options)}][CAST(floor({u(k)} * {len(options)}) AS BIGINT) + 1]"

    def pick(options, s: int) -> str:
        return f"[{sql_list(options)}][CAST(('0x' || substr(md5(row_id || ':{s}:0'), 1, 13)) AS BIGINT) % {len(options)} + 1]"

    common, seldom = ["clear", "wind", "fog", "cloudy", "partly-cloudy"], ["rain", "snow", "sleet"]
    whens = " ".join(f"WHEN {u(10)} * 440 < {70 * (i + 1)} THEN '{c}'" for i, c in enumerate(common))
    whens += " " + " ".join(f"WHEN {u(10)} * 440 < {350 + 30 * (i + 1)} THEN '{c}'" for i, c in enumerate(seldom))
    winds = ["N", "NNE", "NNW", "ENE", "WNW", "E", "W", "S", "SSE", "SSW", "ESE", "WSW"]
    return f"""WITH e AS (SELECT event_id AS row_id FROM events),
d AS (SELECT row_id, {between(0, 1, 11)} AS m, {between(1, 1, 27)} AS d, {between(2, 5, 16)} AS h, {between(3, 0, 10, 10)} AS p,
  {normal(4, 55.0, 20.0)} AS temp_f, LEAST(30.0, GREATEST(0.0, {normal(6, 8.0, 8.0)})) AS wind_speed, {normal(8, 55.0, 20.0)} AS hum,
  CASE {whens} ELSE 'sleet' END AS condition, {one_of(winds, 11)} AS wind_dir, {u(12)} < 0.5 AS is_light,
  GREATEST(20.0, {normal(13, 45.0, 45.0)}) AS duration, {u(15)} AS t FROM e),
g AS (SELECT *, CASE WHEN t < 2.5 / 7.0 THEN 8.0 + sqrt(t * 17.5) ELSE 15.0 - sqrt((1.0 - t) * 31.5) END AS pace_draw FROM d),
f AS (SELECT *, round_even(duration / pace_draw, 2) AS distance FROM g)
SELECT row_id, make_timestamp(2024, m, d, h, 0, 0.0) AS ts, CAST(CASE WHEN p < 20 THEN 0 WHEN p > 80 THEN 100 ELSE p END AS DOUBLE) AS precip_chance,
  temp_f, wind_speed, CASE WHEN hum < 1 THEN hum ELSE hum / 100 END AS pct_humidity, condition, wind_dir, is_light, duration, distance,
  temp_f AS feels_like, round_even(duration / distance, 2) AS pace, 'Anytown, US' AS location,
  {pick(S.OPENING_STATEMENTS, seed + 100)} AS opening, {pick(S.CLOTHING_STATEMENTS, seed + 101)} AS clothing_lead
FROM f"""


@register("scenarios", _scenarios_sql())
def scenarios(spark, sf_dir):
    """S10 + G1-G7 + M5/M6 + T11: one random scenario per event id (draws
    hashed from the id, so independent of partitioning)."""
    ids = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    return random_scenarios(ids)
