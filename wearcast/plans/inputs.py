"""Stand-in inputs built from the driver's tables.

The driver's tables hold no weather or outfit logs, so each query first maps
rows of ``events`` (or ``lineitem``) to rows in the schema our operators
expect.  These views only *shape* input: they compute nothing the operators
compute.  Each view is declared once as a list of ``(column, SQL expression)``
pairs that both Spark and DuckDB evaluate identically, so the oracle sees
exactly the input Spark sees.  Every row of the source table becomes one row
of the view, so the work grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from wearcast import schema as S
from wearcast.session import read_table


def _case(key_sql: str, values: list) -> str:
    """``CASE key WHEN 0 THEN v0 ... END``; a None value maps to NULL."""
    parts = []
    for i, v in enumerate(values):
        lit = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        parts.append(f"WHEN {i} THEN {lit}")
    return f"CASE {key_sql} " + " ".join(parts) + " END"


# Activity-log scenario per event: features, a label set with 'None', NULL and
# out-of-domain values, a location per user and the event's own time.
EVENT_SCENARIO = [
    ("row_id", "event_id"),
    ("user_id", "user_id"),
    ("ts", "ts"),
    ("event_type", "event_type"),
    ("value", "value"),
    ("feels_like", "CAST((event_id * 7) % 120 - 5 AS DOUBLE)"),
    ("wind_speed", "CAST((event_id * 13) % 35 AS DOUBLE)"),
    ("pct_humidity", "CAST((event_id * 29) % 103 AS DOUBLE)"),
    ("duration", "CAST(20 + (event_id * 17) % 160 AS DOUBLE)"),
    ("is_light", "(event_id % 5 <> 0)"),
    ("bearing", "CAST((event_id * 37) % 360 AS DOUBLE)"),
    ("outer_layer", _case("(event_id * 3) % 7", S.LAYER_OPTIONS + [None, "Tank"])),
    ("base_layer", _case("(user_id * 3 + event_id) % 7", S.LAYER_OPTIONS + [None, "Tank"])),
    ("jacket", _case("event_id % 11", S.JACKET_OPTIONS + [None, "Poncho"])),
    ("lower_body", _case("(event_id * 3 + 2) % 6", S.LEG_OPTIONS + [None])),
    ("shoe_cover", _case("event_id % 4", S.SHOE_COVER_OPTIONS + [None])),
    ("ears_hat", "(event_id % 3 = 0)"),
    ("gloves", "CASE WHEN event_id % 9 = 4 THEN NULL ELSE event_id % 4 = 1 END"),
    ("heavy_socks", "(event_id % 6 < 2)"),
    ("arm_warmers", "(event_id % 7 = 3)"),
    ("face_cover", "(event_id % 10 = 0)"),
    (
        "activity",
        "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'Run' "
        "WHEN event_type = 'signup' THEN 'Roadbike' ELSE NULL END",
    ),
    ("athlete", "CONCAT('athlete_', CAST(user_id % 20 AS STRING))"),
]


# Decision-tree stand-in per line item: features from small integer domains,
# labels set by axis-aligned threshold rules a depth-4 tree can represent.
_Q = "CAST(l_quantity AS DOUBLE)"
_W = "CAST(ROUND(l_discount * 100) AS DOUBLE)"
_H = "CAST(ROUND(l_tax * 100) AS DOUBLE) / 10"
_D = "CAST(l_linenumber * 15 AS DOUBLE)"
LABEL_RULES = {
    "outer_layer": f"CASE WHEN {_Q} < 20 THEN 'Sweatshirt-Heavy' WHEN {_Q} < 35 THEN 'Long-sleeve' ELSE 'Short-sleeve' END",
    "base_layer": f"CASE WHEN {_Q} < 12 THEN 'Long-sleeve' ELSE 'None' END",
    "jacket": f"CASE WHEN {_W} >= 6 THEN (CASE WHEN {_Q} < 25 THEN 'Wind-Warm' ELSE 'Wind' END) ELSE 'None' END",
    "lower_body": f"CASE WHEN {_Q} < 15 THEN 'Insulated tights' WHEN {_Q} < 30 THEN 'Long tights' "
    f"WHEN {_Q} < 40 THEN 'Capri' ELSE 'Shorts' END",
    "shoe_cover": f"CASE WHEN {_Q} < 8 AND {_H} >= 0.5 THEN 'Toe Cover' ELSE 'None' END",
    "ears_hat": f"({_Q} < 25)",
    "gloves": f"({_Q} < 22)",
    "heavy_socks": f"({_Q} < 18 AND {_D} >= 60)",
    "arm_warmers": f"({_Q} >= 20 AND {_Q} < 30)",
    "face_cover": f"({_Q} < 5 AND {_W} >= 4)",
}
LINEITEM_TRAINING = [
    ("row_id", "l_orderkey * 8 + l_linenumber"),
    ("feels_like", _Q),
    ("wind_speed", _W),
    ("pct_humidity", _H),
    ("duration", _D),
    ("is_light", "(l_returnflag <> 'R')"),
] + list(LABEL_RULES.items())


def with_plain_round(spec) -> list[tuple[str, str]]:
    """The same columns for Spark, whose ROUND goes through the decimal text of
    a number: ordinary numbers are rounded half up by comparing the fraction,
    which is exact."""

    def plain(found: re.Match) -> str:
        x = f"({found[1]})"
        whole = f"CAST(CAST({x} AS BIGINT) AS DOUBLE)"
        return f"CASE WHEN {x} >= 0 AND {x} < 1e15 THEN {whole} + CASE WHEN {x} - {whole} >= 0.5D THEN 1 ELSE 0 END ELSE ROUND({x}) END"

    return [(name, re.sub(r"ROUND\(([\w* ]+)\)", plain, expr)) for name, expr in spec]


def spark_view(df: DataFrame, spec) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in spec])


def sql_view(table: str, spec) -> str:
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in spec)
    return f"SELECT\n  {cols}\nFROM {table}"


def event_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(read_table(spark, sf_dir, "events"), EVENT_SCENARIO)


def event_scenarios_sql() -> str:
    return sql_view("events", EVENT_SCENARIO)


def lineitem_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(read_table(spark, sf_dir, "lineitem"), LINEITEM_TRAINING)


def lineitem_training_sql() -> str:
    return sql_view("lineitem", LINEITEM_TRAINING)
