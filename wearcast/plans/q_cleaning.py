"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.parsing import parse_bool
from wearcast.operators import cleaning as C
from wearcast.plans.catalog import register, sql_list
from wearcast.plans.inputs import event_scenarios, event_scenarios_sql

_SCEN = event_scenarios_sql()


def _none(c: str) -> str:
    return f"({c} IS NOT DISTINCT FROM 'None')"


_FIX_LAYERS_SQL = f"""
WITH s AS ({_SCEN})
SELECT row_id, jacket,
  CASE WHEN NOT {_none('jacket')} AND NOT {_none('outer_layer')} AND {_none('base_layer')} THEN 'None'
       WHEN {_none('jacket')} AND {_none('outer_layer')} AND NOT {_none('base_layer')} THEN base_layer
       ELSE outer_layer END AS outer_layer,
  CASE WHEN NOT {_none('jacket')} AND NOT {_none('outer_layer')} AND {_none('base_layer')} THEN outer_layer
       WHEN {_none('jacket')} AND {_none('outer_layer')} AND NOT {_none('base_layer')} THEN 'None'
       ELSE base_layer END AS base_layer
FROM s
WHERE NOT ({_none('outer_layer')} AND {_none('base_layer')})
"""


@register("fix_layers", _FIX_LAYERS_SQL)
def fix_layers(spark, sf_dir):
    """P9 + F3: layer normalisation over every event scenario."""
    s = event_scenarios(spark, sf_dir)
    return C.fix_layers(s).select("row_id", "jacket", "outer_layer", "base_layer")


def _bin_sql(x: str) -> str:
    e, n = S.LENGTH_BIN_EDGES, S.LENGTH_BIN_NAMES
    whens = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{name}'" for lo, hi, name in zip(e[:-1], e[1:], n))
    return f"CASE {whens} END"


@register(
    "length_bin",
    f"""WITH s AS ({_SCEN})
SELECT row_id, {_bin_sql('duration')} AS activity_length, {_bin_sql('value * 2')} AS value_bin FROM s""",
)
def length_bin(spark, sf_dir):
    """Right-closed activity-length bins on durations and on value*2."""
    s = event_scenarios(spark, sf_dir)
    return s.select(
        "row_id",
        C.length_bin("duration").alias("activity_length"),
        C.length_bin(F.col("value") * 2).alias("value_bin"),
    )


def _domain_sql(c: str, dom: list[str]) -> str:
    return f"CASE WHEN {c} IN ({sql_list(dom)}) THEN {c} END AS {c}"


def _ordinal_sql(c: str, dom: list[str]) -> str:
    whens = " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(dom))
    return f"CAST(CASE {c} {whens} END AS INTEGER) AS {c}_ord"


@register(
    "category_domain",
    f"""WITH s AS ({_SCEN})
SELECT row_id, {", ".join(_domain_sql(c, d) for c, d in S.CATEGORICAL_DOMAINS.items())},
  {", ".join(_ordinal_sql(c, d) for c, d in S.CATEGORICAL_DOMAINS.items())}
FROM s""",
)
def category_domain(spark, sf_dir):
    """P7 + O2: closed ordered domains and ordinals of the five categorical labels."""
    s = event_scenarios(spark, sf_dir)
    out = C.apply_domains(s, ordinals=True)
    cols = list(S.CATEGORICAL_DOMAINS) + [f"{c}_ord" for c in S.CATEGORICAL_DOMAINS]
    return out.select("row_id", *cols)


_KEEP = ["row_id"] + S.LABELS + S.FEATURES
_NOT_ALL_NULL = " AND ".join(f"{c} IS NULL" for c in ["row_id", "activity", *S.LABELS, *S.FEATURES])


@register(
    "fill_prune_filter",
    f"""WITH s AS ({_SCEN})
SELECT row_id, {", ".join(c if c != "gloves" else "COALESCE(gloves, false) AS gloves" for c in S.LABELS + S.FEATURES)}
FROM s
WHERE activity = 'Run' AND NOT ({_NOT_ALL_NULL})""",
)
def fill_prune_filter(spark, sf_dir):
    """Drop bookkeeping columns, fill missing values, keep one
    activity, drop empty rows, keep features + labels."""
    s = event_scenarios(spark, sf_dir).select("row_id", "activity", "athlete", "ts", *S.LABELS, *S.FEATURES)
    s = C.drop_columns(s, ["athlete", "ts", "Athlete", "activity_date"])
    s = C.fill_missing(s)
    s = C.filter_activity(s, S.RUN)
    s = C.drop_empty_rows(s)
    return C.keep_columns(s, _KEEP)


_ANSWERS = ["Yes", "yes", "y", "Y", "No", "no", "n", "N", "TRUE", "false", "maybe", None]
_ANSWER_SQL = "CASE event_id % 12 " + " ".join(
    f"WHEN {i} THEN {'NULL' if a is None else repr(a)}" for i, a in enumerate(_ANSWERS)
) + " END"


@register(
    "parse_bool",
    f"""WITH a AS (SELECT event_id AS row_id, {_ANSWER_SQL} AS answer FROM events)
SELECT row_id, answer,
  CASE WHEN answer IN ({sql_list(S.TRUE_WORDS + S.TRUE_NATIVE)}) THEN true
       WHEN answer IN ({sql_list(S.FALSE_WORDS + S.FALSE_NATIVE)}) THEN false END AS answer_bool
FROM a""",
)
def parse_bool_query(spark, sf_dir):
    """Yes/No and TRUE/FALSE spellings parsed to booleans."""
    from wearcast.session import read_table

    a = read_table(spark, sf_dir, "events").selectExpr("event_id AS row_id", f"{_ANSWER_SQL} AS answer")
    return a.select("row_id", "answer", parse_bool("answer").alias("answer_bool"))


@register(
    "yes_no",
    f"""WITH s AS ({_SCEN})
SELECT row_id, {", ".join(f"CASE WHEN {c} THEN 'Yes' WHEN NOT {c} THEN 'No' END AS {c}" for c in S.BOOLEAN_LABELS)}
FROM s""",
)
def yes_no(spark, sf_dir):
    """P10: boolean labels as Yes/No categories."""
    s = event_scenarios(spark, sf_dir).select("row_id", *S.BOOLEAN_LABELS)
    return C.booleans_to_yes_no(s)


_CLEAN_COLS = []
for _c in ["row_id"] + S.LABELS + S.FEATURES:
    _CLEAN_COLS.append(_c)


def _clean_sql() -> str:
    fixed_outer = (
        f"CASE WHEN NOT {_none('jacket')} AND NOT {_none('outer_layer')} AND {_none('base_layer')} THEN 'None' "
        f"WHEN {_none('jacket')} AND {_none('outer_layer')} AND NOT {_none('base_layer')} THEN base_layer "
        "ELSE outer_layer END"
    )
    fixed_base = (
        f"CASE WHEN NOT {_none('jacket')} AND NOT {_none('outer_layer')} AND {_none('base_layer')} THEN outer_layer "
        f"WHEN {_none('jacket')} AND {_none('outer_layer')} AND NOT {_none('base_layer')} THEN 'None' "
        "ELSE base_layer END"
    )
    sel = []
    for c in _CLEAN_COLS:
        if c in S.CATEGORICAL_DOMAINS:
            src = {"outer_layer": "fo", "base_layer": "fb"}.get(c, c)
            sel.append(f"CASE WHEN {src} IN ({sql_list(S.CATEGORICAL_DOMAINS[c])}) THEN {src} END AS {c}")
        elif c == "gloves":
            sel.append("COALESCE(gloves, false) AS gloves")
        elif c == "pct_humidity":
            sel.append("CASE WHEN pct_humidity < 1 THEN pct_humidity ELSE pct_humidity / 100 END AS pct_humidity")
        else:
            sel.append(c)
    return f"""WITH s AS ({_SCEN}),
f AS (SELECT *, {fixed_outer} AS fo, {fixed_base} AS fb FROM s
      WHERE NOT ({_none('outer_layer')} AND {_none('base_layer')}))
SELECT {", ".join(sel)} FROM f WHERE activity = 'Run'"""


@register("clean_log", _clean_sql())
def clean_log(spark, sf_dir):
    """The whole clean-up in order (fill, humidity scale, layers, domains,
    activity, drops, keep) over every event scenario."""
    s = event_scenarios(spark, sf_dir)
    return C.clean_activity_log(s, activity=S.RUN, features=["row_id"] + S.FEATURES)


@register(
    "drop_metric",
    f"""WITH s AS ({_SCEN})
SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE {_none('outer_layer')} AND {_none('base_layer')}) AS n_dropped,
  count(*) FILTER (WHERE NOT ({_none('outer_layer')} AND {_none('base_layer')})) AS n_kept
FROM s""",
)
def drop_metric(spark, sf_dir):
    """F4 + A7: row count and rows dropped for lacking any layer."""
    return C.drop_counts(event_scenarios(spark, sf_dir))


@register(
    "rename_union",
    """SELECT * FROM (
  SELECT o_orderkey AS row_id, CAST(o_totalprice AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS duration,
         o_orderpriority AS condition, CAST(NULL AS VARCHAR) AS wind_dir
  FROM orders
  UNION ALL
  SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(NULL AS DOUBLE) AS distance,
         CAST(l_quantity AS DOUBLE) AS duration, CAST(NULL AS VARCHAR) AS condition,
         l_returnflag || l_linestatus AS wind_dir
  FROM lineitem
)""",
)
def rename_union(spark, sf_dir):
    """P1 + U1: two tables with workbook-style headers renamed to canonical
    names, then unioned by name with missing columns as NULL."""
    from wearcast.session import read_table

    a = read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS `Row`", "o_totalprice AS Distance", "o_orderpriority AS Condition"
    )
    b = read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS `Row`",
        "CAST(l_quantity AS DOUBLE) AS `Length of activity (min)`",
        "l_returnflag || l_linestatus AS `Wind Dir`",
    )
    renames = {**S.WORKBOOK_RENAMES, "Row": "row_id"}
    a = C.rename_workbook_headers(a, renames)
    b = C.rename_workbook_headers(b, renames)
    return C.union_all_by_name(a, b).select("row_id", "distance", "duration", "condition", "wind_dir")
