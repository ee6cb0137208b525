"""Queries over descriptions and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import cleaning as C
from wearcast.operators.reply import (
    add_replies,
    description_rows,
    label_items,
    lookup_descriptions,
    profile,
    resolve_descriptions,
    with_option_ordinal,
)
from wearcast.plans.catalog import register, sql_str
from wearcast.plans.inputs import event_scenarios, event_scenarios_sql
from wearcast.plans.q_cleaning import _clean_sql
from wearcast.session import read_table

_SCEN = event_scenarios_sql()


def _values_sql(table: dict) -> str:
    rows = []
    for k, v in table.items():
        d, a = (None, None) if v is None else v
        rows.append(f"({sql_str(k)}, {sql_str(d)}, {sql_str(a)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(item, description, alt_description)"


_BASE = {S.ALIGNED_KEY.get(k, k): v for k, v in S.BASE_DESCRIPTIONS.items()}
_RUN = {S.ALIGNED_KEY.get(k, k): v for k, v in S.RUN_OVERRIDES_COMPAT.items()}


@register(
    "descriptions",
    f"""WITH s AS ({_SCEN}),
b AS ({_values_sql(_BASE)}),
o AS ({_values_sql(_RUN)}),
r AS (SELECT COALESCE(o.item, b.item) AS item,
        CASE WHEN o.item IS NOT NULL THEN o.description ELSE b.description END AS description,
        CASE WHEN o.item IS NOT NULL THEN o.alt_description ELSE b.alt_description END AS alt_description
      FROM b FULL OUTER JOIN o ON b.item = o.item),
i AS ({" UNION ALL ".join(f"SELECT row_id, '{c}' AS label, {c} AS item FROM s" for c in S.CATEGORICAL_LABELS)})
SELECT i.row_id, i.label, i.item, r.description, r.alt_description FROM i LEFT JOIN r ON i.item = r.item""",
)
def descriptions(spark, sf_dir):
    """J4 + X1: the running profile resolved from base and override tables
    (override first, explicit deletions), then every outfit item of every
    scenario looked up in it (broadcast join of a bounded profile table)."""
    s = event_scenarios(spark, sf_dir)
    resolved = resolve_descriptions(description_rows(spark, _BASE), description_rows(spark, _RUN))
    items = label_items(s, S.CATEGORICAL_LABELS)
    return lookup_descriptions(items, resolved).select("row_id", "label", "item", "description", "alt_description")


# -- X1 over several generations ----------------------------------------------
# A profile per customer, which inherits from the nation's, the region's and
# the base one; each mentions some of nine items and deletes a few.
_FAMILY = {
    "customer": ("'c' || CAST(c_custkey AS STRING)", "'n' || CAST(c_nationkey AS STRING)", "c_custkey"),
    "nation": ("'n' || CAST(n_nationkey AS STRING)", "'r' || CAST(n_regionkey AS STRING)", "n_nationkey"),
    "region": ("'r' || CAST(r_regionkey AS STRING)", "'base'", "r_regionkey"),
}


def _mention(activity: str, key: str, item: str) -> list[tuple[str, str]]:
    return [("activity", activity), ("item", f"'item' || CAST({item} AS STRING)"),
            ("description", f"CASE WHEN {key} % 4 <> 3 THEN {activity} || ' wears ' || CAST({item} AS STRING) END"),
            ("alt_description", f"CASE WHEN {key} % 4 = 0 THEN 'other' END")]


_MENTIONS = [(t, _mention(name, key, item.format(k=key))) for t, (name, _, key) in _FAMILY.items() for item in ("{k} % 9", "({k} * 5 + 2) % 9")]
_MENTIONS.append(("nation", _mention("'base'", "(n_nationkey * 2)", "n_nationkey % 8")))


def _inherited_sql() -> str:
    mentions = " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {n}' for n, e in spec)} FROM {t}" for t, spec in _MENTIONS)
    p = {t: f"SELECT {name} AS activity, {parent} AS parent FROM {t}" for t, (name, parent, _) in _FAMILY.items()}
    return f"""WITH c AS ({p["customer"]}), n AS ({p["nation"]}), r AS ({p["region"]}),
line AS (
  SELECT activity, activity AS ancestor, 0 AS depth FROM c UNION ALL SELECT activity, parent, 1 FROM c
  UNION ALL SELECT c.activity, n.parent, 2 FROM c JOIN n ON c.parent = n.activity
  UNION ALL SELECT c.activity, r.parent, 3 FROM c JOIN n ON c.parent = n.activity JOIN r ON n.parent = r.activity
  UNION ALL SELECT activity, activity, 0 FROM n UNION ALL SELECT activity, parent, 1 FROM n
  UNION ALL SELECT n.activity, r.parent, 2 FROM n JOIN r ON n.parent = r.activity
  UNION ALL SELECT activity, activity, 0 FROM r UNION ALL SELECT activity, parent, 1 FROM r),
m AS (SELECT activity AS ancestor, item, max(struct_pack(d := description, a := alt_description)) AS x FROM (
  SELECT activity, item, coalesce(description, '') AS description, coalesce(alt_description, '') AS alt_description FROM ({mentions})) GROUP BY ALL)
SELECT activity, item, nullif(x.d, '') AS description, nullif(x.a, '') AS alt_description, depth FROM line JOIN m USING (ancestor)
QUALIFY row_number() OVER (PARTITION BY activity, item ORDER BY depth) = 1"""


@register("inherited_profiles", _inherited_sql())
def inherited_profiles(spark, sf_dir):
    """X1 + J4 over generations: every customer's, nation's and region's
    profile resolved against its ancestors, deletions kept, by one recursive
    query."""
    from functools import reduce

    from wearcast.operators.profiles import resolve_inherited
    from wearcast.plans.inputs import spark_view

    tables = {t: read_table(spark, sf_dir, t) for t in _FAMILY}
    parents = reduce(lambda a, b: a.unionByName(b), [spark_view(tables[t], [("activity", a), ("parent", p)]) for t, (a, p, _) in _FAMILY.items()])
    mentions = reduce(lambda a, b: a.unionByName(b), [spark_view(tables[t], spec) for t, spec in _MENTIONS])
    return resolve_inherited(parents, mentions)


def _list_sql(parts: list[str]) -> str:
    t = f"trim(concat_ws(', ', {', '.join(parts)}), ', ')"
    return f"CASE WHEN contains({t}, ',') THEN replace(regexp_replace({t}, ',([^,]*)$', ' and\\1'), 'and and', 'and') ELSE {t} END"


def _describe_sql(c: str, table: dict) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v[0])}" for k, v in table.items())
    return f"CASE {c} {whens} END"


# What a runner's outfit items are called, written out for the oracle.
RUN_TEXT = {
    "Sleeveless": "a sleeveless top",
    "Short-sleeve": "singlet",
    "Long-sleeve": "a long-sleeved top",
    "Sweatshirt-Heavy": "a sweatshirt or heavier long-sleeve outwear",
    "Rain": "a rain jacket",
    "Warm": "a warm jacket",
    "Wind": "a windbreaker",
    "Rain-Wind": "a water repellent windbreaker",
    "Rain-Warm": "a warm water repellent jacket",
    "Wind-Warm": "an insulated windbreaker",
    "Warm-Rain-Wind": "an water repellent, insulated windbreaker",
    "Shorts": "shorts",
    "Shorts-calf cover": "shorts with long socks or calf sleeves",
    "Capri": "capri tights",
    "Long tights": "full length tights",
    "Insulated tights": "Insulated tights",
}


def run_reply_sql(opening: str, clothing: str, labels=None) -> str:
    """The reply for a runner from columns feels_like, wind_speed and the
    labels, with the given numbers of the sentence leads."""
    from wearcast.plans.q_weather import _temp_sql, _wind_sql

    conds = _list_sql([_temp_sql("feels_like"), _wind_sql("wind_speed")])
    items = _list_sql([_describe_sql(c, {k: (v, None) for k, v in RUN_TEXT.items()}) for c in labels or S.CATEGORICAL_LABELS])
    first = f"['It looks like', 'Oh my,', 'Well,'][{opening} % 3 + 1]"
    second = ("['I suggest wearing', 'Based on the weather conditions, you should consider', "
              f"'Looks like today would be a good day to wear', 'If I were going out I''d wear'][{clothing} % 4 + 1]")
    return f"{first} || ' it is going to be ' || {conds} || '.' || chr(10) || {second} || ' ' || {items} || '. '"


def _reply_sql() -> str:
    return f"""WITH c AS (SELECT * FROM ({_clean_sql()}))
SELECT row_id, {run_reply_sql("row_id", "row_id")} AS reply
FROM c"""


@register("reply_text", _reply_sql())
def reply_text(spark, sf_dir):
    """L8 then T10: every event scenario cleaned, then turned into an English
    recommendation with the running profile (leads picked by row id)."""
    s = C.clean_activity_log(event_scenarios(spark, sf_dir), activity=S.RUN, features=["row_id"] + S.FEATURES)
    out = add_replies(s, profile(S.RUN), opening_index=F.col("row_id"), clothing_index=F.col("row_id"))
    return out.select("row_id", "reply")


# -- X3 ---------------------------------------------------------------------
def _options_sql() -> str:
    rows = []
    for lab, opts in {**S.CATEGORICAL_DOMAINS, **{b: S.BOOLEAN_OPTIONS for b in S.BOOLEAN_LABELS}}.items():
        rows += [f"('{lab}', {i}, {sql_str(o)})" for i, o in enumerate(opts)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(label, ordinal, option)"


def _items_sql() -> str:
    parts = [f"SELECT row_id, '{c}' AS label, {c} AS option FROM s" for c in S.CATEGORICAL_LABELS]
    parts += [
        f"SELECT row_id, '{b}' AS label, CASE WHEN {b} THEN 'y' WHEN NOT {b} THEN 'n' END AS option FROM s"
        for b in S.BOOLEAN_LABELS
    ]
    return " UNION ALL ".join(parts)


@register(
    "option_ordinals",
    f"""WITH s AS ({_SCEN}), i AS ({_items_sql()}), o AS ({_options_sql()})
SELECT i.row_id, i.label, i.option, CAST(o.ordinal AS INTEGER) AS ordinal
FROM i LEFT JOIN o ON i.label = o.label AND i.option = o.option""",
)
def option_ordinals(spark, sf_dir):
    """The option table (label, ordinal, option; booleans as n/y) joined
    to every label value of every scenario (a bounded table, broadcast after
    a size check)."""
    from wearcast.operators.reply import option_table

    s = event_scenarios(spark, sf_dir)
    items = label_items(s, S.CATEGORICAL_LABELS, S.BOOLEAN_LABELS, value_col="option")
    return with_option_ordinal(items, option_table(spark)).select("row_id", "label", "option", "ordinal")
