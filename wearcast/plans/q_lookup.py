"""Queries over the store and lookup operators (A5, A6/U3/S7, F5, F6, J1-J3,
J7, T1-T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast.functions import weather as W
from wearcast.operators import store as ST
from wearcast.operators.location import parse_locations, with_coordinates
from wearcast.plans.catalog import ORACLES, register
from wearcast.session import read_table, shared_path
from wearcast.sources import day_table

NOW = "2024-01-15 00:00:00"
FORECAST_TYPES = ("view", "click", "purchase")

# Every event is an observation write of its user's place for its hour.
_OBS_SQL = """SELECT CAST(user_id AS VARCHAR) AS location_key, date_trunc('hour', ts) AS obs_hour,
  CAST(ts AS DATE) AS obs_date, ts AS snapshot_ts, event_id, value,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'forecast' ELSE 'history' END AS kind
FROM events"""
_LATEST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY snapshot_ts DESC, event_id DESC) = 1"


def _observations(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("location_key"),
        W.truncate_hour("ts").alias("obs_hour"),
        F.to_date("ts").alias("obs_date"),
        F.col("ts").alias("snapshot_ts"),
        "event_id",
        "value",
        F.when(F.col("event_type").isin(*FORECAST_TYPES), "forecast").otherwise("history").alias("kind"),
    )


# Requests: each event asks for its user's (or the next user's) place, some
# hours around its own time.
_REQ_SQL = """SELECT event_id AS row_id, CAST(user_id + event_id % 2 AS VARCHAR) AS location_key,
  date_trunc('hour', ts + to_hours(event_id % 5 - 2)) AS obs_hour,
  CAST(date_trunc('hour', ts + to_hours(event_id % 5 - 2)) AS DATE) AS obs_date
FROM events"""


def _requests(spark, sf_dir, extra=()):
    e = read_table(spark, sf_dir, "events")
    when = F.timestamp_add("HOUR", F.col("event_id") % 5 - 2, F.col("ts"))
    return e.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") + F.col("event_id") % 2).cast("string").alias("location_key"),
        W.truncate_hour(when).alias("obs_hour"),
        F.to_date(when).alias("obs_date"),
        *extra,
    )


# -- A5 ---------------------------------------------------------------------
@register(
    "hourly_last",
    f"""SELECT location_key, obs_hour, snapshot_ts, event_id, value FROM ({_OBS_SQL})
{_LATEST.format(k='location_key, obs_hour')}""",
)
def hourly_last(spark, sf_dir):
    """A5: newest write per (place, hour)."""
    obs = _observations(spark, sf_dir).select("location_key", "obs_hour", "snapshot_ts", "event_id", "value")
    return ST.latest_per_key(obs, order=("snapshot_ts", "event_id"))


# -- J2 / J7 / F5 -----------------------------------------------------------
@register(
    "observation_lookup",
    f"""WITH st AS (SELECT * FROM ({_OBS_SQL}) {_LATEST.format(k='kind, location_key, obs_hour')}),
r AS (SELECT *, CASE WHEN obs_hour > TIMESTAMP '{NOW}' THEN 'forecast' ELSE 'history' END AS kind FROM ({_REQ_SQL}))
SELECT r.row_id, r.location_key, r.obs_hour, r.kind, st.event_id AS obs_event_id, st.value AS obs_value,
  st.snapshot_ts AS obs_snapshot_ts, st.event_id IS NOT NULL AS found
FROM r LEFT JOIN st ON r.kind = st.kind AND r.location_key = st.location_key AND r.obs_hour = st.obs_hour""",
)
def observation_lookup(spark, sf_dir):
    """F5 routing by time, then J7/J2: each request looked up in the forecast
    or history store (newest write per place and hour, A5)."""
    obs = _observations(spark, sf_dir)
    cols = ["location_key", "obs_hour", "snapshot_ts", "event_id", "value"]
    forecasts = obs.filter(F.col("kind") == "forecast").select(*cols)
    history = obs.filter(F.col("kind") == "history").select(*cols)
    req = _requests(spark, sf_dir).drop("obs_date")
    out = ST.routed_lookup(req, forecasts, history, NOW, order=("snapshot_ts", "event_id"))
    return out.select(
        "row_id", "location_key", "obs_hour", "kind", "obs_event_id", "obs_value", "obs_snapshot_ts", "found"
    )


@register("store_lookup", ORACLES["observation_lookup"])
def store_lookup(spark, sf_dir):
    """J7 + A5 over a bucketed store: one half of the writes is stored by
    (kind, place, hour), the other half added to it, and every request looked
    up without shuffling the store."""
    from wearcast.sources import observation_store as OS

    obs = _observations(spark, sf_dir).select("kind", "location_key", "obs_hour", "snapshot_ts", "event_id", "value")
    order, late = ("snapshot_ts", "event_id"), F.col("event_id") % 2 == 1
    part = {(k, b): obs.filter((F.col("kind") == k) & (late == F.lit(b))).drop("kind") for k in ("forecast", "history") for b in (False, True)}
    table = OS.write_store(part["forecast", False], part["history", False], 8, order)
    for kind in ("forecast", "history"):
        OS.append_store(table, part[kind, True], kind, order)
    out = OS.store_lookup(_requests(spark, sf_dir).drop("obs_date"), table, NOW, order=order)
    return out.select("row_id", "location_key", "obs_hour", "kind", "obs_event_id", "obs_value", "obs_snapshot_ts", "found")


# -- J3 ---------------------------------------------------------------------
@register(
    "fetch_plan",
    f"""WITH h AS (SELECT * FROM ({_OBS_SQL}) WHERE kind = 'history')
SELECT DISTINCT r.location_key, r.obs_date FROM ({_REQ_SQL}) r
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.location_key = r.location_key AND h.obs_date = r.obs_date)""",
)
def fetch_plan(spark, sf_dir):
    """(place, day) pairs requested but missing from the history store."""
    history = _observations(spark, sf_dir).filter(F.col("kind") == "history")
    return ST.fetch_plan(_requests(spark, sf_dir), history)


# -- F6 ---------------------------------------------------------------------
@register(
    "fresh_snapshots",
    f"""SELECT event_id AS row_id, user_id, ts AS snapshot_ts FROM events
WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR""",
)
def fresh_snapshots(spark, sf_dir):
    """snapshots at most 12 hours old at a fixed 'now' (the predicate
    reaches the Parquet scan)."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("snapshot_ts")
    )
    return ST.fresh_only(e, NOW, "snapshot_ts", 12)


# -- A6 / U3 / S7 -----------------------------------------------------------
@register(
    "day_upsert",
    f"""WITH o AS ({_OBS_SQL}),
h AS (SELECT * FROM o WHERE kind = 'forecast' {_LATEST.format(k='location_key, obs_hour')}),
f AS (SELECT * FROM o WHERE kind = 'history' {_LATEST.format(k='location_key, obs_hour')}),
fd AS (SELECT DISTINCT location_key, obs_date FROM f)
SELECT location_key, obs_date, obs_hour, snapshot_ts, event_id, value FROM h
WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.location_key = h.location_key AND fd.obs_date = h.obs_date)
UNION ALL
SELECT location_key, obs_date, obs_hour, snapshot_ts, event_id, value FROM f""",
)
def day_upsert(spark, sf_dir):
    """S7 + A6: one half of the writes (newest per hour) opens a store of
    days; the other half is upserted into it, which writes its own days only;
    the store is read back."""
    obs = _observations(spark, sf_dir).select("kind", "location_key", "obs_date", "obs_hour", "snapshot_ts", "event_id", "value")
    base, latest = shared_path(spark, "day_store"), ("snapshot_ts", "event_id")
    for kind in ("forecast", "history"):
        half = obs.filter(F.col("kind") == kind).drop("kind")
        day_table.upsert(half, base, order=latest)
    return day_table.read(spark, base, half.schema)


# -- T1-T3 ------------------------------------------------------------------
_NK = "CAST(c_nationkey AS STRING)"
_ST = "substr('ARTXOKMOKS', 1 + 2 * (c_nationkey % 5), 2)"
_ZIP = "CAST(72700 + c_nationkey AS STRING)"
_PLACE = (
    f"CASE c_custkey % 6 WHEN 0 THEN 'Town' || {_NK} || ', ' || {_ST} "
    f"WHEN 1 THEN ' Town' || {_NK} || ',' || {_ST} "
    f"WHEN 2 THEN {_ZIP} "
    f"WHEN 3 THEN ' ' || {_ZIP} || ' ' "
    f"WHEN 4 THEN 'Town' || {_NK} || ', ' || {_ST} || ' ' "
    f"ELSE 'New Town' || {_NK} || ',  ' || {_ST} END"
)
_RE = "^([\\w\\s]+),\\s*(\\w{2})$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_PARSED_SQL = f"""WITH c AS (SELECT c_custkey, c_nationkey, {_PLACE} AS place FROM customer),
p AS (SELECT c_custkey, c_nationkey, place, regexp_full_match(place, '{_RE}') AS is_city FROM c),
q AS (SELECT c_custkey, c_nationkey, place,
  CASE WHEN is_city THEN {_strip(f"regexp_extract(place, '{_RE}', 1)")} END AS city,
  CASE WHEN is_city THEN {_strip(f"regexp_extract(place, '{_RE}', 2)")} END AS state,
  CASE WHEN NOT is_city THEN {_strip('place')} END AS zipcode FROM p)"""


@register(
    "location_parse",
    f"""{_PARSED_SQL}
SELECT c_custkey, place, city, state, zipcode,
  CASE WHEN zipcode IS NULL THEN state || '/' || city ELSE zipcode END AS location_key,
  CASE WHEN zipcode IS NULL THEN state || '_' || city ELSE zipcode END AS key_underscore,
  CASE WHEN zipcode IS NULL THEN city || ',' || state ELSE zipcode END AS location_name
FROM q""",
)
def location_parse(spark, sf_dir):
    """Free-text places -> city/state or zipcode, keys and names."""
    from wearcast.functions.parsing import location_key

    c = read_table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PLACE} AS place")
    p = parse_locations(c, "place", sep="/")
    p = p.withColumn("key_underscore", location_key(F.struct("city", "state", "zipcode"), "_"))
    return p.select("c_custkey", "place", "city", "state", "zipcode", "location_key", "key_underscore", "location_name")



_COORD_ROWS = [
    ("location", "substr('ARTXOKMOKS', 1 + 2 * (n_nationkey % 5), 2) || '-Town' || CAST(n_nationkey AS STRING)"),
    ("latitude", "30.0 + n_nationkey * 0.5"),
    ("longitude", "-90.0 - n_regionkey"),
]
_ZIP_ROWS = [
    ("location", "CAST(72700 + n_nationkey AS STRING)"),
    ("latitude", "30.0 + n_nationkey * 0.5"),
    ("longitude", "-90.0 - n_regionkey"),
]


def _coords_sql() -> str:
    a = ", ".join(f"CAST({e} AS {'VARCHAR' if n == 'location' else 'DOUBLE'}) AS {n}" for n, e in _COORD_ROWS)
    b = ", ".join(f"CAST({e} AS {'VARCHAR' if n == 'location' else 'DOUBLE'}) AS {n}" for n, e in _ZIP_ROWS)
    return f"SELECT {a} FROM nation UNION ALL SELECT {b} FROM nation"


@register(
    "coordinates",
    f"""{_PARSED_SQL},
k AS (SELECT c_custkey, CASE WHEN zipcode IS NULL THEN state || '-' || city ELSE zipcode END AS coord_key FROM q),
d AS ({_coords_sql()})
SELECT k.c_custkey, k.coord_key, d.latitude, d.longitude, d.location IS NOT NULL AS found
FROM k LEFT JOIN d ON k.coord_key = d.location""",
)
def coordinates(spark, sf_dir):
    """S5 + J1: a coordinate table derived from the nations is written as CSV
    and read back through the coordinate source (keys stay text); each
    customer's parsed place, keyed ``ST-City``/zip, is joined to it
    (broadcast only after a bounded size check)."""
    from wearcast.sources.files import read_coordinates

    nation = read_table(spark, sf_dir, "nation")
    sel = lambda rows: [
        f"CAST({e} AS {'STRING' if n == 'location' else 'DOUBLE'}) AS {n}" for n, e in rows
    ]
    path = shared_path(spark, "coordinates")
    nation.selectExpr(*sel(_COORD_ROWS)).unionByName(nation.selectExpr(*sel(_ZIP_ROWS))).write.option(
        "header", True
    ).csv(path)
    coords = read_coordinates(spark, path)
    c = read_table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PLACE} AS place")
    p = parse_locations(c, "place", sep="-").withColumnRenamed("location_key", "coord_key")
    out = with_coordinates(p.select("c_custkey", "coord_key"), coords, key_col="coord_key")
    return out.select("c_custkey", "coord_key", "latitude", "longitude", "found")
