"""Observation store operators: last-write-wins per key (A5), whole-day
upsert (A6/U3), request routing (F5), freshness (F6), the cache-miss fetch
plan (J3) and the routed point lookup (J2/J7).

Scale notes: A5 is a ``groupBy`` with ``max_by`` (partial aggregation on the
map side, so a hot key collapses to one row per task before the shuffle, and
no key's rows are ever gathered in one place).  The lookups are equi-joins on
``(location_key, obs_hour)``; the store side is unique per key after A5, so
AQE may broadcast it when small at run time or split a skewed request key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S

KEYS = ["location_key", "obs_hour"]


def _lit_ts(now) -> Column:
    if isinstance(now, Column):
        return now
    if isinstance(now, str):
        return F.lit(now).cast("timestamp_ntz")
    if isinstance(now, dt.datetime):
        return F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    raise TypeError(f"unsupported time {now!r}")


# -- A5 ---------------------------------------------------------------------
def latest_per_key(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("snapshot_ts",)) -> DataFrame:
    """Keep, per key, the row that is greatest by ``order`` (the newest write);
    rows that tie in it are settled by their other columns, so the result does
    not depend on the order of work.

    The maximum of one struct, ``order`` first: one partial aggregate per
    task, one final aggregate per key."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    agg = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_latest")
    return df.groupBy(*keys).agg(agg).select(*keys, *[F.col("_latest")[c].alias(c) for c in rest])


# -- A6 / U3 ----------------------------------------------------------------
def upsert_days(
    history: DataFrame,
    fresh: DataFrame,
    day_keys: Sequence[str] = ("location_key", "obs_date"),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("snapshot_ts",),
) -> DataFrame:
    """Whole-day upsert: a day present in ``fresh`` replaces that day of
    ``history`` entirely (its hours are the fresh ones, newest write per hour);
    other days of ``history`` are kept as they are."""
    day_keys = list(day_keys)
    fresh_latest = latest_per_key(fresh, keys, order)
    # The replaced days come from the raw fresh rows (a hash aggregate on two
    # columns): the same set as the newest writes' days, without evaluating
    # the newest-write aggregate a second time.
    fresh_days = fresh.select(*day_keys).distinct()
    kept = history.join(fresh_days, on=day_keys, how="left_anti")
    return kept.unionByName(fresh_latest.select(*history.columns))


# -- F5 ---------------------------------------------------------------------
def route(when_col, now) -> Column:
    """'forecast' for times after ``now``, else 'history'."""
    w = F.col(when_col) if isinstance(when_col, str) else when_col
    return F.when(w > _lit_ts(now), F.lit("forecast")).otherwise(F.lit("history"))


# -- F6 ---------------------------------------------------------------------
def freshness_cutoff(now, hours: int = S.FORECAST_TTL_HOURS) -> Column:
    """The oldest time stamp that is still fresh at ``now``."""
    return _lit_ts(now) - F.make_dt_interval(F.lit(0), F.lit(hours))


def fresh_only(df: DataFrame, now, ts_col: str = "snapshot_ts", hours: int = S.FORECAST_TTL_HOURS) -> DataFrame:
    """Rows whose snapshot is at most ``hours`` old at ``now`` (pushed down to
    the scan as a range predicate when ``ts_col`` is a stored column)."""
    return df.filter(F.col(ts_col) >= freshness_cutoff(now, hours))


# -- J3 ---------------------------------------------------------------------
def fetch_plan(requests: DataFrame, history: DataFrame, day_keys: Sequence[str] = ("location_key", "obs_date")) -> DataFrame:
    """Days that requests need and the history store does not hold."""
    day_keys = list(day_keys)
    need = requests.select(*day_keys).distinct()
    have = history.select(*day_keys).distinct()
    return need.join(have, on=day_keys, how="left_anti")


# -- J2 / J7 ----------------------------------------------------------------
def lookup(requests: DataFrame, store: DataFrame, keys: Sequence[str] = KEYS, prefix: str = "obs_") -> DataFrame:
    """Each request row with the observation at its key (NULLs if none);
    ``found`` tells hits from misses."""
    keys = list(keys)
    vals = [c for c in store.columns if c not in keys]
    right = store.select(*keys, *[F.col(c).alias(prefix + c) for c in vals], F.lit(True).alias("_hit"))
    out = requests.join(right, on=keys, how="left")
    return out.withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def routed_lookup(
    requests: DataFrame,
    forecasts: DataFrame,
    history: DataFrame,
    now,
    when_col: str = "obs_hour",
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = (),
    ttl_hours: int | None = None,
) -> DataFrame:
    """Route each request to the forecast or the history store by its
    time, then look it up there.  Both stores hold writes: the newest per
    (kind, key) by ``order`` counts (without an order, the greatest row), so a
    request stays one row however often its hour was written.  The stores are
    tagged and unioned before that one aggregate, and its partitioning serves
    the join.  With ``ttl_hours`` only forecasts whose ``snapshot_ts`` is at
    most that old at ``now`` count (F6)."""
    cols = [c for c in forecasts.columns if c in history.columns]
    if ttl_hours is not None:
        forecasts = fresh_only(forecasts, now, "snapshot_ts", ttl_hours)
    stores = forecasts.select(*cols).withColumn("kind", F.lit("forecast")).unionByName(
        history.select(*cols).withColumn("kind", F.lit("history"))
    )
    routed = requests.withColumn("kind", route(when_col, now))
    return lookup(routed, latest_per_key(stores, ["kind", *keys], order), keys=["kind", *keys])
