"""Column builders for weather observations: humidity, feels-like, compass
direction, icon clean-up, calendar keys and epoch conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearcast import schema as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- M1 ---------------------------------------------------------------------
def humidity_fraction(c) -> Column:
    """Below 1 the value is already a fraction; otherwise it is a percent."""
    h = _col(c)
    return F.when(h < 1, h).otherwise(h / 100)


# -- M2 ---------------------------------------------------------------------
def feels_like(heat_index, wind_chill, sentinel: float = S.OBSERVATION_SENTINEL) -> Column:
    """Heat index unless it holds the sentinel, then wind chill."""
    hi = _col(heat_index)
    return F.when(hi == F.lit(float(sentinel)), _col(wind_chill)).otherwise(hi)


# -- M3 ---------------------------------------------------------------------
def compass_point(bearing) -> Column:
    """Bearing in degrees -> one of 16 compass points: int(b/22.5 + .5) mod 16.
    A missing bearing counts as 0 (north)."""
    b = F.coalesce(_col(bearing).cast("double"), F.lit(0.0))
    idx = F.pmod((b / 22.5 + 0.5).cast("int"), F.lit(16))
    return F.element_at(F.array(*[F.lit(p) for p in S.COMPASS_POINTS]), idx + 1)


# -- J5 ---------------------------------------------------------------------
def direction_name(code, compat: bool = False) -> Column:
    """Compass code -> name; unknown codes give NULL.  ``compat`` keeps only the
    12 names the original knows."""
    names = S.WIND_DIRECTION_NAMES_COMPAT if compat else S.WIND_DIRECTION_NAMES
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _col(code))


# -- T4 ---------------------------------------------------------------------
def icon_condition(icon, compat: bool = False) -> Column:
    """Weather icon -> condition name.

    Default strips a ``-day``/``-night`` suffix (``clear-day`` -> ``clear``).
    ``compat`` reproduces the original's character-set strip: trailing letters
    from {d,a,y,n,i,g,h,t} are removed, then trailing dashes
    (``cloudy`` -> ``clou``, ``rain`` -> ``r``)."""
    s = F.coalesce(_col(icon), F.lit(""))
    if compat:
        return F.regexp_replace(F.regexp_replace(s, "[daynight]+$", ""), "-+$", "")
    return F.regexp_replace(s, "-(day|night)$", "")


# -- D1-D4 ------------------------------------------------------------------
def day_name(ts) -> Column:
    return F.date_format(_col(ts), "EEEE")


def civil_hour(ts) -> Column:
    """``HH:00`` of the hour."""
    return F.date_format(_col(ts), "HH:00")


def day_key(ts) -> Column:
    """Unpadded ``y_m_d`` key of the day."""
    t = _col(ts)
    return F.concat_ws("_", F.year(t), F.month(t), F.dayofmonth(t))


def truncate_hour(ts) -> Column:
    """Start of the hour, kept as a timestamp without time zone."""
    t = _col(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


# -- D5 ---------------------------------------------------------------------
def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_to_local(epoch_s, tz: str = "UTC") -> Column:
    """Epoch seconds -> civil (wall-clock) time in ``tz``, without time zone.
    Independent of the session time zone."""
    utc_wall = F.timestamp_add("SECOND", _col(epoch_s), _epoch_ntz())
    return utc_wall if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall)


def local_to_epoch(ts, tz: str = "UTC") -> Column:
    """Civil time in ``tz`` (timestamp without time zone) -> epoch seconds."""
    t = _col(ts).cast("timestamp_ntz")
    utc_wall = t if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), t)
    return F.timestamp_diff("SECOND", _epoch_ntz(), utc_wall)
