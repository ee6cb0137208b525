"""Column builders for parsing raw values: booleans, option domains,
sentinels, locations, hours and relative dates.

Each function maps Column(s) to a Column built only from native Spark
expressions, so everything stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearcast import schema as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- P6 ---------------------------------------------------------------------
def parse_bool(c) -> Column:
    """Text -> boolean: Yes/yes/y/Y and TRUE/True/true are true, No/no/n/N and
    FALSE/False/false are false, anything else is NULL.  Boolean input passes."""
    c = _col(c)
    s = c.cast("string")
    return (
        F.when(s.isin(S.TRUE_WORDS + S.TRUE_NATIVE), F.lit(True))
        .when(s.isin(S.FALSE_WORDS + S.FALSE_NATIVE), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def yes_no(c) -> Column:
    """P10: boolean -> 'Yes'/'No' category (NULL stays NULL)."""
    c = _col(c)
    return F.when(c, F.lit("Yes")).when(~c, F.lit("No"))


# -- P7 / O2 ----------------------------------------------------------------
def in_domain(c, options: list[str]) -> Column:
    """Closed ordered category: value if it is one of ``options``, else NULL."""
    c = _col(c)
    return F.when(c.isin(options), c)


def domain_ordinal(c, options: list[str]) -> Column:
    """0-based position of the value in its ordered domain (NULL if outside)."""
    c = _col(c)
    pos = F.array_position(F.array(*[F.lit(o) for o in options]), c)
    return F.when(pos > 0, pos - 1).cast("int")


# -- M4 / V2 ----------------------------------------------------------------
def sentinel_null(c, threshold: float = S.READING_SENTINEL) -> Column:
    """Number or NULL: non-numeric text and values <= threshold become NULL."""
    v = _col(c).try_cast("double")
    return F.when(v > F.lit(float(threshold)), v)


def try_number(c) -> Column:
    """V2: the value as a double, NULL where it is not numeric."""
    return _col(c).try_cast("double")


# -- T1-T3 ------------------------------------------------------------------
_CITY_STATE = r"(?U)^([\w\s]+),\s*(\w{2})$"
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip_space(c) -> Column:
    """Remove leading/trailing whitespace of any kind (SQL trim only removes blanks)."""
    return F.regexp_replace(_col(c), _EDGE_SPACE, "")


def parse_location(c) -> Column:
    """``City, ST`` -> struct(city, state, zipcode=NULL); anything else ->
    struct(NULL, NULL, zipcode = stripped text)."""
    s = _col(c)
    is_city = s.rlike(_CITY_STATE)
    city = F.when(is_city, strip_space(F.regexp_extract(s, _CITY_STATE, 1)))
    state = F.when(is_city, strip_space(F.regexp_extract(s, _CITY_STATE, 2)))
    zipcode = F.when(~is_city, strip_space(s))
    return F.struct(city.alias("city"), state.alias("state"), zipcode.alias("zipcode"))


def location_key(loc, sep: str = "/") -> Column:
    """``ST<sep>City`` for a city location, else the zipcode."""
    loc = _col(loc)
    return F.when(
        loc["zipcode"].isNull(), F.concat(loc["state"], F.lit(sep), loc["city"])
    ).otherwise(loc["zipcode"])


def location_name(loc) -> Column:
    """``City,ST`` for a city location, else the zipcode."""
    loc = _col(loc)
    return F.when(loc["zipcode"].isNull(), F.concat(loc["city"], F.lit(","), loc["state"])).otherwise(
        loc["zipcode"]
    )


# -- D6-D8 ------------------------------------------------------------------
_HOUR_FORM = r"^([0-9]{1,2})(:[0-9]{2})?(AM|PM)?$"


def parse_hour(c) -> Column:
    """Hour of day from ``10am``, ``10 PM``, ``10:30pm``, ``22:00``, ``22``.

    Spaces are removed and case folded; with an AM/PM marker the hour is
    12-hour (12AM = 0, 12PM = 12), otherwise 24-hour.  Unparseable -> NULL
    (a text that does not match extracts '', which is no number)."""
    s = F.upper(F.regexp_replace(_col(c), r"\s+", ""))
    h = F.regexp_extract(s, _HOUR_FORM, 1).try_cast("int")
    marker = F.regexp_extract(s, _HOUR_FORM, 3)
    twelve = (h >= 1) & (h <= 12)
    return (
        F.when(marker == "", F.when(h <= 23, h))
        .when(twelve, F.pmod(h, F.lit(12)) + F.when(marker == "PM", F.lit(12)).otherwise(F.lit(0)))
    )


_DAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def resolve_date(word, ref_date) -> Column:
    """``today`` -> ref, ``tomorrow`` -> ref + 1, a weekday abbreviation ->
    the next such day on or after ref (today counts).  Else NULL."""
    w = _col(word)
    ref = ref_date if isinstance(ref_date, Column) else F.lit(ref_date)
    if isinstance(ref_date, (_dt.date, _dt.datetime)):
        ref = F.lit(ref_date).cast("date")
    ref = ref.cast("date")
    return (
        F.when(w == "today", ref)
        .when(w == "tomorrow", F.date_add(ref, 1))
        .when(w.isin(_DAY_ABBR), F.call_function("next_day", F.date_sub(ref, 1), w))
    )


def combine_date_hour(date_col, hour_col) -> Column:
    """Date + hour -> timestamp without time zone."""
    d = _col(date_col)
    return F.make_timestamp_ntz(
        F.year(d), F.month(d), F.dayofmonth(d), _col(hour_col), F.lit(0), F.lit(0)
    )
