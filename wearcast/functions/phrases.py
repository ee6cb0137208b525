"""Column builders that turn conditions and predicted outfits into English.

All phrases are native expressions (CASE, concat, array_join, regexp), so a
reply for a billion rows is one codegen'd projection with no Python in it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.draws import draw
from wearcast.functions.weather import direction_name


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_text(c: Column) -> Column:
    """Value as text the way it is printed in a sentence."""
    return c.cast("string")


# -- T5 ---------------------------------------------------------------------
def temp_phrase(temp_f) -> Column:
    """cold / cool / mild / warm / very warm / hot; NULL stays NULL."""
    t = _col(temp_f)
    expr = None
    for bound, word in S.TEMP_PHRASES:
        expr = F.when(t < bound, F.lit(word)) if expr is None else expr.when(t < bound, F.lit(word))
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(S.TEMP_PHRASE_ABOVE)))


# -- T6 ---------------------------------------------------------------------
def wind_phrase(wind_speed, wind_dir=None, compat: bool = False) -> Column:
    """calm / breezy / windy / very windy; with a known direction code appends
    ``, <speed> miles per hour out of the <Direction>`` (all 16 points; with
    ``compat`` the original's 12)."""
    w = _col(wind_speed)
    expr = None
    for bound, word in S.WIND_PHRASES:
        expr = F.when(w < bound, F.lit(word)) if expr is None else expr.when(w < bound, F.lit(word))
    base = F.when(w.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(S.WIND_PHRASE_ABOVE)))
    if wind_dir is None:
        return base
    name = direction_name(_col(wind_dir), compat=compat)
    return F.when(
        name.isNotNull(), F.concat(base, F.lit(", "), _as_text(w), F.lit(" miles per hour out of the "), name)
    ).otherwise(base)


# -- T7 / T8 ----------------------------------------------------------------
def condition_phrase(condition) -> Column:
    """The weather condition is described by its own name."""
    return _col(condition)


def precipitation_phrase(_chance=None) -> Column:
    """Precipitation is never described."""
    return F.lit(None).cast("string")


def phrases_for(conditions) -> Column:
    """T8 over an array of ``struct<kind, value>`` conditions, in order."""
    return F.transform(_col(conditions), lambda c: phrase_for(c["kind"], c["value"]))


def phrase_for(condition_type, value, wind_dir=None) -> Column:
    """Dispatch on the condition type held in a column.

    ``feels_like`` -> temperature phrase, ``wind_speed`` -> wind phrase,
    ``condition`` -> itself, ``pct_precip`` and anything else -> NULL.
    ``value`` is text; numeric phrases read it as a double."""
    kind = _col(condition_type)
    v = _col(value)
    num = v.try_cast("double")
    return (
        F.when(kind == "feels_like", temp_phrase(num))
        .when(kind == "wind_speed", wind_phrase(num, wind_dir) if wind_dir is not None else wind_phrase(num))
        .when(kind == "condition", v.cast("string"))
        .otherwise(F.lit(None).cast("string"))
    )


# -- T9 ---------------------------------------------------------------------
def english_list(items) -> Column:
    """Join the non-NULL items as ``a, b and c``.

    Items are joined with ``', '``; commas and blanks are trimmed at both ends;
    the last comma (even one inside an item) becomes `` and``, and then a
    doubled ``and and`` collapses.  An empty or NULL list gives ''."""
    if isinstance(items, (list, tuple)):
        arr = F.array(*[_col(i).cast("string") for i in items])
    else:
        arr = _col(items)
    joined = F.coalesce(F.array_join(arr, ", "), F.lit(""))
    trimmed = F.btrim(joined, F.lit(", "))
    with_and = F.regexp_replace(trimmed, ",([^,]*)$", " and$1")
    return F.when(trimmed.contains(","), F.replace(with_and, F.lit("and and"), F.lit("and"))).otherwise(trimmed)


# -- T11 / X2 ---------------------------------------------------------------
def pick(options: Sequence[str], index) -> Column:
    """Element ``index mod n`` of a fixed list of options."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, F.pmod(_col(index).cast("long"), F.lit(len(options))).cast("int") + 1)


def hashed_index(row_id, seed: int) -> Column:
    """A per-row draw that does not depend on partitioning."""
    return draw(row_id, seed, 0)


def opening_prefix(index, statements: Sequence[str] = S.OPENING_STATEMENTS) -> Column:
    return F.concat(pick(statements, index), F.lit(" it is going to be "))


def clothing_prefix(index, statements: Sequence[str] = S.CLOTHING_STATEMENTS) -> Column:
    return pick(statements, index)


# -- J4 (column form) -------------------------------------------------------
def describe(item, descriptions: Mapping[str, tuple], use_alt=None) -> Column:
    """Description of an item from a resolved description table (item ->
    (description, alternative)).  Unknown items give NULL.  ``use_alt`` (a
    boolean Column) selects the alternative description."""
    it = _col(item).cast("string")
    main = F.create_map(*[x for k, v in descriptions.items() for x in (F.lit(k), F.lit(v[0]))])
    if use_alt is None:
        return F.element_at(main, it) if descriptions else F.lit(None).cast("string")
    alt_items = {k: v[1] for k, v in descriptions.items()}
    alt = F.create_map(*[x for k, v in alt_items.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    return F.when(_col(use_alt), F.element_at(alt, it)).otherwise(F.element_at(main, it))


# -- T10 --------------------------------------------------------------------
def reply(
    condition_phrases: Sequence,
    item_descriptions: Sequence,
    opening_index,
    clothing_index,
    openings: Sequence[str] = S.OPENING_STATEMENTS,
    clothing_leads: Sequence[str] = S.CLOTHING_STATEMENTS,
) -> Column:
    """``<opening> it is going to be <conditions>.\\n<clothing lead> <items>. ``

    ``condition_phrases`` is a list of phrase columns or one array column."""
    if isinstance(condition_phrases, Column):
        conditions = english_list(condition_phrases)
    else:
        conditions = english_list(list(condition_phrases)) if condition_phrases else F.lit("")
    items = english_list(list(item_descriptions))
    return F.concat(
        opening_prefix(opening_index, openings),
        conditions,
        F.lit(".\n"),
        clothing_prefix(clothing_index, clothing_leads),
        F.lit(" "),
        items,
        F.lit(". "),
    )


# -- T12 --------------------------------------------------------------------
def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def observation_report(location, ts, feels_like, wind_speed, wind_dir, condition, precip_chance, pct_humidity) -> Column:
    """Multi-line text report of one observation; missing values print as None."""
    t = _col(ts)
    return F.concat(
        F.lit("Observation for "),
        _shown(_col(location)),
        F.lit(" on "),
        _shown(F.date_format(t, "EEEE")),
        F.lit(" (Month-Day): "),
        _shown(F.month(t)),
        F.lit("-"),
        _shown(F.dayofmonth(t)),
        F.lit(" at "),
        _shown(F.date_format(t, "HH:00")),
        F.lit(". \n\tTemperature (feels like): "),
        _shown(_col(feels_like)),
        F.lit(" °F\n\tWind "),
        _shown(_col(wind_speed)),
        F.lit(" mph from "),
        _shown(_col(wind_dir)),
        F.lit("\n\tConditions: "),
        _shown(_col(condition)),
        F.lit(" \n\tChance of precipitation: "),
        _shown(_col(precip_chance)),
        F.lit(" %\n\tHumidity: "),
        _shown(_col(pct_humidity) * 100),
        F.lit("%"),
    )
