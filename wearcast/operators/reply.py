"""Item descriptions per activity profile (J4, X1), option tables (X3) and
batch replies (T10/T11).

A profile is configuration, not data: a base description table plus an
activity's overrides, where an override of None deletes the item.  It is
resolved once (a few dozen entries) and applied as a map literal, so
describing a billion predicted outfits is a projection with no join.  The
DataFrame form of the same resolution (full outer join on *presence*) is
``resolve_descriptions`` for profiles that live in tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import phrases as T

Descriptions = dict[str, tuple]


def _aligned(table: Mapping) -> dict:
    return {S.ALIGNED_KEY.get(k, k): v for k, v in table.items()}


def resolve_profile(base: Mapping, overrides: Mapping) -> Descriptions:
    """Overrides first, then base; an override of None removes the item."""
    out = dict(base)
    for k, v in overrides.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = v
    return out


def profile(activity: str = "default", compat: bool = False) -> Descriptions:
    """Resolved descriptions of an activity.

    ``compat`` keeps the original keys (so options whose names differ from
    the description keys find no description, and the road-bike overrides
    have no effect); the default aligns keys with the option names."""
    if compat:
        base = dict(S.BASE_DESCRIPTIONS)
        over = {S.RUN: S.RUN_OVERRIDES_COMPAT}.get(activity, {})
    else:
        base = _aligned(S.BASE_DESCRIPTIONS)
        over = {S.RUN: _aligned(S.RUN_OVERRIDES_COMPAT), S.ROADBIKE: _aligned(S.ROADBIKE_OVERRIDES_COMPAT)}.get(
            activity, {}
        )
    return resolve_profile(base, over)


# -- J4 / X1 (table form) ---------------------------------------------------
_DESC_SCHEMA = "item string, description string, alt_description string"


def description_rows(spark: SparkSession, table: Mapping) -> DataFrame:
    """A description table as rows; a None entry becomes a row with NULL
    descriptions (an explicit deletion when used as overrides)."""
    rows = [(k, None, None) if v is None else (k, v[0], v[1]) for k, v in table.items()]
    return spark.createDataFrame(rows, _DESC_SCHEMA)


def resolve_descriptions(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """J4 over tables: an item present in ``overrides`` takes the override
    row as it is (NULL description = deleted), else the base row."""
    o = overrides.select(
        "item", F.col("description").alias("o_desc"), F.col("alt_description").alias("o_alt"), F.lit(True).alias("o")
    )
    j = base.join(o, on="item", how="full_outer")
    present = F.coalesce(F.col("o"), F.lit(False))
    return j.select(
        "item",
        F.when(present, F.col("o_desc")).otherwise(F.col("description")).alias("description"),
        F.when(present, F.col("o_alt")).otherwise(F.col("alt_description")).alias("alt_description"),
    )


# -- X3 ---------------------------------------------------------------------
def option_table(spark: SparkSession, domains: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(label, ordinal, option)`` for every label; booleans offer n/y."""
    if domains is None:
        domains = {**S.CATEGORICAL_DOMAINS, **{b: S.BOOLEAN_OPTIONS for b in S.BOOLEAN_LABELS}}
    rows = [(lab, list(opts)) for lab, opts in domains.items()]
    df = spark.createDataFrame(rows, "label string, options array<string>")
    return df.select("label", F.posexplode("options").alias("ordinal", "option"))


# -- T10 over tables --------------------------------------------------------
def item_descriptions(
    labels_categorical: Sequence[str],
    descriptions: Descriptions,
    labels_boolean: Sequence[str] = (),
    include_boolean_items: bool = False,
) -> list[Column]:
    """Description columns of an outfit's items, in label order.

    Categorical items are described by their value.  Boolean items are left
    out by default (the original never describes them); with
    ``include_boolean_items`` a true item gives its description and a false
    one its alternative (e.g. regular socks)."""
    cols = [T.describe(c, descriptions) for c in labels_categorical]
    if include_boolean_items:
        for b in labels_boolean:
            d = descriptions.get(b)
            if d is None:
                cols.append(F.lit(None).cast("string"))
            else:
                cols.append(F.when(F.col(b), F.lit(d[0])).when(~F.col(b), F.lit(d[1]).cast("string")))
    return cols


def add_replies(
    df: DataFrame,
    descriptions: Descriptions,
    categorical: Sequence[str] = S.CATEGORICAL_LABELS,
    boolean: Sequence[str] = S.BOOLEAN_LABELS,
    feels_like: str | None = "feels_like",
    wind_speed: str | None = "wind_speed",
    wind_dir: str | None = None,
    opening_index: Column | None = None,
    clothing_index: Column | None = None,
    row_id: str = "row_id",
    seed: int = 17,
    include_boolean_items: bool = False,
    openings: Sequence[str] = S.OPENING_STATEMENTS,
    clothing_leads: Sequence[str] = S.CLOTHING_STATEMENTS,
    name: str = "reply",
) -> DataFrame:
    """Adds the English reply for each row's outfit and conditions.

    Conditions are the temperature and wind phrases (the direction only when
    ``wind_dir`` is given); sentence leads are picked per row by
    ``opening_index``/``clothing_index`` or, by default, by a hash of the row
    id and ``seed`` (independent of partitioning).  ``openings`` and
    ``clothing_leads`` replace the sentence banks (an activity's own wording)."""
    conds = []
    if feels_like:
        conds.append(T.temp_phrase(feels_like))
    if wind_speed:
        conds.append(T.wind_phrase(wind_speed, wind_dir) if wind_dir else T.wind_phrase(wind_speed))
    items = item_descriptions(categorical, descriptions, boolean, include_boolean_items)
    oi = opening_index if opening_index is not None else T.hashed_index(row_id, seed)
    ci = clothing_index if clothing_index is not None else T.hashed_index(row_id, seed + 1)
    return df.withColumn(name, T.reply(conds, items, oi, ci, openings, clothing_leads))


# -- J4 / X3 lookups over tables --------------------------------------------
def label_items(
    df: DataFrame, categorical=S.CATEGORICAL_LABELS, boolean=(), key: str = "row_id", value_col: str = "item"
) -> DataFrame:
    """One row per (row, label) with the label's value: categorical values as
    they are, booleans as their n/y options.  A narrow explode, no shuffle."""
    values = [F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias(value_col)) for c in categorical]
    values += [
        F.struct(F.lit(b).alias("label"), F.when(F.col(b), "y").when(~F.col(b), "n").alias(value_col)) for b in boolean
    ]
    return df.select(key, F.explode(F.array(*values)).alias("_i")).select(key, "_i.label", f"_i.{value_col}")


def lookup_descriptions(df: DataFrame, resolved: DataFrame, item_col: str = "item") -> DataFrame:
    """Each row's item looked up in a resolved description table
    (``item, description, alt_description``); unknown or deleted items get
    NULL.  The table is broadcast after a bounded size check."""
    from wearcast.operators.joins import join_dimension

    dim = resolved.withColumnRenamed("item", item_col) if item_col != "item" else resolved
    return join_dimension(df, dim, on=item_col, how="left")


def with_option_ordinal(df: DataFrame, options: DataFrame, label_col: str = "label", option_col: str = "option") -> DataFrame:
    """The ordinal of each row's option in its label's option table
    (NULL when the option is not offered)."""
    from wearcast.operators.joins import join_dimension

    dim = options.withColumnsRenamed({"label": label_col, "option": option_col})
    return join_dimension(df, dim, on=[label_col, option_col], how="left")


def build_reply(
    spark: SparkSession,
    outfit: Mapping | None,
    conditions: Mapping | None = None,
    descriptions: Descriptions | None = None,
    opening: int = 0,
    clothing: int = 0,
) -> str:
    """T10 for one outfit (label -> value) and its conditions (type -> value),
    as a one-row batch: the same expressions as ``add_replies``; no outfit
    gives ''.  Condition types other than feels_like, wind_speed and
    condition contribute nothing; boolean items are not described."""
    if outfit is None:
        return ""
    descriptions = profile() if descriptions is None else descriptions
    cats = [c for c in S.CATEGORICAL_LABELS if c in outfit]
    conds = [(k, None if v is None else str(v)) for k, v in (conditions or {}).items()]
    schema = ", ".join([*(f"{c} string" for c in cats), "conds array<struct<kind: string, value: string>>"])
    df = spark.createDataFrame([(*[outfit[c] for c in cats], conds)], schema)
    items = item_descriptions(cats, descriptions)
    text = T.reply(T.phrases_for("conds"), items, F.lit(opening), F.lit(clothing))
    return df.select(text.alias("r")).collect()[0]["r"]
