"""Cleaning operators for labelled activity logs (DataFrame -> DataFrame).

The row operators are narrow transformations (select/filter): no shuffle,
one codegen stage, so the clean-up pipeline scans a table once at any size.
The dropped-row counts are one global aggregate (partial per task) or an
``observe`` metric riding on another job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast import schema as S
from wearcast.functions.parsing import domain_ordinal, in_domain, parse_bool, yes_no
from wearcast.functions.weather import humidity_fraction


# -- P1 ---------------------------------------------------------------------
def rename_workbook_headers(df: DataFrame, renames: dict[str, str] = S.WORKBOOK_RENAMES) -> DataFrame:
    """Workbook headers -> canonical names (headers that are absent are ignored)."""
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


# -- U1 ---------------------------------------------------------------------
def union_all_by_name(*frames: DataFrame) -> DataFrame:
    """Union all rows, matching columns by name; a column missing from a
    frame is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# -- P2 ---------------------------------------------------------------------
def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the named columns if present."""
    return df.drop(*[c for c in columns if c in df.columns])


# -- P3 ---------------------------------------------------------------------
def keep_columns(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Keep only the listed columns that exist, in the table's own order."""
    keep = set(keep)
    return df.select(*[c for c in df.columns if c in keep])


# -- P4 ---------------------------------------------------------------------
def select_features(df: DataFrame, features: Iterable[str] = S.FEATURES) -> DataFrame:
    """Feature columns in model order; a missing feature is an analysis error."""
    return df.select(*features)


# -- P5 ---------------------------------------------------------------------
def fill_missing(df: DataFrame) -> DataFrame:
    """NULL booleans -> False, NULL numbers -> 0.  Categories stay NULL (a
    blank category is neither 'None' nor a garment)."""
    fills: dict[str, object] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            fills[f.name] = False
        elif isinstance(f.dataType, T.NumericType):
            fills[f.name] = 0
    return df.na.fill(fills) if fills else df


# -- P6 ---------------------------------------------------------------------
def parse_booleans(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text columns holding Yes/No (or TRUE/FALSE) spellings -> boolean."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: parse_bool(c) for c in cols}) if cols else df


# -- P7 / O2 ----------------------------------------------------------------
def apply_domains(df: DataFrame, domains: dict[str, list[str]] = S.CATEGORICAL_DOMAINS, ordinals: bool = False) -> DataFrame:
    """Categorical labels constrained to their closed domain (else NULL);
    optionally adds ``<label>_ord`` = position in the ordered domain."""
    present = {c: d for c, d in domains.items() if c in df.columns}
    out = df.withColumns({c: in_domain(c, d) for c, d in present.items()})
    if ordinals:
        out = out.withColumns({f"{c}_ord": domain_ordinal(c, d) for c, d in present.items()})
    return out


# -- P8 ---------------------------------------------------------------------
def length_bin(duration) -> Column:
    """Right-closed bins (0,31] short, (31,61] medium, (61,121] long,
    (121,720] extra long; anything else NULL."""
    d = F.col(duration) if isinstance(duration, str) else duration
    edges, names = S.LENGTH_BIN_EDGES, S.LENGTH_BIN_NAMES
    expr = None
    for lo, hi, name in zip(edges[:-1], edges[1:], names):
        cond = (d > lo) & (d <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def add_length_bin(df: DataFrame, duration: str = "duration", name: str = "activity_length") -> DataFrame:
    return df.withColumn(name, length_bin(duration))


# -- P9 / F3 ----------------------------------------------------------------
def _is_none(c: str) -> Column:
    # Null-safe: a NULL layer is not the 'None' option, so it counts as present.
    return F.col(c).eqNullSafe(F.lit("None"))


def no_layer(outer: str = "outer_layer", base: str = "base_layer") -> Column:
    """F3 predicate: neither an outer nor a base layer."""
    return _is_none(outer) & _is_none(base)


def fix_layers(df: DataFrame, jacket: str = "jacket", outer: str = "outer_layer", base: str = "base_layer") -> DataFrame:
    """Layer normalisation.

    * rows with neither layer are dropped;
    * jacket + outer + no base  -> the outer layer becomes the base layer;
    * no jacket + no outer + base -> the base layer becomes the outer layer.
    Both right-hand sides read the original values."""
    no_base, no_outer, no_jacket = _is_none(base), _is_none(outer), _is_none(jacket)
    to_base = ~no_jacket & ~no_outer & no_base
    to_outer = no_jacket & no_outer & ~no_base
    new_base = F.when(to_base, F.col(outer)).when(to_outer, F.lit("None")).otherwise(F.col(base))
    new_outer = F.when(to_base, F.lit("None")).when(to_outer, F.col(base)).otherwise(F.col(outer))
    return df.filter(~(no_outer & no_base)).withColumns({base: new_base, outer: new_outer})


# -- F1 ---------------------------------------------------------------------
def filter_activity(df: DataFrame, activity: str, column: str = "activity") -> DataFrame:
    """Rows of one activity (case-sensitive); tables without the column pass."""
    return df.filter(F.col(column) == F.lit(activity)) if column in df.columns else df


# -- F2 ---------------------------------------------------------------------
def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


# -- F4 / A7 ----------------------------------------------------------------
def observe_dropped_layers(df: DataFrame, name: str = "dropped_layers") -> tuple[DataFrame, Observation]:
    """Attach a metric counting rows without any layer; read it after an action
    via ``observation.get``.  Costs no extra pass."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), F.count_if(no_layer()).alias("dropped")), obs


def drop_counts(df: DataFrame) -> DataFrame:
    """One-row table: all rows, rows without any layer, rows kept."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(no_layer()).alias("n_dropped"),
        F.count_if(~no_layer()).alias("n_kept"),
    )


# -- P10 --------------------------------------------------------------------
def booleans_to_yes_no(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Boolean columns -> 'Yes'/'No' categories (all boolean columns by default)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: yes_no(c) for c in cols}) if cols else df


# -- L8 ---------------------------------------------------------------------
def clean_activity_log(
    df: DataFrame,
    activity: str = S.RUN,
    features=S.FEATURES,
    labels=S.LABELS,
    normalize_humidity: bool = True,
) -> DataFrame:
    """The full clean-up, in order: fill missing values, normalise layers (drop
    rows without any), constrain categories to their domains, keep one
    activity, drop bookkeeping columns, keep only features + labels.

    ``normalize_humidity`` turns whole-percent humidity into the fraction that
    observations carry, so training and serving see the same scale (off: the
    log's values are kept as they are)."""
    out = fill_missing(df)
    if normalize_humidity and "pct_humidity" in out.columns:
        out = out.withColumn("pct_humidity", humidity_fraction("pct_humidity"))
    out = fix_layers(out)
    out = apply_domains(out)
    out = filter_activity(out, activity)
    out = drop_columns(out, S.SAMPLE_DROPS)
    return keep_columns(out, list(labels) + list(features))
