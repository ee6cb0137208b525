"""Assembling labelled sample rows.

A sample row merges, per ``row_id``, the outfit (labels only), the forecast
(features only) and explicit overrides (features or labels), in that order
of precedence, and is stamped with the athlete and activity.  Precedence is
by *presence*: a source that has the column and a row for the id wins, even
when its value is NULL (an explicit override of nothing).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators.cleaning import union_all_by_name


def observation_row(obs: DataFrame, struct_col: str = "obs") -> DataFrame:
    """Flatten an observation struct column to plain columns."""
    return obs.select(*[c for c in obs.columns if c != struct_col], f"{struct_col}.*")


def merge_samples(
    outfits: DataFrame,
    forecasts: DataFrame | None = None,
    overrides: DataFrame | None = None,
    athlete: str = "default",
    activity: str = S.RUN,
    labels: Sequence[str] = S.LABELS,
    features: Sequence[str] = S.FEATURES,
    key: str = "row_id",
) -> DataFrame:
    """P12 + P11: one sample row per outfit row."""
    labels, features = list(labels), list(features)
    known = labels + features
    sources = [("o", outfits, [c for c in labels if c in outfits.columns])]
    if forecasts is not None:
        sources.append(("f", forecasts, [c for c in features if c in forecasts.columns]))
    if overrides is not None:
        sources.append(("k", overrides, [c for c in known if c in overrides.columns]))

    merged = outfits.select(key, *[F.col(c).alias(f"o__{c}") for c in sources[0][2]], F.lit(True).alias("o__hit"))
    for tag, df, cols in sources[1:]:
        right = df.select(key, *[F.col(c).alias(f"{tag}__{c}") for c in cols], F.lit(True).alias(f"{tag}__hit"))
        merged = merged.join(right, on=key, how="left")

    out_cols = [F.col(key)]
    for c in known:
        expr = None
        for tag, _df, cols in sources:  # lowest precedence first
            if c in cols:
                hit = F.coalesce(F.col(f"{tag}__hit"), F.lit(False))
                expr = F.col(f"{tag}__{c}") if expr is None else F.when(hit, F.col(f"{tag}__{c}")).otherwise(expr)
        if expr is not None:
            out_cols.append(expr.alias(c))
    out = merged.select(*out_cols)
    return out.withColumns({"Athlete": F.lit(athlete), "activity": F.lit(activity)})


def append_samples(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows to a sample table (columns matched by name)."""
    return union_all_by_name(existing, new)
