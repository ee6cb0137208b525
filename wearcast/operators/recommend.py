"""Weather-driven recommendations for a table of requests.

requests (place, hour, duration, daylight) -> routed observation lookup
(forecast or history store) -> one tree per outfit item -> English reply.
One join (the store side is unique per key), then narrow transforms in a
single pass.  Requests without a usable observation keep ``found`` /
``usable`` flags and get no outfit and no reply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions.parsing import location_key, parse_location
from wearcast.functions.weather import humidity_fraction, truncate_hour
from wearcast.operators.model import apply_model
from wearcast.operators.reply import Descriptions, add_replies
from wearcast.operators.store import routed_lookup
from wearcast.operators.trees import TreeModel

_OBS = ["feels_like", "wind_speed", "pct_humidity"]
LAST_WRITE = ("snapshot_ts", "seq", "epoch")


def recommend(
    requests: DataFrame,
    forecasts: DataFrame,
    history: DataFrame,
    model: PipelineModel | TreeModel,
    descriptions: Descriptions,
    now,
    row_id: str = "row_id",
    with_direction: bool = False,
    order: Sequence[str] = LAST_WRITE,
    ttl_hours: int | None = S.FORECAST_TTL_HOURS,
    sep: str = "/",
) -> DataFrame:
    """Adds the looked-up conditions, ``pred_<label>`` per item and ``reply``.

    ``forecasts``/``history`` hold observation writes keyed by
    ``location_key`` and ``obs_hour`` with ``feels_like``, ``wind_speed`` and
    ``pct_humidity``; the newest write by those of ``order`` that they have
    counts, and of forecasts with a ``snapshot_ts`` only those at most
    ``ttl_hours`` old at ``now``.  ``requests`` hold ``duration``, optionally
    ``is_light`` (else the observation's, else daylight), and either
    ``location_key`` and ``obs_hour`` or the raw ``place`` ("City, ST" or a
    code) and ``when``, which are parsed here.  With ``with_direction`` the
    stores' ``wind_dir`` is looked up too and the reply names it (the
    original's replies never do)."""
    keys = ["location_key", "obs_hour"]
    if "location_key" not in requests.columns:
        requests = requests.withColumn("location_key", location_key(parse_location("place"), sep))
    if "obs_hour" not in requests.columns:
        requests = requests.withColumn("obs_hour", truncate_hour("when"))
    both = set(forecasts.columns) & set(history.columns)
    obs = [*_OBS, *(["wind_dir"] if with_direction else [])]
    light = ["is_light"] if "is_light" in both and "is_light" not in requests.columns else []
    stamps = [c for c in order if c in both]
    stored = [*keys, *obs, *light, *stamps]
    looked = routed_lookup(
        requests, forecasts.select(*stored), history.select(*stored), now, order=stamps,
        ttl_hours=ttl_hours if "snapshot_ts" in stamps else None,
    ).drop(*[f"obs_{c}" for c in stamps])
    looked = looked.withColumnsRenamed({f"obs_{c}": c for c in [*obs, *light]})
    if "is_light" not in looked.columns:
        looked = looked.withColumn("is_light", F.lit(True))
    usable = F.col("found")
    for c in [*_OBS, "duration", "is_light"]:
        usable = usable & F.col(c).isNotNull()
    base_cols = list(looked.columns)
    inputs = {"pct_humidity": humidity_fraction("pct_humidity")}
    scored = apply_model(model, looked.withColumn("usable", usable), features=inputs)
    labels = [lab for lab in S.LABELS if f"pred_{lab}" in scored.columns]
    out = scored.select(
        *base_cols, "usable", *[F.when(F.col("usable"), F.col(f"pred_{lab}")).alias(lab) for lab in labels]
    )
    replied = add_replies(out, descriptions, row_id=row_id, wind_dir="wind_dir" if with_direction else None)
    return replied.select(
        *base_cols,
        "usable",
        *[F.col(lab).alias(f"pred_{lab}") for lab in labels],
        F.when(F.col("usable"), F.col("reply")).alias("reply"),
    )
