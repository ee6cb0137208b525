"""Queries over the streaming operators (ST1-ST3); each runs its stream with
``trigger(availableNow=True)`` and returns the batch view of the result, so
the oracle is the equivalent batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast.operators import model as M
from wearcast.plans.catalog import register
from wearcast.plans.inputs import lineitem_training
from wearcast.plans.q_lookup import FORECAST_TYPES, NOW
from wearcast.plans.q_model import _PRED_SQL
from wearcast.plans.q_weather import _doc_points_sql, event_hourly
from wearcast.session import read_table, shared_path
from wearcast.streaming import ingest as ST

_STREAM_COLS = ["location_key", "obs_hour", "snapshot_ts", "seq", "epoch", "condition", "temp_f", "feels_like",
                "wind_dir", "pct_humidity"]


def _stream_sql() -> str:
    pts = _doc_points_sql().replace(
        "SELECT CAST(user_id AS VARCHAR) AS location,",
        "SELECT CAST(user_id AS VARCHAR) AS location, ts AS snapshot_ts, event_id AS seq,",
    )
    ts = "TIMESTAMP '1970-01-01 00:00:00' + to_seconds(time)"
    feels = "CASE WHEN apparentTemperature > -999 THEN apparentTemperature END"
    hum = "CASE WHEN humidity > -999 THEN humidity END"
    from wearcast.plans.q_weather import _POINTS

    return f"""WITH p AS ({pts}),
o AS (SELECT location AS location_key, date_trunc('hour', {ts}) AS obs_hour, snapshot_ts, seq, time AS epoch,
  regexp_replace(COALESCE(icon, ''), '-(day|night)$', '') AS condition,
  CASE WHEN temperature > -999 THEN temperature END AS temp_f,
  CASE WHEN ({feels}) = -9999 THEN 0.0 ELSE ({feels}) END AS feels_like,
  {_POINTS}[CAST(trunc(COALESCE(windBearing, 0.0) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind_dir,
  CASE WHEN ({hum}) < 1 THEN ({hum}) ELSE ({hum}) / 100 END AS pct_humidity
FROM p)
SELECT * FROM o
QUALIFY row_number() OVER (PARTITION BY location_key, obs_hour ORDER BY snapshot_ts DESC, seq DESC, epoch DESC) = 1"""


@register("stream_upsert", _stream_sql())
def stream_upsert(spark, sf_dir):
    """ST1 (+ST3 reader): forecast documents of every event land in two
    batches; a file stream appends their observations to the day-partitioned
    log; the store read back keeps the newest write per (place, hour)."""
    e = read_table(spark, sf_dir, "events")
    base = shared_path(spark, "stream_upsert")
    landing, log = f"{base}/landing", f"{base}/log"
    docs = e.select(
        F.col("event_type"),
        F.to_json(
            F.struct(
                F.col("user_id").cast("string").alias("location"),
                F.col("ts").alias("snapshot_ts"),
                F.col("event_id").alias("seq"),
                event_hourly().alias("hourly"),
            ),
            {"timestampNTZFormat": ST.TS_FORMAT},
        ).alias("value"),
    )
    first = F.coalesce(F.col("event_type").isin(*FORECAST_TYPES), F.lit(False))
    docs.filter(first).select("value").write.mode("append").text(landing)
    docs.filter(~first).select("value").write.mode("append").text(landing)
    q = ST.start_observation_log(ST.observation_stream(spark, landing), log, checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    return ST.current_observations(spark, log).select(*_STREAM_COLS)


def _ingest(spark, sf_dir, name, compact=False):
    """Forecast documents of every event in two batches, the second landing
    after the first was ingested (and the log compacted)."""
    e = read_table(spark, sf_dir, "events")
    base = shared_path(spark, name)
    landing, log = f"{base}/landing", f"{base}/log"
    value = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("location"),
            F.col("ts").alias("snapshot_ts"),
            F.col("event_id").alias("seq"),
            event_hourly().alias("hourly"),
        ),
        {"timestampNTZFormat": ST.TS_FORMAT},
    )
    first = F.coalesce(F.col("event_type").isin(*FORECAST_TYPES), F.lit(False))
    done = None
    for late in (False, True):
        e.filter(first != F.lit(late)).select(value.alias("value")).write.mode("append").text(landing)
        ST.start_observation_log(ST.observation_stream(spark, landing), log, checkpoint=f"{base}/ckpt").awaitTermination()
        if compact:
            done = ST.compact_log(spark, log) if not late else done
    return log, done


@register("stream_compact", _stream_sql())
def stream_compact(spark, sf_dir):
    """ST1 with compaction: the log is compacted between two batches, and the
    store is the snapshot plus the batch after it, whose rows are older."""
    log, done = _ingest(spark, sf_dir, "stream_compact", compact=True)
    return ST.current_observations(spark, log, compacted=done).select(*_STREAM_COLS)


@register("stream_fresh", _stream_sql().replace("SELECT * FROM o\n", f"SELECT * FROM o WHERE snapshot_ts >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR\n"))
def stream_fresh(spark, sf_dir):
    """ST3: the store read with expiry: only snapshots at most 12 hours old."""
    log, _ = _ingest(spark, sf_dir, "stream_fresh")
    return ST.current_observations(spark, log, now=NOW, ttl_hours=12).select(*_STREAM_COLS)


_MS = "epoch_ms(snapshot_ts)"


@register("stream_current", _stream_sql().replace("SELECT * FROM o\n", f"SELECT * FROM o WHERE {_MS} > (SELECT max({_MS}) FROM o) - 43200000\n"))
def stream_current(spark, sf_dir):
    """ST1 + ST3 in keyed state: the stream itself keeps the newest write per
    (place, hour) and drops it twelve hours after its snapshot, by the time of
    the newest snapshot seen; two runs, the second with late documents."""
    from wearcast.streaming import current as C

    e = read_table(spark, sf_dir, "events")
    base = shared_path(spark, "stream_current")
    landing = f"{base}/landing"
    document = F.struct(F.col("user_id").cast("string").alias("location"), F.col("ts").alias("snapshot_ts"), F.col("event_id").alias("seq"), event_hourly().alias("hourly"))
    value = F.to_json(document, {"timestampNTZFormat": ST.TS_FORMAT})
    first = F.coalesce(F.col("event_type").isin(*FORECAST_TYPES), F.lit(False))
    for part in (first, ~first):
        e.filter(part).select(value.alias("value")).write.mode("append").text(landing)
        C.start_current(ST.observation_stream(spark, landing), f"{base}/changes", checkpoint=f"{base}/ckpt").awaitTermination()
    return C.read_current(spark, f"{base}/changes").select(*_STREAM_COLS)


@register("stream_score", _PRED_SQL)
def stream_score(spark, sf_dir):
    """ST2: a model fitted on every line item scores line items arriving as
    Parquet files through a stateless stream appended to a sink."""
    train = lineitem_training(spark, sf_dir)
    model = M.fit_dual(train)
    base = shared_path(spark, "stream_score")
    landing, out = f"{base}/landing", f"{base}/out"
    feats = train.select("row_id", "feels_like", "wind_speed", "pct_humidity", "duration", "is_light")
    feats.filter("is_light IS TRUE").write.mode("append").parquet(landing)
    feats.filter("is_light IS NOT TRUE").write.mode("append").parquet(landing)
    stream = spark.readStream.schema(feats.schema).parquet(landing)
    q = ST.start_scoring(model, stream, out, checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(out)
