"""Plan-shape checks for the scale properties the README claims."""

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import model as M
from wearcast.operators import store as ST
from wearcast.operators.cleaning import clean_activity_log
from wearcast.operators.reply import add_replies, profile
from wearcast.plans.inputs import event_scenarios, lineitem_training
from wearcast.plans.q_lookup import _observations

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleanup_and_replies_do_not_shuffle(spark):
    clean = clean_activity_log(event_scenarios(spark, SF), features=["row_id"] + S.FEATURES)
    replies = add_replies(clean, profile(S.RUN))
    for df in (clean, replies):
        p = _plan(df)
        assert "Exchange" not in p  # no shuffle
        assert "*(" in p  # runs inside whole-stage codegen


def test_last_write_wins_pre_aggregates(spark):
    obs = _observations(spark, SF).select("location_key", "obs_hour", "snapshot_ts", "event_id", "value")
    p = _plan(ST.latest_per_key(obs, order=("snapshot_ts", "event_id")))
    assert "partial_max(" in p  # a hot key collapses per task before the shuffle


def test_freshness_filter_reaches_the_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "snapshot_ts")
    p = _plan(ST.fresh_only(e, "2024-01-15 00:00:00"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_native_prediction_has_no_udf(spark):
    train = lineitem_training(spark, SF)
    model = M.fit_dual(train)
    p = _plan(M.predict_outfits(model, train))
    assert "UDF" not in p and "Exchange" not in p


def test_routed_lookup_aggregates_once_on_the_join_key(spark):
    """Both stores share one newest-write aggregate, whose partitioning serves
    the join: one exchange for the stores, one for the requests."""
    obs = _observations(spark, SF).select("kind", "location_key", "obs_hour", "snapshot_ts", "event_id")
    stores = [obs.filter(F.col("kind") == k).drop("kind") for k in ("forecast", "history")]
    req = obs.select(F.col("event_id").alias("row_id"), "location_key", "obs_hour")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(ST.routed_lookup(req, *stores, "2024-01-15 00:00:00", order=("snapshot_ts", "event_id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == 2 and p.count("partial_max(") == 1
