from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators.generate import random_scenarios
from wearcast.session import shared_path
from wearcast.streaming import ingest as ST


def test_scenario_bounds_and_reproducibility(spark):
    ids = spark.range(20000).withColumnRenamed("id", "row_id")
    a = random_scenarios(ids, seed=3)
    r = a.agg(
        F.min(F.month("ts")).alias("m0"), F.max(F.month("ts")).alias("m1"),
        F.min(F.dayofmonth("ts")).alias("d0"), F.max(F.dayofmonth("ts")).alias("d1"),
        F.min(F.hour("ts")).alias("h0"), F.max(F.hour("ts")).alias("h1"),
        F.min("wind_speed").alias("w0"), F.max("wind_speed").alias("w1"),
        F.min("duration").alias("dur0"), F.avg("temp_f").alias("t_avg"),
        F.collect_set("precip_chance").alias("p"), F.collect_set("condition").alias("c"),
        F.collect_set("wind_dir").alias("wd"),
    ).collect()[0]
    assert (r.m0, r.m1, r.d0, r.d1, r.h0, r.h1) == (1, 11, 1, 27, 5, 20)
    assert 0 <= r.w0 and r.w1 <= 30 and r.dur0 >= 20
    assert 53 < r.t_avg < 57
    assert set(r.p) == {0.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 100.0}
    assert set(r.c) == set(S.WEATHER_CONDITIONS)
    assert set(r.wd) == set(S.WIND_DIRECTION_NAMES_COMPAT)
    rare = a.filter(F.col("condition") == "snow").count() / 20000
    assert 0.05 < rare < 0.09  # 30 / 440
    # same ids, different partitioning -> same rows
    b = random_scenarios(ids.repartition(7), seed=3)
    assert a.exceptAll(b).count() == 0
    assert random_scenarios(ids, seed=4).exceptAll(a).count() > 0
    pace = a.select(((F.col("duration") / F.col("distance")) - F.col("pace")).alias("e")).agg(F.max(F.abs("e"))).collect()[0][0]
    assert pace < 0.006


def test_stream_equals_batch(spark, tmp_path):
    import json

    base = shared_path(spark, "test_stream")
    landing, log = f"{base}/landing", f"{base}/log"
    t0 = 1_704_067_200  # 2024-01-01 00:00 UTC
    docs1 = [{"location": "a", "snapshot_ts": "2024-01-01T00:00:00.000000", "seq": 1,
              "hourly": {"data": [{"time": t0, "icon": "rain", "temperature": 40.0, "humidity": 50.0}]}}]
    docs2 = [{"location": "a", "snapshot_ts": "2024-01-01T01:00:00.000000", "seq": 2,
              "hourly": {"data": [{"time": t0, "icon": "cloudy", "temperature": 45.0, "humidity": 0.4},
                                  {"time": t0 + 3600, "icon": "fog", "temperature": 41.0, "humidity": 0.9}]}}]
    spark.createDataFrame([(json.dumps(d),) for d in docs1], "value string").write.text(f"{landing}")
    spark.createDataFrame([(json.dumps(d),) for d in docs2], "value string").write.mode("append").text(landing)
    q = ST.start_observation_log(ST.observation_stream(spark, landing), log, checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    cur = {r.obs_hour.hour: (r.temp_f, r.condition) for r in ST.current_observations(spark, log).collect()}
    assert cur == {0: (45.0, "cloudy"), 1: (41.0, "fog")}
    # expiry on read: only snapshots at most 12 hours old at 'now'
    fresh = ST.current_observations(spark, log, now="2024-01-01 12:30:00", ttl_hours=12).collect()
    assert {r.seq for r in fresh} == {2}


def _landing(spark, name):
    import json

    base = shared_path(spark, name)
    landing, log = f"{base}/landing", f"{base}/log"
    t0 = 1_704_067_200

    def land_and_ingest(seq, temp, hour):
        doc = {"location": "a", "snapshot_ts": f"2024-01-01T0{seq}:00:00.000000", "seq": seq,
               "hourly": {"data": [{"time": t0 + 3600 * hour, "icon": "rain", "temperature": temp}]}}
        spark.createDataFrame([(json.dumps(doc),)], "value string").write.mode("append").text(landing)
        ST.start_observation_log(ST.observation_stream(spark, landing), log, checkpoint=f"{base}/ckpt").awaitTermination()

    return log, land_and_ingest


def _store(spark, log, **kw):
    return {(r.obs_date.day, r.obs_hour.hour): r.temp_f for r in ST.current_observations(spark, log, **kw).collect()}


def test_log_compaction(spark):
    log, ingest = _landing(spark, "test_compact")
    assert ST.last_batch(spark, log) == -1
    ingest(1, 40.0, 0)
    ingest(2, 41.0, 1)
    ingest(2, 50.0, 24)
    snap = ST.compact_log(spark, log)
    assert snap[1] == ST.last_batch(spark, log) == 2
    ingest(3, 42.0, 0)
    full, fast = _store(spark, log), _store(spark, log, compacted=snap)
    assert full == fast == {(1, 0): 42.0, (1, 1): 41.0, (2, 0): 50.0}
    # the compacted read takes only the batches after the cut, pruned by folder
    assert ST.read_log(spark, log, after=snap[1]).count() == 1
    assert ST.read_log(spark, log).count() == 4


def test_late_batch_with_an_old_stamp(spark):
    """Rows of a batch that commits after the compaction count, whatever their
    time stamps say."""
    log, ingest = _landing(spark, "test_late")
    ingest(2, 41.0, 1)
    snap = ST.compact_log(spark, log)
    old = ST.read_log(spark, log).withColumn("temp_f", F.lit(7.0)).withColumn("obs_hour", F.col("obs_hour") + F.expr("interval 1 hour"))
    old = old.withColumn("ingest_ts", F.expr("timestamp '2001-01-01'")).withColumn("snapshot_ts", F.expr("timestamp_ntz '2001-01-01'"))
    old.write.partitionBy("obs_date").parquet(f"{log}/batch_id=1")
    assert _store(spark, log, compacted=snap) == {(1, 1): 41.0}  # not committed yet
    spark.createDataFrame([(1,)], "batch_id long").write.json(f"{log}/_commits/n=1")
    assert _store(spark, log, compacted=snap) == _store(spark, log) == {(1, 1): 41.0, (1, 2): 7.0}


def test_chained_compaction_rewrites_touched_days_only(spark):
    log, ingest = _landing(spark, "test_chain")
    ingest(1, 30.0, 0)
    ingest(1, 33.0, 24)
    first = ST.compact_log(spark, log)
    ingest(2, 31.0, 1)
    second = ST.compact_log(spark, log, previous=first)
    ingest(3, 32.0, 0)
    assert _store(spark, log, compacted=second) == {(1, 0): 32.0, (1, 1): 31.0, (2, 0): 33.0}
    folder = lambda snap: {r["obs_date"]: r["folder"] for r in spark.read.json(snap[0]).collect()}
    one, two = folder(first), folder(second)
    assert one["2024-01-02"] == two["2024-01-02"] and one["2024-01-01"] != two["2024-01-01"]
