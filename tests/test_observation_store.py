"""The bucketed store: same answers, and its rows are never shuffled."""

import datetime as dt

from wearcast.operators import store as ST
from wearcast.session import shared_path
from wearcast.sources import observation_store as OS

SCHEMA = "location_key string, obs_hour timestamp_ntz, snapshot_ts timestamp_ntz, v int"
H = dt.datetime(2024, 1, 1, 10)
NOW = "2024-01-01 09:00:00"


def _writes(spark, n, seed):
    rows = [(None if i % 29 == 0 else f"p{i * seed % 11}", H + dt.timedelta(hours=i * seed % 7 - 3), H - dt.timedelta(hours=i % 25), i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _requests(spark):
    return spark.createDataFrame([(i, None if i % 13 == 0 else f"p{i % 14}", H + dt.timedelta(hours=i % 9 - 4)) for i in range(200)], "row_id int, location_key string, obs_hour timestamp_ntz")


def test_store_equals_the_plain_lookup(spark):
    first, more, past = _writes(spark, 300, 3), _writes(spark, 100, 5), _writes(spark, 200, 7)
    path = shared_path(spark, "test_store")
    table = OS.write_store(first, past, 4, path=path)
    OS.append_store(table, more, "forecast")
    for ttl in (None, 12):
        got = OS.store_lookup(_requests(spark), table, NOW, ttl_hours=ttl)
        want = ST.routed_lookup(_requests(spark), first.unionByName(more), past, NOW, order=("snapshot_ts",), ttl_hours=ttl)
        got = got.select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 200
        assert got.where("found").count() > 20
    # the files serve another session under any name
    other = OS.open_store(spark, table + "_again", path, spark.table(table).schema, 4)
    assert OS.store_lookup(_requests(spark), other, NOW).exceptAll(OS.store_lookup(_requests(spark), table, NOW)).count() == 0


def test_the_store_is_not_exchanged(spark):
    table = OS.write_store(_writes(spark, 300, 3), _writes(spark, 200, 7), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = OS.store_lookup(_requests(spark), table, NOW)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
