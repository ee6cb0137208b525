"""Keyed state: one change per change, expiry, late rows; log attempts."""

import datetime as dt
import json
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast.session import shared_path
from wearcast.streaming import current as C
from wearcast.streaming import ingest as ST

T0 = 1_704_067_200


def _doc(place, hour, seq, temp, at):
    return json.dumps({"location": place, "snapshot_ts": at.strftime("%Y-%m-%dT%H:%M:%S.%f"), "seq": seq,
                       "hourly": {"data": [{"time": T0 + 3600 * hour, "icon": "rain", "temperature": temp}]}})


def _land(spark, base, *docs):
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.mode("append").text(f"{base}/landing")


def _run(spark, base, **kw):
    C.start_current(ST.observation_stream(spark, f"{base}/landing"), f"{base}/changes", checkpoint=f"{base}/ckpt", **kw).awaitTermination()
    rows = C.read_changes(spark, f"{base}/changes").collect()
    held = {(r["location_key"], r["obs_hour"].hour): r["temp_f"] for r in C.read_current(spark, f"{base}/changes").collect()}
    return sorted((str(r["location_key"]), r["obs_hour"].hour, r["change"], r["temp_f"]) for r in rows), held


def test_changes_expiry_and_late_rows(spark):
    base, t = shared_path(spark, "test_current"), dt.datetime(2024, 1, 1)
    provider = spark.conf.get(C.STATE_PROVIDER)
    _land(spark, base, _doc("a", 0, 1, 40.0, t), _doc("a", 0, 2, 41.0, t), _doc("b", 5, 1, 50.0, t + dt.timedelta(hours=1)), _doc(None, 3, 1, 60.0, t + dt.timedelta(hours=2)))
    changes, held = _run(spark, base)
    assert spark.conf.get(C.STATE_PROVIDER) == provider
    assert held == {("a", 0): 41.0, ("b", 5): 50.0, (None, 3): 60.0}
    assert changes == [("None", 3, "set", 60.0), ("a", 0, "set", 41.0), ("b", 5, "set", 50.0)]
    # an older and an equal write change nothing; a newer one is told once
    _land(spark, base, _doc("a", 0, 1, 39.0, t), _doc("a", 0, 2, 41.0, t), _doc("b", 5, 7, 51.0, t + dt.timedelta(hours=3)))
    after, held = _run(spark, base)
    assert held == {("a", 0): 41.0, ("b", 5): 51.0, (None, 3): 60.0} and [c for c in after if c not in changes] == [("b", 5, "set", 51.0)] and len(after) == 4
    # a snapshot 13 hours later ends the rows of hour 0, but not later ones
    _land(spark, base, _doc("c", 9, 1, 70.0, t + dt.timedelta(hours=13, minutes=30)))
    later, held = _run(spark, base)
    assert held == {("b", 5): 51.0, (None, 3): 60.0, ("c", 9): 70.0}
    assert ("a", 0, "expired", 41.0) in later and sum(c[2] == "expired" for c in later) == 1
    # a write that is already expired is dropped; an expired key may come back
    _land(spark, base, _doc("z", 1, 1, 1.0, t), _doc("a", 0, 9, 45.0, t + dt.timedelta(hours=13, minutes=45)))
    _, held = _run(spark, base)
    assert held == {("b", 5): 51.0, (None, 3): 60.0, ("c", 9): 70.0, ("a", 0): 45.0}


def test_rows_of_an_attempt_without_commit_do_not_count(spark):
    """A batch that runs again: readers keep the committed attempt until the
    new one commits, then see that one alone."""
    log = shared_path(spark, "test_attempts")
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, obs_date string").withColumn("obs_date", F.col("obs_date").cast("date"))
    ST.append_batch(rows, 0, log, "obs_date")
    rows.withColumn("v", F.lit(99)).write.partitionBy("obs_date").parquet(f"{log}/batch_id=0_halfway")
    rows.write.partitionBy("obs_date").parquet(f"{log}/batch_id=1_halfway")
    got = lambda: sorted(r["v"] for r in ST.read_log(spark, log).collect())
    assert got() == [1, 2] and ST.last_batch(spark, log) == 0
    ST.append_batch(rows.withColumn("v", F.col("v") + 10), 0, log, "obs_date")
    assert got() == [11, 12]
    ST.append_batch(rows.limit(1), 1, log, "obs_date")
    assert got() == [1, 11, 12] and sorted(r["b"] for r in ST.read_log(spark, log, batch_as="b").collect()) == [0, 0, 1]
    assert [r["v"] for r in ST.read_log(spark, log, after=0).collect()] == [1] and ST.read_log(spark, log, upto=0).count() == 2


def test_compaction_writes_about_a_file_a_day(spark, tmp_path):
    days, places = 12, 40
    rows = spark.range(days * places * 24).select(
        (F.col("id") % places).cast("string").alias("location_key"),
        F.timestamp_add("HOUR", F.floor(F.col("id") / places).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("obs_hour"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("snapshot_ts"), F.col("id").alias("seq"), F.col("id").alias("epoch")).repartition(16)
    rows = rows.withColumn("obs_date", F.col("obs_hour").cast("date"))
    log = str(tmp_path / "log")
    ST.append_batch(rows, 0, log, "obs_date")
    ST.compact_log(spark, log, target=str(tmp_path / "compacted"))
    files = [p for p in (tmp_path / "compacted" / "days").rglob("part-*.parquet")]
    assert days <= len(files) <= 2 * days + 8


class _Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_place_costs_a_few_state_calls_a_batch(spark):
    """However many hours it has; one timer serves them all."""
    schema = T.StructType([T.StructField("place", T.StringType()), T.StructField("hour", T.IntegerType()), T.StructField("seq", T.LongType())])
    store, held = _Store(), C.NewestPerKey(schema, ["place", "hour"], ["seq"])
    held.init(store)
    first = [Row(place="a", hour=h, seq=1, _at=100 + h) for h in range(200)]
    told = list(held.handleInputRows(("a",), iter(first), None))
    assert [(r.place, r.hour, r.change, r.seq) for r in told] == [("a", h, "set", 1) for h in range(200)] and store.calls <= 3 and store.timers == [100]
    store.calls = 0
    again = [Row(place="a", hour=0, seq=2, _at=150), Row(place="a", hour=0, seq=1, _at=100), Row(place="a", hour=5, seq=1, _at=105)]
    assert [(r.hour, r.seq) for r in held.handleInputRows(("a",), iter(again), None)] == [(0, 2)] and store.calls <= 4 and store.timers == [101]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 149)
    store.timers, store.calls = [], 0
    gone = list(held.handleExpiredTimer(("a",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 101)))
    assert sorted(r.hour for r in gone) == list(range(1, 50)) and {r.change for r in gone} == {"expired"} and store.timers == [150] and store.calls <= 3
    clock.getCurrentWatermarkInMs = lambda: 500
    assert len(list(held.handleExpiredTimer(("a",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 150)))) == 151 and store.value is None
