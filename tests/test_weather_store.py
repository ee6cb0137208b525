import datetime as dt
import json

from wearcast.functions import weather as W
from wearcast.operators import store as ST
from wearcast.operators.observations import observations_from_points
from wearcast.sources.weather_json import explode_hourly, read_hourly_json

T0 = 1_700_000_000 - (1_700_000_000 % 3600)  # an hour boundary


def _docs(tmp_path):
    docs = [
        {"location": "72712", "hourly": {"data": [
            {"time": T0, "icon": "clear-day", "temperature": 50.0, "apparentTemperature": 48.0, "windSpeed": 5.0,
             "windBearing": 10.0, "precipProbability": 0.1, "humidity": 0.55},
            {"time": T0 + 3600, "icon": "partly-cloudy-night", "temperature": -9999.0, "apparentTemperature": -9999.0,
             "windSpeed": 7.0, "precipProbability": 0.0, "humidity": 85.0},
            {"time": T0 + 3600 + 600, "icon": "rain", "temperature": 44.0, "apparentTemperature": 40.0,
             "windSpeed": 12.0, "windBearing": 350.0, "precipProbability": 0.9, "humidity": 1.0},
        ]}},
        {"location": "AR/Bentonville"},
        {"location": "AR/Bentonville", "hourly": {"data": [
            {"time": T0, "icon": "wind", "temperature": 60.0, "apparentTemperature": 61.0, "windSpeed": 25.0,
             "windBearing": 100.0, "precipProbability": 0.0, "humidity": 0.3},
        ]}},
    ]
    p = tmp_path / "docs.json"
    p.write_text("\n".join(json.dumps(d) for d in docs))
    return str(p)


def test_hourly_json_to_observations(spark, tmp_path):
    pts = explode_hourly(read_hourly_json(spark, _docs(tmp_path)), ["location"])
    obs = observations_from_points(pts).orderBy("location_key", "epoch").collect()
    assert len(obs) == 4  # the document without 'hourly' yields nothing
    a0, a1, a2, b0 = obs[0], obs[1], obs[2], obs[3]
    assert (a0.condition, a0.wind_dir, a0.pct_humidity, a0.feels_like) == ("clear", "N", 0.55, 48.0)
    assert (a1.temp_f, a1.feels_like, a1.wind_dir, a1.pct_humidity) == (None, None, "N", 0.85)  # sentinel, no bearing
    assert (a2.condition, a2.pct_humidity, a2.wind_dir) == ("rain", 0.01, "N")  # exactly 1 -> percent
    assert a1.obs_hour == a2.obs_hour  # a repeated hour
    assert b0.wind_dir == "E" and b0.condition == "wind"
    latest = ST.latest_per_key(
        observations_from_points(pts).select("location_key", "obs_hour", "epoch", "temp_f"), order=("epoch",)
    )
    rows = {(r.location_key, r.obs_hour): r.temp_f for r in latest.collect()}
    assert rows[("72712", a1.obs_hour)] == 44.0  # the later point of the repeated hour wins


def test_icon_compat(spark):
    df = spark.createDataFrame([(i,) for i in ["rain", "cloudy", "wind", "fog", "sleet", "clear-day"]], "i string")
    got = [r.c for r in df.select(W.icon_condition("i", compat=True).alias("c")).collect()]
    assert got == ["r", "clou", "w", "fo", "slee", "clear"]


def test_epoch_round_trip_other_zone(spark):
    df = spark.createDataFrame([(T0,)], "e long")
    r = df.select(W.epoch_to_local("e", "America/Chicago").alias("t")).select(
        "t", W.local_to_epoch("t", "America/Chicago").alias("back")
    ).collect()[0]
    assert r.back == T0
    assert r.t == dt.datetime.fromtimestamp(T0, dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(hours=6)


def test_upsert_days_replaces_whole_days(spark):
    schema = "location_key string, obs_date date, obs_hour timestamp_ntz, snapshot_ts long, v int"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    h = lambda d, k: dt.datetime(d.year, d.month, d.day, k)
    history = spark.createDataFrame(
        [("a", d1, h(d1, 1), 1, 10), ("a", d1, h(d1, 2), 1, 11), ("a", d2, h(d2, 1), 1, 12), ("b", d1, h(d1, 1), 1, 13)],
        schema,
    )
    fresh = spark.createDataFrame([("a", d1, h(d1, 1), 2, 20), ("a", d1, h(d1, 1), 3, 21)], schema)
    got = sorted((r.location_key, r.obs_date, r.obs_hour.hour, r.v) for r in ST.upsert_days(history, fresh).collect())
    assert got == [("a", d1, 1, 21), ("a", d2, 1, 12), ("b", d1, 1, 13)]


def test_routing_freshness_and_fetch_plan(spark):
    now = "2024-01-10 00:00:00"
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 9, 11),), (dt.datetime(2024, 1, 9, 13),), (dt.datetime(2024, 1, 11),)], "t timestamp_ntz"
    )
    kinds = [r.k for r in df.select(ST.route("t", now).alias("k")).collect()]
    assert kinds == ["history", "history", "forecast"]
    fresh = ST.fresh_only(df.withColumnRenamed("t", "snapshot_ts"), now)
    assert fresh.count() == 2  # 11:00 is 13 hours old; future snapshots count as fresh
    req = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 2))],
                                "location_key string, obs_date date")
    hist = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "location_key string, obs_date date")
    assert [tuple(r) for r in ST.fetch_plan(req, hist).collect()] == [("a", dt.date(2024, 1, 2))]



def test_quarantine_split(spark):


    from wearcast.functions.parsing import try_number
    from wearcast.operators.observations import quarantine, units_valid

    df = spark.createDataFrame([("metric", "1.5"), ("kelvin", "2"), (None, "x"), ("english", None)], "units string, r string")
    good, bad = quarantine(df, units_valid("units") & try_number("r").isNotNull())
    assert [r.units for r in good.collect()] == ["metric"]
    assert sorted(str(r.units) for r in bad.collect()) == ["None", "english", "kelvin"]



def test_multiline_json_documents(spark, tmp_path):
    doc = {"location": "72712", "hourly": {"data": [
        {"time": T0, "icon": "snow", "temperature": 20.0, "apparentTemperature": 12.0, "windSpeed": 9.0,
         "windBearing": 180.0, "precipProbability": 0.8, "humidity": 0.9}]}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"location": "x"}, indent=2))
    pts = explode_hourly(read_hourly_json(spark, str(tmp_path), multi_line=True), ["location"])
    rows = observations_from_points(pts).collect()
    assert [(r.location_key, r.condition, r.wind_dir, r.feels_like) for r in rows] == [("72712", "snow", "S", 12.0)]


def test_repeated_dst_hour_keeps_later_epoch(spark, tmp_path):
    # 2024-11-03 01:30 happens twice in America/Chicago (CDT, then CST)
    first, second = 1_730_615_400, 1_730_619_000
    doc = {"location": "72712", "hourly": {"data": [
        {"time": first, "icon": "clear-night", "temperature": 40.0},
        {"time": second, "icon": "cloudy", "temperature": 38.0}]}}
    (tmp_path / "dst.json").write_text(json.dumps(doc))
    pts = explode_hourly(read_hourly_json(spark, str(tmp_path / "dst.json")), ["location"])
    obs = observations_from_points(pts, tz="America/Chicago")
    hours = {r.obs_hour for r in obs.collect()}
    assert len(hours) == 1 and next(iter(hours)).hour == 1
    latest = ST.latest_per_key(obs.select("location_key", "obs_hour", "epoch", "temp_f"), order=("epoch",)).collect()
    assert [(r.epoch, r.temp_f) for r in latest] == [(second, 38.0)]
