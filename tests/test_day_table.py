"""The day store: only touched days are written, reads equal a plain model."""

import datetime as dt
import random

import pytest

from wearcast.operators import store as ST
from wearcast.session import shared_path
from wearcast.sources import day_table as D

SCHEMA = "location_key string, obs_date date, obs_hour timestamp_ntz, snapshot_ts long, v string"
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(5)]


def _row(place, day, hour, ts, v):
    return (place, day, None if day is None else dt.datetime(day.year, day.month, day.day, hour), ts, v)


def _files(tmp_path, part="data"):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("part-*") if f"/{part}/" in str(p)}


def test_only_touched_days_are_written(spark, tmp_path):
    base = str(tmp_path / "store")
    first = spark.createDataFrame([_row(p, d, h, 1, f"{p}{d}{h}") for p in "ab" for d in DAYS for h in range(3)], SCHEMA)
    assert D.upsert(first, base) == 1
    before = _files(tmp_path)
    assert {f.split("obs_date=")[1][:10] for f in before} == {str(d) for d in DAYS}
    fresh = spark.createDataFrame([_row("a", DAYS[1], 7, 2, "new"), _row("a", DAYS[1], 7, 1, "old"), _row("c", DAYS[3], 0, 2, "c")], SCHEMA)
    assert D.upsert(fresh, base) == 2
    added = _files(tmp_path) - before
    assert {f.split("obs_date=")[1][:10] for f in added} == {str(DAYS[1]), str(DAYS[3])}
    assert _files(tmp_path) >= before  # nothing rewritten, nothing deleted
    got = D.read(spark, base, first.schema)
    want = ST.upsert_days(first, fresh)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # days that one version holds are read without the join; the files of a
    # replaced day stay listed for it alone
    one = D.read(spark, base, first.schema, days=[str(DAYS[0])])
    assert "Join" not in one._jdf.queryExecution().toString() and one.count() == 6
    read = {f.split("obs_date=")[1][:10] for f in D.read(spark, base, first.schema, days=[str(DAYS[1])]).inputFiles()}
    assert {str(DAYS[1])} <= read
    # versions stay readable
    old = D.read(spark, base, first.schema, version=1)
    assert old.exceptAll(first).count() == 0 and old.count() == first.count()
    with pytest.raises(ValueError):
        D.current(spark, base, 9)


def test_random_upserts_equal_a_dictionary(spark):
    rng = random.Random(2)
    base = shared_path(spark, "test_days")
    held = {}
    schema = spark.createDataFrame([], SCHEMA).schema
    for step in range(6):
        rows = []
        for p in rng.sample("abcd", 2):
            for d in rng.sample(DAYS, 2):
                rows += [_row(p, d, rng.randrange(4), rng.randrange(3), f"{step}-{i}") for i in range(4)]
        rows += [_row(None, DAYS[0], 1, 5, f"null place {step}"), _row("a", None, 0, 5, f"null day {step}")]
        for p, d in {(r[0], r[1]) for r in rows if None not in r[:2]}:
            held = {k: r for k, r in held.items() if (r[0], r[1]) != (p, d)}
        newest = {}
        for r in rows:
            newest[(r[0], r[2])] = max(newest.get((r[0], r[2]), r), r, key=lambda x: (x[3], str(x[1]), x[4]))
        held |= {(k, step if None in r[:2] else None): r for k, r in newest.items()}
        D.upsert(spark.createDataFrame(rows, SCHEMA), base)
        if step == 3:
            before = D.current(spark, base)
            assert D.compact_days(spark, base, schema, versions=3) == before.number + 1
            after = D.current(spark, base)
            assert max(map(len, after.days.values())) <= 2 and any(len(h) < len(before.days[d]) for d, h in after.days.items())
        got = sorted(map(str, (tuple(r) for r in D.read(spark, base, schema).collect())))
        assert got == sorted(map(str, held.values())), step
    assert D.compact_days(spark, base, schema, versions=99) == D.current(spark, base).number


def test_empty_stores_and_frames(spark):
    base = shared_path(spark, "test_no_days")
    empty = spark.createDataFrame([], SCHEMA)
    assert D.read(spark, base, empty.schema).collect() == [] and D.current(spark, base).number == 0
    assert D.upsert(empty, base) == 0
    one = spark.createDataFrame([_row("a", DAYS[0], 1, 1, "x")], SCHEMA)
    assert D.upsert(one, base) == 1 and D.upsert(empty, base) == 1
    assert D.read(spark, base, empty.schema).collect() == one.collect()


def test_a_second_writer_is_refused(spark, monkeypatch):
    base = shared_path(spark, "test_two_writers")
    one = spark.createDataFrame([_row("a", DAYS[0], 1, 1, "x")], SCHEMA)
    D.upsert(one, base)
    stale = D.Version(0, {})
    with pytest.raises(RuntimeError):
        D._commit(spark, base, "v=1-other", stale, {"2024-01-01": [(1, "v=1-other")]})
    assert D.read(spark, base, one.schema).count() == 1
