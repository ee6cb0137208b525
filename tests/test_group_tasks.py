"""Models of many groups, grown and applied inside tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wearcast import schema as S

FEATURES = S.FEATURES
LABELS = {"categorical": ["jacket", "lower_body"], "boolean": ["gloves"]}


def _noisy(spark, rows=1500, groups=7, many=False):
    """Labels by a rule of the group with much noise, some NULL; NULL keys,
    features and labels, repeated rows and tiny groups."""
    rng, out = random.Random(11), []
    for i in range(rows):
        g = rng.choice([None, *(f"a{k}" for k in range(groups))]) if i % 4 else "big"
        q, w, h, d = rng.randint(0, 30), rng.randint(0, 6), rng.randint(0, 9) / 10, rng.choice([15.0, 30.0, 45.0])
        at = (10 if g == "big" else 18) + (rng.random() < 0.2) * 6
        out.append((
            i, g, rng.choice([1, 2, None]) if i % 50 else 900 + i, None if i % 37 == 0 else q + (rng.random() if many else 0.0), float(w), h, d, rng.random() < 0.5,
            rng.choice([None, "é", "Z"]) if rng.random() < 0.1 else ("Warm" if q < at else "None"), rng.choice("xyz") if rng.random() < 0.3 else "x", None if i % 17 == 0 else (q < at and d >= 30) != (rng.random() < 0.1)))
    kinds = "row_id long, athlete string, activity int, feels_like double, wind_speed double, pct_humidity double, duration double, is_light boolean, jacket string, lower_body string, gloves boolean"
    df = spark.createDataFrame(out, kinds)
    return df.unionByName(df.where("row_id % 5 = 0"))


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN is NaN in text


def _refused(*_, **__):
    raise AssertionError("ordinary groups need no histogram for all of them and no row with its group's model")


@pytest.mark.parametrize("many", [False, True])
def test_a_group_grows_in_one_task(spark, monkeypatch, many):
    """At 60 times the rows the histograms of all groups did not end.  The
    trees are those of the histograms, to the last bit."""
    from wearcast.operators import grouped as G

    df = _noisy(spark, many=many)
    options = {**LABELS, "max_bins": 32, "max_depth": 5}
    with monkeypatch.context() as m:
        m.setattr(G, "_histogram", _refused)
        here = _rows(G.fit_groups(df, **options))
    with monkeypatch.context() as m:
        m.setattr(G, "MOST_ROWS", 0)  # all groups level by level
        assert _rows(G.fit_groups(df, **options)) == here
    with monkeypatch.context() as m:
        m.setattr(G, "MOST_ROWS", 300)  # the largest group
        assert _rows(G.fit_groups(df, **options)) == here
    with monkeypatch.context() as m:
        m.setattr(G, "_class_texts", lambda *_: None)  # as for keys of other kinds
        assert _rows(G.fit_groups(df, **options)) == here
    assert any("True, 2, 3" in r for r in here) == many


@pytest.mark.parametrize("depth", [0, 1])
def test_shallow_trees(spark, monkeypatch, depth):
    from wearcast.operators import grouped as G

    df = _noisy(spark, 300)
    here = _rows(G.fit_groups(df, **LABELS, max_depth=depth))
    monkeypatch.setattr(G, "MOST_ROWS", 0)
    assert _rows(G.fit_groups(df, **LABELS, max_depth=depth)) == here and any("False, 2, 3" in r for r in here) == bool(depth)


def test_values_that_are_not_finite_grow_by_levels(spark, monkeypatch):
    from wearcast.operators import grouped as G

    odd = F.when(F.col("row_id") % 40 == 0, float("inf")).when(F.col("row_id") % 40 == 8, float("nan")).otherwise(F.col("feels_like"))
    df = _noisy(spark, 600).withColumn("feels_like", F.when(F.col("athlete") == "big", odd).otherwise(F.col("feels_like")))
    here = _rows(G.fit_groups(df, **LABELS))
    monkeypatch.setattr(G, "_class_texts", lambda *_: None)
    assert _rows(G.fit_groups(df, **LABELS)) == here


def test_small_chunks_make_the_same_trees(spark, monkeypatch):
    """Groups over several chunks and blocks, in this process."""
    import pyarrow as pa

    from wearcast.operators import group_tasks as W

    rng = random.Random(5)
    rows = sorted(((rng.choice("abcdefgh"), rng.randint(0, 1), float(rng.randint(0, 9)), rng.random(), rng.randint(0, 8)) for _ in range(4000)), key=lambda r: r[:2])
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("g0", "g1", "x0", "x1", "c0"))})

    def nodes(pack, block, chunk):
        for name, n in (("PACK_ROWS", pack), ("BLOCK_ROWS", block), ("CHUNK_ROWS", chunk)):
            monkeypatch.setattr(W, name, n)
        packed = pa.Table.from_batches(W.packer(["g0", "g1"], ["x0", "x1"], [None, [0.2, 0.4, 0.8]], ["c0"])(iter(table.to_batches(max_chunksize=300))))
        assert sum(packed["n"].to_pylist()) == 4000
        dealt = packed.sort_by([("g0", "ascending"), ("g1", "ascending")]).to_batches(max_chunksize=3)
        grown = W.grower(["g0", "g1"], ["x0", "x1"], ["c0"], [(0, 1), (0, 3)], [["n", "y"], ["p", "q"]], 3, 1e-9)(iter(dealt))
        return sorted((tuple(r.values()) for b in grown for r in b.to_pylist()), key=repr)

    assert nodes(4000, 4000, 100_000) == nodes(700, 50, 16) == nodes(300, 7, 900)


def _model(spark):
    rows = [
        ("a", "jacket", 1, "feels_like", 3.0, True, 2, 3, "deep"), ("a", "jacket", 2, None, None, False, None, None, "low"), ("a", "jacket", 3, "wind_speed", 1.0, False, 6, 7, "x"),
        ("a", "jacket", 6, None, None, False, None, None, None), ("a", "jacket", 7, None, None, False, None, None, "é"),
        ("a", "gloves", 1, "is_light", 0.5, False, 2, 3, "true"), ("a", "gloves", 2, None, None, False, None, None, "false"), ("a", "gloves", 3, None, None, False, None, None, "true"),
        (None, "jacket", 1, "no_such", 3.0, False, 2, 3, "deep"), (None, "jacket", 2, None, None, False, None, None, "left"), (None, "jacket", 3, None, None, False, None, None, "right"),
        (None, "gloves", 1, None, None, False, None, None, "true"), (None, "other", 1, None, None, False, None, None, "?"),
        ("n", "jacket", 1, "feels_like", float("nan"), False, 2, 3, "deep"), ("n", "jacket", 2, None, None, False, None, None, "left"), ("n", "jacket", 3, None, None, False, None, None, "right"),
        ("s", "jacket", 1, "feels_like", float("nan"), True, 2, 3, "deep"), ("s", "jacket", 2, None, None, False, None, None, "left"), ("s", "jacket", 3, None, None, False, None, None, "right"),
        ("i", "jacket", 1, "feels_like", float("-inf"), True, 2, 3, "deep"), ("i", "jacket", 2, None, None, False, None, None, "left"),
    ]
    return spark.createDataFrame(rows, "athlete string, label string, node long, feature string, threshold double, strict boolean, left long, right long, value string").withColumn("kind", F.lit("string"))


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_rows_meet_their_model_in_a_task(spark, monkeypatch, most):
    """The same predictions as by native expressions, for odd trees and values,
    whether or not a group is dealt over several tasks."""
    from wearcast.operators import grouped as G

    values = [None, float("-inf"), -0.0, 2.9999999, 3.0, 7.0, float("inf"), float("nan")]
    rows = [(i, a, v, w, 40.0, 15.0, bool(i % 2) if i % 7 else None) for i, (a, v, w) in enumerate((a, v, w) for a in ("a", None, "n", "s", "i", "nobody") for v in values for w in (1.0, 2.0))]
    df = spark.createDataFrame(rows, "row_id long, athlete string, feels_like double, wind_speed double, pct_humidity double, duration double, is_light boolean")
    df = df.withColumns({"day": F.lit(dt.date(2020, 1, 2)), "notes": F.array(F.struct(F.col("row_id").alias("n"))), "pred_gloves": F.lit("old")})
    options = {"group": ["athlete"], "categorical": ["jacket"], "boolean": ["gloves"]}
    monkeypatch.setattr(G, "MOST_ROWS", most)
    with monkeypatch.context() as m:
        m.setattr(G, "_predict_natively", _refused)
        here = G.predict_groups(_model(spark), df, **options)
    with monkeypatch.context() as m:
        m.setattr(G, "_to_python", lambda _: False)
        there = G.predict_groups(_model(spark), df, **options)
    assert here.schema.simpleString() == there.schema.simpleString()
    assert _rows(here) == _rows(there) and here.count() == len(rows)
    assert {r[0] for r in here.select("pred_jacket").distinct().collect()} == {None, "low", "é", "left", "right"}


def test_keys_of_other_kinds(spark):
    """A nested key goes by native expressions."""
    from wearcast.operators import grouped as G

    df = _noisy(spark, 300).withColumn("athlete", F.struct("athlete", F.lit(1).alias("one")))
    plain = _noisy(spark, 300)
    as_text = lambda out, c: out.withColumn("athlete", c).select("row_id", "athlete", "activity", "pred_jacket", "pred_gloves")
    nested = as_text(G.predict_groups(G.fit_groups(df, **LABELS), df, **LABELS), F.col("athlete")["athlete"])
    assert _rows(nested) == _rows(as_text(G.predict_groups(G.fit_groups(plain, **LABELS), plain, **LABELS), F.col("athlete")))


def test_plain_round_is_round(spark):
    from wearcast.plans.inputs import with_plain_round

    values = [0.0, -0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 0.005, 0.07, 0.285, 1e14 + 0.5, 4503599627370495.5, 1e300, -0.5, -2.5, float("nan"), float("inf"), None, *(i / 100 for i in range(-3, 12))]
    df = spark.createDataFrame([(v,) for v in values], "l_tax double")
    spec = [("a", "CAST(ROUND(l_tax * 100) AS DOUBLE) / 10"), ("b", "ROUND(l_tax)")]
    quick = with_plain_round(spec)
    assert all("CASE" in e for _, e in quick)
    got = df.selectExpr(*[f"{e} AS {n}_was" for n, e in spec], *[f"{e} AS {n}_now" for n, e in quick])
    assert got.where("NOT (a_was <=> a_now AND b_was <=> b_now)").count() == 0
