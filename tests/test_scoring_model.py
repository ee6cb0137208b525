from functools import reduce

import pytest
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import model as M
from wearcast.operators.scoring import label_accuracy, overall_accuracy, score_table, weighted_accuracy
from wearcast.plans.inputs import lineitem_training
from wearcast.session import shared_path

SMALL = "/root/testdata/sf0.001"


def _scores(spark):
    df = spark.createDataFrame(
        [("A", "A", True, True, 1), ("A", "B", True, None, 1), ("B", None, False, False, 1), ("B", "B", True, True, 1)],
        "a string, pred_a string, b boolean, pred_b boolean, c int",
    ).withColumn("pred_c", F.col("c"))
    return df


def test_accuracy_nulls_and_drop_perfect(spark):
    df = _scores(spark)
    acc = {r.label: r.accuracy for r in label_accuracy(df, ["a", "b", "c"]).collect()}
    assert acc == {"a": 0.5, "b": 0.75, "c": 1.0}  # a NULL on either side is a miss
    kept = label_accuracy(df, ["a", "b", "c"], drop_perfect=True)
    assert sorted(r.label for r in kept.collect()) == ["a", "b"]
    assert overall_accuracy(kept).collect()[0].overall == pytest.approx(0.625)
    table = {r.label: r.accuracy for r in score_table(df, ["a", "b", "c"], drop_perfect=True).collect()}
    assert table == {"a": 0.5, "b": 0.75, "overall": pytest.approx(0.625)}
    all_perfect = {r.label: r.accuracy for r in score_table(df, ["c"], drop_perfect=True).collect()}
    assert all_perfect == {"overall": None}


def test_all_perfect_gives_null_overall(spark):
    df = _scores(spark)
    kept = label_accuracy(df, ["c"], drop_perfect=True)
    assert kept.count() == 0
    assert overall_accuracy(kept).collect()[0].overall is None


def test_weighted(spark):
    scores = label_accuracy(_scores(spark), ["a", "b", "c"])
    w = weighted_accuracy(scores, {"a": 2.0, "c": 1.0}).collect()[0]
    assert w.weighted == pytest.approx((0.5 * 2 + 1.0 * 1) / 2)
    with pytest.raises(Exception):
        weighted_accuracy(label_accuracy(_scores(spark), ["a", "b", "c"], drop_perfect=True), {"c": 1.0}).collect()


def test_trees_recover_rules_and_round_trip(spark):
    train = lineitem_training(spark, SMALL)
    model = M.fit_dual(train)
    pred = M.predict_outfits(model, train)
    same_row = M.predict_outfits(model, train, keep=("row_id", *S.LABELS))
    for lab in S.LABELS:
        assert same_row.filter(~F.col(f"pred_{lab}").eqNullSafe(F.col(lab))).count() == 0, lab
    base = shared_path(spark, "test_models")
    path = M.model_path(base)
    M.save_model(spark, model, path)
    loaded = M.load_model(spark, path)
    assert M.predict_outfits(loaded, train).exceptAll(pred).count() == 0
    # single prediction = batch prediction on one row
    assert M.predict_outfits(loaded, train.limit(1)).count() == 1


def test_single_strategy_and_scores(spark):
    train = lineitem_training(spark, SMALL)
    model = M.fit_single(train, compress=False)
    scores = {r.label: r.accuracy for r in M.score_model(model, train, strategy="sdt").collect()}
    assert scores["overall"] == 1.0
    preds = M.predict_outfits(model, train).select("pred_gloves").distinct().collect()
    assert {r.pred_gloves for r in preds} <= {"Yes", "No"}


def test_staleness(spark):
    import datetime as dt

    train = lineitem_training(spark, SMALL)
    base = shared_path(spark, "test_stale")
    t1 = dt.datetime(2024, 1, 1)
    _, fitted = M.get_model(spark, train, base, "ddt", data_mtime=t1)
    _, again = M.get_model(spark, train, base, "ddt", data_mtime=t1)
    _, newer = M.get_model(spark, train, base, "ddt", data_mtime=t1 + dt.timedelta(hours=1))
    assert (fitted, again, newer) == (True, False, True)
    with pytest.raises(ValueError):
        M.get_model(spark, train, base, "xyz")


def test_recommend_consistent_with_model(spark):
    import datetime as dt

    from wearcast.operators.recommend import recommend
    from wearcast.operators.reply import profile

    train = lineitem_training(spark, SMALL)
    model = M.fit_dual(train)
    h = dt.datetime(2024, 1, 1, 10)
    store_schema = "location_key string, obs_hour timestamp_ntz, feels_like double, wind_speed double, pct_humidity double"
    forecasts = spark.createDataFrame([("a", h, 10.0, 8.0, 0.5), ("b", h, 45.0, 2.0, 0.2)], store_schema)
    history = spark.createDataFrame([("a", h, 30.0, 1.0, 0.9), ("c", h, None, 1.0, 0.9)], store_schema)
    req = spark.createDataFrame(
        [(1, "a", h, 30.0, True), (2, "b", h, 60.0, False), (3, "a", h, 45.0, True), (4, "z", h, 45.0, True),
         (5, "c", h, 45.0, True)],
        "row_id long, location_key string, obs_hour timestamp_ntz, duration double, is_light boolean",
    )
    # 'now' before the hour: forecast store; after: history store
    early = {r.row_id: r for r in recommend(req, forecasts, history, model, profile(S.RUN), "2024-01-01 00:00:00").collect()}
    late = {r.row_id: r for r in recommend(req, forecasts, history, model, profile(S.RUN), "2024-01-02 00:00:00").collect()}
    assert early[1].kind == "forecast" and early[1].feels_like == 10.0 and early[1].usable
    assert late[1].kind == "history" and late[1].feels_like == 30.0
    assert not early[4].found and early[4].reply is None and early[4].pred_outer_layer is None
    assert late[5].found and not late[5].usable and late[5].reply is None
    direct = M.predict_outfit(spark, model, feels_like=10.0, wind_speed=8.0, pct_humidity=0.5, duration=30.0, is_light=True)
    assert {lab: getattr(early[1], f"pred_{lab}") for lab in S.LABELS} == direct
    assert early[1].reply.endswith(". ")


def test_native_predictions_equal_transform(spark):
    from pyspark.ml import PipelineModel

    train = lineitem_training(spark, SMALL)
    model = M.fit_dual(train, compress=False)
    assert M.native_predictions(model) is not None
    native = M.predict_outfits(model, train)
    direct = model.transform(train).select("row_id", *[f"pred_{lab}" for lab in S.LABELS])
    assert native.exceptAll(direct).count() == 0 and direct.exceptAll(native).count() == 0
    # a model with a stage that has no native form falls back to transform,
    # also when feature values are given as expressions
    wrapped = PipelineModel(stages=[*model.stages, PipelineModel(stages=[])])
    assert M.native_predictions(wrapped) is None
    doubled = {"duration": F.col("duration") * 2}
    a = M.apply_model(wrapped, train, features=doubled).select("row_id", "duration", "pred_heavy_socks")
    b = M.apply_model(model, train, features=doubled).select("row_id", "duration", "pred_heavy_socks")
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.max("duration")).collect()[0][0] == train.agg(F.max("duration")).collect()[0][0]


def test_native_predictions_on_continuous_random_data(spark):
    # arbitrary double thresholds and impure leaves: the compiled trees must
    # still agree with the model's own transform on every row
    df = spark.range(6000).select(
        F.col("id").alias("row_id"),
        (F.rand(1) * 100 - 20).alias("feels_like"),
        (F.rand(2) * 30).alias("wind_speed"),
        F.rand(3).alias("pct_humidity"),
        (F.rand(4) * 180).alias("duration"),
        (F.rand(5) < 0.5).alias("is_light"),
    )
    df = df.withColumns({
        "outer_layer": F.when(F.rand(6) < 0.4, "Long-sleeve").when(F.col("feels_like") < 30, "Sweatshirt-Heavy").otherwise("Short-sleeve"),
        "gloves": (F.col("feels_like") + F.rand(7) * 40) < 30,
    }).cache()
    model = M.fit_trees(df, ["outer_layer"], ["gloves"], compress=False)
    native = M.predict_outfits(model, df)
    direct = model.transform(df).select("row_id", "pred_outer_layer", "pred_gloves")
    assert native.exceptAll(direct).count() == 0 and direct.exceptAll(native).count() == 0


def test_train_from_logs(spark):
    import datetime as dt

    rows = []
    for i in range(400):
        t = float(i % 80)
        rows.append((t, float(i % 20), 50.0 + i % 30, 30.0 + i % 90, i % 3 != 0,
                     "Long-sleeve" if t < 40 else "Short-sleeve", "None", "None" if t >= 30 else "Wind",
                     "Long tights" if t < 45 else "Shorts", "None", t < 35, t < 25, t < 20, False, False,
                     "Run" if i % 4 else "Roadbike"))
    schema = ("feels_like double, wind_speed double, pct_humidity double, duration double, is_light boolean, "
              "outer_layer string, base_layer string, jacket string, lower_body string, shoe_cover string, "
              "ears_hat boolean, gloves boolean, heavy_socks boolean, arm_warmers boolean, face_cover boolean, activity string")
    logs = spark.createDataFrame(rows, schema)
    base = shared_path(spark, "test_train_logs")
    model, fitted = M.train_from_logs(spark, logs, base, data_mtime=dt.datetime(2024, 1, 1))
    _, again = M.train_from_logs(spark, logs, base, data_mtime=dt.datetime(2024, 1, 1))
    assert fitted and not again
    out = M.predict_outfit(spark, model, feels_like=10.0, wind_speed=3.0, pct_humidity=0.6, duration=45.0, is_light=True)
    # jacket + outer + no base in the logs: the layer rule moved the outer layer to the base
    assert (out["outer_layer"], out["base_layer"], out["jacket"]) == ("None", "Long-sleeve", "Wind")
    assert out["gloves"] is True and out["lower_body"] == "Long tights"


def test_recommend_with_direction(spark):
    import datetime as dt

    from wearcast.operators.recommend import recommend
    from wearcast.operators.reply import profile

    model = M.fit_dual(lineitem_training(spark, SMALL))
    h = dt.datetime(2024, 1, 1, 10)
    schema = "location_key string, obs_hour timestamp_ntz, feels_like double, wind_speed double, pct_humidity double, wind_dir string"
    store = spark.createDataFrame([("a", h, 45.0, 22.0, 0.5, "N")], schema)
    req = spark.createDataFrame([(1, "a", h, 30.0, True)],
                                "row_id long, location_key string, obs_hour timestamp_ntz, duration double, is_light boolean")
    plain = recommend(req, store, store, model, profile(S.RUN), "2024-01-01 00:00:00").collect()[0]
    windy = recommend(req, store, store, model, profile(S.RUN), "2024-01-01 00:00:00", with_direction=True).collect()[0]
    assert "cool and very windy." in plain.reply
    # the list rule turns the last comma, here the one inside the wind phrase, into ' and'
    assert "cool, very windy and 22.0 miles per hour out of the North." in windy.reply
    assert windy.wind_dir == "N"


def test_incomplete_rows_have_no_prediction(spark):
    """Native expressions and the pipeline agree, NULL by NULL."""
    train = lineitem_training(spark, SMALL)
    model = M.fit_dual(train)
    some = train.limit(6).select("row_id", *S.FEATURES)
    gaps = reduce(lambda a, b: a.unionByName(b), [some.withColumn(f, F.lit(None).cast(some.schema[f].dataType)) for f in S.FEATURES])
    rows = some.unionByName(gaps)
    native = M.predict_outfits(model, rows)
    plain = M.native_predictions
    try:
        M.native_predictions = lambda *a, **k: None
        piped = M.predict_outfits(model, rows)
    finally:
        M.native_predictions = plain
    assert native.exceptAll(piped).count() == 0 and piped.exceptAll(native).count() == 0
    assert native.where("pred_outer_layer IS NOT NULL").count() == 6 and native.count() == 36


def test_percent_humidity_meets_fraction_trees(spark):
    train = lineitem_training(spark, SMALL)
    model = M.fit_dual(train)
    one = {"feels_like": 40.0, "wind_speed": 5.0, "duration": 30.0, "is_light": True}
    assert M.predict_outfit(spark, model, pct_humidity=60.0, **one) == M.predict_outfit(spark, model, pct_humidity=0.6, **one)


def test_scores_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "pred_a string, a string")
    scores = label_accuracy(empty, ["a"])
    assert [r.accuracy for r in scores.collect()] == [None]
    assert overall_accuracy(scores).first().overall is None
    assert {r.accuracy for r in score_table(empty, ["a"]).collect()} <= {None}


def test_repeated_writes_do_not_repeat_requests(spark):
    import datetime as dt

    from wearcast.operators.store import latest_per_key, routed_lookup

    h = dt.datetime(2024, 1, 1, 10)
    store = spark.createDataFrame([("a", h, h, 1), ("a", h, h, 2), ("a", h, h - dt.timedelta(hours=13), 3)],
                                  "location_key string, obs_hour timestamp_ntz, snapshot_ts timestamp_ntz, v int")
    req = spark.createDataFrame([(1, "a", h)], "row_id int, location_key string, obs_hour timestamp_ntz")
    got = routed_lookup(req, store, store, "2024-01-01 09:00:00", order=("snapshot_ts",)).collect()
    assert [(r.row_id, r.obs_v) for r in got] == [(1, 2)]
    assert [r.v for r in latest_per_key(store.repartition(3)).collect()] == [2]
    stale = routed_lookup(req, store.where("v = 3"), store, "2024-01-01 09:30:00", order=("snapshot_ts",), ttl_hours=12).collect()
    assert [(r.kind, r.found) for r in stale] == [("forecast", False)]


def test_recommend_from_free_text(spark):
    import datetime as dt

    from wearcast.operators.recommend import recommend
    from wearcast.operators.reply import profile

    model = M.fit_dual(lineitem_training(spark, SMALL))
    h = dt.datetime(2024, 1, 1, 10)
    store = spark.createDataFrame(
        [("AR/Bentonville", h, 45.0, 2.0, 20.0, h - dt.timedelta(hours=2), True), ("AR/Bentonville", h, 90.0, 2.0, 20.0, h - dt.timedelta(hours=30), True),
         ("72712", h, 45.0, 2.0, 0.2, h - dt.timedelta(hours=20), True)],
        "location_key string, obs_hour timestamp_ntz, feels_like double, wind_speed double, pct_humidity double, snapshot_ts timestamp_ntz, is_light boolean")
    req = spark.createDataFrame([(1, " Bentonville, AR", h + dt.timedelta(minutes=40), 30.0), (2, "72712 ", h, 30.0)],
                                "row_id int, place string, when timestamp_ntz, duration double")
    got = {r.row_id: r for r in recommend(req, store, store, model, profile(S.RUN), "2024-01-01 09:00:00").collect()}
    assert got[1].feels_like == 45.0 and got[1].usable and got[1].is_light and got[1].reply
    assert not got[2].found and got[2].reply is None  # its forecast is over twelve hours old
    same = M.predict_outfit(spark, model, feels_like=45.0, wind_speed=2.0, pct_humidity=0.2, duration=30.0, is_light=True)
    assert {lab: got[1][f"pred_{lab}"] for lab in S.LABELS} == same


def test_only_a_missing_pointer_means_no_model(spark, tmp_path):
    assert M._pointer(spark, str(tmp_path / "none")) is None
    folder = tmp_path / "m" / "_latest"
    folder.mkdir(parents=True)
    (folder / "x.gz").write_bytes(b"not gzip at all")
    with pytest.raises(Exception):
        M._pointer(spark, str(tmp_path / "m"))


def test_trees_do_not_depend_on_layout(spark):
    """More values than bins: plain, compressed and repartitioned fits agree."""
    i = F.col("id")
    df = spark.range(60000).select(
        i.alias("row_id"),
        (F.pmod(F.xxhash64("id"), F.lit(6000)) / 50.0).alias("feels_like"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700)) / 10.0).alias("wind_speed"),
        F.lit(0.5).alias("pct_humidity"),
        (i % 90).cast("double").alias("duration"),
        (i % 2 == 0).alias("is_light"),
    )
    noise = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)) == 0
    df = df.withColumn("id", F.col("row_id")).withColumn("gloves", ((F.col("feels_like") < 41.3) != noise) & (F.col("wind_speed") < 60))
    df = df.withColumn("outer_layer", F.when(F.col("feels_like") < 20.1, "a").when(F.col("wind_speed") < 33.3, "b").otherwise("c"))
    fits = [M.fit_trees(d, ["outer_layer"], ["gloves"], compress=c) for d, c in ((df, False), (df, True), (df.repartition(11), False), (df.orderBy("wind_speed"), True))]
    shapes = [[st.toDebugString.split("\n", 1)[1] for st in m.stages if hasattr(st, "toDebugString")] for m in fits]
    assert all(s == shapes[0] for s in shapes) and "If (feature" in shapes[0][0]
    native = M.predict_outfits(fits[0], df, normalize_humidity=False)
    direct = fits[0].transform(df).select("row_id", "pred_outer_layer", "pred_gloves")
    assert native.exceptAll(direct).count() == 0 and direct.exceptAll(native).count() == 0
    right = fits[0].transform(df).where("pred_outer_layer = outer_layer").count()
    assert right > 0.99 * 60000


def test_cuts_follow_the_weight_of_skewed_values(spark):
    """A few far values leave the others their thresholds."""
    import bisect
    from collections import Counter

    from wearcast.operators.model import feature_cuts

    near = [(i % 6000) / 100 for i in range(12000)]
    tables = {
        "one_far": [*near, 1e6],
        "both_ends": [*(x - 30 for x in near), 1e300, -1e200],
        "powers": [float(f"{1 + i % 10}e{i // 100 - 60}") * (-1) ** i for i in range(12000)],
        "infinite": [*near, float("inf")],
    }
    for name, values in tables.items():
        df = spark.createDataFrame([(x,) for x in values], "x double")
        cuts = feature_cuts(df, ["x"], 64)["x"]
        assert cuts == sorted(cuts) and 50 <= len(cuts) <= 63, name
        sizes = Counter(bisect.bisect_right(cuts, x) for x in values)
        assert max(sizes.values()) <= 3 * len(values) / 64, name


def test_a_tree_reads_the_combinations_of_its_own_label(spark, monkeypatch):
    """Other labels, however many patterns they make, add no rows to it."""
    read, fit = [], M.DecisionTreeClassifier.fit
    monkeypatch.setattr(M.DecisionTreeClassifier, "fit", lambda self, df: read.append(df.count()) or fit(self, df))
    i = F.col("id")
    df = spark.range(512).select(
        *[(i % 4).cast("double").alias(f) for f in S.FEATURES[:4]], (i % 2 == 0).alias("is_light"),
        *[F.when(F.shiftright(i, k) % 2 == 1, S.CATEGORICAL_DOMAINS[c][0]).otherwise("None").alias(c) for k, c in enumerate(S.CATEGORICAL_LABELS, 2)],
        *[(F.shiftright(i, k) % 2 == 1).alias(b) for k, b in enumerate(S.BOOLEAN_LABELS, 4)])
    M.fit_and_score(df, ("ddt",))
    assert len(read) == 10 and max(read) <= 8  # four values of the features, two classes
