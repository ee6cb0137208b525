"""Trees as a table: stored models and models of many groups."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import model as M
from wearcast.operators import trees as T
from wearcast.plans.inputs import lineitem_training
from wearcast.session import shared_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    train = lineitem_training(spark, SMALL)
    return train, M.fit_dual(train)


def test_a_model_is_one_small_table(spark, fitted, tmp_path):
    train, model = fitted
    target = M.save_model(spark, model, str(tmp_path / "m"))
    parts = [p.name for p in (tmp_path / "m").rglob("*") if p.name.startswith("part-") and "v=" in str(p)]
    assert len(parts) == 1 and parts[0].endswith(".parquet")
    loaded = M.load_model(spark, str(tmp_path / "m"))
    assert isinstance(loaded, T.TreeModel) and loaded == T.model_of_rows(T.model_of_pipeline(model).frame(spark).collect())
    assert loaded.labels == S.LABELS and len(loaded.nodes) <= 31 * len(S.LABELS)
    assert T.read_model(spark, target) == loaded
    direct = model.transform(train).select("row_id", *[f"pred_{lab}" for lab in S.LABELS])
    native = M.predict_outfits(loaded, train)
    assert native.columns == direct.columns and native.exceptAll(direct).count() == 0


def test_models_that_nodes_cannot_express_use_the_ml_writer(spark, fitted):
    train, model = fitted
    path = shared_path(spark, "test_wrapped")
    M.save_model(spark, PipelineModel(stages=[*model.stages, PipelineModel(stages=[])]), path)
    loaded = M.load_model(spark, path)
    assert isinstance(loaded, PipelineModel)
    assert M.predict_outfits(loaded, train).exceptAll(M.predict_outfits(model, train)).count() == 0


def test_broken_tables_are_refused(spark, fitted):
    nodes = list(T.model_of_pipeline(fitted[1]).nodes)
    inner = next(n for n in nodes if n.feature is not None)
    rows = [n.__dict__ for n in nodes]
    for wrong, said in (
        ([r for r in rows if (r["label"], r["node"]) != (inner.label, inner.left)], "missing"),
        (rows + rows[:1], "twice"),
        ([r for r in rows if (r["label"], r["node"]) != (inner.label, 1)], "no root"),
        ([r | {"feature": "shoe_size"} if r["feature"] else r for r in rows], "unknown"),
    ):
        with pytest.raises(ValueError, match=said):
            T.model_of_rows(wrong)


def test_binned_features_keep_their_bounds(spark):
    """A strict bound of a bin, infinite and NaN values, and NULL features."""
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(3000)) / 7.0).alias("feels_like"), F.lit(1.0).alias("wind_speed"),
        F.lit(0.5).alias("pct_humidity"), F.lit(30.0).alias("duration"), F.lit(True).alias("is_light"))
    df = df.withColumn("gloves", F.col("feels_like") < 200)
    model = M.fit_trees(df, [], ["gloves"], max_bins=16)
    trees = T.model_of_pipeline(model)
    assert any(n.strict for n in trees.nodes)
    same = M.predict_outfits(trees, df).exceptAll(model.transform(df).select("row_id", "pred_gloves"))
    assert same.count() == 0
    odd = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, None), (4, float("-inf"))], "row_id long, feels_like double")
    odd = odd.withColumns({"wind_speed": F.lit(1.0), "pct_humidity": F.lit(0.5), "duration": F.lit(30.0), "is_light": F.lit(True)})
    assert {r[0]: r[1] for r in M.predict_outfits(trees, odd).collect()} == {1: False, 2: False, 3: None, 4: True}


# -- many groups ---------------------------------------------------------------
def _grouped(spark, rows=3000, groups=6):
    """Rows whose labels follow a rule of their group; one group in two thirds
    of all rows, and a NULL key."""
    i = F.col("row_id")
    df = spark.range(rows).select(F.col("id").alias("row_id")).withColumns({
        "athlete": F.when(i % 3 != 0, "hot").when(i % 30 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("a"), (i % groups).cast("string"))),
        "activity": F.when(i % 2 == 0, "Run").otherwise("Roadbike"),
        "feels_like": (i * 7 % 50).cast("double"), "wind_speed": (i * 3 % 11).cast("double"), "pct_humidity": (i % 9) / 10.0,
        "duration": (i % 13 * 10).cast("double"), "is_light": i % 4 == 0})
    at = F.when(F.col("athlete") == "hot", 10).when(F.col("athlete").isNull(), 40).otherwise(20) + F.when(F.col("activity") == "Run", 0).otherwise(3)
    return df.withColumns({
        "jacket": F.when(F.col("feels_like") < at, F.when(F.col("wind_speed") > 5, "Wind").otherwise("Warm")).otherwise("None"),
        "gloves": F.when(F.col("row_id") % 17 != 0, (F.col("feels_like") < at) & (F.col("duration") >= 60))})


OPTIONS = {"categorical": ["jacket"], "boolean": ["gloves"]}


def test_each_group_gets_its_own_rules(spark):
    from wearcast.operators import grouped as G

    df = _grouped(spark).cache()
    nodes = G.fit_groups(df, **OPTIONS).cache()
    out = G.predict_groups(nodes, df.withColumn("pred_gloves", F.lit("old")), **OPTIONS, normalize_humidity=False)
    assert out.columns[-2:] == ["pred_jacket", "pred_gloves"] and out.count() == 3000
    assert out.where("NOT pred_jacket <=> jacket OR (gloves IS NOT NULL AND NOT pred_gloves <=> gloves)").count() == 0
    assert nodes.select("athlete", "activity").distinct().count() == df.select("athlete", "activity").distinct().count()
    # the layout of the rows does not matter
    again = G.fit_groups(df.repartition(9, "duration"), **OPTIONS)
    assert again.exceptAll(nodes).count() == 0 and nodes.exceptAll(again).count() == 0


def test_a_group_is_fitted_as_if_alone(spark):
    """One of many and a single fit have the same gini trees (noisy labels)."""
    from wearcast.operators import grouped as G

    noise = F.pmod(F.xxhash64("row_id"), F.lit(9)) == 0
    df = _grouped(spark).withColumn("gloves", F.col("gloves") != noise).cache()
    nodes = G.fit_groups(df, **OPTIONS)
    for athlete in ("hot", None):
        mine = df.where(F.col("athlete").eqNullSafe(F.lit(athlete)) & (F.col("activity") == "Run"))
        alone = M.fit_trees(mine, ["jacket"], ["gloves"])
        model = G.model_for(nodes, athlete=athlete, activity="Run")
        a = M.apply_model(model, mine).agg(F.avg((F.col("pred_gloves") == F.col("gloves")).cast("double"))).first()[0]
        b = M.apply_model(alone, mine).agg(F.avg((F.col("pred_gloves") == F.col("gloves")).cast("double"))).first()[0]
        assert a == pytest.approx(b, abs=0.01) and a > 0.85
        one = G.fit_groups(mine, **OPTIONS)
        assert one.exceptAll(nodes).count() == 0


def test_gini_gain_against_brute_force(spark):
    """The root split of every group is the best of all thresholds."""
    import itertools
    import random

    from wearcast.operators import grouped as G

    rng = random.Random(4)
    rows = [(g, rng.randint(0, 6), rng.randint(0, 4), rng.choice("abc"), float(rng.randint(1, 3))) for g in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, x int, y int, c string, w double")
    got = {r["g"]: r for r in G.fit_groups(df, ["g"], ["c"], [], ["x", "y"], max_depth=1, weight_col="w").where("node = 1").collect()}

    def gini(rs):
        n = sum(r[4] for r in rs)
        return n - sum(sum(r[4] for r in rs if r[3] == c) ** 2 for c in "abc") / n

    for g in range(5):
        mine = [r for r in rows if r[0] == g]
        options = []
        for f in (1, 2):
            values = sorted({r[f] for r in mine})
            for a, b in itertools.pairwise(values):
                options.append((gini([r for r in mine if r[f] <= a]) + gini([r for r in mine if r[f] > a]), f, (a + b) / 2))
        best = min(options)
        assert (got[g]["feature"], got[g]["threshold"]) in {("xy"[f - 1], t) for s, f, t in options if s <= best[0] + 1e-9}


def test_awkward_groups(spark):
    from wearcast.operators import grouped as G

    df = _grouped(spark, 300)
    empty = G.fit_groups(df.limit(0), **OPTIONS)
    assert empty.count() == 0
    out = G.predict_groups(empty, df, **OPTIONS)
    assert out.count() == 300 and out.where("pred_jacket IS NOT NULL OR pred_gloves IS NOT NULL").count() == 0
    holes = df.withColumn("feels_like", F.when(F.col("row_id") % 2 == 0, F.col("feels_like"))).withColumn("gloves", F.lit(None).cast("boolean"))
    nodes = G.fit_groups(holes, **OPTIONS)
    assert {r[0] for r in nodes.select("label").distinct().collect()} == {"jacket"}
    got = G.predict_groups(nodes, holes, **OPTIONS, normalize_humidity=False)
    assert got.where("feels_like IS NULL AND pred_jacket IS NOT NULL").count() == 0 and got.where("pred_gloves IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        G.model_for(nodes, athlete="nobody", activity="Run")


def test_many_values_are_binned(spark):
    from wearcast.operators import grouped as G

    df = _grouped(spark).withColumn("feels_like", F.col("feels_like") + F.col("row_id") / 10_000)
    nodes = G.fit_groups(df, **OPTIONS, max_bins=64)
    assert nodes.where("strict").count() > 0
    out = G.predict_groups(nodes, df, **OPTIONS, normalize_humidity=False)
    assert out.where("pred_jacket = jacket").count() > 0.97 * 3000
    model = G.model_for(nodes, athlete="hot", activity="Run")
    mine = out.where("athlete = 'hot' AND activity = 'Run'")
    assert M.apply_model(model, mine.drop("pred_jacket", "pred_gloves")).select("row_id", "pred_jacket").exceptAll(mine.select("row_id", "pred_jacket")).count() == 0


def test_only_stale_groups_are_fitted_anew(spark):
    from wearcast.operators import grouped as G

    path = shared_path(spark, "test_groups")
    df = _grouped(spark, 600).withColumn("modified", F.lit(5))
    nodes, state = G.refresh_groups(df, path, **OPTIONS)
    assert state.where("fitted").count() == state.count() == 5
    newer = df.where("athlete IS NULL OR athlete <> 'a3'").withColumn("modified", F.when(F.col("athlete") == "hot", 6).otherwise(5)).withColumn("jacket", F.lit("Vest"))
    after, state = G.refresh_groups(newer, path, **OPTIONS)
    assert {(r["athlete"], r["fitted"]) for r in state.collect()} >= {("hot", True), (None, False)} and state.where("fitted").count() == 2
    assert {r[0] for r in after.where("athlete = 'hot' AND label = 'jacket'").select("value").collect()} == {"Vest"}
    untouched = "athlete IS NULL OR athlete <> 'hot'"
    assert after.where(untouched).exceptAll(nodes.where(untouched)).count() == 0 and after.where("athlete = 'a3'").count() > 0
    assert G.load_groups(spark, path).exceptAll(after).count() == 0 and G.load_groups(spark, shared_path(spark, "nothing")) is None


def test_rows_of_a_group_lie_together_and_histograms_go(spark, monkeypatch):
    """Scattered over tasks, every task made its own histogram of every group;
    and each level's was kept."""
    from wearcast.operators import grouped as G

    kept, store = {}, G._stored
    monkeypatch.setattr(G, "_stored", lambda df, name, **kw: kept.setdefault(name, []).append(store(df, name, **kw)) or kept[name][-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        G.fit_groups(_grouped(spark), **OPTIONS, max_depth=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = kept["rows"][0].select("g0", "g1", F.input_file_name().alias("file")).distinct().groupBy("g0", "g1").count().collect()
    assert len(files) > 4 and {r["count"] for r in files} == {1}
    assert not [name for name in kept if name.startswith("level")]
