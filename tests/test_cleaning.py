from wearcast import schema as S
from wearcast.functions.parsing import parse_bool
from wearcast.operators import cleaning as C

LAYER_SCHEMA = "jacket string, outer_layer string, base_layer string"


def test_fix_layers_rules(spark):
    rows = [
        ("Wind", "A", "B"),
        ("Wind", "A", "None"),
        ("Wind", "None", "B"),
        ("None", "A", "B"),
        ("None", "A", "None"),
        ("None", "None", "B"),
        ("None", "None", "None"),
    ]
    out = C.fix_layers(spark.createDataFrame(rows, LAYER_SCHEMA)).collect()
    got = [(r.jacket, r.outer_layer, r.base_layer) for r in out]
    assert got == [
        ("Wind", "A", "B"),
        ("Wind", "None", "A"),
        ("Wind", "None", "B"),
        ("None", "A", "B"),
        ("None", "A", "None"),
        ("None", "B", "None"),
    ]


def test_fix_layers_null_counts_as_present(spark):
    df = spark.createDataFrame([("Wind", None, "None"), ("None", None, "None")], LAYER_SCHEMA)
    out = C.fix_layers(df).collect()
    # A NULL outer layer is not the 'None' option: neither row is dropped,
    # and the jacket row moves its (NULL) outer layer to the base.
    assert len(out) == 2
    assert (out[0].outer_layer, out[0].base_layer) == ("None", None)


def test_length_bin_right_closed(spark):
    df = spark.createDataFrame([(d,) for d in [0.0, 0.5, 31.0, 31.5, 61.0, 121.0, 121.5, 720.0, 721.0, None]], "d double")
    got = [r.b for r in df.select(C.length_bin("d").alias("b")).collect()]
    assert got == [None, "short", "short", "medium", "medium", "long", "extra long", "extra long", None, None]


def test_domains_and_ordinals(spark):
    df = spark.createDataFrame([("Capri", "Warm"), ("Tank", "None"), (None, "Vest")], "lower_body string, jacket string")
    out = C.apply_domains(df, ordinals=True).collect()
    assert [(r.lower_body, r.lower_body_ord, r.jacket, r.jacket_ord) for r in out] == [
        ("Capri", 2, "Warm", 3),
        (None, None, "None", 0),
        (None, None, "Vest", 1),
    ]


def test_parse_bool_spellings(spark):
    words = ["Yes", "yes", "y", "Y", "No", "no", "n", "N", "TRUE", "false", "maybe", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.b for r in df.select(parse_bool("w").alias("b")).collect()]
    assert got == [True] * 4 + [False] * 4 + [True, False, None, None]


def test_clean_log_order_and_columns(spark):
    rows = [
        # feels, wind, hum, dur, light, outer, base, jacket, legs, shoe, 5 booleans, activity, Athlete
        (40.0, 5.0, 50.0, 30.0, True, "None", "Long-sleeve", "None", "Capri", "None", True, None, False, False, False, "Run", "me"),
        (40.0, 5.0, 50.0, 30.0, True, "None", "None", "Wind", "Capri", "None", True, True, False, False, False, "Run", "me"),
        (60.0, None, 50.0, 45.0, False, "Tank", "None", "Wind", "Shorts", "Boots", False, False, True, False, False, "Run", "me"),
        (60.0, 2.0, 50.0, 45.0, False, "Sleeveless", "None", "None", "Shorts", "None", False, False, True, False, False, "Roadbike", "me"),
    ]
    schema = (
        "feels_like double, wind_speed double, pct_humidity double, duration double, is_light boolean, "
        "outer_layer string, base_layer string, jacket string, lower_body string, shoe_cover string, "
        "ears_hat boolean, gloves boolean, heavy_socks boolean, arm_warmers boolean, face_cover boolean, "
        "activity string, Athlete string"
    )
    out = C.clean_activity_log(spark.createDataFrame(rows, schema))
    assert set(out.columns) == set(S.LABELS + S.FEATURES)
    got = out.collect()
    assert len(got) == 2  # no-layer row dropped, other activity dropped
    first, second = got
    assert (first.outer_layer, first.base_layer, first.gloves) == ("Long-sleeve", "None", False)
    # out-of-domain 'Tank' moved to base by the jacket rule, then nulled by the domain
    assert (second.outer_layer, second.base_layer, second.wind_speed) == ("None", None, 0.0)


def test_drop_counts(spark):
    df = spark.createDataFrame([("None", "None"), ("A", "None"), (None, "None")], "outer_layer string, base_layer string")
    r = C.drop_counts(df).collect()[0]
    assert (r.n_rows, r.n_dropped, r.n_kept) == (3, 1, 2)


def test_workbook_rename_and_yes_no(spark):
    df = spark.createDataFrame([("Long-sleeve", True, None)], "`Outer Layer` string, `Hat-Ears` boolean, Notes string")
    out = C.rename_workbook_headers(df)
    assert out.columns == ["outer_layer", "ears_hat", "Notes"]
    assert C.booleans_to_yes_no(out).collect()[0].ears_hat == "Yes"
    assert C.drop_columns(out, ["Notes", "absent"]).columns == ["outer_layer", "ears_hat"]


def test_observed_drop_metric(spark):
    df = spark.createDataFrame([("None", "None"), ("A", "None"), ("None", "B")], "outer_layer string, base_layer string")
    observed, obs = C.observe_dropped_layers(df)
    assert observed.filter(~C.no_layer()).count() == 2
    assert obs.get == {"rows": 3, "dropped": 1}


def test_yes_no_keeps_an_unknown_answer_apart(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "row_id int, gloves boolean")
    assert {r.row_id: r.gloves for r in C.booleans_to_yes_no(rows).collect()} == {1: "Yes", 2: "No", 3: None}
