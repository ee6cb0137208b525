import datetime as dt

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.functions import parsing as P
from wearcast.functions import phrases as T
from wearcast.operators.location import parse_locations, with_coordinates
from wearcast.operators.reply import add_replies, description_rows, profile, resolve_descriptions, resolve_profile
from wearcast.sources.files import read_coordinates


def test_location_keys_and_names(spark):
    rows = [("72712",), (" 72712 ",), ("72712 ",), ("Bentonville, AR",), (" Bentonville, AR",), ("Bentonville,AR",)]
    df = parse_locations(spark.createDataFrame(rows, "raw string"), "raw", sep="_")
    df = df.withColumn("slash", P.location_key(F.struct("city", "state", "zipcode"), "/"))
    got = [(r.location_key, r.location_name, r.slash) for r in df.collect()]
    assert got[:3] == [("72712", "72712", "72712")] * 3
    assert got[3:] == [("AR_Bentonville", "Bentonville,AR", "AR/Bentonville")] * 3


def test_default_coordinates(spark, tmp_path):
    coords = read_coordinates(spark, str(tmp_path / "missing.csv"))
    df = parse_locations(spark.createDataFrame([("72712",), ("Bentonville, AR",), ("Nowhere, ZZ",)], "raw string"), "raw", sep="-")
    out = with_coordinates(df.withColumnRenamed("location_key", "coord_key"), coords).orderBy("raw").collect()
    got = {r.raw: (r.latitude, r.longitude, r.found) for r in out}
    assert got["72712"] == (36.37233, -94.20949, True)
    assert got["Bentonville, AR"] == (36.37233, -94.20949, True)
    assert got["Nowhere, ZZ"] == (None, None, False)


def test_phrases(spark):
    df = spark.createDataFrame([(40, 40, "N"), (40, 40, "NE"), (None, None, None)], "t int, w int, d string")
    out = df.select(
        T.temp_phrase("t").alias("t"),
        T.wind_phrase("w").alias("w"),
        T.wind_phrase("w", "d", compat=True).alias("wd"),
        T.wind_phrase("w", "d").alias("wd16"),
    ).collect()
    assert (out[0].t, out[0].w, out[0].wd) == ("cool", "very windy", "very windy, 40 miles per hour out of the North")
    assert out[1].wd == "very windy"  # NE has no name in the original's table
    assert out[1].wd16 == "very windy, 40 miles per hour out of the Northeast"
    assert (out[2].t, out[2].w) == (None, None)


def test_english_list(spark):
    lists = [
        ["short sleeves", "socks", "shoes", None],
        [None, "short sleeves", "socks", "shoes"],
        ["short sleeves", None, "socks", "shoes"],
        ["a", "b and", "c"],
        [None, None],
        [],
    ]
    df = spark.createDataFrame([(x,) for x in lists], "a array<string>")
    got = [r.s for r in df.select(T.english_list("a").alias("s")).collect()]
    assert got[:3] == ["short sleeves, socks and shoes"] * 3
    assert got[3] == "a, b and c"  # 'b and and c' collapses
    assert got[4:] == ["", ""]


def test_descriptions_override_delete_alt(spark):
    run = profile(S.RUN)
    assert run["Short-sleeve"][0] == "singlet"
    assert run["Long-sleeve"][0] == "a long-sleeved top"
    assert run["heavy_socks"] == ("wool or insulated socks", "regular socks")
    assert "face_cover" not in run
    base = profile()
    assert base["gloves"][0] == "full fingered gloves"
    custom = resolve_profile(base, {"Short-sleeve": ("singlet", None), "gloves": None, "camel_back": ("running camelback", None),
                                   "wind_jacket": ("wind jacket", "rain jacket")})
    assert "gloves" not in custom and custom["camel_back"][0] == "running camelback"
    # table form gives the same answers
    over = {"Short-sleeve": ("singlet", None), "gloves": None, "wind_jacket": ("wind jacket", "rain jacket")}
    t = resolve_descriptions(description_rows(spark, base), description_rows(spark, over))
    d = {r.item: (r.description, r.alt_description) for r in t.collect()}
    assert d["gloves"] == (None, None)
    assert d["Short-sleeve"] == ("singlet", None)
    assert d["wind_jacket"][1] == "rain jacket"
    # compat keys: the original's 'Warm' option finds no description
    assert "Warm" not in profile(S.RUN, compat=True) and "Warm" in run


def test_reply_sentence(spark):
    df = spark.createDataFrame(
        [(1, 50.0, 0.0, "Long-sleeve", "None", "None", "Shorts-calf cover", "None", False, False, False, False, False)],
        "row_id long, feels_like double, wind_speed double, outer_layer string, base_layer string, jacket string, "
        "lower_body string, shoe_cover string, ears_hat boolean, gloves boolean, heavy_socks boolean, "
        "arm_warmers boolean, face_cover boolean",
    )
    r = add_replies(df, profile(S.RUN), opening_index=F.lit(0), clothing_index=F.lit(0)).collect()[0].reply
    assert r == (
        "It looks like it is going to be mild and calm.\n"
        "I suggest wearing a long-sleeved top and shorts with long socks or calf sleeves. "
    )
    r2 = add_replies(df, profile(S.RUN), opening_index=F.lit(2), clothing_index=F.lit(3),
                     include_boolean_items=True).collect()[0].reply
    assert r2.startswith("Well, it is going to be mild and calm.\nIf I were going out I'd wear ")
    assert r2.endswith("and regular socks. ")


def test_hours_and_dates(spark):
    hours = ["10am", "10Am", "10AM", "10 AM", "10PM", "10pM", "22:00", "22", "12am", "12pm", "noon", "25"]
    df = spark.createDataFrame([(h,) for h in hours], "h string")
    got = [r.x for r in df.select(P.parse_hour("h").alias("x")).collect()]
    assert got == [10, 10, 10, 10, 22, 22, 22, 22, 0, 12, None, None]
    ref = dt.date(2018, 12, 18)  # a Tuesday
    words = spark.createDataFrame([("today",), ("tomorrow",), ("Sun",), ("Tue",), ("Someday",)], "w string")
    got = [r.d for r in words.select(P.resolve_date("w", ref).alias("d")).collect()]
    assert got == [ref, dt.date(2018, 12, 19), dt.date(2018, 12, 23), ref, None]


def test_option_table(spark):
    from wearcast.operators.reply import option_table

    rows = {(r.label, r.ordinal): r.option for r in option_table(spark).collect()}
    assert rows[("jacket", 0)] == "None" and rows[("jacket", 8)] == "Warm-Rain-Wind"
    assert rows[("lower_body", 0)] == "Shorts"
    assert (rows[("gloves", 0)], rows[("gloves", 1)]) == ("n", "y")
    assert len(rows) == 5 + 5 + 9 + 5 + 3 + 2 * 5


def test_activity_sentence_banks(spark):
    df = spark.createDataFrame([(1, 80.0, 12.0, "Sleeveless")], "row_id long, feels_like double, wind_speed double, outer_layer string")
    out = add_replies(df, profile(S.ROADBIKE), categorical=["outer_layer"], boolean=[], openings=["Saddle up:"],
                      clothing_leads=["Pack"]).collect()[0].reply
    assert out == "Saddle up: it is going to be hot and breezy.\nPack a sleeveless top. "


def test_all_logs_skip_foreign_files(spark, tmp_path):
    from pyspark.sql import types as TT

    from wearcast.sources.files import read_activity_csv, read_all_logs

    schema = TT.StructType([TT.StructField("row_id", TT.LongType()), TT.StructField("outer_layer", TT.StringType()),
                            TT.StructField("gloves", TT.BooleanType())])
    (tmp_path / "a.csv").write_text("row_id,outer_layer,gloves\n1,None,Yes\n2,Long-sleeve,FALSE\n")
    (tmp_path / "b.csv").write_text("row_id,outer_layer,gloves\n3,Sleeveless,n\n")
    (tmp_path / "location_cache.csv").write_text("location,latitude,longitude\n72712,36.3,-94.2\n")
    rows = read_all_logs(spark, [(str(tmp_path / "*.csv"), schema)]).orderBy("row_id").collect()
    assert [(r.row_id, r.outer_layer, r.gloves) for r in rows] == [(1, "None", True), (2, "Long-sleeve", False),
                                                                     (3, "Sleeveless", False)]
    # a named file gets the .csv suffix
    named = read_activity_csv(spark, str(tmp_path / "a"), schema).collect()
    assert len(named) == 2


def test_dimension_join_paths_and_strict(spark):
    import pytest

    from wearcast.operators.joins import join_dimension

    fact = spark.createDataFrame([("a", 1), ("b", 2)], "coord_key string, v int")
    dim = spark.createDataFrame([("a", 1.0, 2.0)], "location string, latitude double, longitude double")
    wide = dim.withColumnRenamed("location", "coord_key")
    big = join_dimension(fact, wide, "coord_key")
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()  # no hint: the planner decides on bytes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "BroadcastHashJoin" not in join_dimension(fact, wide, "coord_key")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.v for r in big.collect()) == [1, 2]
    ok = with_coordinates(fact, dim)
    assert {r.coord_key: r.found for r in ok.collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="no coordinates"):
        with_coordinates(fact, dim, strict=True).collect()


def test_coordinates_seeded_when_missing(spark, tmp_path):
    path = str(tmp_path / "location_cache")
    first = read_coordinates(spark, path, seed_missing=True)
    assert sorted(r.location for r in first.collect()) == ["72712", "AR-Bentonville"]
    again = read_coordinates(spark, path)  # now read from the written table
    assert again.count() == 2


def test_activity_log_in_its_own_column_order(spark, tmp_path):
    from wearcast.sources.files import read_activity_csv

    header = ("location,condition,feels_like,heat_index,temp_f,wind_dir,wind_speed,precip_chance,tod,month_day,mth,dow,"
              "civil_time,is_light,pct_humidity,timestamp,is_daylight,arm_warmers,base_layer,ears_hat,face_cover,gloves,"
              "heavy_socks,jacket,lower_body,outer_layer,shoe_cover,duration")
    row = (",clear,41,0,41,NW,7,0,7,3,2,Sunday,7:00:00 AM,TRUE,64,2/3/2019 7:00,TRUE,FALSE,Long-sleeve,TRUE,FALSE,"
           "TRUE,FALSE,None,Long tights,None,None,45")
    (tmp_path / "log.csv").write_text(header + "\n" + row + "\n")
    r = read_activity_csv(spark, str(tmp_path / "log")).collect()[0]
    assert (r.feels_like, r.wind_speed, r.pct_humidity, r.duration) == (41.0, 7.0, 64.0, 45.0)
    assert (r.is_light, r.ears_hat, r.gloves, r.arm_warmers) == (True, True, True, False)
    assert (r.base_layer, r.outer_layer, r.jacket, r.lower_body) == ("Long-sleeve", "None", "None", "Long tights")
    assert r.location is None and r.dow == "Sunday"


def test_build_reply_single_outfit(spark):
    from wearcast.operators.reply import build_reply

    outfit = {"outer_layer": "Long-sleeve", "base_layer": "None", "jacket": "None", "lower_body": "Shorts-calf cover",
              "shoe_cover": "None", "ears_hat": False, "gloves": False, "heavy_socks": False, "arm_warmers": False,
              "face_cover": False}
    got = build_reply(spark, outfit, {"feels_like": 50, "wind_speed": 12, "pct_humidity": 0.5}, profile(S.RUN))
    assert got == ("It looks like it is going to be mild and breezy.\n"
                   "I suggest wearing a long-sleeved top and shorts with long socks or calf sleeves. ")
    assert build_reply(spark, None) == ""
    single = build_reply(spark, {"outer_layer": "Short-sleeve"}, None, profile(S.RUN), 1, 3)
    assert single == "Oh my, it is going to be .\nIf I were going out I'd wear singlet. "


def test_template_sink_and_parquet_workbook(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import types as TT

    from wearcast.sources import files as FS

    tpl = FS.sample_template(spark, [TT.StructField("row_id", TT.LongType())])
    assert tpl.count() == 0 and tpl.columns[0] == "row_id" and set(S.LABELS + S.FEATURES) <= set(tpl.columns)
    assert FS.default_sample_name(dt.datetime(2024, 3, 7, 9, 5)) == "outfit_data_7395.csv"
    out = FS.write_sample_data(tpl.limit(0), str(tmp_path), "empty.csv")
    assert spark.read.option("header", True).csv(out).count() == 0
    sheet = spark.createDataFrame(
        [("2024-01-01", "07:00", "Run", "5.2", "45", "Yes", "Long-sleeve", "n", None),
         (None, None, None, None, None, None, None, None, None)],
        "Date string, Time string, Activity string, Distance string, `Length of activity (min)` string, "
        "Light string, `Outer Layer` string, Gloves string, Notes string",
    )
    sheet.write.parquet(str(tmp_path / "sheet.parquet"))
    rows = FS.read_workbook_export(spark, str(tmp_path / "sheet.parquet")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.activity, r.distance, r.duration, r.is_light, r.outer_layer, r.gloves) == ("Run", 5.2, 45.0, True, "Long-sleeve", False)
    assert "Notes" not in rows[0].asDict() and "activity_hour" not in rows[0].asDict()


def test_logs_are_read_by_their_own_headers(spark, tmp_path):
    from pyspark.sql import types as TT

    from wearcast.sources import files as FS

    schema = TT.StructType([TT.StructField("row_id", TT.LongType()), TT.StructField("jacket", TT.StringType()),
                            TT.StructField("gloves", TT.BooleanType()), TT.StructField("wind_speed", TT.DoubleType())])
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a b.csv").write_text("row_id,jacket,gloves,wind_speed\n1,Wind,Yes,3\n2,None,No,4.5\n")
    (logs / "b.csv").write_text("wind_speed,gloves,row_id,jacket\n5,TRUE,3,Rain\n6,,4,None\n7,n,5,bad,extra\n")
    (logs / "c.csv").write_text("jacket,row_id,note,gloves\nWarmth,6,hi,y\nWind,x,ho,y\n")
    (logs / "d.csv").write_text("location,latitude\n72712,3.0\n")
    (logs / "e.csv").write_text("")
    families = [(str(logs / "*.csv"), schema)]
    df = FS.read_all_logs(spark, families)
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert rows == sorted([(1, "Wind", True, 3.0, None), (2, "None", False, 4.5, None), (3, "Rain", True, 5.0, None),
                           (4, "None", None, 6.0, None), (6, "Warmth", True, None, "hi"), (None, "Wind", True, None, "ho")], key=str)
    assert df.count() == len(rows) == len(df.select("jacket").collect()) == len(df.select("gloves").collect())
    report = {r["header"]: (r["files"], r["taken"], r["lines_read"], r["lines_dropped"]) for r in FS.log_report(spark, families).collect()}
    assert report == {"row_id,jacket,gloves,wind_speed": (1, True, 2, 0), "wind_speed,gloves,row_id,jacket": (1, True, 2, 1),
                      "jacket,row_id,note,gloves": (1, True, 2, 0), "location,latitude": (1, False, 0, 0)}
    named = FS.read_activity_csv(spark, str(logs / "b"), schema)
    assert named.count() == 3 and {r["row_id"] for r in named.collect()} == {3, 4, 5}


def test_truncated_log_fails(spark, tmp_path):
    import gzip

    import pytest

    from wearcast.sources.files import read_activity_csv

    data = gzip.compress(("row_id,jacket\n" + "".join(f"{i},Wind{i * 7919}\n" for i in range(60000))).encode())
    (tmp_path / "part.csv.gz").write_bytes(data[: len(data) // 2])
    from pyspark.sql import types as TT

    schema = TT.StructType([TT.StructField("row_id", TT.LongType()), TT.StructField("jacket", TT.StringType())])
    with pytest.raises(Exception):
        read_activity_csv(spark, str(tmp_path / "*.csv.gz"), schema).count()


def test_workbook_parts_in_other_column_orders(spark, tmp_path):
    from wearcast.sources.files import read_workbook_export

    (tmp_path / "p1.csv").write_text("Wind,Feels like,Gloves\n5,41.5,Yes\n,,\n")
    (tmp_path / "p2.csv").write_text("Feels like,Wind,Gloves\n60.5,9,n\n")
    rows = {(r["wind_speed"], r["feels_like"], r["gloves"]) for r in read_workbook_export(spark, str(tmp_path)).collect()}
    assert rows == {(5.0, 41.5, True), (9.0, 60.5, False)}


def test_samples_can_be_appended(spark, tmp_path):
    import pytest

    from wearcast.sources.files import write_sample_data

    df = spark.createDataFrame([(1, "a")], "row_id long, jacket string")
    path = write_sample_data(df, str(tmp_path), "s")
    write_sample_data(df, str(tmp_path), "s", append=True)
    assert spark.read.option("header", True).csv(path).count() == 2
    with pytest.raises(Exception):
        write_sample_data(df, str(tmp_path), "s")


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    import pytest

    from wearcast.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
