"""Queries over the decision-tree models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators import model as M
from wearcast.plans.catalog import register
from wearcast.plans.inputs import LABEL_RULES, lineitem_training
from wearcast.session import read_table, shared_path

# The stand-in labels follow threshold rules a depth-4 tree can represent, so
# a correct fit recovers them exactly: the oracle is the rules themselves.
_PRED_SQL = "SELECT l_orderkey * 8 + l_linenumber AS row_id, " + ", ".join(
    f"{rule} AS pred_{lab}" for lab, rule in LABEL_RULES.items()
) + " FROM lineitem"


@register("tree_predict", _PRED_SQL)
def tree_predict(spark, sf_dir):
    """L1 + L2: fit one depth-4 tree per label (dual strategy) on every line
    item, then predict every line item."""
    train = lineitem_training(spark, sf_dir)
    model = M.fit_dual(train)
    return M.predict_outfits(model, train)


def _perfect_sql() -> str:
    rows = []
    for strategy in ("ddt", "sdt"):
        for lab in [*S.LABELS, "overall"]:
            rows.append(f"SELECT '{strategy}' AS strategy, '{lab}' AS label, CAST(1.0 AS DOUBLE) AS accuracy")
    return " UNION ALL ".join(rows)


@register("tree_score", _perfect_sql())
def tree_score(spark, sf_dir):
    """Both strategies fitted and scored on the labelled line items
    (the single strategy with booleans as Yes/No categories)."""
    train = lineitem_training(spark, sf_dir)
    return M.fit_and_score(train, ("ddt", "sdt"))


# -- L4 on rows the model has not seen ----------------------------------------
# One label in thirty is wrong, by numbers that no feature knows of; every fifth
# order is held out.  A tree keeps to the rule, so its score is the share of
# held-out rows whose label does, which SQL counts.
_WRONG = "((l_partkey * {k} + l_suppkey + l_orderkey) % 30 = 3)"
_NOISY = {
    lab: f"CASE WHEN {_WRONG.format(k=3 + 2 * i)} THEN {'NOT ' + rule if lab in S.BOOLEAN_LABELS else repr(S.CATEGORICAL_DOMAINS[lab][0])} ELSE {rule} END"
    for i, (lab, rule) in enumerate(LABEL_RULES.items())
}


def _held_out_sql() -> str:
    hits = ", ".join(f"CAST(count(*) FILTER ({noisy} = {LABEL_RULES[lab]}) AS DOUBLE) AS {lab}" for lab, noisy in _NOISY.items())
    shares = [(lab, f"{lab} / n") for lab in S.LABELS] + [("overall", f"({' + '.join(S.LABELS)}) / (n * {len(S.LABELS)})")]
    rows = " UNION ALL ".join(
        f"SELECT '{strategy}' AS strategy, '{lab}' AS label, {share} AS accuracy FROM a" for strategy in ("ddt", "sdt") for lab, share in shares)
    return f"WITH a AS (SELECT CAST(count(*) AS DOUBLE) AS n, {hits} FROM lineitem WHERE l_orderkey % 5 = 0) {rows}"


@register("held_out_scores", _held_out_sql())
def held_out_scores(spark, sf_dir):
    """L4: both strategies fitted on four fifths of the orders, with wrong
    labels among them, and scored on the fifth that they have not seen."""
    from wearcast.plans.inputs import LINEITEM_TRAINING, spark_view

    shaped = [c for c in LINEITEM_TRAINING if c[0] not in LABEL_RULES] + list(_NOISY.items()) + [("held_out", "l_orderkey % 5 = 0")]
    train = spark_view(read_table(spark, sf_dir, "lineitem"), shaped)
    return M.fit_and_score(train, held_out=F.col("held_out"))


@register("model_roundtrip", _PRED_SQL)
def model_roundtrip(spark, sf_dir):
    """S8 + L7 + F7: train-or-load against the training files' modification
    time: the first call fits and saves a new version, the second finds it
    fresh and loads it; the loaded model predicts every line item."""
    from wearcast.session import table_path

    train = lineitem_training(spark, sf_dir)
    base = shared_path(spark, "models")
    mtime = M.data_modified(spark, table_path(sf_dir, "lineitem"))
    _, retrained = M.get_model(spark, train, base, "ddt", data_mtime=mtime)
    loaded, retrained_again = M.get_model(spark, train, base, "ddt", data_mtime=mtime)
    if not retrained or retrained_again:
        raise RuntimeError("model staleness check did not behave as expected")
    return M.predict_outfits(loaded, train)


# -- L7 for many groups -------------------------------------------------------
# Every supplier is an athlete with two activities and label rules of its own:
# the quantity moves by the supplier's number.
_OWN = {lab: rule.replace("CAST(l_quantity AS DOUBLE)", "CAST(l_quantity + l_suppkey % 5 AS DOUBLE)") for lab, rule in LABEL_RULES.items()}
_KEYS = [("athlete", "l_suppkey"), ("activity", "CASE WHEN l_linestatus = 'F' THEN 'Run' ELSE 'Roadbike' END")]
_GROUPED_SQL = "SELECT l_orderkey * 8 + l_linenumber AS row_id, " + ", ".join(
    [f"{rule} AS {name}" for name, rule in _KEYS] + [f"{rule} AS pred_{lab}" for lab, rule in _OWN.items()]) + " FROM lineitem"


@register("grouped_models", _GROUPED_SQL)
def grouped_models(spark, sf_dir):
    """L7, L1, L2 for many: the models of every (athlete, activity) are fitted
    together and stored as one node table; every line item is then predicted
    by its own group's stored model."""
    from wearcast.operators import grouped as G
    from wearcast.plans.inputs import LINEITEM_TRAINING, spark_view, with_plain_round

    shaped = [c for c in LINEITEM_TRAINING if c[0] not in LABEL_RULES] + _KEYS + list(_OWN.items()) + [("modified", "1")]
    train = spark_view(read_table(spark, sf_dir, "lineitem"), with_plain_round(shaped))
    nodes, _ = G.refresh_groups(train, shared_path(spark, "grouped_models"))
    out = G.predict_groups(nodes, train.drop(*S.LABELS, "modified"))
    return out.select("row_id", "athlete", "activity", *[f"pred_{lab}" for lab in S.LABELS])


# -- L2 on incomplete rows, L3 ----------------------------------------------
_GAPS = "SELECT l_orderkey * 8 + l_linenumber AS row_id, " + ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % 6 = 5 THEN {rule} END AS pred_{lab}" for lab, rule in LABEL_RULES.items()
) + " FROM lineitem"


@register("predict_incomplete", _GAPS)
def predict_incomplete(spark, sf_dir):
    """L2 with gaps: five of six line items lack one feature or another and
    get no outfit; the sixth is complete."""
    train = lineitem_training(spark, sf_dir)
    model = M.fit_dual(train)
    lacks = (F.floor(F.col("row_id") / 8) + F.col("row_id") % 8) % 6
    holed = train.withColumns({f: F.when(lacks != i, F.col(f)) for i, f in enumerate(S.FEATURES)})
    return M.predict_outfits(model, holed)


_ONE = f"""WITH p AS ({_PRED_SQL}) SELECT {", ".join(f"pred_{lab} AS {lab}" for lab in S.LABELS)} FROM p
WHERE row_id = (SELECT max(row_id) FROM p)"""


@register("predict_single", _ONE)
def predict_single(spark, sf_dir):
    """L3: the outfit of one scenario, the last line item's, with humidity
    given in percent, by trees fitted on every line item."""
    train = lineitem_training(spark, sf_dir)
    last = train.orderBy(F.desc("row_id")).select(*S.FEATURES).first().asDict()
    percent = {**last, "pct_humidity": round(last["pct_humidity"] * 100)}
    outfit = M.predict_outfit(spark, M.fit_dual(train), **percent)
    kinds = ", ".join(f"{lab} {'boolean' if lab in S.BOOLEAN_LABELS else 'string'}" for lab in S.LABELS)
    return spark.createDataFrame([tuple(outfit[lab] for lab in S.LABELS)], kinds)


# -- E2 ---------------------------------------------------------------------
# Stand-in weather on the training grid, so that the trees give the label
# rules: two hours per event, newest write per place and hour, in the forecast
# store by event type; a request per event some hours around its time.
_GRID = {"feels_like": "CAST(1 + (event_id + {k}) % 50 AS DOUBLE)", "wind_speed": "CAST(event_id % 11 AS DOUBLE)", "pct_humidity": "CAST(event_id % 9 * 10 AS DOUBLE)"}


def _recommendation_sql() -> str:
    from wearcast.plans.inputs import _D, _H, _Q, _W
    from wearcast.plans.q_lookup import FORECAST_TYPES, NOW
    from wearcast.plans.q_reply import run_reply_sql

    kind = f"CASE WHEN event_type IN {FORECAST_TYPES} THEN 'forecast' ELSE 'history' END"
    points = " UNION ALL ".join(
        f"SELECT {kind} AS kind, CAST(user_id AS VARCHAR) AS location_key, date_trunc('hour', ts) + to_hours({k}) AS obs_hour, ts AS snapshot_ts, "
        f"event_id AS seq, {_GRID['feels_like'].format(k=k)} AS feels_like, {_GRID['wind_speed']} AS wind_speed, "
        f"CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE {_GRID['pct_humidity']} / 100 END AS pct_humidity FROM events WHERE event_id % 17 <> 0"
        for k in (0, 1)
    )
    rules = {}
    for lab, rule in LABEL_RULES.items():
        for old, new in ((_Q, "feels_like"), (_W, "wind_speed"), (_H, "pct_humidity"), (_D, "duration")):
            rule = rule.replace(old, new)
        rules[lab] = f"CASE WHEN found THEN {rule} END AS {lab}"
    draw = "CAST(('0x' || substr(md5(row_id || ':{}:0'), 1, 13)) AS BIGINT)"
    reply = run_reply_sql(draw.format(17), draw.format(18))
    return f"""WITH p AS ({points}),
st AS (SELECT * FROM p WHERE kind = 'history' OR snapshot_ts >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR
  QUALIFY row_number() OVER (PARTITION BY kind, location_key, obs_hour ORDER BY snapshot_ts DESC, seq DESC) = 1),
r AS (SELECT event_id AS row_id, CAST(user_id + event_id % 2 AS VARCHAR) AS location_key, date_trunc('hour', ts + to_hours(event_id % 5 - 2)) AS obs_hour,
  15.0 * (event_id % 7 + 1) AS duration FROM events),
k AS (SELECT *, CASE WHEN obs_hour > TIMESTAMP '{NOW}' THEN 'forecast' ELSE 'history' END AS kind FROM r),
j AS (SELECT k.*, st.seq IS NOT NULL AS found, st.feels_like, st.wind_speed, st.pct_humidity FROM k
  LEFT JOIN st ON k.kind = st.kind AND k.location_key = st.location_key AND k.obs_hour = st.obs_hour),
o AS (SELECT *, {", ".join(rules.values())} FROM j)
SELECT row_id, location_key, obs_hour, kind, found, found AS usable, feels_like, wind_speed, pct_humidity,
  {", ".join(f"{lab} AS pred_{lab}" for lab in S.LABELS)}, CASE WHEN found THEN {reply} END AS reply FROM o"""


@register("weather_recommendation", _recommendation_sql())
def weather_recommendation(spark, sf_dir):
    """E2 end to end: every event's forecast document becomes observations;
    every event is also a request for a place and a time as typed; each
    request is parsed, routed, looked up (newest write, forecasts at most 12
    hours old), its outfit predicted by trees fitted on every line item, and
    answered with an English reply."""
    from wearcast.operators.observations import observations_from_points
    from wearcast.operators.recommend import recommend
    from wearcast.operators.reply import profile
    from wearcast.plans.q_lookup import FORECAST_TYPES, NOW
    from wearcast.sources.weather_json import explode_hourly

    e = read_table(spark, sf_dir, "events")
    hour = F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp"))

    def point(k: int):
        return F.struct(
            (hour + 3600 * k).alias("time"),
            F.lit("wind").alias("icon"),
            F.expr(_GRID["feels_like"].format(k=k)).alias("temperature"),
            F.expr(_GRID["feels_like"].format(k=k)).alias("apparentTemperature"),
            F.expr(_GRID["wind_speed"]).alias("windSpeed"),
            F.lit(0.0).alias("windBearing"),
            F.lit(0.0).alias("precipProbability"),
            F.expr(_GRID["pct_humidity"]).alias("humidity"),
        )

    docs = e.select(
        F.col("user_id").cast("string").alias("location"),
        F.col("ts").alias("snapshot_ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").isin(*FORECAST_TYPES).alias("is_forecast"),
        F.when(F.col("event_id") % 17 != 0, F.struct(F.array(point(0), point(1)).alias("data"))).alias("hourly"),
    )
    obs = observations_from_points(explode_hourly(docs, ["location", "snapshot_ts", "seq", "is_forecast"]))
    cols = ["location_key", "obs_hour", "snapshot_ts", "seq", "epoch", "feels_like", "wind_speed", "pct_humidity"]
    typed = F.concat(F.lit(" "), (F.col("user_id") + F.col("event_id") % 2).cast("string"), F.lit(" "))
    requests = e.select(
        F.col("event_id").alias("row_id"),
        typed.alias("place"),
        F.timestamp_add("HOUR", F.col("event_id") % 5 - 2, F.col("ts")).alias("when"),
        (F.lit(15.0) * (F.col("event_id") % 7 + 1)).alias("duration"),
        (F.col("event_id") % 5 != 0).alias("is_light"),
    )
    model = M.fit_dual(lineitem_training(spark, sf_dir))
    out = recommend(
        requests, obs.filter("is_forecast IS TRUE").select(*cols), obs.filter("is_forecast IS NOT TRUE").select(*cols),
        model, profile(S.RUN), NOW,
    )
    return out.select(
        "row_id", "location_key", "obs_hour", "kind", "found", "usable", "feels_like", "wind_speed", "pct_humidity",
        *[f"pred_{lab}" for lab in S.LABELS], "reply",
    )
