"""Property checks: Spark column functions against small Python statements of
their specifications, on random batches (one Spark job per batch)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from wearcast import schema as S
from wearcast.functions import phrases as T
from wearcast.functions import weather as W
from wearcast.operators import cleaning as C

SETTINGS = settings(max_examples=4, deadline=None)

_words = st.sampled_from(["shorts", "socks", "a, b", " cap ", "and", "gloves,", None])


def spec_list(items):
    """Spec: non-NULL items joined by ', ', commas/blanks trimmed at the ends,
    the last comma replaced by ' and', doubled 'and and' collapsed."""
    text = ", ".join(i for i in items if i is not None).strip(", ")
    head, sep, tail = text.rpartition(",")
    if sep and head:
        text = f"{head} and{tail}"
    return text.replace("and and", "and")


@SETTINGS
@given(st.lists(st.lists(_words, max_size=5), min_size=1, max_size=60))
def test_english_list_matches_spec(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<string>")
    got = {r.i: r.s for r in df.select("i", T.english_list("a").alias("s")).collect()}
    assert got == {i: spec_list(r) for i, r in enumerate(rows)}


_layer = st.sampled_from(["None", "Sleeveless", "Long-sleeve", None])
_jacket = st.sampled_from(["None", "Wind", None])


@SETTINGS
@given(st.lists(st.tuples(_jacket, _layer, _layer), min_size=1, max_size=80))
def test_fix_layers_matches_spec(spark, rows):
    def spec(j, o, b):
        none = lambda x: x == "None"  # noqa: E731 - NULL is not the 'None' option
        if none(o) and none(b):
            return None
        if not none(j) and not none(o) and none(b):
            return (j, "None", o)
        if none(j) and none(o) and not none(b):
            return (j, b, "None")
        return (j, o, b)

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, jacket string, outer_layer string, base_layer string")
    got = {r.i: (r.jacket, r.outer_layer, r.base_layer) for r in C.fix_layers(df).collect()}
    want = {i: spec(*r) for i, r in enumerate(rows) if spec(*r) is not None}
    assert got == want


_num = st.one_of(st.none(), st.floats(min_value=-50, max_value=800, allow_nan=False).map(lambda x: round(x, 2)))


@SETTINGS
@given(st.lists(st.tuples(_num, _num, _num), min_size=1, max_size=80))
def test_numeric_phrases_and_bins_match_spec(spark, rows):
    def temp(t):
        if t is None:
            return None
        return next((w for b, w in S.TEMP_PHRASES if t < b), S.TEMP_PHRASE_ABOVE)

    def wind(w):
        if w is None:
            return None
        return next((p for b, p in S.WIND_PHRASES if w < b), S.WIND_PHRASE_ABOVE)

    def length(d):
        if d is None:
            return None
        e, n = S.LENGTH_BIN_EDGES, S.LENGTH_BIN_NAMES
        return next((name for lo, hi, name in zip(e[:-1], e[1:], n) if lo < d <= hi), None)

    def compass(b):
        b = 0.0 if b is None else b  # a missing bearing counts as north
        return S.COMPASS_POINTS[int(b / 22.5 + 0.5) % 16]  # truncation, then a non-negative modulo

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, w double, d double")
    out = df.select(
        "i",
        T.temp_phrase("t").alias("tp"),
        T.wind_phrase("w").alias("wp"),
        C.length_bin("d").alias("lb"),
        W.compass_point("w").alias("cp"),
        W.humidity_fraction("d").alias("h"),
    ).collect()
    for r in out:
        t, w, d = rows[r.i]
        assert (r.tp, r.wp, r.lb, r.cp) == (temp(t), wind(w), length(d), compass(w))
        assert r.h == (None if d is None else (d if d < 1 else d / 100))


_place = st.builds(
    lambda a, b, c, d: f"{a}{b}{c}{d}",
    st.sampled_from(["", " ", "  "]),
    st.sampled_from(["Bentonville", "New Town", "72712", "Fort Smith", "x"]),
    st.sampled_from([",", ", ", ",  ", " ", ""]),
    st.sampled_from(["AR", "ark", "", "TX ", "12"]),
)


@SETTINGS
@given(st.lists(_place, min_size=1, max_size=60))
def test_place_parsing_matches_spec(spark, texts):
    import re

    from wearcast.operators.location import parse_locations

    def spec(t):
        """'City, ST' (word characters and blanks, a comma, two word characters
        at the end) gives (ST/City, City,ST); anything else is a stripped zip."""
        m = re.fullmatch(r"([\w\s]+),\s*(\w{2})", t)
        if m:
            city, state = m.group(1).strip(), m.group(2).strip()
            return (f"{state}/{city}", f"{city},{state}")
        return (t.strip(), t.strip())

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r.i: (r.location_key, r.location_name) for r in parse_locations(df, "raw").collect()}
    assert got == {i: spec(t) for i, t in enumerate(texts)}
