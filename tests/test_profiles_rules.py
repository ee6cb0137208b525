"""Inherited profiles, rules as a variant, one-pass quarantine."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wearcast.operators import profiles as P
from wearcast.operators.observations import quarantine, reason_counts, with_reasons, write_checked
from wearcast.sources.files import read_clothing_rules, read_coordinates

PARENTS = "activity string, parent string"
MENTIONS = "activity string, item string, description string, alt_description string"


def _resolved(spark, parents, mentions):
    out = P.resolve_inherited(spark.createDataFrame(parents, PARENTS), spark.createDataFrame(mentions, MENTIONS))
    return {(r["activity"], r["item"]): (r["description"], r["alt_description"], r["depth"]) for r in out.collect()}


def test_nearest_mention_and_deletions(spark):
    parents = [("trail", "run"), ("run", "base"), ("base", None), ("ride", "base"), (None, "base"), ("orphan", "unlisted")]
    mentions = [
        ("base", "gloves", "full fingered gloves", None), ("base", "socks", "wool socks", "regular socks"), ("base", "cap", "cap", None),
        ("run", "gloves", None, None), ("run", "cap", "visor", None), ("trail", "socks", "gaiters", "x"), ("trail", "cap", None, None),
        ("ride", "gloves", "short gloves", None), ("nobody", "cap", "crown", None), ("ride", None, "no item", None), ("unlisted", "hat", "hat", None),
        ("ride", "socks", None, None), ("ride", "socks", "cycling socks", None),
    ]
    got = _resolved(spark, parents, mentions)
    assert got == {
        ("base", "gloves"): ("full fingered gloves", None, 0), ("base", "socks"): ("wool socks", "regular socks", 0), ("base", "cap"): ("cap", None, 0),
        ("run", "gloves"): (None, None, 0), ("run", "socks"): ("wool socks", "regular socks", 1), ("run", "cap"): ("visor", None, 0),
        ("trail", "gloves"): (None, None, 1), ("trail", "socks"): ("gaiters", "x", 0), ("trail", "cap"): (None, None, 0),
        ("ride", "gloves"): ("short gloves", None, 0), ("ride", "socks"): ("cycling socks", None, 0), ("ride", "cap"): ("cap", None, 1),
        ("orphan", "hat"): ("hat", None, 1),
    }
    out = P.resolve_inherited(spark.createDataFrame(parents, PARENTS), spark.createDataFrame(mentions, MENTIONS))
    shown = {(r["activity"], r["item"]) for r in P.described(out).collect()}
    assert ("run", "gloves") not in shown and ("run", "cap") in shown


def test_long_lines_against_a_walk(spark):
    """Forty generations, and many activities on one parent."""
    names = [f"g{i}" for i in range(40)]
    parents = list(zip(names, [None, *names])) + [(f"leaf{i}", "g39") for i in range(300)]
    mentions = [(n, f"item{i % 7}", f"{n}", None) for i, n in enumerate(names)]
    got = _resolved(spark, parents, mentions)
    up, said = dict(parents), {}
    for n, item, text, _ in mentions:
        said[(n, item)] = text
    for a in up:
        for item in {m[1] for m in mentions}:
            at, depth = a, 0
            while at is not None and (at, item) not in said:
                at, depth = up[at], depth + 1
            assert got.get((a, item)) == (None if at is None else (said[(at, item)], None, depth))


@pytest.mark.parametrize("parents, said", [
    ([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "circle"), ([("a", "a")], "circle"), ([("a", "b"), ("a", "c")], "several parents")])
def test_circles_and_two_parents_are_refused(spark, parents, said):
    with pytest.raises(Exception, match=said):
        P.ancestry(spark.createDataFrame(parents, PARENTS)).collect()


def test_too_deep_is_refused(spark):
    names = [f"g{i}" for i in range(9)]
    parents = spark.createDataFrame(list(zip(names, [None, *names])), PARENTS)
    assert P.ancestry(parents, max_depth=8).count() == 45
    with pytest.raises(Exception, match="more than 5"):
        P.ancestry(parents, max_depth=5).collect()


# -- S9 ------------------------------------------------------------------------
def _rules(spark, tmp_path, *docs):
    for i, d in enumerate(docs):
        (tmp_path / f"r{i}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=2))
    return sorted(tuple(r) for r in read_clothing_rules(spark, str(tmp_path)).collect())


def test_rules_of_every_type(spark, tmp_path):
    doc = {"run": {"cold": {"head": "hat", "feet": ["a", None, "", "b", 3, ["x"]], "n": None, "num": 5, "list text": '["not", "a list"]', "open": "[x", "o": {"k": 1}, "none": []}, "empty": {}}, "bike": "odd"}
    assert _rules(spark, tmp_path, doc, {"swim": {"wet": {"all": ["suit"]}}}) == [
        ("run", "cold", "feet", "3"), ("run", "cold", "feet", '["x"]'), ("run", "cold", "feet", "a"), ("run", "cold", "feet", "b"), ("run", "cold", "head", "hat"),
        ("run", "cold", "list text", '["not", "a list"]'), ("run", "cold", "num", "5"), ("run", "cold", "o", '{"k":1}'), ("run", "cold", "open", "[x"), ("swim", "wet", "all", "suit")]


def test_rules_that_are_no_object(spark, tmp_path):
    assert _rules(spark, tmp_path, "[1, 2]") == []


# -- S5 ------------------------------------------------------------------------
def test_only_a_missing_table_gives_default_coordinates(spark, tmp_path):
    assert read_coordinates(spark, str(tmp_path / "none")).count() == 2
    with pytest.raises(Exception):
        read_coordinates(spark, "nofs://x/y").collect()


# -- V1 / V2 -------------------------------------------------------------------
ROWS = [(1, "metric", "3"), (2, "kelvin", "x"), (3, None, "4"), (4, "metric", None), (5, "metric", "-1")]


def _rules_of():
    number = F.expr("try_cast(r AS double)")
    return {"units": F.col("u").isin("metric", "english"), "number": number.isNotNull(), "positive": number > 0}


def test_one_write_two_folders(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, u string, r string")
    good, bad = write_checked(df, _rules_of(), str(tmp_path / "checked"))
    assert good.columns == df.columns and [tuple(r) for r in good.collect()] == [ROWS[0]]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {2: ["units", "number", "positive"], 3: ["units"], 4: ["number", "positive"], 5: ["positive"]}
    assert {r["reason"]: r["n_rows"] for r in reason_counts(bad).collect()} == {"units": 2, "number": 2, "positive": 3}
    assert sorted(os.listdir(tmp_path / "checked"))[-2:] == ["_good=false", "_good=true"]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_good" in plan
    # the same split as the two filters, from one scan
    a, b = quarantine(df, F.expr("u IN ('metric', 'english') AND try_cast(r AS double) > 0"))
    assert a.exceptAll(good).count() == 0 and b.count() == bad.count()


def test_one_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, u string, r string").write.parquet(str(tmp_path / "in"))
    plan = with_reasons(spark.read.parquet(str(tmp_path / "in")), _rules_of())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_clashing_names_and_no_rules(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, u string, r string")
    with pytest.raises(ValueError):
        write_checked(df.withColumn("reasons", F.lit(1)), {}, str(tmp_path / "x"))
    good, bad = write_checked(df, {}, str(tmp_path / "y"))
    assert good.count() == 5 and bad.count() == 0


def test_lines_of_more_rows_than_a_recursion_may_have(spark):
    """The row limit of recursive queries binds neither leaves nor parents,
    and stays as it was."""
    spark.conf.set(P.ROW_LIMIT, "50")
    try:
        chain = [(f"g{i}", f"g{i - 1}" if i else None) for i in range(20)]
        leaves = [(f"leaf{i}", "g19" if i % 2 else "unlisted") for i in range(100)]
        got = {(r["activity"], r["ancestor"]): r["depth"] for r in P.ancestry(spark.createDataFrame(chain + leaves, PARENTS)).collect()}
        assert spark.conf.get(P.ROW_LIMIT) == "50"
    finally:
        spark.conf.unset(P.ROW_LIMIT)
    assert len(got) == 20 * 21 // 2 + 50 * 21 + 50 * 2
    assert got[("leaf1", "g0")] == 20 and got[("leaf0", "unlisted")] == 1 and got[("g19", "g0")] == 19 and got[("leaf2", "leaf2")] == 0
