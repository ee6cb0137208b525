"""Benchmark decontamination: exact, re-parameterised and clean documents."""

import random

from tests.llm import brute
from wearcast.llm import decontaminate
from wearcast.llm.decontaminate import contaminated

ITEM = "A train leaves with Alice at 9 and covers 120 km before noon, then Alice waits 45 minutes and rides 120 km more toward the coast"


def _run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (round(r["cover"], 3), r["templated"]) for r in contaminated(d, b, **options).collect()}


def test_exact_edited_and_clean(spark):
    filler = "some words ahead of it that nobody asked about here. "
    docs = [
        (1, filler + ITEM + ". " + filler),
        (2, filler + ITEM.lower().replace(" ", "\n") + filler),
        (3, filler * 10),
        (4, "A train leaves with Alice at 9 and covers nothing at all"),
        (5, ITEM[: len(ITEM) * 2 // 3]),
    ]
    got = _run(spark, docs, [(7, ITEM)])
    assert got[(1, 7)] == (1.0, False) and set(got) == {(1, 7), (2, 7), (5, 7)}


def test_other_numbers_names_and_units(spark):
    changed = ITEM.replace("Alice", "Boris").replace("120", "77").replace("45", "30").replace(" 9 ", " 8 ").replace("km", "miles")
    torn = changed.replace("77", "78", 1)  # the two 120s get different values
    got = _run(spark, [(1, changed), (2, torn)], [(7, ITEM)])
    assert got == {(1, 7): (1.0, True)}


def test_short_items_and_awkward_rows(spark):
    long_text = "filler words go on " * 40000 + "what is the capital of France today " + "and on " * 1000
    docs = [(None, ITEM), (1, None), (2, ""), (3, long_text), (4, "x " + ITEM), (4, "x " + ITEM), (4, "clean with the same id")]
    items = [(7, ITEM), (8, ITEM), (9, "the capital of France"), (10, None), (11, ""), (None, ITEM)]
    got = _run(spark, docs, items)
    assert set(got) == {(None, 7), (None, 8), (None, None), (4, 7), (4, 8), (4, None), (3, 9)}
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r["words"] for r in kept.collect()) == [1, 2, 6]
    assert contaminated(d.limit(0), b).collect() == [] and contaminated(d, b.limit(0)).collect() == []
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)


def test_without_the_filter_ahead(spark, monkeypatch):
    """A benchmark too large to broadcast gives the same rows."""
    docs = [(1, "x " + ITEM), (2, ITEM.replace("120", "55")), (3, "clean " * 30)]
    with_filter = _run(spark, docs, [(7, ITEM)])
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 1)
    assert _run(spark, docs, [(7, ITEM)]) == with_filter and set(with_filter) == {(1, 7), (2, 7)}


def test_plain_matches_equal_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice("abcdefghij") * 2 for _ in range(r.randint(8, 20)))) for i in range(20)]
    docs = []
    for d in range(60):
        w = [r.choice("klmnop") for _ in range(r.randint(0, 30))]
        if d % 2:
            t = r.choice(items)[1].split()
            at = r.randint(0, len(w))
            w[at:at] = t[: r.randint(1, len(t))]
        docs.append((d, " ".join(w)))
    want = set()
    for d, text in docs:
        w = brute.words(text)
        held = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, item in items:
            t = item.split()
            covered = {i + j for i in range(len(t) - 7) if tuple(t[i : i + 8]) in held for j in range(8)}
            if len(covered) >= 0.5 * len(t):
                want.add((d, k))
    assert set(_run(spark, docs, items)) == want and len(want) >= 10
