"""Periodic runs against every lag of small texts, and awkward rows."""

import random
import time

from wearcast.llm.periodic import find_runs, runs_of_texts

EMPTY = (0, [], "")


def brute_runs(w, min_length=6, min_repeats=4, max_period=None):
    """Every lag, every diagonal; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, min(len(w) // min_repeats, max_period or len(w)) + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _text(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 9]))) for _ in range(rng.randint(0, 40))]
    if w and rng.random() < 0.7:
        w = [w[i % rng.randint(1, len(w))] if rng.random() < 0.02 else w[i % max(1, len(w) // 5)] for i in range(len(w))] * rng.randint(1, 5)
    return w


def test_random_texts_equal_every_lag():
    rng = random.Random(13)
    for bounds in ((6, 4), (1, 3), (10, 5)):
        texts = [_text(rng) for _ in range(2000)]
        got = runs_of_texts([[x.encode() for x in t] for t in texts], *bounds)
        assert got == [brute_runs(t, *bounds) for t in texts]
        assert sum(map(len, got)) > 300


def test_operator(spark):
    rng = random.Random(7)
    texts = [_text(rng) for _ in range(300)]
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(t)) for i, t in enumerate(texts)]
    out = find_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    for r in out:
        w = texts[r["doc_id"]]
        runs = brute_runs(w)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(w), runs, brute_collapsed(w, runs))
    assert len(out) == len(rows)


def test_nested_runs(spark):
    """A period of which each repeat holds a run of its own."""
    text = " ".join((["a"] * 6 + ["b"]) * 5)
    row = find_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1), (0, 35, 7), *[(7 * k, 6, 1) for k in range(1, 5)]]
    assert row["collapsed"] == "a b"


def test_awkward_rows(spark):
    schema = "doc_id long, text string, runs int, text_ string, n_words string"
    rows = [(1, None, 5, "x", "n"), (None, "", 5, None, None), (2, " \n\t", None, "y", None), (3, "w " * 6, 1, "z", None), (3, "w " * 6, 1, "z", None), (4, "w " * 5, 1, "z", None)]
    out = find_runs(spark.createDataFrame(rows, schema).repartition(2))
    assert out.columns == ["doc_id", "text", "text_", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, r["text_"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=str)
    assert got == [(0, None, *EMPTY), (1, "x", *EMPTY), (2, "y", *EMPTY), (3, "z", 6, [(0, 6, 1)], "w"), (3, "z", 6, [(0, 6, 1)], "w"), (4, "z", 5, [], "w w w w w")]
    assert find_runs(spark.createDataFrame([], schema)).collect() == []


def test_very_long_texts():
    """One word, two words at random, and a run of runs stay near linear."""
    rng = random.Random(1)
    n = 200_000
    begun = time.perf_counter()
    one, two, nested = [b"a"] * n, [rng.choice([b"0", b"1"]) for _ in range(n)], ([b"a"] * 99 + [b"b"]) * (n // 100)
    got = runs_of_texts([one, two, nested], 6, 4)
    assert got[0] == [(0, n, 1)] and got[1] == brute_runs(two, max_period=40) and (0, n, 100) in got[2] and len(got[2]) == n // 100 + 1
    assert time.perf_counter() - begun < 60

