"""Hard negatives against all pairs, ties, hot vectors and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearcast.llm import hard_negatives as H


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    rows = [(i, str(lab), [int(x) for x in q]) for i, lab, q in rows if None not in (i, lab, q) and None not in q]
    out = []
    for a, lab, q in rows:
        if not is_anchor(a):
            continue
        score = [(-sum(x * y for x, y in zip(q, v)), i, m) for i, m, v in rows if i != a]
        for ps, p, _ in sorted((s, i, m) for s, i, m in score if m == lab)[:positives]:
            fit = sorted((s, i) for s, i, m in score if m != lab and low * -ps <= 100 * -s <= high * -ps)[:negatives]
            out += [(a, p, r, n, -ps, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def _mine(spark, rows, schema="vec_id long, label int, q array<long>", every=7, **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, H.mine_hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def _vectors(rng, n, dim, groups, spread):
    centres = rng.normal(size=(groups, dim)) * 200
    return [(i, int(rng.integers(4)), [int(x) for x in centres[rng.integers(groups)] + rng.normal(size=dim) * spread]) for i in range(n)]


@pytest.mark.parametrize("dim, groups, spread", [(6, 5, 60), (16, 1, 300), (3, 40, 1)])
def test_equals_all_pairs(spark, dim, groups, spread):
    rows = _vectors(np.random.default_rng(dim), 400, dim, groups, spread)
    got = _mine(spark, rows)
    assert got == brute(rows, lambda i: i % 7 == 0) and len(got) > 100


def test_small_blocks_and_groups(spark, monkeypatch):
    """Many blocks, and clusters cut over several groups of anchors."""
    monkeypatch.setattr(H, "BLOCK", 6 * 20)
    monkeypatch.setattr(H, "MEMBERS", 7)
    rows = _vectors(np.random.default_rng(2), 300, 6, 3, 40)
    assert _mine(spark, rows, every=3) == brute(rows, lambda i: i % 3 == 0)


def test_ties_and_a_hot_vector(spark):
    """A third of all rows is one vector; small whole numbers tie often."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(2)), [3, 1, 2] if i % 3 == 0 else [int(x) for x in rng.integers(0, 4, 3)]) for i in range(600)]
    got = _mine(spark, rows, every=20)
    assert got == brute(rows, lambda i: i % 20 == 0)


def test_walk_stops_when_certified():
    """Members of a narrow cluster leave the list long before its end."""
    rng = np.random.default_rng(1)
    axis = np.eye(8)[0]
    members = axis * 100 + rng.normal(size=(20, 8))
    x = np.concatenate([axis * 100 + rng.normal(size=(3000, 8)) * 2, rng.normal(size=(200_000, 8)) * 30])
    bound = H.bounds(x, np.linalg.norm(x, axis=1), members, axis)
    order = np.argsort(-bound, kind="stable")
    seen = []

    def want(slot, who, rows, scores):
        seen.append(rows[-1])
        return np.ones_like(scores, bool)

    found = list(H.walk(members, x[order], order, bound[order], True, want, 1, 5, np.full((20, 1), H.NEVER)))
    assert max(seen) < 10_000 and found
    exact = (members @ x.T).astype(np.int64)
    who, score = np.concatenate([f[0] for f in found]), np.concatenate([f[3] for f in found])
    for m in range(20):
        assert sorted(score[who == m])[-5:] == sorted(exact[m])[-5:]


def test_first_ties():
    tie = np.array([[True, True, False, True, True], [True, False, False, False, False]])
    assert H._first_ties(tie, np.array([5, 3, 0, 3, 3]), 2).tolist() == [[False, True, False, True, False], [True, False, False, False, False]]


def test_awkward_rows(spark):
    schema = "vec_id long, label string, q array<long>, score int, anchor string, part string"
    rows = [(0, "a", [2, 2], 1, "x", None), (0, "a", [2, 2], 1, "x", None), (1, "a", [3, 3, 9], 2, None, "p"), (2, "b", [2, 2], 1, "x", None), (2, "b", [2, 2], 1, "x", None),
            (3, None, [9, 9], 1, "x", None), (4, "b", None, 1, "x", None), (5, "b", [9, None], 1, "x", None), (None, "b", [9, 9], 1, "x", None), (6, "b", [], 1, "x", None), (8, "a", [], 0, "", "")]
    got = _mine(spark, rows, schema)
    # each of the two equal anchors: the row 1 scores 12, row 8 zero; two equal rows 2 score 8, row 6 zero
    one = [(0, 1, 1, 2, 12, 8), (0, 1, 2, 2, 12, 8), (0, 8, 1, 6, 0, 0)]
    assert got == sorted(one * 2)
    assert _mine(spark, [], schema) == []
    assert _mine(spark, rows, schema, every=1000) == got and _mine(spark, [r for r in rows if r[0] in (1, 2)], schema) == []


def test_large_components(spark):
    """Scores beyond what doubles hold stay exact."""
    big = 2**31 - 1
    rows = [(0, 1, [big, 1]), (1, 1, [big, 2]), (2, 1, [big, 3]), (3, 2, [big - 2**28, 5]), (4, 2, [big - 2**28, 6])]
    assert _mine(spark, rows) == brute(rows, lambda i: i % 7 == 0)
