"""Line dedup and SimHash near-dedup against all-pairs versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wearcast.llm import line_dedup, simhash
from wearcast.llm.components import connected_components
from wearcast.llm.line_dedup import dedup_lines, removed_lines


def _texts(seed, n):
    """Documents of few distinct words, so that lines meet often, with edits."""
    r = random.Random(seed)
    pool = [[r.choice("abcdef") * r.randint(1, 2) for _ in range(r.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 16, 17, 18]))] for _ in range(25)]
    docs = {}
    for d in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.randrange(len(w) + 1)
                kind = r.randrange(3)
                if kind == 0:
                    w.insert(at, r.choice("abcdef"))
                elif at < len(w):
                    w[at : at + 1] = [r.choice("xyz")] if kind == 1 else []
            lines.append(r.choice([" ", "  ", "\t"]).join(x.upper() if r.random() < 0.2 else x for x in w))
        docs[d] = r.choice(["\n", "\n", "\n\n"]).join(lines) if r.random() > 0.05 else None
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_all_pairs(spark, seed):
    docs = _texts(seed, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert got == brute.dedup_lines(docs)


def test_line_dedup_exact_only(spark):
    df = spark.createDataFrame([(1, "a b c d e\nA  b c d E"), (2, "a b c d x\na b c d e")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(df, max_edits=0).collect()}
    assert got == {1: ("a b c d e", 2, 1), 2: ("a b c d x", 2, 1)}


def test_line_dedup_awkward_rows(spark):
    long_line = " ".join(f"w{i}" for i in range(6000))
    rows = [
        (None, "a b c d e", 1), (2, None, 1), (3, "", 1), (4, " \n\t\n", 1), (5, "a b c d e", 1), (5, "a b c d e", 1),
        (6, long_line, 1), (7, long_line.replace("w4000 ", ""), 1), (8, "the\nthe\nthe", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(df).collect() if r["doc_id"] not in (6, 7))
    assert got == [(False, 2, None, 0, 0), (False, 3, "", 1, 0), (False, 4, " \n\t\n", 3, 0), (False, 5, "a b c d e", 1, 0), (False, 5, "a b c d e", 1, 0), (False, 8, "the\nthe\nthe", 3, 0), (True, 0, "", 1, 1)]
    assert [(r["doc_id"], r["pos"], r["near"]) for r in removed_lines(df).where("doc_id > 5").collect()] == [(7, 0, True)]
    assert dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_cuts_only_the_rows_own_lines(spark):
    """Rows that share an id, or have none, but not a text."""
    line, other, third = "one two three four five", "six seven eight nine ten", "k l m n o"
    for shared in (7, None):
        rows = [(1, line), (shared, f"{line}\n{other}"), (shared, f"p q r s t\n{line}"), (shared, f"{third}\nu v w x y")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in dedup_lines(df).collect())
        assert got == sorted([(1, line, 0), (shared or 0, other, 1), (shared or 0, "p q r s t", 1), (shared or 0, f"{third}\nu v w x y", 0)])
        twice = spark.createDataFrame([(shared, f"{line}\n{other}"), (shared, f"{line}\n{third}")], "doc_id long, text string")
        assert sum(line in r["text"] for r in dedup_lines(twice).collect()) == 1


def test_line_tables_hold_hashes_only(spark):
    """The table of all lines has no text; lines that may have a neighbour are
    read again from their documents, once each, also from repeated rows."""
    rows = [(None, "\n A  b\tc d E\nx"), (None, "\n A  b\tc d E\nx"), (None, "f g h i j"), (3, None), (3, "\n\r\n É b c d\x0be \n1 2 3 4\n1 2 3 4 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text", 5)
    assert dict(lines.dtypes) == {"doc_id": "bigint", "text_hash": "bigint", "pos": "int", "lid": "binary", "halves": "array<bigint>"}
    wanted = lines.dropDuplicates(["lid"]).select("lid", line_dedup._place().alias("first"), F.lit(1).alias("shared"))
    got = line_dedup._with_words(line_dedup._texts(docs, "doc_id", "text"), wanted).select(F.md5("norm"), F.lower(F.hex("lid")), "norm").collect()
    assert sorted(r["norm"] for r in got) == ["1 2 3 4 5", "a b c d e", "f g h i j", "é b c d e"]
    assert all(r[0] == r[1] for r in got)


@pytest.mark.parametrize("min_words", [1, 2])
def test_line_dedup_of_short_lines(spark, min_words):
    r = random.Random(min_words)
    docs = {d: "\n".join(" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 3))) for _ in range(3)) for d in range(12)}
    got = {x["doc_id"]: x["text"] for x in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), min_words=min_words).collect()}
    assert got == brute.dedup_lines(docs, min_words)


def test_line_dedup_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_fingerprint():
    for text in (None, "", " \t\n", "one", "One two\x0bthree", "a b c d e f g h a b c d", "é É ÀB " * 50, "x " * 70000):
        assert simhash.fingerprint(text, 4) == brute.fingerprint(text)


def test_index_finds_every_pair():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    fp = np.concatenate([base, *[b ^ (np.uint64(1) << r.integers(0, 64, 30).astype(np.uint64)) for b in base[:6]], r.integers(0, 2**64, 300, dtype=np.uint64)])
    key = np.sort(r.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), key))
    fp, key = fp[order], key[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    for bound in (0, 2, 4, 9):
        found = {(int(a), int(b)) for x, y in simhash.linked_pairs(fp, first, bound) for a, b in zip(x, y)}
        want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= bound}
        assert found == want


def test_gray_rank_orders_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    by_rank = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(by_rank, by_rank[1:]))


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_components_equal_all_pairs(spark, bucket_rows):
    """Also with buckets cut into chunks."""
    r = random.Random(9)
    prints = {}
    for d in range(120):
        x = r.getrandbits(64) if d % 6 == 0 else x
        for _ in range(r.randint(0, 3)):
            x ^= 1 << r.randrange(64)
        prints[d] = x
    signed = {d: x - (1 << 64) if x >> 63 else x for d, x in prints.items()}
    df = spark.createDataFrame([(v,) for v in set(signed.values())], "fp long")
    root = {r["node"]: r["root"] for r in simhash.fingerprint_components(df, 4, bucket_rows).collect()}
    want = brute.components(prints)
    groups = {}
    for d, x in signed.items():
        groups.setdefault(root.get(x, x), set()).add(d)
    expected = {}
    for d, c in want.items():
        expected.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_awkward_rows(spark):
    long_text = "alpha beta gamma delta " * 30000
    rows = [(5, None, "x"), (4, "", "x"), (9, " \n ", "y"), (None, "one two three four five", "y"), (7, "one two three four five", "z"), (7, "one two three four five", "z"), (3, long_text, "z"), (2, "far from all the others here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, 7), (2, 2), (3, 3), (4, 4), (5, 4), (7, 7), (7, 7), (9, 4)]
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7]
    assert simhash.simhash_components(df.limit(0)).collect() == [] and simhash.near_dedup(df.limit(0)).collect() == []


def test_near_dedup_keeps_one_row_of_every_group(spark):
    """Groups of NULL ids only, and one id on several texts."""
    a, b, c = ("alpha beta gamma delta epsilon", "red orange yellow green blue", "un deux trois quatre cinq")
    schema = "doc_id long, text string"
    nulls = spark.createDataFrame([(None, a), (None, b), (None, a), (None, c), (3, c)], schema)
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in simhash.near_dedup(nulls).collect()) == [(0, a), (0, b), (3, c)]
    shared = spark.createDataFrame([(1, a), (5, a), (5, b), (5, c), (5, c)], schema)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.near_dedup(shared).collect()) == [(1, a), (5, b), (5, c)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 999), (999, 1000), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: 999}


def test_block_masks_are_complete():
    for n in (10, 10**7, 10**10):
        masks = simhash.block_masks(n, 4)
        r = random.Random(n)
        for _ in range(200):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_equal_id_and_text_keep_one_whatever_the_order(spark):
    """Rows that differ in other columns only: the input's order is no rule."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, s, i) for i, s in enumerate("abcdefgh")] + [(2, text + " eleven", "z", 0)]
    schema = "doc_id long, text string, source string, `odd name` int"
    kept = {tuple(simhash.near_dedup(spark.createDataFrame(r, schema).coalesce(1)).select("doc_id", "source", "odd name").first()) for r in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(kept) == 1 and next(iter(kept))[0] == 1
