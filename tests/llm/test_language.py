"""Language identification: held-out accuracy, fusion, priors, awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearcast.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)) == 0
    return docs.where(~held), docs.where(held)


def test_held_out_accuracy(split):
    """Trained on one half, text evidence alone on the other."""
    train, held = split
    model = language.train(train, "text", "lang")
    rows = held.select("text", "lang").collect()
    right = [model.languages[int(np.argmax(model.score(r["text"])[0]))] == r["lang"] for r in rows]
    assert len(right) > 200 and np.mean(right) > 0.98


def test_fused_accuracy_and_no_clean_loss(split):
    train, held = split
    model = language.train(train, "text", "lang")
    out = language.identify(held, model=model).collect()
    assert np.mean([r["language"] == r["lang"] for r in out]) > 0.99
    assert all(r["accepted"] for r in out)


def test_training_sample_is_bounded(split):
    train, _ = split
    few = language.train(train, "text", "lang", sample_per_language=5)
    assert few.languages == ["de", "en", "es", "fr"]


def test_every_declared_language_is_trained(spark):
    """The 65th language is as good as the first."""
    r = random.Random(4)
    words = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(r.choices(w, k=30)), x) for x, w in words.items() for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = language.identify(df, host_col=None).collect()
    assert len(out) == 140 and all(x["language"] == x["lang"] and x["accepted"] for x in out)


def test_too_many_languages_raise(spark):
    df = spark.range(language.MAX_LANGUAGES + 1).select(F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="declared languages"):
        language.train(df, "text", "lang")


def test_a_text_counts_once_in_training(spark):
    once = spark.createDataFrame([("der die das und",), ("nicht mit dem wort",), ("ein anderes wort hier",)], "text string").withColumn("lang", F.lit("de"))
    often = once.unionByName(spark.range(3000).select(F.lit("der die das und").alias("text"), F.lit("de").alias("lang")))
    a, b = (language.train(x, "text", "lang", sample_per_language=3) for x in (once, often))
    assert len(np.unique(a.logp)) > 1 and np.array_equal(a.logp, b.logp)


def test_sample_thresholds():
    for wanted, size in ((5, 4), (5, 5), (5, 10), (2000, 10**12)):
        share = (language._threshold(wanted, size) + (1 << 63) + 1) / (1 << 64)
        assert share == pytest.approx(min(1.0, wanted / size), rel=1e-6)


def test_text_beats_a_wrong_declaration(split):
    train, held = split
    model = language.train(train, "text", "lang")
    long_ = held.where("lang = 'de' AND n_chars > 1500").withColumn("lang", F.lit("en"))
    assert {r["language"] for r in language.identify(long_, model=model).collect()} == {"de"}


def test_evidence_decides_short_texts(spark, split):
    model = language.train(split[0], "text", "lang")
    rows = [(1, "xqz", "fr", "http://a.b/1"), (2, "xqz", None, "http://a.b/es/2"), (3, "xqz", None, "http://a.de/2")]
    df = spark.createDataFrame(rows, "id int, text string, lang string, url string")
    got = {r["id"]: r["language"] for r in language.identify(df, url_col="url", host_col=None, model=model).collect()}
    assert got == {1: "fr", 2: "es", 3: "de"}


def test_host_prior_moves_from_corpus_to_host(spark):
    rows = [("a.x.org", "x.org", [0.9, 0.1], 50)] + [("b.x.org", "x.org", [0.9, 0.1], 1), ("c.y.org", "y.org", [0.1, 0.9], 1)]
    flat = [(h, d, p, (0, 3, True)) for h, d, p, n in rows for _ in range(n)]
    df = spark.createDataFrame(flat, "_host string, _domain string, _p array<double>, _text struct<a:int,grams:int,known:boolean>")
    priors, corpus = language.host_priors(df, 2, 20.0, 50.0)
    got = {r["_host"]: r["_prior"][0] for r in priors.collect()}
    assert abs(sum(corpus) - 1) < 1e-9 and corpus[0] > 0.8
    assert got["a.x.org"] > got["b.x.org"] > got["c.y.org"]
    n = np.array([0.9 * 51 + 0.1, 0.1 * 51 + 0.9])
    assert np.allclose(corpus, (n + 1) / (52 + 2))


def test_awkward_rows(spark, split):
    model = language.train(split[0], "text", "lang")
    rows = [(None, None, None, None, "k"), (1, "", "en", "s", "k"), (2, "12 34 !!", "en", "s", "k"), (3, "漢字仮名交じり文の例です。" * 30, "en", "s", "k"), (4, "the and of that with this " * 40000, None, None, "k"), (4, "the and of that with this", None, None, "k"), (4, "the and of that with this", None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string")
    out = language.identify(df, model=model)
    assert out.columns == ["doc_id", "text", "lang", "source", "language", "posterior", "accepted"]
    got = sorted(((r["doc_id"] or 0, "any" if r["doc_id"] == 3 else r["language"], r["accepted"]) for r in out.collect()), key=str)
    assert got == sorted([(0, None, False), (1, None, False), (2, None, False), (3, "any", False)] + [(4, "en", True)] * 3, key=str)
    assert language.identify(df.limit(0), model=model).collect() == []
    assert language.identify(df.limit(0)).collect() == []
    undeclared = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["language"], r["posterior"], r["accepted"]) for r in undeclared} == {(None, 0.0, False)}


def test_accept_list(spark, split):
    out = language.identify(split[1], model=language.train(split[0], "text", "lang"), accept=["fr"]).where("accepted")
    assert {r["language"] for r in out.select("language").distinct().collect()} == {"fr"}


def test_declared_language_of_markup(spark):
    df = spark.createDataFrame([('<!DOCTYPE html><HTML class="x" lang="de-AT">',), ("<html lang=fr>",), ("<html><p lang='en'>",), (None,)], "h string")
    assert [r[0] for r in df.select(language.page_declared(F.col("h"))).collect()] == ["de", "fr", None, None]
