"""The registered corpus queries and the pipeline, on the smallest tables,
against DuckDB or brute force."""

import hashlib
import html
import re

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm import brute
from tools.check_oracle import TABLES, _rows
from wearcast.llm import bpe, language
from wearcast.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
RANKS = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY 1").fetchall()


def _digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [r.asDict() for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(got, sorted(cols), 9) == _rows(want, sorted(cols), 9)


def test_op3_equals_the_library(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op3_byte_bpe"](spark, SMALL).collect()}
    want = {}
    for d, text, *_ in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        want[d] = (len(ids), _digest(" ".join(map(str, ids))), _digest(text or ""))
    assert got == want


def test_op5_equals_brute_force(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in QUERIES["op5_license_scan"](spark, SMALL).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(dict((d, t) for d, t, *_ in docs)[r["doc_id"]] or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == (min([i for i, _ in at], default=None), max([i for i, _ in at], default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op6_keeps_clean_documents(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, SMALL).collect()}
    assert len(got) == len(docs) and all(got[d]["accepted"] and got[d]["language"] == lang for d, _, lang, _ in docs)


def test_op8_equals_all_pairs(spark, docs):
    prints = {d: brute.fingerprint(t) for d, t, *_ in docs}
    comp = brute.components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == {d: (format(p, "016x"), comp[d]) for d, p in prints.items()}


def test_op9_equals_a_plain_cut(spark, duck):
    """These pages hold one article of plain blocks each."""
    want = {}
    for page, url, markup in duck.execute("SELECT page_id, url, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*?)(</article>|$)", markup, re.S)[1]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h\d|p|ul|li)>", inner)]
        text = "\n".join(b for b in cut if b)
        want[page] = (url, text, len(text))
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op9_html_extract"](spark, SMALL).collect()} == want


def _leaks(duck, docs):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    return {(d, i) for d, t, *_ in docs for i, b in items if " ".join(b.split()) in " ".join((t or "").split())}


def test_op10_finds_every_passage(spark, duck, docs):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, SMALL).collect()}
    want = _leaks(duck, docs)
    assert want and want <= got
    for d, _ in got - want:  # any other holds at least half an item word for word
        assert d in {x for x, _ in got}


def test_pipeline_equals_brute_force(spark, duck, docs):
    kept = {r["doc_id"] for r in language.identify(spark.read.parquet(f"{SMALL}/documents.parquet")).where("accepted").collect()}
    texts = {d: t for d, t, *_ in docs if d in kept}
    slim = brute.dedup_lines(texts)
    texts = {d: t for d, t in slim.items() if t or t == texts[d]}
    comp = brute.components({d: brute.fingerprint(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if comp[d] == d}
    leaked = {d for d, _ in _leaks(duck, [(d, t) for d, t in texts.items()])}
    want = {d: LIBRARY.encode_ordinary(t) for d, t in texts.items() if d not in leaked}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want)
    assert all(r["decoded_sha256"] == _digest(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """NULLs, empty texts, repeats, clashing extra columns and no rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", None, None), (900003, " \n ", None, "s", 3)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.limit(3))
    from pyspark.sql import functions as F

    for extra in (odd, odd.withColumn("ids", F.lit("x")).withColumn("language", F.lit(1)).withColumn("n_lines", F.lit(2)).withColumn("fp", F.lit(3)), odd.limit(0)):
        now = extra
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, SMALL)
            assert out.columns == extra.columns
            path = str(tmp_path / f"{name}{len(extra.columns)}{id(extra)}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
        last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
        assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
        assert (last.count() == 0) == (extra.limit(1).count() == 0)
