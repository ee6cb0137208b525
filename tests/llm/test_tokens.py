"""Byte-level BPE against the tokenizer library, and exact round trips."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wearcast.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
OURS = bpe.Encoder(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "日本", "😀", "'s", "'re", "1", "23", "!!", "<|endoftext|>", "the", "ing", "\t", "\xa0", "ZZZ", "aaaaaaaaaa", "\x00", "́", "՘", "\U000323b5", "࢏"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=80))
def test_ids_equal_the_library(text):
    ids = OURS.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert "".join(bpe.decode_stream([ids[:3], ids[3:4], ids[4:]], OURS.transducer.bytes_of)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehint oué", max_size=60))
def test_search_and_stream_agree_with_merges(text):
    piece, t = text.encode(), OURS.transducer
    if piece:
        assert t.search(piece) == list(t.stream(piece)) == t.merged(piece)


def test_long_pieces_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    small = bpe.Encoder(RANKS, P.PATTERN)
    r = random.Random(3)
    for text in ("a" * 5000, "ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(4000)), "日本語" * 700, "word " * 500):
        assert small.encode(text).tolist() == LIBRARY.encode_ordinary(text)
        assert len(small) <= 5


def test_tokens_leave_before_the_end():
    """The transducer emits after a bounded look-ahead, not at the end."""
    out = bpe.Transducer(RANKS).stream(iter(b"the" * 2000))
    seen = 0

    def feed():
        nonlocal seen
        for b in b"the" * 2000:
            seen += 1
            yield b

    first = next(bpe.Transducer(RANKS).stream(feed()))
    assert seen < 100 and first == next(out)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_utf8_machine_equals_one_decode(data, cuts):
    machine, at, out = bpe.Utf8Machine(), 0, ""
    for cut in sorted(cuts):
        out += machine.feed(data[at:cut])
        at = max(at, cut)
    out += machine.feed(data[at:]) + machine.finish()
    try:
        assert out == data.decode("utf-8")
    except UnicodeDecodeError:
        assert "�" in out


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0}).encode_piece(b"ab")


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "same", "z"), (None, "same", "z"), (3, "word and more " * 20000, "w"), (4, "naïve 😀\x00", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ranks = bpe.read_ranks(spark, PATH)
    tokens = bpe.encode(df, ranks, P.PATTERN)
    assert tokens.columns == ["doc_id", "text", "ids"]
    for r in tokens.collect():
        assert r["ids"] == LIBRARY.encode_ordinary(r["text"] or "")
    back = bpe.decode(tokens.withColumn("decoded", tokens["doc_id"]), ranks)
    assert sorted((r["text"] or "", r["decoded"]) for r in back.collect()) == sorted((t or "", t or "") for _, t, _ in rows)
    assert bpe.encode(df.limit(0), ranks, P.PATTERN).collect() == []


def test_ranks_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCAB_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.read_ranks(spark, PATH)
