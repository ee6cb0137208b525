"""Byte-level BPE as a finite-state transducer.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when each
token encodes to itself and each neighbouring pair does.  So the encoder is a
nondeterministic transducer: it walks the vocabulary trie byte by byte, and at
each token's end may emit it if it is compatible with the token before.  The
transducer is determinised while it runs: a state is the set of live
hypotheses (tokens not yet emitted, trie node); tokens that all hypotheses
share are emitted, so output follows input after a bounded look-ahead.  States
and transitions are made on first use and kept; past ``MAX_STATES`` the
automaton starts afresh, which bounds memory and changes no result.  Most
words that are new to a worker are short and never seen again, so pieces of up
to ``SHORT`` bytes first run on the nondeterministic transducer, depth first,
and their output is kept as one transition of its own; longer pieces stream
through the determinised states.

Decoding.  Token bytes pass through an incremental UTF-8 state machine that
holds back at most the three bytes of an unfinished character.

Spark splits the rows; each task works through its Arrow batches with the
vocabulary broadcast (its size is checked).
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm.common import schema_with, small_batches, with_column

MAX_STATES = 100_000
MAX_PIECES = 250_000
MAX_PAIRS = 500_000
MAX_VOCAB_BYTES = 64 << 20
ROWS = 256
SHORT = 32  # bytes of a piece that is searched rather than streamed
LATIN = 0x250
UNASSIGNED = chr(0x378)
UNSPELLABLE = "the vocabulary cannot spell some byte of this text"
_ROOT = 0
TOKEN = 256
MAX_VOCAB = 1 << 20

# Letters and numbers that the pattern engine knows and the
# tokenizer library's Unicode version does not (first and last code point).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class Transducer:
    """Lazily determinised encoder for one vocabulary (``bytes -> rank``)."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= MAX_VOCAB:
            raise ValueError(f"more than {MAX_VOCAB} tokens")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.branch: dict = {}  # nested: byte -> branch; TOKEN -> token that ends here
        for word, rank in ranks.items():
            node = self.branch
            for b in word:
                node = node.setdefault(b, {})
            node[TOKEN] = rank
        self.pairs: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.nodes = [self.branch]  # trie nodes that states speak of, numbered on first use
        self.node_number = {id(self.branch): _ROOT}
        self.states = [(-1, (((), _ROOT),))]  # (last emitted token, hypotheses)
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte

    def merged(self, data: bytes) -> list[int]:
        """Encoding by repeated lowest-rank merges; used on single tokens and
        pairs to fill the compatibility relation."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 1
        while len(parts) > 1:
            found = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == none:
                break
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        key = before << 20 | token  # ranks are below 2**20, see MAX_VOCAB
        known = self.pairs.get(key)
        if known is None:
            if before < 0:
                known = self.merged(self.bytes_of[token]) == [token]
            else:
                known = self.compatible(-1, token) and self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of ``state`` on ``byte``."""
        base, hypotheses = self.states[state]
        after = []
        for pending, node in hypotheses:
            below = self.nodes[node].get(byte)
            if below is None:
                continue
            token = below.get(TOKEN)
            if len(below) > (token is not None):
                child = self.node_number.setdefault(id(below), len(self.nodes))
                if child == len(self.nodes):
                    self.nodes.append(below)
                after.append((pending, child))
            if token is not None and self.fits(pending[-1] if pending else base, token):
                after.append(((*pending, token), _ROOT))
        # what all hypotheses share is certain and goes out now
        emitted, shared = (), 0
        if after:
            emitted = min(p for p, _ in after)
            furthest = max(p for p, _ in after)
            for x, y in zip(emitted, furthest):
                if x != y:
                    break
                shared += 1
            emitted = emitted[:shared]
        target = (emitted[-1] if shared else base, tuple([(p[shared:], n) for p, n in after]) if shared else tuple(after))
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = (number, emitted)
        return move

    def fits(self, before: int, token: int) -> bool:
        known = self.pairs.get(before << 20 | token)
        return self.compatible(before, token) if known is None else known

    def search(self, piece: bytes) -> list[int]:
        """One run of the nondeterministic transducer, longest token first.

        A prefix has one encoding only, so a position that was left once
        without success is never tried again."""
        n, root, pairs = len(piece), self.branch, self.pairs
        ends: list[list[tuple[int, int]] | None] = [None] * n
        dead: set[int] = set()
        path: list[tuple[int, int, int]] = []  # position, token before, next choice
        out: list[int] = []
        at, before, choice = 0, -1, -1
        while at < n:
            found = ends[at]
            if found is None:
                found, node, end = [], root, at
                for b in piece[at:]:
                    node = node.get(b)
                    if node is None:
                        break
                    end += 1
                    if TOKEN in node:
                        found.append((node[TOKEN], end))
                ends[at], choice = found, len(found) - 1
            while choice >= 0:
                token, end = found[choice]
                if end not in dead:
                    fits = pairs.get(before << 20 | token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                choice -= 1
            if choice >= 0:
                path.append((at, before, choice - 1))
                out.append(token)
                at, before = end, token
                if at < n and ends[at] is not None:
                    choice = len(ends[at]) - 1
            elif path:
                dead.add(at)
                at, before, choice = path.pop()
                out.pop()
            else:
                raise ValueError(UNSPELLABLE)
        return out

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """The determinised run: tokens leave as soon as they are certain."""
        if len(self.states) > MAX_STATES:
            self.restart()
        state, moves = 0, self.moves
        for b in piece:
            state, emitted = moves.get(state << 8 | b) or self.step(state, b)
            yield from emitted
        for pending, node in self.states[state][1]:
            if node == _ROOT:
                yield from pending
                return
        raise ValueError(UNSPELLABLE)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.search(piece) if len(piece) <= SHORT else list(self.stream(piece))


def _classes_below(pattern: str, limit: int) -> str:
    """``pattern`` for the standard ``re`` engine, with the letter and number
    classes written out for the characters below ``limit``."""
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N")):
        pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(limit) if unicodedata.category(chr(c))[0] == kind))
    return pattern


class Splitter:
    """``pattern.findall`` as the tokenizer library splits.

    Texts of characters below ``LATIN`` go to the faster standard engine where
    the pattern uses classes it can express in brackets.  Characters that were
    assigned after the library's Unicode version stand for themselves as
    unassigned ones while the text is split."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.wide = re.compile(f"[{chr(LATIN)}-{chr(0x10FFFF)}]").search
        self.newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
        latin = _classes_below(pattern.replace(r" ?\p{L}+", r" ?[\p{L}]+").replace(r" ?\p{N}+", r" ?[\p{N}]+"), LATIN)
        self.narrow = None if r"\p" in latin or r"\P" in latin else re.compile(latin).findall

    def __call__(self, text: str) -> list[str]:
        if self.narrow and not self.wide(text):
            return self.narrow(text)
        plain = self.newer.sub(UNASSIGNED, text)
        if plain == text:
            return self.full.findall(text)
        return [text[m.start() : m.end()] for m in self.full.finditer(plain)]


class Encoder(dict):
    """Pieces -> token ids (as int32 bytes); a bounded memory of pieces in
    front of the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.split = Transducer(ranks), Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode_piece(piece.encode("utf-8"))).tobytes()
        if len(self) >= MAX_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text or ""))), dtype=np.int32)


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in any cut, text out.

    The state is the unfinished character at the end of what was fed so far
    (at most three bytes).  Bytes that no character can hold become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the unfinished character at the end of ``data``."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:  # continuation: look for its lead byte
                continue
            need = 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 1
            return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(chunks: Iterable[list[int]], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a token stream, chunk by chunk."""
    machine = Utf8Machine()
    for ids in chunks:
        yield machine.feed(b"".join(map(bytes_of.__getitem__, ids)))
    yield machine.finish()


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file as bytes, through Spark's readers, with its size checked."""
    row = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content").where(F.col("length") <= MAX_VOCAB_BYTES).first()
    if row is None:
        raise ValueError(f"{path}: larger than {MAX_VOCAB_BYTES} bytes")
    return bytes(row["content"])


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(data), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the whole text's token ids,
    each match of ``pattern`` encoded separately, no special tokens.  NULL and
    empty texts give no ids.  An existing column of that name is replaced;
    other columns pass through unread."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for whole in batches:
            at = whole.schema.names.index(text_col)
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                ids = [encoder.encode(t.as_py()) for t in b.column(at)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield with_column(b, ids_col, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))

    fields = [f for f in docs.schema.fields if f.name != ids_col]
    return small_batches(docs).mapInArrow(run, schema_with(fields, ids_col, "array<int>"))


def decode(tokens: DataFrame, ranks: bytes, ids_col: str = "ids", text_col: str = "decoded", chunk: int = 65536) -> DataFrame:
    """``tokens`` with ``ids_col`` replaced by ``text_col``, the decoded text.
    NULL ids give an empty text; an id outside the vocabulary raises."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _encoder(shared.value, "").transducer.bytes_of
        for whole in batches:
            at = whole.schema.names.index(ids_col)
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                texts = []
                for row in b.column(at):
                    ids = row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []
                    texts.append("".join(decode_stream((ids[i : i + chunk] for i in range(0, len(ids), chunk)), bytes_of)))
                yield with_column(b, text_col, pa.array(texts, pa.string()), drop=ids_col)

    fields = [f for f in tokens.schema.fields if f.name not in (ids_col, text_col)]
    if text_col in tokens.columns:
        tokens = tokens.drop(text_col)
    return small_batches(tokens).mapInArrow(run, schema_with(fields, text_col, "string"))
