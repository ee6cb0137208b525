"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words, each in two forms: plain (lower-cased) and
template, in which numbers, units after a number and names (capitalised words
inside a sentence) are typed placeholders.  Windows of ``window`` words of
either form are hash-joined with the benchmark's; the window's words are
compared as well, so a hash alone decides nothing.  A template match stands
only when its slots are consistent: along one alignment of a document with an
item, every benchmark value of a slot maps to one value in the document, so a
question with other numbers or names is caught and a coincidence is not.

A document is contaminated by an item when the windows that match cover at
least ``min_cover`` of the item's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, small_batches

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£¥°]|[.!?]+(?=\s)|\n").findall

#: Words that are a unit when they follow a number.
UNITS = frozenset(
    "% $ € £ ¥ ° percent cent cents dollar dollars euro euros pound pounds usd eur gbp mm cm m km mi ft in inch inches foot "
    "feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t gram grams "
    "kilogram kilograms ton tons tonne tonnes oz lb lbs ml l liter liters litre litres gallon gallons s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years mph kph kmh w kw watt watts v volt volts "
    "hz khz mhz ghz kb mb gb tb degree degrees celsius fahrenheit".split()
)
NUMBER, UNIT, NAME, STOP = 1, 2, 4, 8
FLAGS = np.uint64(15)
PLACEHOLDER = {NUMBER: "<num>", UNIT: "<unit>", NAME: "<name>"}
MAX_TOKENS_KEPT = 400_000
MAX_BROADCAST_WINDOWS = 2_000_000
FILTER_BITS = 22


class Tokens(dict):
    """Token -> hash of its lower-cased form, with what it can be in the low
    bits; bounded, refilled on demand."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = 0
        if token[0].isdigit():
            kind = NUMBER
        elif token[0] in ".!?\n":
            kind = STOP
        else:
            kind = (UNIT if low in UNITS else 0) | (NAME if token[0].isupper() else 0)
        code = xxhash.xxh64_intdigest(low.encode("utf-8")) & ~15 | kind
        if len(self) >= MAX_TOKENS_KEPT:
            self.clear()
        self[token] = code
        return code


class Canonical:
    """The two forms of one text."""

    def __init__(self, text: str | None, known: Tokens):
        tokens = _TOKEN(text or "")
        codes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        flags = (codes & FLAGS).astype(np.uint8)
        stop = flags & STOP > 0
        opens = np.append(True, stop[:-1])[: len(codes)]
        word = ~stop
        self.at = np.flatnonzero(word)
        self.tokens, codes, flags, opens = tokens, codes[word], flags[word], opens[word]
        number = flags & NUMBER > 0
        unit = (flags & UNIT > 0) & np.append(False, number[:-1])[: len(codes)]
        name = (flags & NAME > 0) & ~opens & ~unit
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0))).astype(np.uint8)
        self.plain = codes & ~FLAGS
        self.template = np.where(self.kind > 0, self.kind.astype(np.uint64), self.plain)

    def __len__(self) -> int:
        return len(self.plain)

    def word(self, i: int, template: bool) -> str:
        return PLACEHOLDER[int(self.kind[i])] if template and self.kind[i] else self.tokens[self.at[i]].lower()

    def hashes(self, size: int, template: bool) -> np.ndarray:
        form = self.template if template else self.plain
        n = len(form) - size + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(size if n > 0 else 0):
            out = (out ^ (form[j : j + n] + np.uint64(j + 1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def usable(self, size: int, min_words: int) -> np.ndarray:
        """Template windows that have a slot and enough plain words."""
        slots = np.concatenate(([0], np.cumsum(self.kind > 0)))
        n = slots[size:] - slots[:-size] if len(self) >= size else np.empty(0, dtype=np.int64)
        return (n > 0) & (size - n >= min_words)


class HashFilter:
    """Sorted window hashes behind a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.table[self.sorted >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[h >> np.uint64(64 - FILTER_BITS)])
        if len(at) and len(self.sorted):
            spot = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            return at[self.sorted[spot] == h[at]]
        return at[:0]


_WINDOWS = "template boolean, size int, hash long, words string, pos int, kinds array<int>, slots array<string>, length int"


def _windows(window: int, min_words: int, sizes: list[int] | None, wanted):
    """Rows of (the id columns, _WINDOWS) for each window that can match.
    ``sizes``: the window lengths to make (None: the one the text has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        filters = wanted.value if wanted is not None else None
        for b in batches:
            ids = b.columns[:-1]
            rows: list[tuple] = []
            source: list[int] = []
            for r, text in enumerate(b.column(b.num_columns - 1)):
                c = Canonical(text.as_py(), known)
                for size in sizes or ([min(window, len(c))] if len(c) else []):
                    for template in (False, True):
                        h = c.hashes(size, template)
                        if not len(h):
                            continue
                        at = filters.hits(h) if filters is not None else np.arange(len(h))
                        if template:
                            at = at[c.usable(size, min(min_words, size - 1))[at]]
                        for i in at.tolist():
                            slots = [j for j in range(i, i + size) if c.kind[j]] if template else []
                            rows.append((
                                template, size, int(h[i].astype(np.int64)), " ".join(c.word(j, template) for j in range(i, i + size)), i,
                                [int(c.kind[j]) for j in slots], [c.word(j, False) for j in slots], len(c)))
                            source.append(r)
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(x.take(take) for x in ids), *(pa.array(x, k) for x, k in zip(cols, kinds))],
                names=[*b.schema.names[:-1], "template", "size", "hash", "words", "pos", "kinds", "slots", "length"],
            )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    window: int = 8,
    min_words: int = 4,
    min_cover: float = 0.5,
) -> DataFrame:
    """``(doc_id, text_hash, item_id, cover, templated)``: one row per document
    and item that contaminates it.  ``cover`` is the covered share of the
    item's words; ``templated`` tells whether only templates give it.

    Documents are known by (doc_id, xxhash64 of the text), so repeated rows
    are one and a NULL id is an id.  Items shorter than the window are matched
    whole; empty and NULL texts and items match nothing.  Items with equal
    text are reported each.  Template windows need ``min_words`` plain words.
    Other columns are ignored."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_id_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    bench = materialise(items.mapInArrow(_windows(window, min_words, None, None), f"item_id long, {_WINDOWS}"), "benchmark_windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `window` lengths
    hashes = bench.select("hash").distinct()
    wanted = None  # a larger benchmark is joined in full, without the filter ahead of the join
    if hashes.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS:
        wanted = spark.sparkContext.broadcast(HashFilter(hashes.toPandas()["hash"].to_numpy(dtype=np.int64).view(np.uint64)))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = small_batches(source).mapInArrow(_windows(window, min_words, sizes or [window], wanted), f"doc_id long, text_hash long, {_WINDOWS}")
    theirs = bench.select("template", "size", "hash", "words", "item_id", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("length").alias("item_length"))
    hits = materialise(
        found.join(theirs, ["template", "size", "hash", "words"])
        .select("doc_id", "text_hash", "item_id", "template", "size", "item_pos", "item_length", (F.col("pos") - F.col("item_pos")).alias("shift"), "kinds", "slots", "item_slots")
        .distinct(),
        "benchmark_hits",
    )
    doc = ["doc_id", "text_hash", "item_id"]
    pairs = hits.where("template").select(*doc, "shift", F.inline(F.arrays_zip("kinds", "item_slots", "slots")))
    torn = (
        pairs.groupBy(*doc, "shift", "kinds", "item_slots")
        .agg(F.min("slots").alias("a"), F.max("slots").alias("b"))
        .where("a <> b")
        .select(*[F.col(c).alias(f"_{c}") for c in (*doc, "shift")])
        .distinct()
    )
    same = hits["doc_id"].eqNullSafe(torn["_doc_id"]) & (hits["text_hash"] == torn["_text_hash"]) & hits["item_id"].eqNullSafe(torn["_item_id"]) & (hits["shift"] == torn["_shift"])
    fair = hits.where("template").join(torn, same, "left_anti").unionByName(hits.where("NOT template"))
    spans = fair.groupBy(*doc).agg(
        F.sort_array(F.collect_set(F.struct("item_pos", "size"))).alias("spans"),  # at most the item's windows
        F.sort_array(F.collect_set(F.when(~F.col("template"), F.struct("item_pos", "size")))).alias("plain"),
        F.max("item_length").alias("length"),
    )

    def covered(name: str):
        def add(acc, s):
            end = s["item_pos"] + s["size"]
            return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], s["item_pos"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

        return F.aggregate(name, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"] / F.col("length")

    out = spans.select(*doc, covered("spans").alias("cover"), (covered("plain") < min_cover).alias("templated"))
    return out.where(F.col("cover") >= min_cover)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents; the rest is unchanged."""
    hit = contaminated(docs, benchmark, text_col, id_col, **options).select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    mine = docs[id_col].cast("long").eqNullSafe(hit["_hit_id"]) & (F.xxhash64(text) == hit["_hit_hash"])
    return docs.join(hit, mine, "left_anti")
