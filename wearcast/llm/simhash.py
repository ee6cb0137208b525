"""SimHash near-dedup over a Gray-order hierarchical index.

1. One pass over the texts gives a 64-bit fingerprint per document.
2. Equal fingerprints collapse to one row (a map-side aggregate), so exact
   copies never meet pairwise.
3. The fingerprint is cut into blocks; two fingerprints within the bound agree
   on at least ``blocks - max_distance`` whole blocks, so every linked pair
   meets in some bucket of equal blocks.  The number of blocks follows from the
   number of fingerprints, and any number is complete.
4. Inside a bucket the fingerprints are sorted by Gray rank and indexed as a
   tree: each node stores the bits on which all its members agree, less those
   its parent already holds.  A search adds up the differing bits on the way
   down and prunes a whole group when the sum exceeds the bound.  A bucket
   larger than ``bucket_rows`` is cut into chunks, and every pair of chunks is
   its own unit of work, so no task holds an unbounded group.
5. A bucket emits one edge per member towards its local component, never all
   pairs; the edges' connected components are the global ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, order_key, small_batches, text_or_empty
from wearcast.llm.components import connected_components

BITS = 64
SEED = 42
FANOUT = 16
QUERY_BLOCK = 512
FLUSH_ROWS = 100_000


# ---------------------------------------------------------------- fingerprint


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text as an unsigned 64-bit number (0 for no words)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    last = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, n, 65536):
        a, b = starts[at : min(n, at + 65536)].tolist(), last[at : at + 65536].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, text_hash: bool = False) -> DataFrame:
    """``(doc_id, fp long)`` per row of ``docs``: the fingerprint's 64 bits as
    a signed number.  NULL and blank texts get 0.  With ``text_hash`` a third
    column has xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    more = [F.xxhash64(text_or_empty(docs, text_col)).alias("text_hash")] if text_hash else []
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)
    return small_batches(slim).mapInArrow(run, "doc_id long, fp long" + ", text_hash long" * text_hash)


# ---------------------------------------------------------------- local index


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_index(fp: np.ndarray, first: np.ndarray) -> list[tuple]:
    """Levels of the index from the leaves' parents to one node per bucket.

    ``fp`` is sorted by bucket and Gray rank; ``first`` holds the first row of
    each bucket.  A level is (start row, first child, children, mask,
    pattern): mask has the bits on which all members agree."""
    levels = []
    low, high, begin = fp, fp, first
    count = len(fp)
    while True:
        sizes = np.diff(np.append(begin, count))
        per = -(-sizes // FANOUT)
        total = int(per.sum())
        bucket = np.repeat(np.arange(len(begin)), per)
        nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
        child = begin[bucket] + nth * FANOUT
        kids = np.minimum(FANOUT, sizes[bucket] - nth * FANOUT)
        low, high = np.bitwise_and.reduceat(low, child), np.bitwise_or.reduceat(high, child)
        mask = ~(low ^ high)
        levels.append((child, kids, mask, low & mask))
        begin, count = np.cumsum(per) - per, total
        if total == len(begin):
            return levels


def linked_pairs(fp: np.ndarray, first: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a < b) of one bucket within the bound, in bounded blocks."""
    levels = gray_index(fp, first)
    bucket = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(fp))))
    # last row below each node, so that only later rows are searched
    last, nodes = [], np.arange(len(fp))
    for child, kids, _, _ in levels:
        nodes = nodes[child + kids - 1]
        last.append(nodes)
    for at in range(0, len(fp), QUERY_BLOCK):
        q = np.arange(at, min(len(fp), at + QUERY_BLOCK))
        node, above = bucket[q], np.zeros(len(q), dtype=np.uint64)
        acc = np.zeros(len(q), dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            child, kids, mask, pattern = levels[depth]
            acc = acc + np.bitwise_count((fp[q] ^ pattern[node]) & mask[node] & ~above)
            keep = (acc <= max_distance) & (last[depth][node] > q)
            q, node, acc = q[keep], node[keep], acc[keep]
            n = kids[node]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            above = np.repeat(mask[node], n)
            q, acc, node = np.repeat(q, n), np.repeat(acc, n), np.repeat(child[node], n) + offset
        acc = acc + np.bitwise_count((fp[q] ^ fp[node]) & ~above)
        keep = (acc <= max_distance) & (node > q)
        if keep.any():
            yield q[keep], node[keep]


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root row of each row under the given links (vectorised hooking)."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (same := ra == rb).all():
                break
            ra, rb = ra[~same], rb[~same]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _bucket_edges(max_distance: int):
    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), *key.T))
        key, fp = key[order], fp[order]
        change = np.any(key[1:] != key[:-1], axis=1)
        first = np.concatenate(([0], np.flatnonzero(change) + 1))
        root = local_roots(len(fp), linked_pairs(fp, first, max_distance))
        hooked = root != np.arange(len(fp))
        out = np.stack([fp[hooked], fp[root[hooked]]], axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1))
            rows += b.num_rows
            if rows >= FLUSH_ROWS:
                all_rows = np.concatenate(held)
                whole = int(np.flatnonzero(np.any(all_rows[:, :4] != all_rows[-1, :4], axis=1))[-1] + 1) if (all_rows[:, :4] != all_rows[-1, :4]).any() else 0
                if whole:
                    yield edges(all_rows[:whole, :4], np.ascontiguousarray(all_rows[:whole, 4]).view(np.uint64))
                held, rows = [all_rows[whole:]], len(all_rows) - whole
        if rows:
            all_rows = np.concatenate(held)
            yield edges(all_rows[:, :4], np.ascontiguousarray(all_rows[:, 4]).view(np.uint64))

    return run


# ---------------------------------------------------------------- distributed


def block_masks(n: int, max_distance: int, target: int = 2048, most: int = 8) -> list[int]:
    """Bit masks of the bucket tables for ``n`` fingerprints: every choice of
    ``blocks - max_distance`` whole blocks, with the fewest blocks for which
    evenly spread fingerprints give at most ``target`` rows a bucket."""
    for blocks in range(max_distance + 1, most + 1):
        equal = blocks - max_distance
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        if blocks == most or n / 2 ** (equal * (BITS // blocks)) <= target:
            break
    cut = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(cut, equal)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def fingerprint_components(fps: DataFrame, max_distance: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """``fps(fp long)`` distinct -> ``(node, root)`` for every fingerprint that
    is linked, directly or through others, to a smaller one (as signed
    numbers).  All fingerprints take part; no bucket is capped."""
    masks = block_masks(fps.count(), max_distance)
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.inline(keys))
    hot = rows.groupBy("t", "key").count().where(F.col("count") > bucket_rows)
    hot = hot.select("t", "key", F.ceil(F.col("count") / bucket_rows).cast("long").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)))
    dealt = (
        rows.join(hot, ["t", "key"], "left")
        .select("t", "key", "fp", mine.alias("c"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
        .select("t", "key", "fp", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
        .select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    )
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return connected_components(dealt.mapInArrow(_bucket_edges(max_distance), "u long, v long"))


def _rooted(prints: DataFrame, first: Column, max_distance: int) -> DataFrame:
    """(fp, first, root): each fingerprint's smallest ``first`` and component."""
    least = materialise(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct_fingerprints")
    roots = fingerprint_components(least.select("fp"), max_distance)
    return least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints link at ``max_distance`` or fewer differing bits;
    ``component_id`` is the smallest doc_id reachable over links.  NULL, empty
    and blank texts have fingerprint zero and link like any other.  Rows with
    a NULL id take part in linking; a component of NULL ids only has a NULL
    component_id.  Repeated rows give repeated results; an empty table gives
    none; other columns are ignored."""
    prints = materialise(with_fingerprint(docs, text_col, id_col, shingle), "fingerprints")
    rooted = _rooted(prints, F.col("doc_id"), max_distance)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with
    the smallest id, NULL ids last, then the smallest hash of its text.  Every
    group keeps one, also a group of NULL ids only, and one whose ids occur in
    other groups.  Of rows equal in id and text one stays, whatever their
    order."""
    prints = materialise(with_fingerprint(docs, text_col, id_col, shingle, text_hash=True), "fingerprints")
    rooted = _rooted(prints, order_key(F.col("doc_id"), F.col("text_hash")), max_distance)
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash"))
    text_hash = F.xxhash64(text_or_empty(docs, text_col))
    kept = docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["_keep_id"]) & (text_hash == keep["_keep_hash"]), "left_semi")
    # of rows equal in id and text the one of the smallest hash of its columns
    rank = F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema.fields])
    one = kept.groupBy(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_or_empty(kept, text_col)).alias("_hash")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias("_row"))
    return one.select("_row.*")
