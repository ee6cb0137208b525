"""Hard negatives from shared lists of anchor clusters (MAXIMUS style).

For each anchor: its best rows of the same label (positives), then for each
positive the best rows of other labels whose score lies between ``low`` and
``high`` percent of the positive's.  Scores are exact integer inner products.

1. Spherical k-means on a bounded sample of anchors gives centroids; every
   anchor joins its nearest.  A cluster's angle is that of its farthest member.
2. For a cluster all candidates are sorted once by the angular upper bound
   |x| cos(max(0, angle(x, centroid) - cluster angle)): no member can score
   higher with x than its own norm times that.
3. Every member walks that list in steps.  It stops, certified, when the bound of
   the next row is below all that could still enter its results: the worst of
   its best, or the low end of its windows.  Rows that tie with the worst are
   still visited, so ties are settled by id.

Candidates are cut into blocks and anchors into groups of whole clusters (a
larger cluster is cut); a task holds one block and one group, whatever the
tables' sizes, and returns the members' best of its block.  Two walks are made:
one for the positives, and, their scores known, one for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearcast.llm.common import materialise

#: vector components in a block of candidates or a group of anchors
BLOCK = 4_194_304
#: anchors, and vector components, that the centroids are fitted on
SAMPLE_ROWS, SAMPLE_COMPONENTS = 4096, 1_048_576
MAX_CLUSTERS = 256
MIN_BLOCKS = 16
MEMBERS, STEP = 512, 1024
NEVER = np.iinfo(np.int64).min


# ------------------------------------------------------------------ clusters


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector becomes the first axis."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out = x / np.where(norm == 0, 1, norm)
    if x.shape[1]:
        out[norm[:, 0] == 0, 0] = 1.0
    return out


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, begun at the rows farthest from those chosen before."""
    x = unit(sample)
    if not len(x) or not x.shape[1]:
        return np.zeros((0, x.shape[1]))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)) and (far := int(np.argmin(nearest))) not in chosen:
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    c = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where((np.linalg.norm(sums, axis=1) > 0)[:, None], unit(sums), c)
    return c


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of one matrix, short vectors filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) >= 2.0**53:
        raise OverflowError("vector components must be below 2^53")
    return out


# ------------------------------------------------------------------ one walk


def bounds(x: np.ndarray, norms: np.ndarray, members: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each row of ``x`` with a unit vector of the
    cluster's cone, with room for rounding."""
    angle = np.arccos(np.clip(unit(members) @ centroid, -1, 1)).max()
    cos = np.clip(x @ centroid / np.where(norms == 0, 1, norms), -1, 1)
    near = np.maximum(0, np.arccos(cos) - angle - 1e-6)
    return norms * np.cos(near) + 1e-6 * (1 + norms)


def _first_ties(tie: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row's marked places ``k`` with the smallest ids."""
    if tie.shape[1] <= k or tie.sum(axis=1).max(initial=0) <= k:
        return tie
    held = np.where(tie, ids[None], np.iinfo(np.int64).max)
    last = np.partition(held, k - 1, axis=1)[:, k - 1 : k]
    less, equal = tie & (held < last), tie & (held == last)
    return less | (equal & (np.cumsum(equal, axis=1) + less.sum(axis=1, keepdims=True) <= k))


def walk(members: np.ndarray, listed: np.ndarray, ids: np.ndarray, bound: np.ndarray, exact: bool, want, slots: int, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each member's rows down the shared list, in steps, until certified:
    yields (member, slot, place in the list, score) of rows that may be among
    the ``k`` best of a slot.

    ``want(members, rows, scores)`` gives, per slot, which rows count;
    ``floor[member, slot]`` is a score below which none does."""
    norms = np.linalg.norm(members, axis=1)
    best = np.full((len(members), slots, k), NEVER, np.int64)
    open_ = np.arange(len(members))
    for at in range(0, len(listed), STEP):
        least = np.maximum(best[open_, :, 0], floor[open_]).min(axis=1)
        # a bound below the least score that could enter closes the member
        top = norms[open_] * bound[at]
        open_ = open_[top + 1e-6 * (1 + np.abs(top)) >= least.astype(np.float64)]
        if not len(open_):
            return
        rows = np.arange(at, min(len(listed), at + STEP))
        m, x = members[open_], listed[rows]
        scores = (m @ x.T).astype(np.int64) if exact else _integer_scores(m, x)
        for slot in range(slots):
            held = best[open_, slot]
            counts = want(slot, open_, rows, scores) & (scores >= np.maximum(held[:, :1], floor[open_, slot][:, None]))
            masked = np.where(counts, scores, NEVER)
            top_k = np.partition(masked, max(0, masked.shape[1] - k), axis=1)[:, -k:]
            both = np.sort(np.concatenate([held, top_k], axis=1), axis=1)[:, -k:]
            best[open_, slot] = both
            last = both[:, :1]
            who, row = np.nonzero(counts & ((scores > last) | _first_ties(counts & (scores == last), ids[rows], k)))
            if len(who):
                yield open_[who], np.full(len(who), slot), rows[row], scores[who, row]


def _integer_scores(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products beyond what doubles hold exactly, in whole numbers."""
    whole = m.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return whole.astype(np.int64)  # raises where a score is no long


def _cluster_walks(anchors: pd.DataFrame, block: pd.DataFrame, centroids: np.ndarray, slots: int, k: int, make) -> Iterator[tuple]:
    """(anchor row, slot, block row, score), the best ``k`` a slot, over all
    clusters of a group of anchors."""
    width = max([len(v) for v in anchors["q"]] + [len(v) for v in block["q"]] + [centroids.shape[1]])
    x, a = padded(list(block["q"]), width), padded(list(anchors["q"]), width)
    c = np.pad(centroids, ((0, 0), (0, width - centroids.shape[1])))
    norms, ids = np.linalg.norm(x, axis=1), block["vec_id"].to_numpy()
    exact = np.linalg.norm(a, axis=1).max(initial=0) * norms.max(initial=0) < 2.0**52
    cluster = anchors["cluster"].to_numpy()
    for one in np.unique(cluster):
        inside = np.flatnonzero(cluster == one)
        bound = bounds(x, norms, a[inside], c[one])
        order = np.argsort(-bound, kind="stable")
        listed, sunk = x[order], bound[order]
        for at in range(0, len(inside), MEMBERS):
            members = inside[at : at + MEMBERS]
            want, floor = make(members, order)
            found = list(walk(a[members], listed, ids[order], sunk, exact, want, slots, k, floor))
            if not found:
                continue
            who, slot, row, score = (np.concatenate(f) for f in zip(*found))
            row, who = order[row], members[who]
            by = np.lexsort((ids[row], -score, slot, who))
            who, slot, row, score = who[by], slot[by], row[by], score[by]
            fresh = np.append(True, (who[1:] != who[:-1]) | (slot[1:] != slot[:-1]))
            first = np.flatnonzero(fresh)
            nth = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            keep = nth < k
            yield who[keep], slot[keep], row[keep], score[keep]


def _labels(anchors: pd.DataFrame, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both as numbers."""
    codes = pd.factorize(pd.concat([anchors["label"], block["label"]]))[0]
    return codes[: len(anchors)], codes[len(anchors) :]


def _table(found: Iterator[tuple], columns) -> pd.DataFrame:
    parts = list(found)
    who, slot, row, score = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts) if parts else [()] * 4))
    return pd.DataFrame(columns(who, slot, row) | {"score": score})


def _positives(centroids: np.ndarray, k: int):
    def task(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids, own = block["vec_id"].to_numpy(), anchors["vec_id"].to_numpy()
        label, labels = _labels(anchors, block)

        def make(members, order):
            def want(slot, who, rows, scores):
                m, r = members[who], order[rows]
                return (label[m][:, None] == labels[r][None]) & (own[m][:, None] != ids[r][None])

            return want, np.full((len(members), 1), NEVER, np.int64)

        found = _cluster_walks(anchors, block, centroids, 1, k, make) if len(anchors) and len(block) else iter(())
        return _table(found, lambda who, slot, row: {"anchor": anchors["anchor"].to_numpy()[who], "positive_id": ids[row]})

    return task


def _negatives(centroids: np.ndarray, k: int, low: int, high: int):
    def task(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids, (label, labels) = block["vec_id"].to_numpy(), _labels(anchors, block)
        given = [np.asarray(s, np.int64) for s in anchors["scores"]]
        slots = max(map(len, given), default=0)
        # windows as whole scores: low * p <= 100 * s <= high * p
        least = np.full((len(given), slots), np.iinfo(np.int64).max, np.int64)
        most = np.full((len(given), slots), NEVER, np.int64)
        for i, s in enumerate(given):
            least[i, : len(s)] = [-((-low * int(p)) // 100) for p in s]
            most[i, : len(s)] = [(high * int(p)) // 100 for p in s]

        def make(members, order):
            def want(slot, who, rows, scores):
                m, r = members[who], order[rows]
                return (label[m][:, None] != labels[r][None]) & (scores >= least[m, slot][:, None]) & (scores <= most[m, slot][:, None])

            return want, least[members]

        found = _cluster_walks(anchors, block, centroids, slots, k, make) if slots and len(block) else iter(())
        return _table(found, lambda who, slot, row: {"anchor": anchors["anchor"].to_numpy()[who], "slot": slot, "negative_id": ids[row]})

    return task


# --------------------------------------------------------------- distributed


def _paired(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, task, schema: str) -> DataFrame:
    """``task`` on every (group of anchors, block of rows)."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(task, schema)


def _ranked(df: DataFrame, by: list[str], second: str, k: int) -> DataFrame:
    """The best ``k`` rows of each key, numbered; Spark limits each task's rows
    to the best ``k`` before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), second)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` from ``rows(vec_id long, label, q array<long>)``.

    An anchor's positives are its ``positives`` best other rows of its label;
    each positive gets the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score``.  Best is
    by score, then smaller vec_id.

    Rows with a NULL id, label, vector or component take no part; a label is
    told apart by its text.  A row with the anchor's own vec_id is no other
    row.  Repeated rows count as often as they stand, and an anchor row that is
    repeated is answered each time.  Shorter vectors are filled up with zeros.  A score that is no
    long raises an error; other columns are ignored; an empty table gives
    none.  Positives without negatives have no rows."""
    complete = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull())
    picked = rows.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    typed = picked.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("q").cast("array<long>").alias("q"), F.col("_anchor").alias("is_anchor"))
    kept = typed.where(complete).withColumn("n", F.monotonically_increasing_id())
    table = materialise(kept, "vectors")
    size = table.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a"), F.max(F.size("q")).alias("w")).first()
    width = max(1, size["w"] or 1)
    held = max(1, BLOCK // width)
    blocks = max(MIN_BLOCKS, -(-size["n"] // held))
    rows_ = table.select("vec_id", "label", "q", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("block"))
    own = table.where("is_anchor")
    # the centroids: a bounded sample of anchors, by the hash of their number
    most = max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // width))
    sample = own.orderBy(F.xxhash64("n")).limit(most).select("q").collect()
    clusters = max(1, min(MAX_CLUSTERS, SAMPLE_COMPONENTS // width, int(size["a"] ** 0.5)))
    centroids = fit_centroids(padded([np.array(r["q"], float) for r in sample], width), clusters)
    anchors, groups = _clustered(own, centroids, width, held)
    first = _paired(anchors, rows_, blocks, groups, _positives(centroids, positives), "anchor long, positive_id long, score long")
    best = materialise(_ranked(first, ["anchor"], "positive_id", positives), "positives")
    given = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select("anchor", F.col("p.score").alias("scores"))
    second = _paired(anchors.join(given, "anchor"), rows_, blocks, groups, _negatives(centroids, negatives, low, high), "anchor long, slot int, negative_id long, score long")
    chosen = _ranked(second, ["anchor", "slot"], "negative_id", negatives)
    told = best.select("anchor", (F.col("rank") - 1).alias("slot"), "positive_id", F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = chosen.join(told, ["anchor", "slot"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def _clustered(own: DataFrame, centroids: np.ndarray, width: int, held: int) -> tuple[DataFrame, int]:
    """Anchors with their cluster and ``part``, the group of clusters they are
    held in, and the number of groups.  A group has at most ``held`` anchors; a
    larger cluster is spread evenly over groups of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.zeros(len(b), np.int32)
            for i in range(0, len(b), MEMBERS):
                at[i : i + MEMBERS] = np.argmax(unit(padded(list(b["q"][i : i + MEMBERS]), width)) @ centroids.T, axis=1)
            yield b.assign(cluster=at)

    near = materialise(own.select(F.col("n").alias("anchor"), "vec_id", "label", "q").mapInPandas(run, "anchor long, vec_id long, label string, q array<bigint>, cluster int"), "anchors")
    sizes = near.groupBy("cluster").count().orderBy("cluster").collect()  # at most MAX_CLUSTERS rows
    first, pieces, group, room = F.lit(0), F.lit(1), 0, held
    for r in sizes:
        cut = -(-r["count"] // held)
        if r["count"] > room:
            group, room = group + (room < held), held
        first, pieces = F.when(F.col("cluster") == r["cluster"], group).otherwise(first), F.when(F.col("cluster") == r["cluster"], cut).otherwise(pieces)
        group, room = (group, room - r["count"]) if cut == 1 else (group + cut, held)
    groups = group + (room < held)
    return near.withColumn("part", (first + F.pmod(F.xxhash64("anchor"), pieces)).cast("int")), max(1, groups)
