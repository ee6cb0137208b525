"""Periodic runs: stretches of words that repeat with a fixed period.

A run is a stretch whose words ``period`` apart are equal, with no smaller
period, at least ``min_repeats`` periods and ``min_length`` words long, that
neither neighbour continues.

The words are read in order.  A word's earlier occurrences name lags; for
every active lag the table of diagonals holds where the match at that lag
began and how far it has come.  A diagonal that the next word does not continue
leaves the table and, if long enough, is emitted there and then.

To stay sparse an earlier occurrence counts for a lag of 2^j to 2^(j+1) - 1
only with its 2^j words of context, and not where that context is itself
periodic with half its length or less.  No run is lost: the windows of 2^j
words inside a run of period q >= 2^j cannot all be so periodic, else they would
all share one period, and the run would have it; and such a window stands
again q words on.  At most four occurrences of another window fit in the lags
of its class, so a text of n words has at most 4 n log n diagonal steps, also
if it holds one word only.  Words between the steps are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import small_batches

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
STREAM_WORDS = 2_000_000


def diagonal_steps(words: np.ndarray, doc: np.ndarray, min_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of every context that stood ``lag`` words earlier in its
    document, in order of place.  ``words`` are the word numbers of several
    documents in a row and ``doc`` their document numbers, ascending."""
    size = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    at, name = np.arange(len(words)), doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    places, lags, k = [], [], 1
    while True:
        fits = size[doc[at]] >= min_repeats * k
        at, name = at[fits], name[fits]
        if not len(at):
            break
        order = np.argsort(name, kind="stable")
        name, at = name[order], at[order]
        fresh = np.append(True, name[1:] != name[:-1])
        group = np.cumsum(fresh) - 1
        again = ~fresh[1:]
        periodic = np.zeros(group[-1] + 1, bool)
        periodic[group[1:][again & (2 * (at[1:] - at[:-1]) <= k)]] = True
        keep = ~periodic[group]
        g, p, t = group[keep], at[keep], 1
        while True:
            lag = p[t:] - p[:-t]
            near = (g[t:] == g[:-t]) & (lag < 2 * k)
            if not near.any():
                break
            near &= lag >= k
            places.append(p[t:][near])
            lags.append(lag[near])
            t += 1
        # contexts twice as long, where both halves recur
        recurs = np.bincount(group)[group] > 1
        names = np.full(len(words), -1, np.int64)
        names[at[recurs]] = group[recurs]
        at = np.sort(at[recurs])
        at = at[at >= k]
        at = at[(doc[at - k] == doc[at]) & (names[at - k] >= 0)]
        name = names[at - k] * (int(group[-1]) + 1) + names[at]
        k *= 2
    place, lag = np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(lags or [np.zeros(0, np.int64)])
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def _has_smaller_period(w: list[int], start: int, period: int) -> bool:
    """Whether a stretch of at least two periods repeats with a divisor of its
    period (a smaller period must be one)."""
    rest, r = period, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = period // r
            if w[start : start + period] == w[start + p : start + period + p]:
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


def scan(w: list[int], steps: Iterator[tuple[int, int]], min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document, by start."""
    active: dict[int, tuple[int, int]] = {}
    runs: list[tuple[int, int, int]] = []
    n = len(w)

    def end(lag: int, first: int, last: int) -> None:
        while last + 1 < n and w[last + 1] == w[last + 1 - lag]:
            last += 1
        start, length = first - lag, last - first + 1 + lag
        if length >= max(min_length, min_repeats * lag) and not _has_smaller_period(w, start, lag):
            runs.append((start, length, lag))

    for i, lag in steps:
        begin = i + 1 - (1 << (lag.bit_length() - 1))
        held = active.get(lag)
        if held is not None and (begin <= held[1] + 1 or w[held[1] + 1 : begin] == w[held[1] + 1 - lag : begin - lag]):
            first = held[0]
        else:
            if held is not None:
                end(lag, *held)
            first = begin
            while first > lag and w[first - 1] == w[first - 1 - lag]:
                first -= 1
        if i + 1 < n and w[i + 1] == w[i + 1 - lag]:
            active[lag] = (first, i)
        else:
            active.pop(lag, None)
            end(lag, first, i)
    for lag, held in active.items():
        end(lag, *held)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, space-joined."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def runs_of_texts(texts: list[list[bytes]], min_length: int, min_repeats: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words; the diagonal steps of all are found together."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    place, lag = diagonal_steps(words, np.repeat(np.arange(len(texts)), sizes), min_repeats)
    first = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cut = np.searchsorted(place, np.append(first, len(words)))
    for d in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[d], cut[d + 1]
        steps = zip((place[a:b] - first[d]).tolist(), lag[a:b].tolist())
        out[d] = scan(words[first[d] : first[d] + sizes[d]].tolist(), steps, min_length, min_repeats)
    return out


def _streams(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The texts in order, in groups of about ``STREAM_WORDS`` words."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > STREAM_WORDS:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_repeats: int = 4) -> DataFrame:
    """``docs`` with ``n_words`` (words between ASCII white space), ``runs``
    (start, length and period in words, by start, then period) and
    ``collapsed``: the text's words without what a run repeats of its first
    period, joined by one space.

    NULL, empty and blank texts have no words, no runs and an empty
    ``collapsed``.  Texts are judged one by one, whole, so repeated rows give
    repeated results; runs of different periods may overlap and are all
    listed.  Columns called ``n_words``, ``runs`` or ``collapsed`` are replaced,
    all others pass through; an empty table gives none."""
    if min_repeats < 3 or min_length < 1:
        raise ValueError("a run has at least three periods and one word")
    made = ("n_words", "runs", "collapsed")
    kept = [f for f in docs.schema.fields if f.name not in made]
    # the text once more, under a name that no other column has
    own = "text"
    while any(f.name.lower() == own for f in kept):
        own += "_"
    slim = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(own), *[docs[f.name] for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or "").encode().split() for t in b.column(0)]
            runs = [r for part in _streams(texts) for r in runs_of_texts(part, min_length, min_repeats)]
            flat = [{"start": s, "length": n, "period": p} for r in runs for s, n, p in r]
            offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            columns = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(flat, _RUN)),
                pa.array([collapsed(t, r).decode() for t, r in zip(texts, runs)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], names=[*b.schema.names[1:], *made])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return small_batches(slim).mapInArrow(run, ", ".join([*ddl, "n_words bigint", f"runs {RUN_TYPE}", "collapsed string"]))
