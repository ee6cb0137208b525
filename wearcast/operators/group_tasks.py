"""What tasks do for the models of many groups (``grouped``), in numpy over
thousands of groups at a time: ``packer`` lays the rows of a group side by
side, ``grower`` grows the trees of whole groups, ``applier`` walks rows down
their group's trees.  Each is a function for ``mapInArrow``; a task holds some
``CHUNK_ROWS`` rows, or one group, at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PACK_ROWS = 2**19
BLOCK_ROWS = 2**16
CHUNK_ROWS = 2**17
Batches = Iterator[pa.RecordBatch]


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table of one chunk."""
    found = table.column(name)
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


def _key_codes(table: pa.Table, keys: Sequence[str]) -> list[np.ndarray]:
    """Each key column as numbers, equal where the keys are (NULL is a key)."""
    return [_column(table, k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where groups begin in rows sorted by their keys."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for codes in _key_codes(table, keys):
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _chunks(batches: Batches, rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield _table(held)
            held, n = [], 0
    if held:
        yield _table(held)


# -- rows of a group side by side ---------------------------------------------
def packer(keys: Sequence[str], values: Sequence[str], cuts: Sequence[Sequence[float] | None], codes: Sequence[str]) -> Callable[[Batches], Batches]:
    """Rows (``keys``, ``values`` as doubles, ``codes`` as longs) to one row for
    each group and chunk, of ``BLOCK_ROWS`` rows at most: the keys, ``n`` rows,
    ``odd`` where a value is not finite, and each column's numbers as bytes.
    Of values with ``cuts`` the number of cuts at or below them is kept."""
    cuts_of = {v: np.array(at) for v, at in zip(values, cuts) if at is not None}

    def run(batches: Batches) -> Batches:
        for table in _chunks(batches, PACK_ROWS):
            group, count = np.zeros(table.num_rows, dtype=np.int64), 1
            for c in _key_codes(table, keys):
                if count > 2**31:
                    group = np.unique(group, return_inverse=True)[1]
                    count = int(group.max()) + 1
                group, count = group * (int(c.max()) + 1) + c, count * (int(c.max()) + 1)
            # numbers of 16 bits are sorted in one pass
            order = np.argsort(group.astype(np.uint16) if count <= 2**16 else group, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0) | (np.arange(table.num_rows) % BLOCK_ROWS == 0))
            offsets = np.append(first, table.num_rows)
            head = pa.array(order[first])
            odd = np.zeros(table.num_rows, dtype=bool)
            packed = []
            for name in (*values, *codes):
                x = np.ascontiguousarray(_column(table, name).to_numpy(zero_copy_only=False)[order])
                if name in cuts_of:
                    x = np.searchsorted(cuts_of[name], x, side="right").astype(np.float64)
                if name in values:
                    odd |= ~np.isfinite(x)
                packed.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(x)]))
            columns = [*(_column(table, k).take(head) for k in keys), pa.array(np.diff(offsets), pa.int64()), pa.array(np.logical_or.reduceat(odd, first)), *packed]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "odd", *values, *codes])

    return run


def _bytes(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, one after the other, and their numbers."""
    packed = packed.cast(pa.binary())
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8), np.diff(offsets)


def _numbers(packed: pa.Array, kind: type) -> np.ndarray:
    """The numbers of packed rows, one after the other."""
    return np.frombuffer(_bytes(packed)[0], dtype=kind)


def unpacker(keys: Sequence[str], values: Sequence[str], codes: Sequence[str]) -> Callable[[Batches], Batches]:
    """The rows that were packed."""

    def run(batches: Batches) -> Batches:
        for b in (b for b in batches if b.num_rows):
            each = pa.array(np.repeat(np.arange(b.num_rows), b.column("n").to_numpy()))
            columns = [*(b.column(k).take(each) for k in keys), *(pa.array(_numbers(b.column(v), np.float64)) for v in values), *(pa.array(_numbers(b.column(c), np.int64)) for c in codes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *values, *codes])

    return run


# -- L1 -----------------------------------------------------------------------
def _whole_groups(batches: Batches, keys: Sequence[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Packed rows, sorted by the keys, in tables of whole groups with about
    ``rows`` rows (or one group), and where groups begin."""
    held, n, most = [], 0, rows
    for b in batches:
        while b.num_rows:
            inside = np.cumsum(b.column("n").to_numpy())
            took = min(int(np.searchsorted(inside, most - n)) + 1, b.num_rows)  # with the row that reaches it
            held.append(b.slice(0, took))
            n += int(inside[took - 1])
            b = b.slice(took)
            if n < most:
                continue
            table = _table(held)
            starts = _starts(table, keys)
            cut = int(starts[-1])
            if cut:
                yield table.slice(0, cut), starts[:-1]
            rest = table.slice(cut)
            held, n = rest.to_batches(), int(_column(rest, "n").to_numpy().sum())
            most = max(rows, 2 * n)
    if held:
        table = _table(held)
        yield table, _starts(table, keys)


def _cells(x: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, value) pairs, in order: each row's, where those of
    a group begin, and their values."""
    held = pa.array(x).dictionary_encode()
    values, place = np.unique(held.dictionary.to_numpy(), return_inverse=True)
    key = group * len(values) + place[held.indices.to_numpy()]
    if n_groups * len(values) <= 8 * len(key):
        there = np.zeros(n_groups * len(values), dtype=bool)
        there[key] = True
        pairs, cell = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
    else:
        pairs, cell = np.unique(key, return_inverse=True)
    return cell, np.searchsorted(pairs, np.arange(n_groups + 1) * len(values)), values[pairs % len(values)]


def _best_of(cells: list, rows: np.ndarray, slot: np.ndarray, y: np.ndarray, totals: np.ndarray, group: np.ndarray, min_gain: float) -> tuple:
    """Per node the split of highest gini gain, as ``grouped._best_splits`` has
    it: feature (-1 for none), threshold, and whether each side is pure.

    ``rows`` are in the nodes ``slot`` with the classes ``y``; ``totals`` are the
    nodes' rows by class, ``group`` their groups."""
    n_classes, n_nodes = totals.shape
    n, tt = totals.sum(0), (totals * totals).sum(0)
    before = np.cumsum(totals, axis=1) - totals
    gain, feature, threshold = np.full(n_nodes, min_gain), np.full(n_nodes, -1), np.full(n_nodes, np.nan)
    l_pure, r_pure = np.zeros(n_nodes, dtype=bool), np.zeros(n_nodes, dtype=bool)
    whole = 1 - 1e-12
    for f, (cell, first, value) in enumerate(cells):
        width = first[group + 1] - first[group]
        size = int(width.sum())
        moved = np.cumsum(width) - width - first[group]
        hist = np.bincount(y * size + (moved[slot] + cell[rows]), minlength=n_classes * size).reshape(n_classes, size)
        there = np.flatnonzero(hist.any(0))
        node = np.repeat(np.arange(n_nodes), width)[there]
        cuts = np.flatnonzero(node[1:] == node[:-1])  # a node's last value splits nothing
        if not len(cuts):
            continue
        at = node[cuts]
        left = np.cumsum(hist[:, there], axis=1, dtype=np.float64)[:, cuts] - before[:, at]
        right = totals[:, at] - left
        nl, ll, nr, rr = left.sum(0), (left * left).sum(0), n[at] - left.sum(0), (right * right).sum(0)
        gains = ((ll / nl + rr / nr) - tt[at] / n[at]) / n[at]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        top = np.maximum.reduceat(gains, begin)
        highest = np.flatnonzero(gains == np.repeat(top, np.diff(np.append(begin, len(at)))))
        lowest = highest[np.append(True, np.diff(at[highest]) != 0)]  # of equal gains the lowest threshold
        better = top > gain[at[begin]]
        c = lowest[better]
        to, a = at[c], there[cuts[c]] - moved[at[c]]
        b = there[cuts[c] + 1] - moved[at[c]]
        gain[to], feature[to], threshold[to] = top[better], f, (value[a] + value[b]) / 2
        l_pure[to], r_pure[to] = ll[c] >= nl[c] * nl[c] * whole, rr[c] >= nr[c] * nr[c] * whole
    return feature, threshold, l_pure, r_pure


def _present(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` numbers occur, and each one's place among these."""
    there = np.zeros(n, dtype=bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def _trees_of(x: np.ndarray, cells: list, group: np.ndarray, n_groups: int, y: np.ndarray, n_classes: int, max_depth: int, min_gain: float) -> Iterator[tuple]:
    """The trees of one label in all groups, level by level: (group, node, class,
    feature or -1, threshold) of the nodes.  ``y`` is -1 where there is none."""
    rows = np.flatnonzero(y >= 0)
    y = y[rows]
    owner, slot = _present(group[rows], n_groups)
    number, closed = np.ones(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=bool)
    for depth in range(max_depth + 1):
        k = len(owner)
        totals = np.bincount(y * k + slot, minlength=n_classes * k).reshape(n_classes, k).astype(np.float64)
        feature, threshold = np.full(k, -1), np.full(k, np.nan)
        pure = np.zeros((k, 2), dtype=bool)
        n = totals.sum(0)
        open_ = np.flatnonzero(~closed & ((totals * totals).sum(0) < n * n)) if depth < max_depth else np.zeros(0, dtype=np.int64)
        if len(open_):
            if len(open_) < k:
                place = np.full(k, -1)
                place[open_] = np.arange(len(open_))
                inside = place[slot]
                kept = np.flatnonzero(inside >= 0)
                rows, y, inside = rows[kept], y[kept], inside[kept]
            else:
                inside = slot
            feature[open_], threshold[open_], pure[open_, 0], pure[open_, 1] = _best_of(cells, rows, inside, y, totals[:, open_], owner[open_], min_gain)
            slot = open_[inside]
        yield owner, number, totals.argmax(0), feature, threshold
        if not (feature >= 0).any():
            return
        kept = np.flatnonzero(feature[slot] >= 0)
        rows, y, slot = rows[kept], y[kept], slot[kept]
        goes_left = x[feature[slot], rows] <= threshold[slot]
        ids, slot = _present(2 * slot + ~goes_left, 2 * k)
        above, side = ids >> 1, ids & 1
        owner, number, closed = owner[above], 2 * number[above] + side, pure[above, side]


def grower(keys: Sequence[str], values: Sequence[str], codes: Sequence[str], places: Sequence[tuple[int, int]], texts: Sequence[Sequence[str]], max_depth: int, min_gain: float) -> Callable[[Batches], Batches]:
    """Packed rows, sorted by the keys, to the nodes of every group's trees:
    the keys, ``label``, ``node``, ``value``, ``f``, ``t``.  Of label i, ``texts[i]``
    are the classes in order, and a row's class is in the code column and at
    the factor ``places[i]``, counted from 1."""
    rows = 8 * CHUNK_ROWS // max([8, *map(len, texts)])

    def grown(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_groups = len(starts)
        n = np.add.reduceat(_column(table, "n").to_numpy(), starts)
        group = np.repeat(np.arange(n_groups), n)
        x = np.stack([_numbers(_column(table, v), np.float64) for v in values])
        cells = [_cells(v, group, n_groups) for v in x]
        coded = [_numbers(_column(table, c), np.int64) for c in codes]
        heads = [_column(table, k).take(pa.array(starts)) for k in keys]
        for label, ((column, factor), classes) in enumerate(zip(places, texts)):
            if not len(classes):
                continue
            y = coded[column] // factor % (len(classes) + 1) - 1
            held = [np.concatenate(parts) for parts in zip(*_trees_of(x, cells, group, n_groups, y, len(classes), max_depth, min_gain))]
            owner, node, best, f, t = held
            at, leaf = pa.array(owner), f < 0
            columns = [*(h.take(at) for h in heads), pa.array(np.full(len(owner), label), pa.int32()), pa.array(node, pa.int64()), pa.array(classes, pa.string()).take(pa.array(best)), pa.array(f, pa.int32(), mask=leaf), pa.array(t, pa.float64(), mask=leaf)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "label", "node", "value", "f", "t"])

    def run(batches: Batches) -> Batches:
        for table, starts in _whole_groups(batches, keys, rows):
            yield from grown(table, starts)

    return run


# -- L2 -----------------------------------------------------------------------
# a node as bytes: ``f`` is -2 for none and -1 for an unknown one, ``t_kind`` 0 for
# no threshold, a child -1 for none, ``flag`` -1 and ``length`` (of the text) -1 for none
_NODE = np.dtype([("node", "<i8"), ("left", "<i8"), ("right", "<i8"), ("t", "<f8"), ("label", "<i4"), ("f", "<i4"), ("length", "<i4"), ("strict", "i1"), ("flag", "i1"), ("t_kind", "i1"), ("", "i1")])


def bundler(keys: Sequence[str]) -> Callable[[Batches], Batches]:
    """Nodes (``keys`` and the fields of ``_NODE`` as columns, ``value`` for the
    text) to one row for each group and chunk: the keys, ``_tree``, its nodes,
    and ``_texts``, their texts one after the other."""

    def run(batches: Batches) -> Batches:
        for table in _chunks(batches, CHUNK_ROWS):
            group = np.zeros(table.num_rows, dtype=np.int64)
            for c in _key_codes(table, keys):
                group = np.unique(group * (int(c.max()) + 1) + c, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            ends = np.append(first, table.num_rows)
            taken = pa.array(order)
            part = {c: _column(table, c).take(taken) for c in ("node", "left", "right", "t", "label", "f", "strict", "flag", "value")}
            text = part["value"].cast(pa.string())
            lengths = pc.binary_length(text).fill_null(-1).to_numpy(zero_copy_only=False)
            nodes = np.zeros(table.num_rows, dtype=_NODE)
            for c, none in (("node", -1), ("left", -1), ("right", -1), ("t", 0.0), ("label", -1), ("f", -2), ("strict", False)):
                nodes[c] = part[c].fill_null(none).to_numpy(zero_copy_only=False)
            nodes["t_kind"], nodes["length"] = part["t"].is_valid().to_numpy(zero_copy_only=False), lengths
            nodes["flag"] = part["flag"].cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.append(0, np.cumsum(np.maximum(lengths, 0)))[ends].astype(np.int32)
            data = b"".join(pc.fill_null(text, "").cast(pa.binary()).to_pylist())
            columns = [
                *(_column(table, k).take(pa.array(order[first])) for k in keys),
                pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * _NODE.itemsize).astype(np.int32)), pa.py_buffer(nodes.tobytes())]),
                pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_tree", "_texts"])

    return run


def _forest(bundles: pa.Table, model: np.ndarray, n_models: int, n_labels: int) -> dict:
    """The nodes of all models in one: ``root`` by model and label, and of each
    node its feature, threshold and children; a leaf leads to itself.  The last
    node is where no tree is.  A row goes left where its value is at most
    ``t``, which for a strict split is the number below the threshold.
    ``model`` is the number of each bundle's model."""
    raw, sizes = _bytes(_column(bundles, "_tree"))
    nodes = np.frombuffer(raw.tobytes(), dtype=_NODE)
    tree = np.repeat(model, sizes // _NODE.itemsize) * n_labels + nodes["label"]
    texts = _bytes(_column(bundles, "_texts"))[0]
    ends = np.append(0, np.cumsum(np.maximum(nodes["length"], 0))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(nodes["length"] >= 0, bitorder="little").tobytes())
    value = pa.Array.from_buffers(pa.string(), len(nodes), [valid, pa.py_buffer(ends), pa.py_buffer(texts.tobytes())])
    order = np.lexsort((nodes["node"], tree))
    tree, nodes, none = tree[order], nodes[order], len(order)
    node, feature, cut, strict = nodes["node"], nodes["f"], nodes["t"], nodes["strict"] == 1
    known, place = np.unique(node, return_inverse=True)
    key = tree * (len(known) + 1) + place

    def child(side: str) -> np.ndarray:
        wanted = nodes[side]
        at = np.searchsorted(known, wanted).clip(0, max(0, len(known) - 1))
        to = np.searchsorted(key, tree * (len(known) + 1) + at).clip(0, max(0, none - 1))
        return np.where((known[at] == wanted) & (key[to] == tree * (len(known) + 1) + at), to, none) if none else at

    leaf, itself = feature == -2, np.arange(none)
    last = np.isnan(cut) & (nodes["t_kind"] == 1)  # NaN: above every number
    cut = np.where(strict & (cut == -np.inf), np.nan, np.where(strict, np.nextafter(cut, -np.inf), cut))
    cut = np.where(last, np.inf, np.where((feature == -1) | (nodes["t_kind"] == 0), np.nan, cut))
    children = np.append(np.stack([np.where(leaf, itself, child("left")), np.where(leaf, itself, child("right"))], axis=1).ravel(), [none, none])
    root = np.full((n_models + 1) * n_labels, none)
    heads = np.flatnonzero(np.append(True, np.diff(tree) != 0)) if none else itself
    root[tree[heads]] = heads
    highest = np.zeros(n_labels, dtype=np.int64)
    np.maximum.at(highest, tree % n_labels, node)
    flag = pa.array(nodes["flag"] == 1, mask=nodes["flag"] < 0)
    return {
        "root": root.reshape(-1, n_labels), "f": np.append(np.maximum(feature, 0), 0), "t": np.append(cut, np.nan), "children": children,
        "all_left": np.append(last & ~strict & ~leaf, False), "depth": [max(0, int(h).bit_length() - 1) for h in highest],
        "value": pa.concat_arrays([value.take(pa.array(order)), pa.nulls(1, pa.string())]), "flag": pa.concat_arrays([flag, pa.nulls(1, pa.bool_())])}


def _ends(forest: dict, label: int, model: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    at, row = forest["root"][model, label], np.arange(x.shape[1])
    odd = forest["all_left"].any() and np.isnan(x).any()
    for _ in range(forest["depth"][label]):
        goes_left = x[forest["f"][at], row] <= forest["t"][at]
        if odd:
            goes_left |= forest["all_left"][at]
        at = forest["children"][2 * at + ~goes_left]
    return at


class _Lookup:
    """Which model has a row's keys."""

    def __init__(self, models: pa.Table, keys: Sequence[str]):
        self.keys, self.steps, at = keys, [], np.zeros(models.num_rows, dtype=np.int64)
        for k in keys:
            held = _column(models, k).dictionary_encode(null_encoding="encode")
            known, at = np.unique(at * len(held.dictionary) + held.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            size = int(known[-1]) + 1 if len(known) else 0
            place = None
            if size <= 2**22:  # -1 is the last
                place = np.full(size + 1, -1)
                place[known] = np.arange(len(known))
            self.steps.append((held.dictionary, known, place))
        self.each, self.count = at, len(self.steps[-1][1])  # the model of each of ``models``

    def find(self, rows: pa.Table) -> np.ndarray:
        """The model's number; the count of models where there is none."""
        at = np.zeros(rows.num_rows, dtype=np.int64)
        for k, (values, known, place) in zip(self.keys, self.steps):
            i = pc.index_in(_column(rows, k), value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
            wanted = np.where((at < 0) | (i < 0), -1, at * len(values) + i)
            if place is not None:
                at = place[np.minimum(wanted, len(place) - 1)]
            else:
                to = np.searchsorted(known, wanted).clip(0, len(known) - 1)
                at = np.where(known[to] == wanted, to, -1)
        return np.where(at < 0, self.count, at)


def applier(keys: Sequence[str], inputs: Sequence[str], kept: Sequence[str], out: Sequence[str], is_text: Sequence[bool]) -> Callable[[Batches], Batches]:
    """Models (``_kind`` 0, in bundles), then rows (``_kind`` 1): the
    columns ``kept`` of the rows and a prediction a label, called ``out``.  A
    task holds the models of its part of the groups."""

    def run(batches: Batches) -> Batches:
        models: list[pa.RecordBatch] = []

        def rows() -> Batches:
            for b in batches:
                n = int(np.searchsorted(b.column("_kind").to_numpy(), 1))
                if n:
                    models.append(b.slice(0, n).select([*keys, "_tree", "_texts"]))
                if n < b.num_rows:
                    yield b.slice(n).select([*dict.fromkeys([*keys, *kept, *inputs])])

        forest = None
        for table in _chunks(rows(), CHUNK_ROWS):
            if forest is None:  # every model came before the first row
                known = _table(models) if models else None
                lookup = _Lookup(known, keys) if models else None
                forest = _forest(known, lookup.each, lookup.count, len(out)) if models else None
            given = [_column(table, c).cast(pa.float64()) for c in inputs]
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in given])
            gaps = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in given])
            model = lookup.find(table) if models else None
            preds = []
            for label, text in enumerate(is_text):
                if not models:
                    preds.append(pa.nulls(table.num_rows, pa.string() if text else pa.bool_()))
                    continue
                at = _ends(forest, label, model, x)
                at[gaps] = len(forest["f"]) - 1
                preds.append(forest["value" if text else "flag"].take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*(_column(table, c) for c in kept), *preds], names=[*kept, *out])

    return run
