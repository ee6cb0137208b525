"""Licence scans with a generalised suffix automaton.

The automaton holds every substring of the licence templates and phrases, as
sequences of word numbers.  A text streams through it once, word by word; the
automaton's state gives the matching statistic (the longest template substring
that ends at this word).  Right-maximal matches of at least ``MIN_MATCH`` words
are chained per template - places ascending in text and template, gaps up to
``MAX_GAP`` words - and a chain that covers enough of its template is a span.
Phrases are found where the current match has one as a suffix.

The automaton is built from the template list alone, once per task, and its
size is bounded by twice the templates' words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wearcast.llm.common import small_batches

MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.5

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Standard licence notices by label; texts are public and may be replaced.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
SPANS = "array<struct<label:string,template:int,start:long,end:long,coverage:double>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; characters above ASCII are
    word characters."""
    return _WORD((text or "").encode("utf-8").lower())


class Automaton:
    """Generalised suffix automaton of the templates and phrases."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.templates = [(label, words(t)) for label in templates for t in templates[label]]
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], [set()]
        for t, (_, seq) in enumerate(self.templates):
            self._add(seq, t)
        spelled = [(words(p), label) for p, label in phrases.items()]
        for seq, _ in spelled:
            self._add(seq, None)
        # where a state's longest string ends, in templates; short to long
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]
        self.own: list[list[tuple[int, str]]] = [[] for _ in self.size]
        for seq, label in spelled:
            state = 0
            for w in seq:
                state = self.step[state][self.number[w]]
            self.own[state].append((len(seq), label))
        self.above: list[list[tuple[int, str]]] = [[] for _ in self.size]
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.above[s] = self.above[self.link[s]] + self.own[self.link[s]]

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the strings that end ``p`` then ``c``."""
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, seq: list[bytes], template: int | None) -> None:
        last = 0
        for at, w in enumerate(seq):
            c = self.number.setdefault(w, len(self.number))
            q = self.step[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
            else:
                p, fresh = last, self._new(self.size[last] + 1, {}, 0)
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = fresh
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][c]
                    self.link[fresh] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
                last = fresh
            if template is not None:
                self.ends[last].add((template, at))

    def statistics(self, seq: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the longest match that ends at each word
        that has one."""
        step, link, size = self.step, self.link, self.size
        state = length = 0
        known = self.number
        for at, c in enumerate(map(known.get, seq)):
            if c is None:
                state = length = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            to = step[state].get(c)
            if to is not None:
                state, length = to, length + 1
                yield at, length, state

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple]]:
        """Phrase places (start, label) and template spans."""
        phrases, matches = [], []
        held = (-2, 0, 0)
        own, above = self.own, self.above
        for now in self.statistics(seq):
            at, length, state = now
            if own[state]:
                phrases += [(at - n + 1, label) for n, label in own[state] if n <= length]
            if above[state]:
                phrases += [(at - n + 1, label) for n, label in above[state]]
            if held[1] >= MIN_MATCH and (at != held[0] + 1 or length <= held[1]):
                matches.append(held)
            held = now
        if held[1] >= MIN_MATCH:
            matches.append(held)
        return phrases, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple]:
        """Spans (label, template, first word, last word, coverage)."""
        open_: dict[int, list[list[int]]] = {}
        done: list[tuple[int, list[int]]] = []
        for at, length, state in matches:
            for t, end in sorted(self.ends[state]):
                for chain in reversed(open_.setdefault(t, [])):
                    first, last, last_t, covered = chain
                    new = min(length, at - last, end - last_t)
                    if new > 0 and at - length - last <= MAX_GAP:
                        chain[1:] = [at, end, covered + new]
                        break
                else:
                    open_[t].append([at - length + 1, at, end, length])
            for t, chains in open_.items():  # a chain too far behind is closed, so few stay open
                done += [(t, c) for c in chains if at - c[1] > 4 * MAX_GAP]
                open_[t] = [c for c in chains if at - c[1] <= 4 * MAX_GAP]
        done += [(t, c) for t, chains in open_.items() for c in chains]
        spans = []
        for t, (first, last, _, covered) in done:
            label, seq = self.templates[t]
            cover = min(1.0, covered / len(seq))
            if cover >= MIN_COVER:
                spans.append((label, t, first, last, cover))
        return sorted(spans, key=lambda s: (s[2], s[3], s[0], s[1]))


def scan_text(automaton: Automaton, text: str | None) -> dict:
    seq = words(text)
    phrases, spans = automaton.scan(seq)
    starts = [p for p, _ in phrases]
    base = {label for _, label in phrases}
    return {
        "n_words": len(seq),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": max([s[4] for s in spans], default=0.0),
        "spans": [dict(zip(("label", "template", "start", "end", "coverage"), s)) for s in spans],
    }


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of all
    phrases), first_word and last_word (their smallest and largest start, NULL
    without any), base_labels, labels (phrase and span labels: distinct,
    sorted, comma-joined), score (the largest covered share of a template) and
    spans.  NULL and empty texts have no words; other columns are ignored;
    repeated rows give repeated results."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases, templates)
        for b in batches:
            found = [scan_text(automaton, t.as_py()) for t in b.column(1)]
            rows = [{"doc_id": i.as_py(), **f} for i, f in zip(b.column(0), found)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return small_batches(slim).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
])
