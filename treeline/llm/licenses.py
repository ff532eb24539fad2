"""Operator 5: licence scan with a generalised suffix automaton.

The words of all templates make one suffix automaton. A text streams through it word by word and gives matching
statistics: how long a run of template words ends here, and where in the templates it may lie. Runs that cannot grow
and are long enough are chained, per template, into spans that advance in the text and in the template; a span that
covers enough of its template gets the template's label. Base phrases are templates of their own, and every place
where one stands whole is reported. Only stretches of words that templates know are streamed; the others reset the
automaton anyway. The automaton is bounded by the templates, not by the corpus.

Cases: null and empty texts have no words, places or spans; every row is scanned on its own, so repeated rows, null ids
and other columns (not read) do no harm; of equal places of a run in a template the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.tokens import slices

# Phrases of the contract.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# The opening notices of public licences.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License version 3",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
}

LONG_MATCH = 5  # words of a run that counts as evidence
COVERED = 0.5  # share of a template that a span must cover for its label
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split()


class LicenseAutomaton:
    """Suffix automaton over the word ids of several templates; built once per worker from the templates."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names, self.sizes = list(templates), [len(words_of(t)) for t in templates.values()]
        self.at: list[dict[int, int]] = [{}]  # per state: template -> first end of this run in it
        phrase_words = {p: self._ids(words_of(t)) for p, t in phrases.items()}
        for number, text in enumerate([*templates.values(), *phrases.values()]):
            last = 0
            for place, c in enumerate(self._ids(words_of(text)), 1):
                last = self._add(last, c, number if number < len(templates) else None, place)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.at[self.link[state]]
            for number, place in self.at[state].items():
                above[number] = min(above.get(number, place), place)
        self.shortest = min((len(w) for w in phrase_words.values()), default=LONG_MATCH)
        whole: dict[int, list[tuple[str, int]]] = {}
        for name, ids in phrase_words.items():
            state = 0
            for c in ids:
                state = self.next[state][c]
            whole.setdefault(state, []).append((name, len(ids)))
        self.whole: list[tuple[tuple[str, int], ...]] = [()] * len(self.link)  # phrases that end where the state does
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.whole[state] = (self.whole[self.link[state]] if state else ()) + tuple(whole.get(state, ()))

    def _ids(self, words: list[bytes]) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids)) for w in words]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.at.append({})
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state after ``p`` by ``c``, made to stand for runs no longer than one more than those of ``p``."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int, number: int | None, place: int) -> int:
        if c in self.next[last]:
            state = self._split(last, c)
        else:
            state = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            self.link[state] = self._split(p, c) if p >= 0 else 0
        if number is not None:
            self.at[state].setdefault(number, place)
        return state

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, int]]]:
        """Words, places ``(label, start)`` of base phrases, and spans ``(label, first, last, covered, template)``."""
        words = text and words_of(text)
        if not words:
            return 0, [], []
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        places: list[tuple[str, int]] = []
        runs: list[tuple[int, int, int]] = []  # end in the text, length, state
        move, link, length, whole = self.next, self.link, self.length, self.whole
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = run = 0
            for at, c in enumerate(ids[start:end].tolist(), start):
                while state and c not in move[state]:
                    if run >= LONG_MATCH:
                        runs.append((at, run, state))
                    state = link[state]
                    run = length[state]
                if c in move[state]:
                    state, run = move[state][c], run + 1
                for name, size in whole[state]:
                    if run >= size:
                        places.append((name, at + 1 - size))
            if run >= LONG_MATCH:
                runs.append((end, run, state))
        return len(words), sorted(places, key=lambda x: (x[1], x[0])), self._chain(runs)

    def _chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int]]:
        spans: list[list[int]] = []  # template, first, last, covered, end in the template
        open_: dict[int, list[int]] = {}
        for end, run, state in runs:
            for number, place in self.at[state].items():
                span = open_.get(number)
                fresh = run
                if span is not None and place > span[4] and end - span[2] <= 2 * self.sizes[number]:
                    fresh = min(run, place - span[4], end - 1 - span[2])
                    if fresh > 0:
                        span[2], span[3], span[4] = end - 1, span[3] + fresh, place
                        continue
                if span is not None and end - run <= span[2] and run <= span[3]:
                    continue  # a shorter run inside the span so far
                open_[number] = span = [number, end - run, end - 1, run, place]
                spans.append(span)
        return [(self.names[n], first, last, min(covered, self.sizes[n]), self.sizes[n]) for n, first, last, covered, _ in spans]


_BUILT: dict[tuple, LicenseAutomaton] = {}


def automaton(phrases: Mapping[str, str], templates: Mapping[str, str]) -> LicenseAutomaton:
    key = (tuple(phrases.items()), tuple(templates.items()))
    if key not in _BUILT:
        _BUILT[key] = LicenseAutomaton(phrases, templates)
    return _BUILT[key]


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = BASE_PHRASES, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, places array<struct<label, start>>, spans array<struct<label, first, last, covered, template>>``.

    Starts and ends are word numbers from 0; ``covered`` and ``template`` are numbers of words. One pass, no shuffle.
    """
    phrases, templates = dict(phrases), dict(templates)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), *((c, pa.int64()) for c in ("first", "last", "covered", "template"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(phrases, templates).scan
        for part in slices(batches, text_col):
            found = [scan(t or "") for t in part.column(1).to_pylist()]
            places = [[dict(zip(("label", "start"), p, strict=True)) for p in x[1]] for x in found]
            spans = [[dict(zip(("label", "first", "last", "covered", "template"), s, strict=True)) for s in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(places, place), pa.array(spans, span)],
                [id_col, "n_words", "places", "spans"],
            )

    frame = docs.select(id_col, text_col)
    kind = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(
        run,
        f"{id_col} {kind}, n_words bigint, places array<struct<label:string,start:bigint>>, "
        "spans array<struct<label:string,first:bigint,last:bigint,covered:bigint,template:bigint>>",
    )


def license_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, labels and a score per row: 1 where a base phrase stands, else the largest covered share of a template."""

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    whole = F.filter("spans", lambda s: s["covered"] >= F.lit(COVERED) * s["template"])
    share = F.array_max(F.transform("spans", lambda s: s["covered"] / s["template"]))
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform(whole, lambda s: s["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
