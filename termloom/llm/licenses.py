"""License scans by a generalised suffix automaton over the words of license texts.

The automaton of all templates is small and built once in each worker. A document streams through it word by
word: the state and the matched length give, at every word, the longest run ending there that stands in some
template (the matching statistics). Phrases are read off the states' suffix links. Long matches are chained per
template, in order on both sides, into spans; the share of a template's words that its spans cover is its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.batches import record, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license texts and notices, or their characteristic paragraphs.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}
SHORTEST, GAP, COVERED = 5, 12, 0.5


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


class SuffixAutomaton:
    """Of several word sequences; each begins anew at the root, so no factor runs across two of them."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]
        self.templates = [(label, words(t)) for label, t in templates.items()]
        for k, sequence in enumerate([t for _, t in self.templates] + [words(p) for p in phrases]):
            last = 0
            for at, w in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                if k < len(self.templates):
                    ends[last].setdefault(k, set()).add(at)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                for k, at in ends[s].items():
                    ends[self.link[s]].setdefault(k, set()).update(at)
        #: for each state that may end a long match: template -> where its factors end there, ascending
        self.ends = [{k: sorted(at) for k, at in e.items()} if self.length[s] >= SHORTEST else {} for s, e in enumerate(ends)]
        own: dict[int, list[tuple[int, str]]] = {}
        for p, label in phrases.items():
            s = 0
            for w in words(p):
                s = self.next[s][self.vocabulary[w]]
            own.setdefault(s, []).append((len(words(p)), label))
        #: for each state: phrases that are a suffix of its factors, as (words, label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[s] = self.phrases[self.link[s]] + own.get(s, [])

    def _extend(self, last: int, c: int, ends: list[dict[int, set[int]]]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return new

    def _state(self, length: int, edges: dict[int, int], ends: list[dict[int, set[int]]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int, ends: list[dict[int, set[int]]]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        ends[clone] = {k: set(at) for k, at in ends[q].items()}
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, text: list[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
        """Phrases as (first word, words, label), and maximal matches of SHORTEST words or more as (end, length, state)."""
        found, long = [], []
        nexts, links, lengths, phrases = self.next, self.link, self.length, self.phrases
        state = size = 0
        get = self.vocabulary.get
        for at, c in enumerate(map(get, text)):
            if c is None:
                if size >= SHORTEST:
                    long.append((at, size, state))
                state = size = 0
                continue
            if c not in nexts[state]:
                if size >= SHORTEST:
                    long.append((at, size, state))
                while state and c not in nexts[state]:
                    state = links[state]
                    size = lengths[state]
            state = nexts[state].get(c, 0)
            size = size + 1 if state else 0
            if phrases[state]:
                found += [(at + 1 - n, n, label) for n, label in phrases[state] if n <= size]
        if size >= SHORTEST:
            long.append((len(text), size, state))
        return found, long

    def spans(self, long: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Chains of matches: (label, share of the template covered, first word, word after the last).

        A match that stands at several places of a template takes the one that adds most to the chain, the first of those.
        """
        out = []
        chains: dict[int, list[int]] = {}  # template -> [covered words, first word, end, end in the template]

        def close(k: int) -> None:
            covered, first, end, _ = chains.pop(k)
            out.append((self.templates[k][0], covered / len(self.templates[k][1]), first, end))

        for end, size, state in long:
            for k, places in self.ends[state].items():
                c = chains.get(k)
                at = places[0]
                if c and len(places) > 1:
                    at = max(places, key=lambda x: (min(size, x + 1 - c[3]), -x))
                new = min(size, at + 1 - c[3], end - c[2]) if c else size
                if c and (end - size - c[2] > GAP or new < 1):
                    close(k)
                    c, new = None, size
                if c:
                    chains[k] = [c[0] + new, c[1], end, at + 1]
                else:
                    chains[k] = [size, end - size, end, at + 1]
        for k in list(chains):
            close(k)
        return sorted(out, key=lambda x: (x[2], x[0], x[3]))


_automata: dict[str, SuffixAutomaton] = {}


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document; a null or empty text has no words, no labels and score 0. Other columns are ignored.

    ``score`` is 1 where a phrase stands, else the largest share of a template that one chain covers; a
    template's label counts from half of its words. ``spans`` has every chain that reaches that share.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    key = repr((sorted(phrases.items()), sorted(templates.items())))
    span = pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata[key] = SuffixAutomaton(phrases, templates)
        automaton = _automata[key]
        for ids, texts in slices(batches, ("doc_id", "text")):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                text = words(text)
                found, long = automaton.scan(text)
                spans = automaton.spans(long) if long else []
                kept = [s for s in spans if s[1] >= COVERED]
                base = {label for _, _, label in found}
                starts = [at for at, _, _ in found]
                score = 1.0 if base else max([0.0, *(s[1] for s in spans)])
                rows.append((doc_id, len(text), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in kept})), round(score, 6), [dict(zip(("label", "share", "first_word", "end_word"), s, strict=True)) for s in kept]))
            yield record(schema, rows)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, share: double, first_word: long, end_word: long>>")
