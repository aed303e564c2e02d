"""Licence scans with a generalised suffix automaton over the words of licence templates.

One automaton holds every substring of every template. A text is streamed through it: after each word the automaton knows
the longest template substring that ends there (the matching statistics). Maximal matches of at least `LEAST_MATCH` words
are chained per template, in order and with bounded gaps, into spans, scored by the share of the template they cover.
Only stretches of words that the templates use are streamed at all; other words reset the automaton anyway. The matches of
all stretches of a text are chained together, so a foreign word within a notice is a gap like any other.

The automaton's size is bounded by the templates, which are fixed; it travels with the task.

Defined results: a null or empty text has no words, no labels and score 0; a null doc_id stays null; rows that repeat keep
a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import alnum_words, blocks, fold, hash_spans, string_parts
from .runtime import NULL_ID, small_batches, table

BATCH_BYTES = 2 << 20
LEAST_MATCH = 4
#: Words that two chained matches may lie apart, in the text and in the template.
GAP = 12
#: A span needs this many matched words, or this share of its template.
LEAST_WORDS, LEAST_SHARE = 8, 0.8

#: Phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template texts by label, public notices in short form.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ],
    "isc": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies."""],
    "mit": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software."""],
    "reserved": ["All rights reserved."],
}


class SuffixAutomaton:
    """All substrings of several word sequences. A state knows its suffix link, its longest length and one place that ends it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Part q's substrings of length up to that of p, plus `word`, from the longer ones."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # a sequence before this one has it
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            p, new = last, self._state(self.length[last] + 1, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """(start, length) of the matches that no longer match contains on both ends: where the matching statistics fall."""
        state = size = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            before = size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            if size <= before and before >= least:
                out.append((i - before, before))
        if size >= least:
            out.append((len(words) - size, size))
        return out


class Templates:
    """Word ids, template sequences, their automaton and the places of each substring of LEAST_MATCH words."""

    def __init__(self, templates: dict[str, list[str]], least: int) -> None:
        self.ids: dict[int, int] = {}
        self.labels: list[str] = []
        self.sequences: list[list[int]] = []
        self.automaton = SuffixAutomaton()
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for label in sorted(templates):
            for text in templates[label]:
                words = [self.ids.setdefault(h, len(self.ids) + 1) for h in hashes(text)]
                n = len(self.sequences)
                self.labels.append(label)
                self.sequences.append(words)
                self.automaton.add(words)
                for i in range(len(words) - least + 1):
                    self.seeds.setdefault(tuple(words[i : i + least]), []).append((n, i))
                if len(words) < least:
                    self.seeds.setdefault(tuple(words), []).append((n, 0))
        self.least = least
        self.sorted = np.array(sorted(self.ids), np.uint64)
        self.number = np.array([self.ids[h] for h in sorted(self.ids)], np.int64)

    def number_of(self, words: np.ndarray) -> np.ndarray:
        """Ids of words by hash, 0 where no template has the word."""
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.number[at], 0)

    def spans(self, stretches: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of the chains found in a text, given its stretches of known words and where they begin."""
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for begin, words in stretches:
            for start, size in self.automaton.matches(words, self.least):
                for n, at in self.seeds.get(tuple(words[start : start + self.least]), ()):
                    if self.sequences[n][at : at + size] == words[start : start + size]:
                        pieces.setdefault(n, []).append((begin + start, at, size))
        out = []
        for n, found in pieces.items():
            found.sort()
            best = [size for _, _, size in found]
            back = [-1] * len(found)
            for j, (s, a, size) in enumerate(found):
                for i in range(j - 1, -1, -1):
                    ps, pa_, psize = found[i]
                    if s - (ps + psize) > GAP:
                        break
                    over = max(0, ps + psize - s, pa_ + psize - a)
                    if a > pa_ and a - (pa_ + psize) <= GAP and over < size and best[i] + size - over > best[j]:
                        best[j], back[j] = best[i] + size - over, i
            used: set[int] = set()
            for j in sorted(range(len(found)), key=lambda j: (-best[j], j)):
                chain, k = [], j
                while k >= 0 and k not in used:
                    chain.append(k)
                    k = back[k]
                used |= set(chain)
                covered = sum(found[k][2] for k in chain)
                share = min(1.0, covered / len(self.sequences[n]))
                if covered >= LEAST_WORDS or share >= LEAST_SHARE:
                    out.append((self.labels[n], found[chain[-1]][0], found[j][0] + found[j][2], share))
        return out


def hashes(text: str) -> list[int]:
    data, offsets = string_parts(pa.array([text], pa.large_string()))
    start, end, _ = alnum_words(data, offsets)
    return hash_spans(fold(data), start, end).tolist()


@lru_cache(maxsize=2)
def _templates() -> Templates:
    return Templates(TEMPLATES, LEAST_MATCH)


def phrase_places(words: np.ndarray, first: np.ndarray, phrase: str) -> np.ndarray:
    """Places where a phrase's words stand consecutively within one text."""
    known = np.array(hashes(phrase), np.uint64)
    n = len(words) - len(known) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(words[:n] == known[0])
    for j in range(1, len(known)):
        hit = hit[words[hit + j] == known[j]]
    text = np.searchsorted(first, hit, side="right")
    return hit[hit + len(known) <= first[text]]


def scan_batch(texts: pa.Array) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text."""
    data, offsets = string_parts(texts)
    start, end, first = alnum_words(data, offsets)
    words = hash_spans(fold(data), start, end)
    n = len(first) - 1
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for phrase, label in PHRASES.items():
        places = phrase_places(words, first, phrase)
        for at, text in zip(places.tolist(), (np.searchsorted(first, places, side="right") - 1).tolist(), strict=True):
            base[text].append((at - int(first[text]), label))
    templates = _templates()
    ids = templates.number_of(words)
    # Stretches of known words, cut where texts end; those too short for any match are left out.
    known = np.zeros(len(ids) + 1, np.int64)
    known[1:] = np.cumsum(ids > 0)
    edge = np.unique(np.concatenate([first, np.flatnonzero(ids == 0), np.flatnonzero(ids == 0) + 1]))
    begin, stop = edge[:-1], edge[1:]
    full = (known[stop] - known[begin] == stop - begin) & (stop - begin >= min(LEAST_MATCH, *map(len, templates.sequences)))
    stretches: list[list[tuple[int, list[int]]]] = [[] for _ in range(n)]
    for a, b in zip(begin[full].tolist(), stop[full].tolist(), strict=True):
        if b - a < LEAST_MATCH:
            continue
        text = int(np.searchsorted(first, a, side="right")) - 1
        stretches[text].append((a - int(first[text]), ids[a:b].tolist()))
    spans = [templates.spans(own) for own in stretches]
    out = []
    for i in range(n):
        places = [p for p, _ in base[i]]
        own = sorted({label for _, label in base[i]})
        every = sorted({*own, *(s[0] for s in spans[i])})
        score = max([1.0] * bool(own) + [s[3] for s in spans[i]], default=0.0)
        out.append((int(first[i + 1] - first[i]), len(places), min(places, default=None), max(places, default=None), ",".join(own), ",".join(every), score, sorted(spans[i])))
    return out


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, texts in blocks(batches, BATCH_BYTES):
        rows = scan_batch(texts)
        cols = list(zip(*rows, strict=True))
        cols[7] = [[dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in x] for x in cols[7]]
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), *[pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)]], names=["doc_id", *[f for f, _ in _FIELDS]])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: words, base phrases, labels, score and the covered template spans (in words)."""
    return small_batches(docs).select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,share:double>>")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
