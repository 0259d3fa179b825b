"""Licence scans with a generalised suffix automaton of licence tokens.

All templates and phrases are read into one automaton. A file is streamed through it token by token, which gives matching
statistics: at each token the longest suffix of the file read so far that occurs in some template. Where such a match
ends (the next token doesn't continue it) and is long enough, its places in templates are looked up; matches that
follow one another in file and template alike are chained into a span, and a template is reported when its tokens are covered well enough.
Phrases are reported wherever they stand, by the automaton's states.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from portolan.llm.textio import arrow_map, texts_of

#: Phrases and their labels: fixed values of the scan's contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short licences and notices as their publishers word them, openings of longer ones, and lines by which works refer to them; fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "the mit license"),
)
MIN_MATCH, MIN_COVER, MIN_TOKENS, MAX_GAP = 3, 0.8, 25, 8

_SPACED = bytes(c if c >= 0x80 or chr(c).isascii() and chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


class LicenseAutomaton:
    """A generalised suffix automaton over token ids, with the places of each state in the templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.token: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.sizes: list[int] = []
        self.first_phrase = len(templates)
        ends: list[list[tuple[int, int]]] = []
        for k, text in enumerate([t for _, t in templates] + list(phrases)):
            state, words = 0, words_of(text)
            self.sizes.append(len(words))
            for at, word in enumerate(words):
                state = self._extend(state, self.token.setdefault(word, len(self.token) + 1))
                ends += [[] for _ in range(len(self.next) - len(ends))]
                ends[state].append((k, at))
        ends += [[] for _ in range(len(self.next) - len(ends))]
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            ends[self.link[v]] += ends[v]
        self.places = [sorted(set(x)) if v else [] for v, x in enumerate(ends)]
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in self.next]
        whole = {}
        for k, text in enumerate(phrases):
            state = 0
            for word in words_of(text):
                state = self.next[state][self.token[word]]
            whole.setdefault(state, []).append(self.first_phrase + k)
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            self.phrases_at[v] = self.phrases_at[self.link[v]] + [(k, self.sizes[k]) for k in whole.get(v, ())]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of the template read so far, after token ``c``; new states as in the online construction."""
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token (state, length) of the longest suffix that occurs in a template."""
        state = size = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            after = self.next[state].get(c)
            state, size = (after, size + 1) if after is not None else (0, 0)
            yield state, size

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Number of words; phrases as (phrase, start); spans as (label, first word, last word, share of the template covered)."""
        words = words_of(text)
        ids = np.fromiter(map(self.token.get, words, [0] * len(words)), np.int32, len(words))
        known = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
        found: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        shortest = min(MIN_MATCH, *(self.sizes[self.first_phrase :] or [MIN_MATCH]))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < shortest:
                continue
            stats = list(self.statistics(ids[a:b].tolist()))
            for k, (state, size) in enumerate(stats):
                found += [(p, a + k + 1 - n) for p, n in self.phrases_at[state] if n <= size]
                if size >= MIN_MATCH and (k + 1 == len(stats) or stats[k + 1][1] <= size):
                    for t, end in self.places[state]:
                        if t < self.first_phrase:
                            matches[t].append((a + k + 1 - size, end + 1 - size, size))
        return len(words), found, [s for t, ms in sorted(matches.items()) for s in self._chains(t, ms)]

    def _chains(self, t: int, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Chains of matches (file place, template place, tokens) that ascend in both, with small gaps in the file."""
        open_: list[list[tuple[int, int, int]]] = []
        for m in sorted(set(matches)):
            over = [c for c in open_ if m[0] - (c[-1][0] + c[-1][2]) > MAX_GAP]  # no later match can follow these
            if over:
                yield from (s for c in over if (s := self._span(t, c)))
                open_ = [c for c in open_ if m[0] - (c[-1][0] + c[-1][2]) <= MAX_GAP]
            fits = [c for c in open_ if 0 <= m[0] - (c[-1][0] + c[-1][2]) <= MAX_GAP and m[1] >= c[-1][1] + c[-1][2]]
            if fits:
                max(fits, key=lambda c: sum(x[2] for x in c)).append(m)
            else:
                open_.append([m])
        yield from (s for c in open_ if (s := self._span(t, c)))

    def _span(self, t: int, chain: list[tuple[int, int, int]]) -> tuple[str, int, int, float] | None:
        covered = sum(m[2] for m in chain)
        if covered < min(MIN_COVER * self.sizes[t], MIN_TOKENS):
            return None
        return self.labels[t], chain[0][0], chain[-1][0] + chain[-1][2] - 1, min(1.0, covered / self.sizes[t])


_automata: dict[tuple, LicenseAutomaton] = {}


def automaton(templates=TEMPLATES, phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())) -> LicenseAutomaton:
    """The automaton, once a process."""
    key = (templates, phrases)
    if key not in _automata:
        _automata[key] = LicenseAutomaton(templates, dict(phrases))
    return _automata[key]


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per span: ``doc_id, label, first_word, last_word, cover``, of every whole text (null: empty, no spans)."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("doc_id", "label", "first_word", "last_word", "cover")}
        for i, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
            for span in automaton().scan(text)[2]:
                for c, v in zip(out, (i, *span)):
                    out[c].append(v)
        return out

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), f"doc_id {docs.schema[id_col].dataType.simpleString()}, label string, first_word long, last_word long, cover double", run)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base``: places of the phrases; ``first_word``, ``last_word``: their smallest and largest start, else null;
    ``labels``: of phrases and covered templates, distinct, sorted, joined by commas (else empty); ``score``: the best
    share of a template or phrase that is covered. Null texts count as empty; repeated rows and null ids are kept; an
    empty table gives an empty result; other columns aren't looked at.
    """

    def run(batch: pa.RecordBatch) -> dict:
        a = automaton()
        out: dict = {"doc_id": batch.column(0)} | {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in texts_of(batch):
            n, found, spans = a.scan(text)
            base, starts = {a.labels[p] for p, _ in found}, [s for _, s in found]
            row = (n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), max([s[3] for s in spans] + [1.0] * bool(found), default=0.0))
            for c, v in zip(list(out)[1:], row):
                out[c].append(v)
        return out

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", run)
