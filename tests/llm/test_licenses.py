from __future__ import annotations

import random
import re

from portolan.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_phrases_as_by_brute_force(docs, odd):
    rng = random.Random(5)
    vocabulary = "the mit license apache version 2 cc by nc under The MIT LICENSE é x 0 licensed".split()
    rows = [(i, rng.choice([" ", "-", ".\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    for frame in (docs(rows), odd):
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(frame).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=str)


def test_base_phrase_begins_with_under(docs):
    rows = [(1, "x under the MIT license and under the mit License"), (2, "as the MIT license says"), (3, "Apache License, version 2.0"), (4, "(CC-BY-NC 4.0)")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in L.license_scan(docs(rows)).collect()}
    assert got == {1: (10, 2, 1, 6, "mit", "mit"), 2: (5, 0, None, None, "", "mit"), 3: (5, 1, 0, 0, "apache-2", "apache-2"), 4: (5, 1, 0, 0, "cc-by-nc", "cc-by-nc")}


def test_matching_statistics_as_by_brute_force():
    texts = ["a b a b c", "b c a", "c c c a b"]
    a = L.LicenseAutomaton(tuple(("x", t) for t in texts), {"a b": "y"})
    known = {tuple(t.split()[i:j]) for t in texts for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1)} | {("a", "b"), ("a",), ("b",)}
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice("abcd") for _ in range(30)]
        got = [n for _, n in a.statistics([a.token.get(x.encode(), 0) for x in w])]
        assert got == [max((n for n in range(i + 2) if tuple(w[i + 1 - n : i + 1]) in known), default=0) for i in range(len(w))]


def test_templates_are_found_with_small_changes():
    label, text = L.TEMPLATES[1]
    words = text.split()
    words[30] = "other"
    n, _, spans = L.automaton().scan("intro words here " + " ".join(words).upper() + " and more")
    assert [s[0] for s in spans if s[3] > 0.9] == [label]
    span = next(s for s in spans if s[3] > 0.9)
    assert span[1] == 3 and span[2] == 3 + len(words) - 1
    assert not L.automaton().scan("the software is provided and the rest of this is not a license at all")[2]


def test_labels_of_the_method_come_on_top(docs):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "Released under the MIT License. All rights reserved."), (3, None)]
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in L.license_scan(docs(rows)).collect()}
    assert got == {1: ("", "gpl-3", 1.0), 2: ("mit", "all-rights-reserved,mit", 1.0), 3: ("", "", 0.0)}
    assert {r.label for r in L.license_spans(docs(rows)).collect()} == {"gpl-3", "mit", "all-rights-reserved"}
    assert L.license_scan(docs([])).collect() == []


def test_many_repeats_of_a_line_take_linear_time():
    import time

    began = time.time()
    n, found, spans = L.automaton().scan("released under the mit license and more of other words that no template has here at all\n" * 20_000)
    assert len(found) == 20_000 and len(spans) >= 20_000 and time.time() - began < 10


def test_chains_as_by_brute_force(monkeypatch):
    """Chains that are closed by the gap are those of a scan that keeps all open."""
    rng = random.Random(4)
    a = L.LicenseAutomaton((("x", "a b c d e f g h i j"), ("y", "d e f k l m")), {"k l": "z"})
    monkeypatch.setattr(L, "MIN_COVER", 0.5)

    def kept_open(t, matches):
        chains = []
        for m in sorted(set(matches)):
            fits = [c for c in chains if 0 <= m[0] - (c[-1][0] + c[-1][2]) <= L.MAX_GAP and m[1] >= c[-1][1] + c[-1][2]]
            if fits:
                max(fits, key=lambda c: sum(x[2] for x in c)).append(m)
            else:
                chains.append([m])
        return sorted(s for c in chains if (s := a._span(t, c)))

    for _ in range(200):
        matches = [(rng.randint(0, 80), rng.randint(0, 7), rng.randint(1, 3)) for _ in range(rng.randint(0, 40))]
        assert sorted(a._chains(0, matches)) == kept_open(0, matches)
