from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from portolan.llm import jaccard_join as J


def shingles(text, n=5):
    w = [x for x in re.split("[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """class and number of links by row number; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    low, links = {i: i for i in ids}, Counter()

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and (c := len(sets[a] & sets[b])) >= threshold * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                low[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in ids}


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40))
    bases = [[word() for _ in range(rng.choice([3, 6, 40, 80, 200]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w).title() if rng.random() < 0.3 else ", ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_classes_and_links_as_by_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.ngram_jaccard_join(docs(rows), recall=0.99999).collect()}
    assert got == brute(rows)


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in J.ngram_jaccard_join(odd).collect()), key=str)
    by = {}
    for i, c, n, s in got:
        by.setdefault(i, []).append((c, n, s))
    assert by[1] == by[2][:1] == [(1, 0, 0)] or by[1] == [(1, 0, 0)]
    assert by[3][0][:2] == by[4][0][:2] == (3, 1)
    assert by[5] == [(5, 2, 2), (5, 2, 2)] and (5, 2, 2) in by[None] and by[6] == [(6, 0, 0)] and by[8] == [(8, 0, 0)]
    assert len(got) == odd.count()


def test_one_of_each_group_keeps_columns_and_order_of_magnitude(docs):
    rows = corpus(60, seed=2)
    frame = docs(rows)
    out = J.one_of_each_group(frame, recall=0.99999)
    want = {c for c, _ in brute(rows).values()}
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == want


def test_empty_table(docs):
    assert J.ngram_jaccard_join(docs([])).collect() == []


def test_prefixes_are_shortened_where_it_is_cheap_until_the_recall_is_reached():
    rng = np.random.default_rng(1)
    shortest = J.least_depth(0.8, 0.999, 10)
    sizes = np.sort(rng.integers(1, 500, (50, 10, 5)), axis=2)[:, :, ::-1]
    level = J.stop_levels(sizes, shortest, 0.8, 0.999)
    missed = np.prod(1 - 0.8 ** (shortest + level), axis=1)
    assert (missed <= 0.001 + 1e-12).all() and level.max() > 0
    thin = np.ones((1, 10, 5))
    thin[0, 3] = [1000, 900, 500, 5, 1]
    assert J.stop_levels(thin, shortest, 0.8, 0.999)[0, 3] > J.stop_levels(thin, shortest, 0.8, 0.999)[0, 0]  # deep where it is crowded
    assert J.least_depth(0.5, 0.9999999, 2) == 1 and J.stop_levels(thin, 1, 0.5, 0.9999999).max() == 0  # out of reach: all the way up


def test_repeated_and_null_ids_keep_their_links(docs):
    w = [f"w{k}" for k in range(60)]
    v = [f"v{k}" for k in range(60)]
    u = [f"u{k}" for k in range(60)]
    rows = [(5, " ".join(w)), (5, " ".join(v)), (7, " ".join(v[:-1])), (None, " ".join(u)), (9, " ".join(u[1:])), (None, "x y z q r s"), (None, "x y z q r s"), (8, "solo")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.ngram_jaccard_join(docs(rows)).collect()), key=str)
    assert got == sorted([(5, 5, 0), (5, 5, 1), (7, 5, 1), (None, 9, 1), (9, 9, 1), (None, None, 1), (None, None, 1), (8, 8, 0)], key=str)
    stay = [(r.doc_id, r.text) for r in J.one_of_each_group(docs(rows)).collect()]
    assert sorted(stay, key=str) == sorted([(5, rows[0][1]), (5, rows[1][1]), (9, rows[4][1]), (None, "x y z q r s"), (None, "x y z q r s"), (8, "solo")], key=str)


@pytest.mark.parametrize("block", [512, 40])
def test_a_huge_group_of_near_copies(docs, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.ngram_jaccard_join(docs(rows)).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] <= want[i][1] for i in want) and sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values())


def test_recall_at_the_defaults(docs):
    """Pairs just above the threshold, a hundred each time."""
    rows, want = [], 0
    for k in range(100):
        w = [f"g{k}w{i}" for i in range(94)]
        other = list(w)
        for at in (20, 60):  # each changes five of ninety shingles: (90 - 10) / (90 + 10)
            other[at] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        want += 2 * (len(shingles(rows[-1][1]) & shingles(rows[-2][1])) >= 0.8 * len(shingles(rows[-1][1]) | shingles(rows[-2][1])))
    assert want == 200
    found = sum(r.n_links for r in J.ngram_jaccard_join(docs(rows)).collect())
    assert 0.98 * want <= found <= want


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101)], "u long, v long")
    got = {r.u: r.low for r in J.components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100}
