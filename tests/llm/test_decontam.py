from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from portolan.llm import decontam as D
from portolan.llm.textio import bitmap, in_bitmap, word_hashes


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def case(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([40, 30, 20, 16, 13, 8, 3])] + [(90, None), (91, "?!")]
    rows, want = [], set()
    for i in range(120):
        w = words(rng, 60)
        k, text = items[i % 7]
        p = text.split()
        if i % 3 == 0:  # whole, in other case and punctuation
            w[20:20] = [x.upper() + "," for x in p]
            want.add((i, k))
        elif i % 3 == 1 and len(p) >= 16:  # with every eighth word another
            w[5:5] = [x if j % 8 != 3 else "other" for j, x in enumerate(p)]
            want.add((i, k))
        elif i % 3 == 2 and len(p) > 20:  # a few words of it only
            w[5:5] = p[:7]
        rows.append((i, " ".join(w)))
    return items, rows, want


def test_planted_passages_are_found_and_nothing_else(spark, docs):
    items, rows, want = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    sizes = {k: len(t.split()) for k, t in items if t}
    assert all(r.overlap == sizes[r.item_id] and r.item_at == 0 for r in got if r.doc_id % 3 == 0)
    frame = docs(rows)
    clean = D.clean_documents(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_stretch_is_the_best_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        train, test = rng.integers(0, 3, 12).astype(np.uint64), rng.integers(0, 3, 6).astype(np.uint64)
        shift = int(rng.integers(-5, 12))
        n, same, a, b = D._stretch(train, test, shift)
        pairs = [(x, x - shift) for x in range(len(train)) if 0 <= x - shift < len(test)]
        score = lambda p: sum(1 if train[x] == test[y] else -2 for x, y in p)
        assert n - 3 * (n - same) == max([score(pairs[i:j]) for i in range(len(pairs)) for j in range(i, len(pairs) + 1)], default=0)
        assert not n or (a - b == shift)


def test_odd_rows_and_empty_tables(spark, docs, odd):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(odd, bench).collect()} == {(5, 1)}
    left = D.clean_documents(odd, bench).collect()
    assert len(left) == odd.count() - 3 and all((r.text or "") != "a b c d e f" for r in left)
    assert D.leaks(odd, bench.limit(0)).collect() == [] and D.leaks(docs([]), bench).collect() == []


def test_bitmap_has_no_false_negatives_and_few_false_positives(spark):
    keys = word_hashes(" ".join(f"k{i}" for i in range(2000)))
    table = bitmap(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long"), "k", 20)
    other = word_hashes(" ".join(f"o{i}" for i in range(20000)))
    assert in_bitmap(table, keys, 20).all() and in_bitmap(table, other, 20).mean() < 0.001 and len(table) == 1 << 14


def test_word_hashes_of_long_texts_are_those_of_their_words(monkeypatch):
    from portolan.llm import textio

    text = "Ünï " + " ".join(f"w{i}" for i in range(400)) + " " + "z" * 5000 + " end"
    want = word_hashes(text)
    monkeypatch.setattr(textio, "_SEGMENT", 1000)
    got = word_hashes(text)
    assert (got[:401] == want[:401]).all() and got[-1] == want[-1]


def test_every_stretch_that_meets_the_rule_is_found_by_brute_force():
    rng = np.random.default_rng(3)
    passed = lost = 0
    for _ in range(3000):
        size, least = int(rng.integers(13, 40)), 13
        test = np.arange(size, dtype=np.uint64)
        train = np.concatenate([np.full(5, 99, np.uint64), np.where(rng.random(size) < rng.uniform(0.1, 0.4), 98, test).astype(np.uint64), np.full(5, 99, np.uint64)])
        same = train[5 : 5 + size] == test
        whole = {(i, j): int(same[i:j].sum()) for i in range(size) for j in range(i + least, size + 1)}
        good = {k: m for k, m in whole.items() if 5 * m >= 4 * (k[1] - k[0])}
        got = D._overlap(train, test, 5, least, 0.8)
        assert (got is not None) == bool(good)
        if got:
            n, m, a, b = got
            assert a - b == 5 and good[b, b + n] == m
            first = D._stretch(train, test, 5)
            if first[0] < least or 5 * first[1] < 4 * first[0]:
                assert n == max(j - i for i, j in good)
                lost += 1
            passed += 1
    assert passed > 500 and lost > 50


def test_a_short_overlap_beside_a_longer_poor_one_is_a_leak(spark, docs):
    rng = random.Random(5)
    item = words(rng, 30)
    edge = item[:13]
    edge[2] = edge[10] = "other"  # trimmed to seven tokens by the score
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = D.leaks(docs([(1, " ".join(words(rng, 20) + edge + words(rng, 20)))]), bench).collect()
    assert [(r.doc_id, r.overlap, r.matches, r.item_at) for r in got] == [(1, 13, 11, 0)]


def test_every_pattern_of_substitutions_that_meets_the_rule_has_a_hit():
    for size, n in ((13, 2), (14, 2), *((s, 3) for s in range(15, 20)), *((s, 4) for s in range(20, 25)), (25, 5)):
        missed = np.array([sum(1 << p for p in c) for c in combinations(range(size), n)])
        for mask in D.MASKS:
            bits = int(mask[::-1], 2)
            for at in range(size - len(mask) + 1):
                missed = missed[missed & (bits << at) != 0]
        assert not len(missed), (size, n)
    for size in range(1, 13):
        masks = [int(m, 2) for m in D._whole_masks(size, 0.8)]
        assert masks and all(any(not m & sum(1 << p for p in c) for m in masks) for c in combinations(range(size), size // 5))


def test_short_items_with_a_word_changed_are_found(spark, docs):
    rng = random.Random(6)
    items = [(n, " ".join(words(rng, n))) for n in (4, 5, 7, 10, 11, 12)]
    rows, want = [], set()
    for n, text in items:
        for size in (1, 2, 3):
            for c in list(combinations(range(n), size))[:: 1 if size == 1 else 7]:
                w = text.split()
                for p in c:
                    w[p] = "other"
                rows.append((len(rows), " ".join(words(rng, 9) + w + words(rng, 9))))
                if 5 * size <= n:
                    want.add((rows[-1][0], n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs(rows), bench).collect()} == want


def test_leaks_are_all_pairs_that_meet_the_rule_by_brute_force(spark, docs):
    rng = random.Random(7)
    vocabulary = words(rng, 400)
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 12, 14, 20, 45]))]) for k in range(25)]
    rows = []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):  # parts of items, some of their words changed: equal at first, then more and more substitutions
            _, item = rng.choice(items)
            a = rng.randrange(len(item))
            w[len(w) // 2 : len(w) // 2] = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.3]) else x for x in item[a : a + rng.randint(5, 45)]]
        rows.append((i // 2 if i < 20 else i, " ".join(w)))  # some ids repeat with other texts

    def leaked(train, test):
        least = min(13, len(test))
        for shift in range(-len(test), len(train)):
            same = [train[x] == test[x - shift] for x in range(max(0, shift), min(len(train), shift + len(test)))]
            if any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(len(same)) for y in range(x + least, len(same) + 1)):
                return True
        return False

    want = {(i, k) for i, t in rows for k, item in items if leaked(t.split(), item)}
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    got = D.leaks(docs(rows), bench).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
