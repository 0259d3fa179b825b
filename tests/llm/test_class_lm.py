from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from portolan.llm import class_lm as C
from portolan.llm.textio import Tally, token_hashes


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return i is None or crc32(str(i).encode()) % 10 == 0


def brute(rows):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t in rows for w in [words(t)]), key=str)


def shown(frame):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect()), key=str)


def test_base_scores_as_by_brute_force(docs, odd, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "a\tb", "É", "x\x0by", "z ", f"n{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    assert shown(C.score(docs(rows))) == brute(rows)
    assert shown(C.score(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    monkeypatch.setattr(C, "BLOCK_CHARS", 500)
    monkeypatch.setattr(C, "SLICE", 100)
    assert shown(C.score(docs(rows))) == brute(rows)


def test_token_hashes_tell_the_words_apart_whatever_their_length():
    rng = random.Random(1)
    texts = ["", None, "The the  THE\x0bx", "é a b", " a", "a ", "x" * 700_000 + " y " + "x" * 700_000] + [" ".join(rng.choice(["A", "b", "cc", "É"]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    hashes, sizes = token_hashes(pa.array(texts))
    want = [words(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    of: dict = {}
    assert all(of.setdefault(w, h) == h for w, h in zip((x for w in want for x in w), hashes.tolist())) and len(set(of.values())) == len(of)
    assert [len(x) for x in token_hashes(pa.array([], pa.string()))] == [0, 0]
    assert token_hashes(pa.array(["a b", "c"]).slice(1))[1].tolist() == [2]
    tally = Tally()
    for _ in range(4):
        tally.add(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3]))
    tally.merge()
    assert tally.keys.tolist() == [3, 5] and tally.sums.tolist() == [8, 16]


def brute_score(rows, classes, of, end):
    """Class transitions and emissions by dictionaries; ``of``: the class of each training word."""
    seen, steps = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            seen.update(w)
            steps.update((of[x], of[y]) for x, y in zip([None, *w], w))
    k = classes
    tokens, kinds = Counter(), Counter()
    for w, n in seen.items():
        tokens[of[w]] += n
        kinds[of[w]] += 1
    n, into = sum(steps.values()), Counter()
    for (_, c), x in steps.items():
        into[c] += x

    def step(a, b):
        out, different = sum(steps[a, c] for c in range(k)), sum(steps[a, c] > 0 for c in range(k)) + 1
        return (steps[a, b] + different * (into[b] + 1) / (n + k)) / (out + different)

    def score(text, unseen):
        total, before = 0.0, of[None]
        for w in words(text):
            c = of.get(w, unseen)
            total += math.log10(step(before, c) * (seen[w] + C.PRIOR) / (tokens[c] + C.PRIOR * (kinds[c] + (c == unseen))))
            before = c
        return total

    return score


def clustered(rows):
    """Words that stand before or behind others by kind, some of them rare."""
    rng = random.Random(8)
    kinds = [[f"noun{k}" for k in range(12)], [f"verb{k}" for k in range(12)]]
    out = [(i, " ".join(x for _ in range(12) for x in (rng.choice(kinds[0]), rng.choice(kinds[1])))) for i in range(rows)]
    free = [i for i in range(rows, 3 * rows) if not held(i)]
    out += [(free[k], f"verb1 rarenoun{k} verb2 noun1 rareverb{k} noun2 verb3") for k in range(20)]
    return out


def test_scores_as_by_brute_force_and_rare_words_get_the_class_of_their_contexts(docs, monkeypatch):
    rows, found = clustered(200), {}
    real = C._emissions
    monkeypatch.setattr(C, "_emissions", lambda words, *a: real(found.update(words=words) or words, *a))  # the classes that are used
    got = C.score(docs(rows), classes=4, frequent=24).collect()
    of_hash = {r.w: r.c for r in found["words"].collect()}
    vocabulary = sorted({w for i, t in rows if not held(i) for w in words(t)}, key=str)
    of = {w: of_hash[int(token_hashes(pa.array([w or ""]))[0].view(np.int64)[0 if w else -1])] for w in vocabulary}
    noun, verb = ({of[w] for w in vocabulary if w and w.startswith(kind)} for kind in ("noun", "verb"))
    assert not noun & verb and of[None] not in noun | verb
    assert all(of[f"rarenoun{k}"] in noun and of[f"rareverb{k}"] in verb for k in range(20))
    rare = Counter(c for w, c in of.items() if w and w.startswith("rare"))
    score = brute_score(rows, max(of.values()) + 1, of, of[None])
    text = dict(rows)
    scores = {r.doc_id: r.score for r in got}
    assert any(scores == pytest.approx({i: score(text[i], unseen) for i in scores}) for unseen in {c for c, n in rare.items() if n == max(rare.values())})
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_transitions_are_distributions_and_classes_grow_with_the_vocabulary():
    n = np.array([[0, 5, 0], [0, 0, 9], [0, 0, 0]], float)
    assert (10 ** C.transitions(n)).sum(axis=1) == pytest.approx(1)
    sizes = [C.classes_for(10**k) for k in range(3, 9)]
    assert sizes == sorted(set(sizes)) and C.frequent_for(sizes[3]) > 10 * sizes[3] and C.classes_for(0) == 2


def test_exchange_finds_the_classes_and_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 30)
    p = np.array([[0, 9, 1], [1, 0, 9], [9, 1, 0]], float)
    bigrams = rng.poisson(p[truth[:, None], truth[None, :]] * 4).astype(float)
    first, second = np.nonzero(bigrams)

    def likelihood(of):
        member = np.eye(int(of.max()) + 1)[of]
        n = member.T @ bigrams @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    run = lambda sweeps: likelihood(C.exchange(first, second, bigrams[first, second], 30, 3, sweeps))
    assert run(6) >= max(run(0), likelihood(truth)) - 1e-6
    values = [run(k) for k in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:]))


def test_gains_of_an_exchange_are_log_probabilities_by_the_counts_of_the_others():
    rng = np.random.default_rng(5)
    k, of = 4, rng.integers(0, 4, 40)
    full = rng.poisson(0.9, (40, 40)).astype(float)
    member = np.eye(k)[of]
    for w in range(40):
        n = full.copy()
        own = of == of[w]  # no neighbours of the word's own class: then no cell is met from both sides
        n[w, own] = n[own, w] = 0
        table = member.T @ n @ member
        left, right = (np.bincount(of, x, k) for x in (n[:, w], n[w]))
        code = np.concatenate([np.flatnonzero(left), k + np.flatnonzero(right)])
        x = np.concatenate([left[left > 0], right[right > 0]])
        got = C.exchange_gains(table, code, x, np.array([0, len(code)]), of[w : w + 1])[0]
        kinds = [sum(table[a, b] > 0 for b in range(k)) + 1 for a in range(k)]
        alone = [(table[:, b].sum() + 1) / (table.sum() + k) for b in range(k)]
        without = table.copy()
        without[:, of[w]] -= left
        without[of[w]] -= right
        want = []
        for c in range(k):
            total = sum(left[a] * math.log(without[a, c] + kinds[a] * alone[c]) for a in range(k) if left[a])
            total += sum(right[b] * math.log((without[c, b] + kinds[c] * alone[b]) / (table[c].sum() - (right.sum() if c == of[w] else 0) + kinds[c])) for b in range(k) if right[b])
            tokens = table[:, c].sum() + (0 if c == of[w] else left.sum())
            want.append(total - left.sum() * math.log(tokens) if left.sum() else total)
        assert got == pytest.approx(want)


def test_rounds_of_exchange_over_all_words_never_lower_the_likelihood(docs, monkeypatch):
    rng, seen = random.Random(12), []
    rows = [(i, " ".join(f"{'abc'[j % 3]}{int(rng.paretovariate(0.6)) % 300}" for j in range(40))) for i in range(300)]
    real = C.transitions
    monkeypatch.setattr(C, "transitions", lambda n: seen.append(C.left_out_likelihood(n)) or real(n))
    for rounds in range(4):
        assert C.score(docs(rows), classes=6, frequent=12, rounds=rounds).count() == 300
    assert seen[1] > seen[0] and all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))


def test_nothing_to_learn_from(docs):
    assert C.score(docs([])).collect() == []
    i = next(k for k in range(100) if held(k))
    r = C.score(docs([(i, "a b")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


def test_input_whose_order_changes_between_reads(spark, docs):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 40))) for i in range(300)]
    plain = {r.doc_id: (r.n_known, r.base_score, round(r.score, 6)) for r in C.score(docs(rows)).collect()}
    dealt = docs(rows).repartition(7).withColumn("at", F.rand()).sortWithinPartitions("at").drop("at")  # another order on each read
    assert {r.doc_id: (r.n_known, r.base_score, round(r.score, 6)) for r in C.score(dealt).collect()} == plain


def test_the_query_exchanges_all_training_words(spark, sf, monkeypatch):
    from portolan.llm import queries

    real, swept = C._swept, []
    monkeypatch.setattr(C, "_swept", lambda *a: swept.append(a[-1]) or real(*a))
    assert queries.op7_class_lm(spark, sf).count() > 0 and swept == [1]


def test_counts_of_words_move_as_a_pack_for_each_shard_and_are_added(docs, monkeypatch):
    rng, k, shards = np.random.default_rng(2), 7, 3
    words = np.unique(rng.integers(0, 2**64, 50, np.uint64))
    of, want, packs = rng.integers(0, k, len(words)), Counter(), []
    for _ in range(4):  # blocks
        keys = np.unique(rng.integers(0, len(words) * 2 * k, 200))
        place, code = np.divmod(keys, 2 * k)
        n = rng.integers(1, 100_000, len(keys))
        want.update({(int(words[p].view(np.int64)), int(c)): int(x) for p, c, x in zip(place, code, n)})
        packs += C._shard_packs(words, of, place, code, n, shards)
    assert len(packs) <= 4 * shards
    got, classes = {}, dict(zip(words.view(np.int64).tolist(), of.tolist()))
    for s in range(shards):
        w, c, edges, code, n = C._of_shard(pa.table({"words": [x for t, x, _ in packs if t == s], "counts": [x for t, _, x in packs if t == s]}), k)
        assert all(classes[x] == y for x, y in zip(w.tolist(), c.tolist()))
        got |= {(int(w[j]), int(code[i])): int(n[i]) for j in range(len(w)) for i in range(edges[j], edges[j + 1])}
    assert got == dict(want)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(30))) for i in range(200)]
    real, stored = C.written, []
    monkeypatch.setattr(C, "written", lambda f: stored.append(real(f)) or stored[-1])
    C.score(docs(rows), classes=3, frequent=5).count()
    assert not any({"w", "code"} <= set(f.columns) for f in stored)  # no row per word and class beside it
