from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from portolan.llm.trie import prefix_trie


def brute(rows):
    """The contract restated over lists and prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        own[conv].append((turn is not None, turn, sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = (turns.get(base, [])[:h] if c is not None else []) + turns[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                children[tuple(seq[: d - 1])].add(tuple(seq[:d]))
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = mine + sum(saved[k] for k in children[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(i for i in ids if i is not None and len(rebuilt[i]) == len(node))))
        out.append((smallest(ids), len(node), smallest(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "conv_id long, turn long, role string, text string, place long, digest string, depth int")


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def conversations(seed, convs, longest, texts):
    random.seed(seed)
    return [(c, t, random.choice(["user", "assistant", None]) if t % 3 == 0 else "user", random.choice(texts)) for c in convs for t in range(random.randint(1, longest))]


def test_as_by_brute_force(spark):
    rows = conversations(1, [*range(90), 1007, 1008, -3, -10, -12], 9, ["hello", "é", "", None])
    got = prefix_trie(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == brute(rows)


def test_copies_nulls_ties_and_repeated_rows(spark):
    rows = conversations(2, range(40), 6, ["a", "b"]) + [(c, t, "user", f"copy {t}") for c in (100, 205, 310, 999) for t in range(23)]
    rows += [(None, 1, "user", "x"), (None, None, "user", "y"), (7, None, None, None), (7, 2, "system", "tie"), (7, 2, "user", "tie"), (8, 1, "user", "long " * 200_000)]
    rows += rows[:5]
    assert found(prefix_trie(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("block", [9, 16])
def test_conversations_of_several_blocks(spark, block):
    long = [(t, random.Random(t).choice(["user", "assistant"]), f"t{t % 50}") for t in range(120)]
    rows = [(c, *x) for c in (0, 3, 50, 53, 77) for x in long[: 120 - c]] + [(4, *x) for x in long[:20]] + [(10, *x) for x in long[:9]] + conversations(4, range(200, 215), 5, ["t0", "t1"])
    assert found(prefix_trie(table(spark, rows).repartition(5), block=block)) == brute(rows)


def test_one_conversation_and_an_empty_table(spark):
    rows = [(4, 0, "user", "alone")]
    assert found(prefix_trie(table(spark, rows))) == brute(rows)
    assert prefix_trie(table(spark, [])).collect() == []

