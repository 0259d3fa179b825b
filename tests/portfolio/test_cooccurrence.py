from __future__ import annotations

import random
from collections import Counter

import pytest

from portolan.operators.cooccurrence import pair_counts, pairs


def plain(left, right):
    return sorted((k, a, b) for k, a in set(left) for q, b in set(right) if k == q and None not in (k, a, b))


def table(spark, rows, member="string"):
    return spark.createDataFrame([(k, m, 1, "x") for k, m in rows], f"key string, member {member}, n long, bits string")


def sides(seed):
    random.seed(seed)
    member = lambda: f"m{random.randint(0, 800)}"
    rows = [("hot", f"m{k}") for k in range(0, 800, 2)] + [("warm", f"m{k}") for k in range(0, 800, 31)] + [(f"k{random.randint(0, 150)}", member()) for _ in range(600)]
    return rows + rows[:50] + [(None, "m1"), ("k1", None), ("hot", "m1")], [("hot", f"m{k}") for k in range(0, 700, 9)] + [(f"k{random.randint(0, 150)}", member()) for _ in range(400)] + [("warm", "m3"), ("alone", "m3")]


@pytest.mark.parametrize("heavy", [1, 10_000, 10**9])
def test_heavy_and_light_keys_give_the_same_pairs(spark, heavy):
    left, right = sides(3)
    want = plain(left, right)
    assert sorted(map(tuple, pairs(table(spark, left), table(spark, right), heavy).collect())) == want
    counts = Counter((a, b) for _, a, b in want)
    assert {(r.a, r.b): r.n for r in pair_counts(table(spark, left), table(spark, right), heavy).collect()} == counts


def test_one_side_with_itself_and_numbers_as_members(spark):
    left = [(k, int(m[1:])) for k, m in sides(5)[0] if m]
    rows = table(spark, left, "long")
    counts = Counter((a, b) for _, a, b in plain(left, left))
    assert {(r.a, r.b): r.n for r in pair_counts(rows, rows, 500).collect()} == counts


def test_no_rows(spark):
    none = table(spark, [])
    assert pairs(none, none).collect() == [] and pair_counts(none, table(spark, [("k", "m")])).collect() == []


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_partners_as_by_pairs(spark, heavy):
    from portolan.operators.cooccurrence import partners

    left, _ = sides(7)
    left += [("alone", "single")]
    counts = Counter((a, b) for _, a, b in plain(left, left) if a != b)
    partners_of, shared_of = Counter(a for a, _ in counts), Counter()
    for (a, _), n in counts.items():
        shared_of[a] += n
    want = {m: (n, shared_of[m]) for m, n in partners_of.items()}
    got = {r.member: (r.n_partners, r.n_shared) for r in partners(table(spark, left), heavy).collect()}
    assert got == want and "single" not in got and partners(table(spark, [])).collect() == []


def test_partners_of_a_hot_key_without_its_pairs(spark):
    """Two hundred thousand members of one key: forty billion pairs."""
    from portolan.operators.cooccurrence import partners

    rows = spark.range(200_000).selectExpr("'hot' AS key", "id AS member")
    assert partners(rows).selectExpr("count(*)", "min(n_partners)", "max(n_shared)").first() == (200_000, 199_999, 199_999)
