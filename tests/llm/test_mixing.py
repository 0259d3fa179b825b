from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from portolan.llm.mixing import mixed, shares, targets
from portolan.llm.ordered import running_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing: who is above stops, the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped = {}
    while True:
        rest = Fraction(sum(sizes.values()) - sum(stopped.values()))
        open_ = [s for s in names if s not in stopped]
        aims = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if aims[s] > most * sizes[s]]
        if not above:
            return {**stopped, **aims}
        stopped |= {s: most * sizes[s] for s in above}


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 3, 0.5) for i, t, s in rows], "doc_id long, text string, source string, size long, key string, passes int, target double")


def rows_of(seed, sources):
    random.seed(seed)
    return [(i, " \t".join(["w"] * random.randint(0, 30)) or None, random.choice(sources)) for i in range(400)]


@pytest.mark.parametrize("sources", [["a", "b", "c", "d", "Z", "é", None], ["a"] * 50 + ["b", "c", None], ["one"]])
def test_targets_and_words_as_by_brute_force(spark, sources):
    rows = rows_of(5, sources)
    got = shares(table(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = reshared(sizes)
    assert sorted((r.doc_id, r.size) for r in got) == [(i, len(WORD.findall(t or ""))) for i, t, _ in rows]
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source])) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - float(want[s])) <= 0.5 for s in sizes)
    cut = Counter(r.source for r in got if r.taken % r.size) if all(r.size for r in got) else Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n == 1 for n in cut.values())
    assert sorted(map(str, shares(table(spark, rows).repartition(7)).collect())) == sorted(map(str, got))


def test_equal_rows_null_ids_and_an_empty_table(spark):
    rows = [(1, "a b c", "s")] * 40 + [(None, "a b", "s")] * 40 + [(None, None, None), (2, "", "t"), (3, " \n", "t")] + [(9, "long " * 50_000, "u")]
    got = shares(table(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), abs=3)
    assert {(r.target, r.taken) for r in got if r.source in ("t", None)} == {(0.0, 0)}
    assert shares(table(spark, [])).collect() == []


def test_more_words_than_there_are(spark):
    got = shares(table(spark, rows_of(3, ["a", "b"])), total=10**9).collect()
    assert all(r.taken == 3 * r.size for r in got)


def test_texts_of_the_mix(spark):
    rows = rows_of(8, ["a", "b", "c"]) + [(1000, "é " * 70, "c")]
    taken = {r.doc_id: r.taken for r in shares(table(spark, rows)).collect()}
    words = Counter()
    for r in mixed(table(spark, rows)).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_many_sources_fill_up_in_order(spark):
    sizes = {f"s{k:04}": (k * 37) % 101 for k in range(700)}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3).collect()
    want = reshared(sizes)
    assert all(r.target == pytest.approx(float(want[r.source])) for r in got) and sum(r.target for r in got) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_running_sums_over_many_tasks(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [("hot" if k % 3 else f"g{k % 40}", k, k % 11) for k in range(1500)] + [(None, k, 1) for k in range(5)]
        got = running_sums(spark.createDataFrame(rows, "g string, at long, v long").repartition(5), ["g", "at"], ["g"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    so_far, want = Counter(), {}
    for g, at, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[g, at], so_far[g] = so_far[g], so_far[g] + v
    assert {(r.g, r["at"]): r.v_before for r in got} == want and len(got) == len(rows)
