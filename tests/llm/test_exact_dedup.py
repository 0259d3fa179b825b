from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from portolan.llm.exact_dedup import exact_groups, without_copies


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("rounds", [1, 2])
def test_groups_as_by_brute_force(docs, keep, rounds):
    rows = [(i, f"text {i % 7}" if i % 3 else "one text") for i in range(200)] + [(500, None), (501, ""), (None, "one text"), (None, "alone")]
    got = exact_groups(docs(rows), keep=keep, fan_in=4, rounds=rounds).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows, {"max": max, "min": min}[keep])
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})


def test_one_of_repeated_rows_stays_with_all_columns(docs, odd):
    out = without_copies(odd)
    assert out.columns == odd.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd.select("text").collect()})


def test_empty_table(docs):
    assert exact_groups(docs([])).collect() == [] and without_copies(docs([])).collect() == []


def test_no_python_in_the_plan(docs):
    plan = exact_groups(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" in plan


def test_rounds_grow_with_the_rows(docs):
    from portolan.llm.exact_dedup import FAN_IN, RUN_ROWS, rounds_for

    assert [rounds_for(n) for n in (0, 10**6, 10**9, 10**12)] == [2, 2, 3, 6] and FAN_IN**6 * RUN_ROWS >= 10**12
    rows = [(i % 50, f"t{i % 9}") for i in range(400)]  # ids repeat with other texts
    got = exact_groups(docs(rows)).collect()
    assert sum(r.kept for r in got) == 9 and len(got) == 400
