from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import pytest

from portolan.llm.repair import best_repair, chart, damaged, repair, repair_of_damaged

GRAMMAR = re.compile(r"(s?(ua)+)?")
NO_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def plain(turns):
    """All edits tried by depth: the least (cost, audit) among repairs whose initials are in the grammar; at most six insertions."""

    @lru_cache(None)
    def best(at, state, inserts):
        found = [] if at < len(turns) or state not in ("", "a") else [(0, "")]
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        options = [(3, "I", at, r, inserts + 1) for r in nexts if r != "s"] if inserts < 6 else []
        if at < len(turns):
            turn = turns[at]
            options.append((4, "D", at + 1, state, inserts))
            if turn != "-":
                more = 3 if turn.isupper() else 0
                options += [(more, "K", at + 1, r, inserts) for r in nexts if r == turn.lower()]
                options += [(3 + more, "R", at + 1, r, inserts) for r in nexts if r != "s"]
        for cost, edit, to, role, n in options:
            if (rest := best(to, role, n)) is not None:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


@pytest.mark.parametrize("seed", range(4))
def test_least_cost_and_audit_as_by_trying_all(seed):
    random.seed(seed)
    for _ in range(400):
        turns = "".join(random.choices("sSuUaAxX-", k=random.randint(0, 7)))
        assert best_repair(turns) == plain(turns)


def test_a_chart_goes_on_from_any_symbol():
    random.seed(1)
    for _ in range(200):
        turns = "".join(random.choices("suaUAx-", k=random.randint(0, 9)))
        at, whole = random.randint(0, len(turns)), chart(turns)
        joined = {}
        for middle, (c, t) in chart(turns[:at]).items():
            for end, (c2, t2) in chart(turns[at:], middle).items():
                joined[end] = min(joined.get(end, (10**9, "")), (c + c2, t + t2))
        assert joined == whole


def brute(rows):
    """The contract restated over lists."""
    groups, ids = defaultdict(list), {r[0] for r in rows}
    sp = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        hit, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        groups[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv in ids:
        turns = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0], sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, marks, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in turns:
            full = NO_SPACE.findall(text)
            fault = "b" if not full else "d" if (role, text) in seen else "t" if full[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in set("sua") else "x"
            marks += "-" if fault in ("b", "d") else initial.upper() if fault else initial
        known = [t for t, *_ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = best_repair(marks)
        at, last, lines = 0, "", []
        for edit in audit:
            role, text = turns[at][1:] if edit in "KRD" else ("", "")
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            at += edit != "I"
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    data = [(c, t, r, x, 1, "f", "d", 0) for c, t, r, x in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, place long, fault string, digest string, pieces int")


def found(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def conversations(seed):
    random.seed(seed)
    texts = ["A line.", "no end", "Why?", "", " \n\t", "Go!  \n", "ends here.\x0b", None, "é û.", "line\nline."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(random.randint(1, 12)):
            rows.append((conv, random.choice([turn, turn, turn + 2, None]), random.choice(["user", "assistant", "system", "tool", "", None, "Unknown", "up"]), random.choice(texts)))
    return rows + random.sample(rows, 10)


@pytest.mark.parametrize("rows", [3, 4096])
def test_as_by_brute_force(spark, rows):
    turns = conversations(2)
    got = repair_of_damaged(table(spark, turns), rows=rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == brute(turns)


@pytest.mark.parametrize("rows", [7, 100])
def test_a_conversation_over_many_tasks(spark, rows):
    random.seed(7)
    turns = [(5, t, random.choice(["user", "assistant", "assistant", "system"]), random.choice([f"text {random.randint(0, 300)}.", "again.", "cut"])) for t in range(900)]
    turns += [(c, t, "user" if t % 2 == 0 else "assistant", "Fine.") for c in (4, 6) for t in range(3)]
    assert found(repair_of_damaged(table(spark, turns).repartition(6), rows=rows)) == brute(turns)


def test_the_repaired_turns_are_in_the_grammar(spark):
    turns = conversations(9)
    for row in repair(damaged(table(spark, turns))).filter("pieces = 1").collect():
        assert GRAMMAR.fullmatch("".join(t.role[0] for t in row.turns)) and len(row.audit) - row.audit.count("D") == len(row.turns)
        assert all(t.text.strip(" \t\n\x0b\x0c\r") for t, e in zip(row.turns, row.audit.replace("D", "")) if e != "I")


def test_long_texts_and_an_empty_table(spark):
    long = "word " * 400_000
    turns = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, 0, "user", "Hello?"), (2, 1, "assistant", "Yes.")]
    assert found(repair_of_damaged(table(spark, turns))) == brute(turns)
    assert repair_of_damaged(table(spark, [])).collect() == []
