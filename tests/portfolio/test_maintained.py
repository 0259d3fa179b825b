from __future__ import annotations

import random

from portolan.operators import flow, maintained

SCHEMA = "app_id long, target string, is_sp boolean, raw string, resolved string, result_columns string"
TEXTS = ["INSERT INTO {t} (IL, ReflA) VALUES (1, 2)", "UPDATE {t} SET STATUS = 1", "SELECT STATUS FROM {t}", "SELECT IL FROM {t}", "SELECT TEST_DATE FROM {t}", "SELECT * FROM {t}", "DELETE FROM {t}", "EXEC {t}", "nothing"]


def statements(rng, n):
    rows = []
    for _ in range(n):
        t = rng.choice(["dbo.", ""]) + rng.choice(["T1", "t2", "T3", "t4"])
        rows.append((rng.randint(1, 6), rng.choice([t, t, t, None]), rng.random() < 0.1, rng.choice(TEXTS).replace("{t}", t), None, "[]"))
    return rows


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def test_as_a_whole_run_after_random_changes(spark):
    rng = random.Random(5)
    kept, there = maintained.new_store(spark), []
    for step in range(3):
        gone = rng.sample(there, len(there) // 3) if step < 2 else list(there)
        come = statements(rng, 25) if step < 2 else statements(rng, 3)
        there = list(there)
        for r in gone:
            there.remove(r)
        there += come
        frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
        assert kept.change(frame(gone) if gone else None, frame(come)) <= 4
        whole = flow.portfolio_roles(frame(there))
        columns = ("app_id", "target", "key", "role", "status", "n_reads", "n_writes")
        assert rows_of(kept.roles(), *columns) == rows_of(whole, *columns)
        assert rows_of(kept.relations(), "producer", "consumer", "n_tables") == rows_of(flow.strong_relations(whole), "producer", "consumer", "n_tables")


def test_only_touched_folders_are_replaced(spark):
    import os

    rng = random.Random(2)
    kept = maintained.new_store(spark)
    kept.change(None, spark.createDataFrame([(a, f"T{k}", False, TEXTS[a % 3].replace("{t}", f"T{k}"), None, "[]") for a in range(4) for k in range(40)], SCHEMA))
    place = kept.path.removeprefix("file:") + "/counts"
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}
    before = files()
    assert kept.change(None, spark.createDataFrame([(9, "T7", False, TEXTS[0].replace("{t}", "T7"), None, "[]")], SCHEMA)) == 1
    after = files()
    assert len({os.path.dirname(f) for f in before ^ after}) == 1 and len(before & after) >= len(before) - 1
    assert kept.change(None, None if rng is None else spark.createDataFrame([], SCHEMA)) == 0


def test_changes_make_no_pairs_until_relations_are_asked_for(spark, monkeypatch):
    """Then only applications whose side at a touched table is another one are paired."""
    made = []
    real = maintained.pair_counts
    monkeypatch.setattr(maintained, "pair_counts", lambda left, right: made.append(left.count() + right.count()) or real(left, right))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = [(a, f"T{k}", False, TEXTS[a % 3].replace("{t}", f"T{k}"), None, "[]") for a in range(6) for k in range(9)]
    kept = maintained.new_store(spark)
    kept.change(None, frame(rows))
    kept.change(frame(rows[:3]), None)
    assert kept.roles().count() == 51 and made == []
    whole = lambda there: rows_of(flow.strong_relations(flow.portfolio_roles(frame(there))), "producer", "consumer", "n_tables")
    assert rows_of(kept.relations(), "producer", "consumer", "n_tables") == whole(rows[3:]) and len(made) == 1
    kept.relations()
    assert len(made) == 1  # nothing has changed since
    kept.change(frame(rows[8:9]), frame([(9, "T2", False, TEXTS[6].replace("{t}", "T2"), None, "[]")]))
    assert rows_of(kept.relations(), "producer", "consumer", "n_tables") == whole(rows[3:8] + rows[9:] + [(9, "T2", False, TEXTS[6].replace("{t}", "T2"), None, "[]")])
    assert sum(made[1:]) < 40 < made[0]


def test_many_changes_are_merged(spark, monkeypatch):
    monkeypatch.setattr(maintained, "CHANGES", 2)
    rng = random.Random(8)
    kept, there = maintained.new_store(spark), []
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for step in range(4):
        gone, come = rng.sample(there, len(there) // 4), statements(rng, 12)
        for r in gone:
            there.remove(r)
        there += come
        kept.change(frame(gone) if gone else None, frame(come))
        if step in (1, 3):
            whole = flow.portfolio_roles(frame(there))
            assert rows_of(kept.relations(), "producer", "consumer", "n_tables") == rows_of(flow.strong_relations(whole), "producer", "consumer", "n_tables")
    assert len(kept._changes()[0]) <= 3
    assert rows_of(kept.roles(), "app_id", "target", "key", "role") == rows_of(flow.portfolio_roles(frame(there)), "app_id", "target", "key", "role")
