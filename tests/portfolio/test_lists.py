"""Lists of names are read as item by item, and pairs are counted as by brute force however their members are dealt."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from portolan.functions import sqltext as S
from portolan.operators import cooccurrence


def test_lists_of_names_by_one_pattern_are_as_item_by_item(spark):
    rng = random.Random(4)
    pieces = ["a", "[B]", "dbo.x", "[d].[e f]", "g.h AS i", "k as [l]", "m as n as o", "as as p", "1q", "r ", " s", "t[", "*", "", "f(x, y)", "u\n", "count(*) as v", "[w].x as y", "é", "z.", "1.b", "a.1b", "x as", "q "]
    lists = ["", "*", "a,b", " a , b "] + [",".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(400)] + [",".join(f"c{k}" for k in range(5000))]
    rows = spark.createDataFrame([(op, x) for x in lists for op in ("select", "insert", "update", "delete")], "op string, x string")
    found = rows.select("op", "x", S.names_of(F.col("op"), F.col("x")).alias("got"), S.names_in(S.list_items(F.col("op"), F.col("x"))).alias("want")).collect()
    assert [r for r in found if r.got != r.want] == [] and any(r.got for r in found)


def test_lists_without_their_calls_have_the_same_names(spark):
    rng = random.Random(6)
    pieces = ["a", "[B]", "dbo.x", "g.h AS i", "f(x, y)", "count(*) as v", "(", ")", "f(g(h(i(j, 1), 2), 3), 4) z", "f(g(h(i(j(k), 1))))", "(a), (b)", " ", "", "*", "\x01", "b\n", "(select q", "x as y(1)", "d.(e).c"]
    lists = [",".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(600)] + ["(" * 500 + "," + ")" * 500, "a," + "f(x)," * 190 + "b", ",".join(f"f{k}(x)" for k in range(900)) + ", c"]
    rows = spark.createDataFrame([(op, x) for x in lists for op in ("select", "insert", "update", "delete")], "op string, x string")
    rows = rows.withColumn("m", S.marked_calls(F.col("op"), F.col("x"))).withColumn("left", S.without_calls(F.col("m"), F.col("x")))
    found = rows.select("op", "x", "left", S.names_of(F.col("op"), F.col("left")).alias("got"), S.names_in(S.list_items(F.col("op"), F.col("x"))).alias("want")).collect()
    assert [r for r in found if r.got != r.want] == [] and any(r.got and r.left != r.x for r in found)


def test_pairs_of_light_keys_are_counted_where_their_first_member_is(spark, monkeypatch):
    rng = random.Random(5)
    left, right = ({(rng.randint(0, 20), rng.randint(0, 15)) for _ in range(150)} for _ in range(2))
    frame = lambda x: spark.createDataFrame(sorted(x), "key int, member long")
    want = Counter((a, b) for k, a in left for j, b in right if k == j)
    own = Counter((a, b) for k, a in left for j, b in left if k == j and a < b)
    for most in (2_000_000, 7):  # members in one slot, and in several
        monkeypatch.setattr(cooccurrence, "PAIRS_AT_ONCE", most)
        got = cooccurrence.pair_counts(frame(left), frame(right))
        assert {(r.a, r.b): r.n for r in got.collect()} == want
        x = frame(left)
        for heavy in (250_000, 60):
            assert {(r.a, r.b): r.n for r in cooccurrence.pair_counts(x, x, heavy, ascending=True).collect()} == own
    empty = frame(left).limit(0)
    assert cooccurrence.pair_counts(empty, frame(right)).collect() == []
