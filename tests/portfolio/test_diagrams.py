from __future__ import annotations

import random
import re

import pytest

from portolan.operators import diagrams as D
from portolan.operators import flow


def ident(prefix, name):
    return f"{prefix}_{re.sub(r'[^\w]', '_', name)[:60] or 'n'}"


def plain_classes(rows, cap):
    """A diagram written item by item until there are ``cap`` nodes."""
    out, nodes, count, full = [D.HEAD], {}, 0, False
    for name in sorted({c for c, _, _ in rows}):
        for kind, target in [(None, None), *sorted({(k, t) for c, k, t in rows if c == name}, key=lambda x: (x[0] == "io", x))]:
            if full or count >= cap:
                full = True
                break
            me, text = ident("class", name), (target or name).replace('"', "'")
            if kind is None:
                out.append(f'    {me}["{text}"]:::classNode')
                count += 1
                continue
            if (kind, target) not in nodes:
                nodes[kind, target] = ident(kind, target)
                count += 1
                out.append("    " + nodes[kind, target] + {"table": f'[("{text}")]', "sp": f'[["{text}"]]', "io": f'("{text}")'}[kind])
            out.append(f"    {me} {'-.->' if kind == 'io' else '-->'} {nodes[kind, target]}")
    return out + ([D.CLASS_NOTE] if full else []) + [D.CLASS_STYLE]


@pytest.mark.parametrize("cap", [3, 9, 80])
def test_class_diagrams_as_written_item_by_item(spark, cap):
    random.seed(cap)
    rows = [(app, random.choice(["Form A", 'Q"x', "é", "B", "C", ""]), kind, random.choice([f"{kind} {k}" for k in range(6)] + ["same", "x" * 70])) for app in "abc" for kind in ("table", "sp", "io") for _ in range(random.randint(1, 14))]
    lines = D.class_diagrams(spark.createDataFrame(rows + rows[:9], "app_name string, class_name string, kind string, target string"), cap)
    got = {r.app_name: r.mermaid.split("\n") for r in D.texts(lines).collect()}
    assert got == {app: plain_classes([r[1:] for r in rows if r[0] == app], cap) for app in "abc"}


def plain_relations(app, relations, loops, cap):
    side = lambda me, you, spelled: {o: ", ".join(sorted({r[spelled] for r in relations if r[me] == app and r[you] == o})) for o in sorted({r[you] for r in relations if r[me] == app and r[you] != app})}
    nodes, out, full, me = {app}, [D.HEAD, f'    {ident("app", app)}["{app}"]:::focalNode'], False, ident("app", app)
    for k, others in enumerate((side(0, 1, 2), side(1, 0, 3))):
        for other, tables in others.items():
            if len(nodes) >= cap:
                full = True
                break
            if other not in nodes:
                nodes.add(other)
                out.append(f'    {ident("app", other)}("{other}")')
            a, b = (me, ident("app", other))[:: -1 if k else 1]
            out.append(f'    {a} -->|"{tables}"| {b}')
    out += [f'    {me} -->|"{t}"| {me}' for t in sorted({t for a, t in loops if a == app})]
    return out + ([D.FOCAL_NOTE] if full else []) + [D.FOCAL_STYLE]


@pytest.mark.parametrize("cap", [2, 5, 80])
def test_relation_diagrams_as_written_item_by_item(spark, cap):
    random.seed(cap)
    apps = [f"app/{k}" for k in range(9)]
    relations = [(random.choice(apps), random.choice(apps), f"T{random.randint(0, 5)}", f"t{random.randint(0, 5)}") for _ in range(60)]
    relations = [r for r in relations if r[0] != r[1]]
    loops = [("app/1", "T2"), ("app/1", "T1"), ("alone", "T9")]
    lines = D.relation_diagrams(spark.createDataFrame(relations, "producer string, consumer string, written string, read string"), spark.createDataFrame(loops, "app_name string, table string"), cap)
    got = {r.app_name: r.mermaid.split("\n") for r in D.texts(lines).collect()}
    assert got == {a: plain_relations(a, relations, loops, cap) for a in {x for r in relations for x in r[:2]} | {"app/1", "alone"}}


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "app_name string, class_name string, kind string, target string")
    assert D.class_diagrams(none).collect() == []
    assert D.relation_diagrams(spark.createDataFrame([], "producer string, consumer string, written string, read string"), spark.createDataFrame([], "app_name string, table string")).collect() == []


def test_evidence_keeps_what_either_side_does(spark):
    rows = [
        (1, "dbo.T", "INSERT INTO dbo.T (IL, ReflA) VALUES (1, 2)"), (1, "t", "UPDATE t SET IL = 1"), (2, "T", "SELECT IL FROM T"), (2, "T", "SELECT IL FROM T"), (3, "U", "SELECT IL FROM U"), (2, "U", "SELECT * FROM U"),
    ]
    findings = spark.createDataFrame([(a, t, False, raw, None, "[]") for a, t, raw in rows], "app_id long, target string, is_sp boolean, raw string, resolved string, result_columns string")
    ops = flow.operations(findings)
    got = flow.relation_evidence(ops, flow.roles(ops, flow.context(ops))).collect()
    (r,) = got
    assert (r.producer, r.consumer, r.key, r.written, r.read) == (1, 2, "T", "dbo.T", "T")
    assert [(x.op, x.cols) for x in r.write_ops] == [("insert", ["IL", "ReflA"]), ("update", ["IL"])] and [(x.op, x.cols) for x in r.read_ops] == [("select", ["IL"])]


@pytest.mark.parametrize(("cap", "hot"), [(2, 1000), (5, 1000), (80, 1000), (2, 3), (5, 3), (80, 3)])
def test_relation_texts_without_pairs(spark, cap, hot):
    random.seed(cap)
    sides = [(f"K{k}", m, random.choice([1, 2, 3]), random.choice([f"k{k}", f'dbo."K{k}"'])) for k in range(7) for m in random.sample(range(1, 14), random.randint(1, 13))] + [("own", 20, 3, "own"), ("one", 21, 1, "one")]
    pairs = [(f"app/{a}", f"app/{b}", s, t) for k, a, x, s in sides for j, b, y, t in sides if j == k and a != b and x & 1 and y & 2]
    loops = [(f"app/{m}", t) for _, m, side, t in sides if side == 3]
    lines = D.relation_diagrams(spark.createDataFrame(pairs, "producer string, consumer string, written string, read string"), spark.createDataFrame(loops, "app_name string, table string"), cap)
    frame = spark.createDataFrame(sides, "key string, member long, side int, table string")
    from pyspark.sql import functions as F

    sizes = frame.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = D.relation_texts(frame, sizes, lambda c: F.concat(F.lit("app/"), c.cast("string")), cap, hot)
    assert sorted(got.collect()) == sorted(D.texts(lines).collect())


def test_relation_texts_move_lists_not_pairs(spark):
    """With forty applications on a table each gets the few first by name; no row is made for each pair."""
    from pyspark.sql import functions as F

    sides = spark.range(40).select(F.lit("T").alias("key"), F.col("id").alias("member"), F.lit(3).alias("side"), F.lit("t").alias("table"))
    got = D.relation_texts(sides, sides.groupBy("key").agg(F.count(F.lit(1)).alias("n")), lambda c: c.cast("string"), 3)
    assert {r.n_lines for r in got.collect()} == {9} and all(D.FOCAL_NOTE in r.mermaid for r in got.collect())
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan
