from __future__ import annotations

import random

import pytest

from portolan.operators import containment as K
from portolan.operators.csharp import Source
from portolan.plans.rendered import REPOSITORY, SCREEN


def plain(text):
    """For each line the latest class and the latest method whose lines it is among."""
    source = Source("F.cs", text)
    classes = [(a, b, name) for a, b, name, *_ in source.classes()]
    methods = {(a, b, m) for a, b, _, m in source.methods()}
    of = lambda spans, i: max(((a, name) for a, b, name in spans if a <= i <= b), default=(0, None))[1]
    return [(i + 1, of(classes, i), of(methods, i)) for i in range(len(source.lines))]


@pytest.mark.parametrize("piece", [3, 1000])
def test_class_and_method_of_every_line(spark, piece):
    random.seed(piece)
    parts = ["public class A {", "public class B", "{", "{", "}", "}", "public void M()", "private int N() { return 1; }", "public void P() {", "x = y;", "if (a) {", "} else {", "public class C { int x; }", "", "} }"]
    texts = {f"r{k}": "\n".join(random.choice(parts) for _ in range(random.randint(1, 30))) for k in range(25)}
    texts |= {"screen": SCREEN.replace("{p}", "7").replace("{q}", "8").replace("{overload}", ""), "store": REPOSITORY.replace("{p}", "7"), "none": "x;\ny;", "empty": ""}
    files = spark.createDataFrame([("a", k, t) for k, t in texts.items()] + [("a", "null", None)], "app_name string, path string, text string")
    got = {}
    for r in K.containment(files, piece).collect():
        got.setdefault(r.file, []).append((r.n, r.class_name, r.method))
    for name, text in texts.items():
        if text:
            bounded = [(n, c, m) for n, c, m in sorted(got[name], key=lambda r: r[0])]
            assert [(n, c) for n, c, _ in bounded] == [(n, c) for n, c, _ in plain(text)], (name, text)
    for name in ("screen", "store", "none"):
        assert sorted(got[name], key=lambda r: r[0]) == plain(texts[name])


def test_a_long_file_is_spread_over_tasks(spark):
    text = "public class A {\n" + "".join(f"public void M{k}()\n{{\nx = {k};\n}}\n" for k in range(3000)) + "}\n"
    rows = K.containment(spark.createDataFrame([("a", "F.cs", text)], "app_name string, path string, text string"), 500)
    got = {r.n: (r.class_name, r.method) for r in rows.collect()}
    assert len(got) == 12_002 and got[12_001 - 1] == ("A", "M2999") and got[4] == ("A", "M0") and got[12_002] == ("A", None)


def test_lines_are_never_broadcast(spark):
    """Stored lines are small files of many rows; Spark would send them through the driver."""
    files = spark.range(50).selectExpr("'A' AS app_name", "concat(id, '.cs') AS path", "'class A {\\n  public void B()\\n  {\\n  }\\n}' AS text")
    plan = K.containment(files)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    lines = K.numbered_lines(files)
    assert "Broadcast" not in K.blocks(lines)._jdf.queryExecution().executedPlan().toString()


def test_files_read_where_they_are_give_the_same_and_move_nothing(spark):
    random.seed(5)
    parts = ["public class A {", "public class B", "{", "}", "}", "public void M()", "private int N() { return 1; }", "public int Q() => 2;", "  [Attr] internal static void P() {", "x = y;", "if (a) {", "public class É {", "public class C { int x; }", "", "} }", "{ }"]
    texts = {f"r{k}": random.choice(["\n", "\r\n", "\x0b"]).join(random.choice(parts) for _ in range(random.randint(1, 40))) for k in range(60)}
    texts |= {"screen": SCREEN.replace("{p}", "7").replace("{overload}", ""), "store": REPOSITORY.replace("{p}", "7"), "none": "x;\ny;\n\n", "empty": "", "null": None}
    files = spark.createDataFrame([("a", k, t) for k, t in texts.items()], "app_name string, path string, text string")
    got = K.containment_by_file(files)
    assert got.schema == K.containment(files).schema
    assert sorted(map(str, got.collect())) == sorted(map(str, K.containment(files).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_long_file_is_passed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(K, "LINES_AT_ONCE", 100)
    text = "public class A {\n" + "".join(f"public void M{k}()\n{{\nx = {k};\n}}\n" for k in range(3000)) + "}\n"
    names, classes, methods = K.around_lines(text)
    assert len(classes) == 12_002 and names[methods[12_000]] == "M2999" and methods[12_001] == -1 and {names[k] for k in classes} == {"A"}
