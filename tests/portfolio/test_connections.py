from __future__ import annotations

import pytest

from portolan.operators import connections as C


def sources(*lines, head="public void M(bool flag)"):
    text = "public class F {\n" + head + "\n{\n" + "\n".join(lines) + "\n}\n}\n"
    return [(line, [(x["kind"], x["name"]) for x in found]) for line, found in C.connections_of("F.cs", text)]


S = lambda *names: [("setting", n) for n in names]
COMMAND = 'SqlCommand c = new SqlCommand("t", new SqlConnection(cs));'


@pytest.mark.parametrize("lines, want", [
    (["var cs = Settings.Default.A;"], S("A")),
    (['var cs = ConfigurationManager.ConnectionStrings["A"].ConnectionString;'], S("A")),
    (["var cs = Settings.Default.A;", "if (flag) cs = Settings.Default.B;"], S("A", "B")),
    (["var cs = Settings.Default.A;", "if (flag) { cs = Settings.Default.B; } else { cs = Settings.Default.D; }"], S("B", "D")),
    (["var cs = Settings.Default.A;", "if (flag) { cs = Settings.Default.B; return; }"], S("A")),
    (["var cs = (flag) ? (Settings.Default.A) : Settings.Default.B;"], S("A", "B")),
    (["var cs = Settings.Default.A ?? Settings.Default.B;"], S("A", "B")),
    (["var x = Settings.Default.A;", "foreach (var y in z) { cs = w; w = x; }"], [("outside", "cs"), ("outside", "w"), ("setting", "A")]),
    (["switch (k) {", "case 1: cs = Settings.Default.A; break;", "case 2: cs = Settings.Default.B; break;", "default: throw new X();", "}"], S("A", "B")),
    (["switch (k) {", "case 1: cs = Settings.Default.A; break;", "}"], [("outside", "cs"), ("setting", "A")]),
    (["var cs = Settings.Default.A;", "try { cs = Settings.Default.B; } catch (Exception e) { cs = Settings.Default.D; }"], S("B", "D")),
    (["var cs = Settings.Default.A; // cs = Settings.Default.B;", "/* cs = x; */"], S("A")),
    (['var cs = "Server=a;" + "x";'], [("unknown", "")]), (['var cs = "Server=a;{";'], [("text", "Server=a;{")]), ([], [("outside", "cs")]),
    (["var o = new Options { A = 1 };", "Do(() => { return 1; });", "var cs = Settings.Default.A;"], S("A")),
])
def test_sources_that_reach_a_command(lines, want):
    ((line, found),) = sources(*lines, COMMAND)
    assert found == want and line == 4 + len(lines)


def test_commands_and_their_connections():
    got = sources("SqlConnection a = new SqlConnection(Settings.Default.A);", "var c = new SqlCommand();", 'c.CommandText = "x";', "c.Connection = a;", "using (var d = new SqlCommand(q, a)) {", 'd.CommandText = "y";', "}", "var e = a.CreateCommand();", 'e.CommandText = "z";', "var f = new OracleCommand(q);")
    assert got == [(5, S("A")), (6, S("A")), (8, S("A")), (9, S("A")), (12, S("A")), (13, [])]


def test_nothing_is_told_of_what_is_nested_too_deep():
    deep = sources("{" * 3000 + "}" * 3000, COMMAND)
    assert deep in ([], [(5, [("outside", "cs")])])
    assert sources("if (flag", COMMAND) in ([], [(5, [("outside", "cs")])])


def test_states_of_a_footprint(spark):
    text = 'public class F {\npublic void M()\n{\nvar c = new SqlCommand("SELECT A FROM T1", new SqlConnection(Settings.Default.Two));\nvar d = new OracleCommand("SELECT A FROM Erp1", new OracleConnection(Settings.Default.Ora));\n}\n}\n'
    files = spark.createDataFrame([("a", "F.cs", text), ("b", "F.cs", text), (None, None, None)], "app_name string, path string, text string")
    rows = [(app, "F.cs", n, "F", "M", kind, target) for app in ("a", "b", "c") for n, kind, target in ((4, "SqlCommand", "T1"), (5, "OracleCommand", "dbo.Erp1"), (9, "SqlCommand", None))]
    findings = spark.createDataFrame(rows, "app_name string, file string, line int, class_name string, method string, kind string, target string")
    settings = spark.createDataFrame([("a", "Two", "Server=S1;Database=D", "sql_or_oracle"), ("a", "Ora", "Data Source=O1", "sql_or_oracle"), ("b", "Two", "C:\\x", "local_path")], "app_name string, name string, value string, category string")
    got = C.footprint(findings, files, settings, ("Erp1",))
    assert sorted((r.app_name, r.target, r.server, r.database, r.status, r.confidence, r.is_erp) for r in got.collect()) == [
        ("a", "T1", "s1", "D", C.RESOLVED, 95, False), ("a", "dbo.Erp1", "o1", None, C.RESOLVED, 95, True), ("b", "T1", None, None, C.UNKNOWN, 20, False), ("b", "dbo.Erp1", None, None, C.UNKNOWN, 20, True),
        ("c", "T1", None, None, C.NO_FILE, 20, False), ("c", "dbo.Erp1", None, None, C.NO_FILE, 20, True),
    ]
    assert tuple(C.footprint_counters(got).first()) == (3, 6, 2, 0, 4, 3)


def test_sides_of_a_footprint_are_never_broadcast(spark):
    """What is read from source has many more rows than the size of the table it comes from tells."""
    from portolan.operators import extraction

    files = spark.range(5).selectExpr("concat('A', id) AS app_name", "'S.cs' AS path", "'class A { public void B() { SqlCommand c = new SqlCommand(\"SELECT 1 FROM T\", x); } }' AS text")
    found = extraction.sql_findings(files)
    settings = extraction.settings(files, files)
    plan = C.footprint(found, files, settings)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3


def test_findings_and_connections_from_one_reading(spark):
    from portolan.operators import connections as C
    from portolan.operators import extraction as X
    from portolan.plans.rendered import REPOSITORY, SCREEN

    texts = {"Data/Store.cs": REPOSITORY.replace("{p}", "7"), "F.cs": SCREEN.replace("{p}", "7").replace("{overload}", ""), "None.cs": "int x;", "Null.cs": None}
    files = spark.createDataFrame([("a", k, t) for k, t in texts.items()], "app_name string, path string, text string")
    both = C.with_findings(files).collect()
    as_rows = lambda rows, names: sorted(str([r[n] for n in names]) for r in rows)
    found, given = X.raw_findings(files), C.connections(files)
    assert as_rows([r for r in both if r.found != "connection"], found.columns) == as_rows(found.collect(), found.columns)
    assert as_rows([r for r in both if r.found == "connection"], given.columns) == as_rows(given.collect(), given.columns)
