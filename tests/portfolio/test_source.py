from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from portolan.functions.textops import masked_secrets, split_lines
from portolan.operators import csharp as C
from portolan.operators import enrich, extraction, report
from portolan.sources import corpus


def findings(text, path="F.cs"):
    return list(C.Source(path, text).findings())


def method(*lines, head="private void M()"):
    return "public class F {\n" + head + "\n{\n" + "\n".join(lines) + "\n}\n}\n"


@pytest.mark.parametrize("lines, want", [
    (['q = "a" + x + "b";'], ("a{x}b", 80)), (['q = "a";', 'q += " b";'], ("a b", 90)), (['q = @"a ""b""', 'c";'], ('a "b"\nc', 90)), (['q = "a\\"b;c";'], ('a"b;c', 90)),
    (['q = cond ? "a" : "b";'], None), (['q = "a";', "if (x)", 'q = "b";'], None), (["foreach (var y in z)", 'q = "b";'], ("b", 90)), (["y = 1;"], None), (['q = f("x, y", 1);'], ('{f(}x, y{, 1)}', 80)),
])
def test_variables_are_rebuilt_or_refused(lines, want):
    (f,) = findings(method(*lines, "SqlCommand c = new SqlCommand(q, k);"))
    assert (f["resolved"], f["confidence"]) == (want or (None, 20))


def test_builders():
    run = lambda *x: findings(method("StringBuilder sb = new StringBuilder();", *x, "SqlCommand c = new SqlCommand(sb.ToString(), k);"))[-1]["resolved"]
    assert run('sb.Append("a ");', 'sb.AppendLine("b" + n);', 'sb.Append(")(");') == "a b{n}\n)("
    assert run('sb.Append("a");', "while (x)", 'sb.Append("b");') is None and run() is None


def test_texts_of_another_method_dont_count():
    text = 'public class F {\nprivate void A()\n{\nq = "a";\n}\nprivate void B()\n{\nSqlCommand c = new SqlCommand(q, k);\n}\n}\n'
    assert findings(text)[0]["resolved"] is None and findings(text)[0]["method"] == "B"


def test_procedures_parameters_and_columns_belong_to_their_command():
    f = findings(method(
        'SqlCommand a = new SqlCommand("P", k);', "a.CommandType = CommandType.StoredProcedure;", 'a.Parameters.Add("@x", SqlDbType.Int).Value = (object)v;', 'b.Parameters.AddWithValue("@no", 1);', "r = a.ExecuteReader();", 's = r["A"] + r["B"] + r["A"] + o["C"];', 'a.Parameters.AddWithValue("@late", 1);',
        'SqlCommand b = new SqlCommand("select 1", k);',
    ))
    assert f[0]["procedure"] and not f[1]["procedure"] and f[0]["parameters"] == ["@x (Int) <- v"] and f[0]["result_columns"] == ["A", "B"]


def test_place_of_a_finding():
    same, below = "public class K {\n", "public class K\n{\n"
    rest = "public void M()\n{\nFile.Delete(x);\n}\n}\n"
    assert [findings(h + rest, "dir/Stem.cs")[0]["class_name"] for h in (same, below)] == ["K", "Stem"]


def test_input_output_and_reflection():
    kinds = [(f["found"], f["kind"]) for f in findings(method("x.Invoke(y);", "File.Copy(a, b);", "new ModbusClient (p);", "Activator.CreateInstance(t);", "MethodInfo m = t.GetMethod(n);", "m.Invoke(o, null);", "c.CommandText = File.ReadAllText(p);"))]
    assert kinds == [("io", "File.Copy"), ("io", "new ModbusClient "), ("reflection", "Activator.CreateInstance"), ("reflection", "MethodInfo.Invoke"), ("sql", "CommandText")]


def structure(text):
    return [x for x in C.Source("F.cs", text).structure()]


def test_structure_of_nested_classes_and_programs():
    rows = structure("namespace N.M\n{\npublic class A : IList<int>, Form {\nprivate class B : Window {\nprivate void Inner()\n{\n}\n}\npublic static void Main()\n{\nApp app = new App();\napp.Run();\n}\n}\n}\n")
    assert [(r[2], r[4], r[5]) for r in rows if r[0] == "class"] == [("A", "IList", "N.M"), ("B", "Window", "N.M")]
    assert [(r[2], r[3]) for r in rows if r[0] == "method"] == [("A", "Inner"), ("A", "Main"), ("B", "Inner")]
    assert [r[4] for r in rows if r[0] == "entry"] == ["wpf_app_run"]


def test_shows_stay_within_a_method():
    rows = structure("public class A : Form {\nprivate void X()\n{\nB f = new B();\n}\nprivate void Y()\n{\nf.Show();\nnew C(1).ShowDialog();\nMessageBox.Show(s);\n}\n}\n")
    assert [(r[3], r[4], r[5]) for r in rows if r[0] == "show"] == [("Y", None, "show"), ("Y", "C", "show_dialog")]


def test_wirings_and_calls():
    rows = structure("public class A : Form {\nprivate void X()\n{\nb.Click += new EventHandler(Gone); c.Enter += Y; d.Leave += unknown; e.Tick += (s, a) => Y();\nn += 1;\nif (Y()) { this.Y(); o.Z(); new W(); base.Q(); }\n}\nprivate void Y()\n{\n}\n}\n")
    assert [(r[3], r[4]) for r in rows if r[0] == "wiring"] == [("b.Click", "Gone"), ("c.Enter", "Y"), ("e.Tick", None)]
    assert [r[4] for r in rows if r[0] == "call" and r[1] == 6] == ["Y", "Y"]


def test_inherited_and_ambiguous_calls(spark):
    files = spark.createDataFrame([("a", "B.cs", "public class B {\npublic void Up()\n{\n}\n}\n"), ("a", "C.cs", "public class C : B {\npublic void M()\n{\nUp(); Two(); One(); None();\n}\npublic void Two()\n{\n}\npublic void Two(int x)\n{\n}\npublic void One()\n{\n}\n}\n"), ("a", None, None), ("b", "C.cs", "")], "app_name string, path string, text string")
    got = {(r.target_method, r.resolution_status) for r in extraction.calls(extraction.facts(files)).collect()}
    assert got == {("Up", "unresolved_call_target_inherited"), ("Two", "unresolved_call_target_ambiguous"), ("One", "resolved"), (None, "unresolved_call_target_unknown")}


def test_config_entries():
    text = '<configuration>\n<connectionStrings>\n<!-- <add name="o" connectionString="x"/> -->\n<add name="a"\n connectionString="s"/><add name="" connectionString="t"/>\n<add name="b" connectionString="u"/>\n</connectionStrings><appSettings><add name="z" connectionString="v"/></appSettings></configuration>'
    assert C.config_settings(text) == [(4, "a", "s"), (6, "b", "u")] and C.config_settings(text[:100]) == [] and C.config_settings("") == []


def test_trees_of_files(spark, tmp_path: Path):
    for path, text in {"App/A.cs": "class", "App/System.X/B.cs": "lib", "App/sub/C.cs": "é\r\nx", "Other/D.cs": "d", "App/App.csproj": "<TargetFramework>net48</TargetFramework>", "App/obj/x.exe": "", "App/bin/App.exe": "", "App/bin/App.vshost.exe": "", "App/bin/Own.dll": "", "App/bin/Microsoft.Y.dll": "", "App/Logs1/z.exe": ""}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text.encode() or b"MZ")
    root = str(tmp_path)
    assert {(r.app_name, r.path, r.text) for r in corpus.code(spark, root, skip=["System.X"]).collect()} == {("App", "A.cs", "class"), ("App", "sub/C.cs", "é\r\nx"), ("Other", "D.cs", "d")}
    assert [tuple(r) for r in corpus.target_framework(corpus.texts(spark, root, "*.csproj")).collect()] == [("App", "net48")]
    files = corpus.listed(spark, root, "*")
    assert [r.path for r in corpus.executables(files).collect()] == ["App/bin/App.exe"]
    assert [r.path for r in corpus.companions(files, "App/bin/App.exe").collect()] == ["App/bin/Own.dll"]
    with pytest.raises(ValueError, match="plain name"):
        corpus.catalog_query("definition", "x'); DROP")


def test_lines_and_secrets(spark):
    row = spark.createDataFrame([("a\r\nb\x0bc\u2028d\n", "Server=a;Password = s3;x=1")], "t string, c string").select(split_lines(F.col("t")).alias("x"), masked_secrets(F.col("c")).alias("y")).first()
    assert row.x == ["a", "b", "c", "d"] and "s3" not in row.y


def test_reports(spark):
    rows = spark.createDataFrame([(2, "x|y"), (1, "a\nb")], "k long, v string")
    assert report.markdown_table(rows, ["k", "v"], ["k"]).first().markdown == "| k | v |\n|---|---|\n| 1 | a b |\n| 2 | x\\|y |"
    assert report.markdown_table(rows.limit(0), ["k"], ["k"]).first().markdown == "| k |\n|---|"


def test_answers_of_connections(spark):
    rows = [(1, "dbo", "p", True, 0, 0, "e0"), (1, "dbo", "p", True, 1, 0, None), (1, "dbo", "t", False, 0, 0, None), (1, "dbo", "t", False, 2, 3, "e2"), (1, "dbo", "u", False, 0, 0, None)]
    got = enrich.picked(spark.createDataFrame(rows, "app_id long, schema string, name string, is_procedure boolean, place int, n_columns int, error string")).collect()
    assert {(r.name, r.place, r.errors) for r in got} == {("p", 0, "e0"), ("t", 2, "e2"), ("u", None, None)}
    targets = spark.createDataFrame([(1, "dbo.T", False), (1, "t", False), (1, "[x].[y]", True)], "app_id long, target string, is_procedure boolean")
    alive = spark.createDataFrame([(1, 0, "OLD"), (1, 1, "new")], "app_id long, place int, server string")
    assert sorted((r.schema, r.name, r.place) for r in enrich.asked(targets, alive, ["old"]).collect()) == [("dbo", "t", 1), ("x", "y", 1)]


def test_stream_replaces_applications(spark, tmp_path):
    from portolan.streaming import incremental

    folder, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "cp"))
    make = lambda text: spark.createDataFrame([("a", "F.cs", text)], incremental.FILES).write.mode("append").parquet(folder)
    for text, n in (("public class A {\n}\n", 1), ("public class A {\n}\npublic class B {\n}\n", 2)):
        make(text)
        incremental.analyse_as_they_come(incremental.arriving_files(spark, folder), lambda f: extraction.classes(extraction.facts(f)), store, checkpoint).awaitTermination()
        assert spark.read.parquet(store).count() == n


def test_long_methods_and_nested_classes_are_read_once():
    import time

    start = time.perf_counter()
    found = findings(method("MethodInfo m;", *["x.Invoke(y);"] * 4000, *[x for k in range(300) for x in (f'q += "a{k}";', f"c{k}.CommandText = q;")]))
    nested = "".join(f"public class C{k} {{\npublic void M{k}()\n{{\n}}\n" for k in range(60)) + "}\n" * 60
    rows = structure(nested)
    assert time.perf_counter() - start < 3
    assert len(found) == 4300 and found[-1]["resolved"] == "".join(f"a{k}" for k in range(300))
    assert [len([r for r in rows if r[0] == "method" and r[2] == f"C{k}"]) for k in (0, 59)] == [60, 1]


def test_a_command_reads_only_its_own_lines():
    f = findings(method(
        'SqlCommand a = new SqlCommand("P", k);', 'SqlCommand a = new SqlCommand("Q", k);', 'a.Parameters.AddWithValue("@x", 1);', *["y();"] * 77, 'a.Parameters.AddWithValue("@in2", 1);', 'a.Parameters.AddWithValue("@out", 1);', "r = a.ExecuteReader();", 's = r["A"];',
    ))
    assert [x["parameters"] for x in f] == [["@x <- 1"], ["@x <- 1", "@in2 <- 1"]] and [x["result_columns"] for x in f] == [["A"], ["A"]]


def test_a_choice_or_branch_before_the_text_doesnt_count():
    (f,) = findings(method("w = a ? 1 : 2;", "if (x) y();", 'q = "t";', "SqlCommand c = new SqlCommand(q, k);"))
    assert (f["resolved"], f["confidence"], f["source_line"]) == ("t", 90, 6)
    (f,) = findings(method('q = "t";', "int? n;", "case 3:", "SqlCommand c = new SqlCommand(q, k);"))
    assert f["resolved"] is None


def test_classes_of_commands_are_made_in_code_that_is_compiled(spark):
    """The JVM doesn't compile methods of more than 8,000 bytes; a filter on what is found must not double the patterns."""
    rows = spark.createDataFrame([], extraction.FINDING)
    plan = extraction.sql_of(rows.repartition(2)).filter("target is not null")._jdf.queryExecution()
    said = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert "(?i)" not in "".join(re.findall(r"Filter .*", plan.optimizedPlan().toString()))
    assert all(x < 8000 for x in sizes)
