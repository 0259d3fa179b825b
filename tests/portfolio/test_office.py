from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree as E

import pytest
from pyspark.sql import functions as F

from portolan.sources import office as O


def sheets(path):
    """Titles and cells of a workbook, by zip and XML alone."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in E.fromstring(z.read("xl/workbook.xml")).iter(f"{{{O.SHEET}}}sheet")]
        parts = [E.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")) for i in range(1, len(names) + 1)]
    unescape = lambda t: re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), t)
    return [(n, [[unescape("".join(c.itertext())) for c in r] for r in p.iter(f"{{{O.SHEET}}}row")]) for n, p in zip(names, parts)]


ODD = ["", " a <b> & \"c\" ", "tab\tand\nline\rend", "bell\x07", "_x0041_", "ñ\U0001f600"]


def rows_of(spark, apps, flags):
    apps = spark.createDataFrame([(a,) for a in apps], "app_name string")
    flags = spark.createDataFrame(flags, "app_name string, severity string, line long, description string")
    return O.sheet_rows(flags, 2, "Seguridad", {"Severidad": F.col("severity"), "Descripcion": F.col("description")}, apps, (F.col("severity"), F.col("line"), "")).unionByName(
        O.sheet_rows(apps, 1, "Tecno/logia", {"Campo": F.lit("App"), "Valor": F.col("app_name")}, apps))


def test_workbooks_read_back_with_the_same_cells(spark, tmp_path):
    apps = [f"app {i}/x" for i in range(20)] + ["none"]
    flags = [(f"app {i}/x", "high" if j % 2 else None, j, ODD[j % len(ODD)]) for i in range(20) for j in range(12)]
    O.write_workbooks(rows_of(spark, apps, flags), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == len(apps)  # nothing hidden is left
    for i in range(20):
        first, second = sheets(tmp_path / "out" / f"app {i}%2Fx.xlsx")
        assert first == ("Tecno logia", [["Campo", "Valor"], ["App", f"app {i}/x"]])
        want = sorted(((s or "", j, t) for a, s, j, t in flags if a == f"app {i}/x"))
        assert second == ("Seguridad", [["Severidad", "Descripcion"]] + [[s, t] for s, _, t in want])
    assert sheets(tmp_path / "out" / "none.xlsx")[1] == ("Seguridad", [["Severidad", "Descripcion"]])
    O.write_workbooks(rows_of(spark, ["none"], []), str(tmp_path / "out"), "append")
    assert len(list((tmp_path / "out").iterdir())) == len(apps)
    O.write_workbooks(rows_of(spark, ["none"], []), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["none.xlsx"]


def test_full_sheets_and_long_texts_go_on(tmp_path, monkeypatch):
    class Row:
        def __init__(self, title, cells):
            self.title, self.cells = title, cells

    monkeypatch.setattr(O, "SHEET_ROWS", 3)
    monkeypatch.setattr(O, "CELL_CHARS", 4)
    with zipfile.ZipFile(tmp_path / "x", "w") as z:
        O.workbook(z, iter([Row("T" * 40, [str(k), "abcdefghij"]) for k in range(7)] + [Row("U", ["z"]), Row("a/b", ["1"]), Row("A b", ["2"])]))
    got = sheets(tmp_path / "x")
    assert [(n, len(r)) for n, r in got] == [("T" * 31, 3), ("T" * 27 + " (2)", 3), ("T" * 27 + " (3)", 1), ("U", 1), ("a b", 1), ("A b (2)", 1)]
    assert got[2][1] == [["6", "abcd", "efgh", "ij"]]


def test_documents_hold_headings_tables_and_paragraphs(spark, tmp_path):
    lines = ["# A & B", "", "> note", "## T", "| x | y |", "|---|---|", "| a\\|b | \x01 |", "", "end", "| k |", None]
    rows = [(app, 1, None, 0, "", n, line) for app in ("one", "two") for n, line in enumerate(lines)]
    O.write_documents(spark.createDataFrame(rows, "app_name string, section int, a string, b long, c string, n int, line string"), str(tmp_path / "d"))
    for app in ("one", "two"):
        with zipfile.ZipFile(tmp_path / "d" / f"{app}.docx") as z:
            body = E.fromstring(z.read("word/document.xml"))[0]
        w = f"{{{O.WORD}}}"
        said = [(e.find(f".//{w}pStyle").get(f"{w}val") if e.find(f".//{w}pStyle") is not None else "", "".join(e.itertext())) for e in body.iter(f"{w}p") if "".join(e.itertext())]
        assert said == [("Heading1", "A & B"), ("", "> note"), ("Heading2", "T"), ("", "x"), ("", "y"), ("", "a|b"), ("", "�"), ("", "end"), ("", "k")]
        assert [[len(r.findall(f"{w}tc")) for r in t.findall(f"{w}tr")] for t in body.iter(f"{w}tbl")] == [[2, 2], [1]]


def test_a_failed_task_leaves_the_older_files(spark, tmp_path):
    O.write_workbooks(rows_of(spark, ["none"], []), str(tmp_path))
    fails = F.udf(lambda a: 1 / 0 if a == "z" else a, "string")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        O.write_workbooks(rows_of(spark, ["none", "z"], []).withColumn("title", fails("app_name")), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["none.xlsx"]


def test_no_rows(spark, tmp_path):
    O.write_workbooks(rows_of(spark, [], []), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_the_workbook_of_each_application_holds_the_sheets_of_the_query(spark, sf, tmp_path):
    from portolan.operators.workbook import workbook_rows
    from portolan.plans import queries as Q

    *given, tables = Q._described(spark, sf)
    some = given[0].filter("app_name in ('App4', 'App6', 'App7')")
    O.write_workbooks(workbook_rows(some, *given[1:], None, tables), str(tmp_path / "w"))
    want = {}
    for r in Q.QUERIES["app_workbooks"](spark, sf).filter("app_name in ('App4', 'App6', 'App7')").orderBy("row").collect():
        want.setdefault(r.app_name, {}).setdefault(r.title, []).append(r.cells)
    got = {p.stem: {t: ["\t".join(row) for row in rows] for t, rows in sheets(p)} for p in (tmp_path / "w").iterdir()}
    assert got == want and set(got) == {"App4", "App6", "App7"}


def test_sheets_of_procedures_and_reflection(spark):
    from portolan.operators.workbook import workbook_rows

    app = spark.createDataFrame([("x", "C#", "net8", None, None, None)], "app_name string, language string, dotnet_target string, ui_framework array<string>, db_drivers array<string>, companions array<string>")
    settings = spark.createDataFrame([], "app_name string, file string, line int, name string, value string, category string, extractor string, confidence int")
    sql = spark.createDataFrame([], "app_name string, file string, line int, class_name string, method string, category string, target string, raw string, resolved string, parameters array<string>, result_columns array<string>, evidence struct<line_number: int, confidence: int>")
    io = spark.createDataFrame([(a, "f", n, "C", "m", c, "op", raw) for a in "xy" for n, c, raw in ((1, "reflection", "r"), (2, "file", "w"), (3, "file", "w"))], "app_name string, file string, line int, class_name string, method string, category string, operation string, raw string")
    p = spark.createDataFrame(
        [("x", "dbo", "P", "ok", " BEGIN ", [("@a", "int", 0, True, True, "1"), ("@b", "char", 5, False, False, "z")], [("c", "int", True)])],
        "app_name string, schema_name string, object_name string, status string, definition string, parameters array<struct<name: string, type: string, max_length: int, is_output: boolean, has_default: boolean, default: string>>, result_columns array<struct<name: string, type: string, nullable: boolean>>")
    got = {}
    for r in workbook_rows(app, settings, sql, io, None, p).orderBy("app_name", "place", "a", "b", "c").collect():
        got.setdefault((r.app_name, r.title), []).append(r.cells)
    assert {a for a, _ in got} == {"x"}
    body = {t: rows[1:] for (_, t), rows in got.items()}
    assert body["Archivos-Impresoras-Red"] == [["C", "m", "op", "w"]] and body["Reflection-COM"] == [["C", "m", "op", "r"]]
    assert body["Definiciones SP (BD)"] == [["dbo.P", "ok", "BEGIN"]]
    assert body["Parametros SP (BD)"] == [["dbo.P", "@a", "int", "", "Si", "1"], ["dbo.P", "@b", "char", "5", "", ""]]
    assert body["Columnas resultado SP (BD)"] == [["dbo.P", "c", "int", "Si"]]
    assert body["Funciones-SQL-SP"] == body["Seguridad"] == body["Conexiones y config"] == []
