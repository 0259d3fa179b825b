from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from portolan.operators import sectioned as S


def esc(x):
    return (x or "").replace("|", "\\|").replace("\n", " ")


def plain(app):
    """A report written section by section."""
    out = [f"# {app['name']} — Inventario automatico (borrador)", "", f"> Generado por me. {S.DRAFT}", ""]
    out += ["## Ciclo de vida", "", f"- **Build date** (proxy, fecha de modificacion del ensamblado): {app['build'] or 'unknown'}", f"- **Last activity evidence**: {app['date'] or 'unknown'}", f"- **Activity source**: {app['source']}", f"- **Activity confidence**: {app['sure']}", ""]
    out += ["## Tecnologia", "", "- **Lenguaje**: C#", "- **Target .NET**: net8", "- **UI Framework**: WPF, WinForms", "- **Drivers de BD detectados**: "]
    out += [S.COMPANIONS + ", ".join(app["companions"])] if app["companions"] else []
    out += [""]
    if app["flags"]:
        out += ["## ⚠️ Alertas de seguridad", "", "| Severidad | Descripcion | Ubicacion |", "|---|---|---|", *[f"| {a} | {esc(b)} | {esc(c)} |" for a, b, c in sorted(app["flags"])], ""]
    of = lambda k: sorted(x for x in app["settings"] if x[3] == k)  # noqa: E731  (file, line, name, kind, value)
    out += ["## Connection strings", ""]
    out += ["| Setting | Valor por defecto | Archivo | Evidencia | Confianza |", "|---|---|---|---|---|", *[f"| `{n}` | `{esc(v)}` | {f} | X{f', linea {i}' if i else ''} | 95% |" for f, i, n, _, v in of("sql_or_oracle")]] if of("sql_or_oracle") else [S.NO_CONNECTIONS]
    out += ["", "## Rutas / archivos locales configurados", ""]
    out += ["| Setting | Valor por defecto |", "|---|---|", *[f"| `{n}` | `{esc(v)}` |" for _, _, n, _, v in of("local_path")]] if of("local_path") else [S.NO_PATHS]
    out += [""]
    if of("other"):
        out += ["### Otras configuraciones", "", "| Setting | Valor por defecto |", "|---|---|", *[f"| `{n}` | `{esc(v)}` |" for _, _, n, _, v in of("other")], ""]
    out += ["## Funciones -> SQL / Stored Procedures", ""]
    out += ['<div class="table-sql-findings" markdown="1">', "", S.SQL_HEAD, "|" + "---|" * 10, *app["sql"], "", "</div>"] if app["sql"] else [S.NO_SQL]
    out += [""]
    if app["notes"] or app["procedures"] or app["tables"]:
        out += ["## Extraccion de esquema desde la base de datos (solo lectura)", ""]
        out += [f"> ⚠️ No se pudo conectar a alguna(s) de las conexiones: {app['notes']}", ""] if app["notes"] else []
    out += ["### Definiciones de Stored Procedures", "", *app["procedures"]] if app["procedures"] else []
    out += ["### Esquema de tablas", "", *app["tables"]] if app["tables"] else []
    out += ["## Archivos, impresoras, procesos y red en codigo", ""]
    out += ["| Clase | Funcion | Operacion | Detalle |", "|---|---|---|---|", *app["io"]] if app["io"] else [S.NO_IO]
    out += ["", "## Invocacion indirecta / tardia (Reflection, COM)", ""]
    out += [S.REFLECTION_NOTE, "", "| Clase | Funcion | API | Detalle |", "|---|---|---|---|", *app["late"]] if app["late"] else [S.NO_REFLECTION]
    return [*out, ""]


@pytest.fixture(scope="module")
def inputs(spark):
    apps = [("full", "2024", "2025", "logs", 70, "C#", "net8", ["WPF", "WinForms"], None, ["A.dll", "B.dll"], "e1"), ("bare", None, None, "none", None, "C#", "net8", ["WPF", "WinForms"], [], None, None)]
    apps = spark.createDataFrame(apps, "app_name string, build_date string, activity_date string, activity_source string, activity_confidence int, language string, dotnet_target string, ui_framework array<string>, db_drivers array<string>, companions array<string>, db_notes string")
    settings = [("full", "S.cs", 9, "B", "Server=a|b", "sql_or_oracle"), ("full", "S.cs", 0, "A", "x\ny", "sql_or_oracle"), ("full", "S.cs", 3, "P", "C:\\x", "local_path"), ("full", "S.cs", 4, "O", None, "other"), ("stranger", "S.cs", 4, "O", "v", "other")]
    settings = spark.createDataFrame(settings, "app_name string, file string, line int, name string, value string, category string").withColumns({"extractor": F.lit("X"), "confidence": F.lit(95)})
    sql = [
        ("full", "B.cs", 5, "K", "M", 'new SqlConnection(cx); "q"', None, "query", "T", [], [], 20, None), ("full", "B.cs", 6, "K", "M", "c = q", 'EXEC "P|1"', "stored_procedure", "P", ["@a <- 1", "@b <- x|y"], ["C1", "C2"], 90, 4),
        ("full", "B.cs", 7, "K", "M", "c = q", 'EXEC "P|1"', "stored_procedure", "P", [], [], 90, 4), ("full", "A.cs", 9, "J", "N", "c = q", None, "query", None, [], [], 20, None), ("full", "C.cs", 1, "L", "O", "pk", "pk.f(1)", "oracle_package_call", "pk.f", [], [], 80, 2),
    ]
    sql = spark.createDataFrame(sql, "app_name string, file string, line int, class_name string, method string, raw string, resolved string, category string, target string, parameters array<string>, result_columns array<string>, c int, l int")
    sql = sql.withColumn("evidence", F.struct(F.lit("f").alias("source_file"), F.col("l").alias("line_number"), F.col("c").alias("confidence"))).withColumn("is_stored_procedure", F.col("category") == "stored_procedure")
    io = [("full", "A.cs", 2, "K", "M", "File.Copy", "File.Copy(a|b);", "io"), ("full", "A.cs", 3, "K", "M", "File.Copy", "File.Copy(a|b);", "io"), ("full", "A.cs", 4, "K", "M", "MethodInfo.Invoke", "m.Invoke();", "reflection")]
    io = spark.createDataFrame(io, "app_name string, file string, line int, class_name string, method string, operation string, raw string, category string")
    flags = spark.createDataFrame([("full", "alta", "x|y", "here"), ("full", "alta", "a", None)], "app_name string, severity string, description string, location string")
    kind = "app_name string, schema_name string, object_name string, status string, definition string, parameters array<struct<name string, type string, max_length int, is_output boolean, has_default boolean, default string>>, result_columns array<struct<name string, type string, nullable boolean>>"
    procedures = [("full", "dbo", "P1", "ok", " CREATE\nPROC \n", [("@a", "int", 4, True, True, "1|2"), ("@b", "int", 0, False, False, "9")], [("C", "int", True), ("D", "bit", False)]), ("full", "dbo", "P2", "ok", "X", [], None), ("full", "dbo", "P3", "denied", None, None, None), ("full", "dbo", "P4", "ok", "Y", None, [])]
    procedures = spark.createDataFrame(procedures, kind.replace(" array<struct<name ", " array<struct<name: ").replace(", type ", ", type: ").replace(", max_length ", ", max_length: ").replace(", is_output ", ", is_output: ").replace(", has_default ", ", has_default: ").replace(", default ", ", default: ").replace(", nullable ", ", nullable: "))
    tables = [("full", "dbo", "T", [("A", "int", "NO", None, "a|b"), ("B", "char", "YES", 8, None)], [("A", "dbo.R", "X", "fk1")]), ("full", "dbo", "U", [], None)]
    tables = spark.createDataFrame(tables, "app_name string, schema_name string, table_name string, columns array<struct<name: string, type: string, nullable: string, max_length: int, default: string>>, foreign_keys array<struct<column: string, ref_table: string, ref_column: string, fk_name: string>>")
    return apps, settings, sql, io, flags, procedures, tables


FULL = dict(
    name="full", build="2024", date="2025", source="logs", sure="high", companions=["A.dll", "B.dll"], notes="e1", flags=[("alta", "x|y", "here"), ("alta", "a", "")],
    settings=[("S.cs", 9, "B", "sql_or_oracle", "Server=a|b"), ("S.cs", 0, "A", "sql_or_oracle", "x\ny"), ("S.cs", 3, "P", "local_path", "C:\\x"), ("S.cs", 4, "O", "other", "")],
    sql=[
        "| `J` | `N` | ? | Query | ? | `(conexion detectada, query no resuelta automaticamente — revisar manualmente)` |  |  |  | 20% |", '| `K` | `M` | cx | Query | T | `new SqlConnection(cx); "q"` |  |  |  | 20% |',
        '| `K` | `M` | cx | Stored Procedure | P | `EXEC "P\\|1"` | `@a <- 1`<br>`@b <- x\\|y` | `C1`, `C2` | , linea 4 | 90% |', "| `L` | `O` | ? | PL/SQL (Oracle) | pk.f | `pk.f(1)` |  |  | , linea 2 | 80% |",
    ],
    io=["| `K` | `M` | File.Copy | `File.Copy(a\\|b);` |"], late=["| `K` | `M` | MethodInfo.Invoke | `m.Invoke();` |"],
    procedures=[
        "#### `dbo.P1`", "", "**Parametros de entrada/salida:**", "", "| Parametro | Tipo | Longitud | Salida | Default |", "|---|---|---|---|---|", "| @a | int | 4 | Si | 1\\|2 |", "| @b | int |  |  |  |", "",
        "**Columnas que devuelve (determinado por SQL Server, solo lectura):**", "", "| Columna | Tipo | Nulo |", "|---|---|---|", "| C | int | Si |", "| D | bit | No |", "", "**Codigo de `dbo.P1`:**", "", "```sql", "CREATE", "PROC", "```", "",
        "#### `dbo.P2`", "", S.NO_SHAPE, "", "**Codigo de `dbo.P2`:**", "", "```sql", "X", "```", "", "#### `dbo.P3` — no disponible (denied)", "", "#### `dbo.P4`", "", "**Codigo de `dbo.P4`:**", "", "```sql", "Y", "```", "",
    ],
    tables=[
        "#### `dbo.T`", "", "| Columna | Tipo | Nulo | Longitud | Default |", "|---|---|---|---|---|", "| A | int | NO |  | a\\|b |", "| B | char | YES | 8 |  |", "", "Claves foraneas:", "- `A` -> `dbo.R.X` (`fk1`)", "",
        "#### `dbo.U`", "", "| Columna | Tipo | Nulo | Longitud | Default |", "|---|---|---|---|---|", "",
    ],
)
BARE = dict(name="bare", build=None, date=None, source="none", sure="unknown", companions=[], notes=None, flags=[], settings=[], sql=[], io=[], late=[], procedures=[], tables=[])


def test_reports_as_written_section_by_section(inputs, tmp_path: Path):
    apps, settings, sql, io, flags, procedures, tables = inputs
    lines = S.report_lines(apps, settings, sql, io, flags, procedures, tables, generator="me")
    S.write_reports(lines, str(tmp_path / "out"))
    files = {f.parent.name.removeprefix("app_name="): f.read_text(encoding="utf-8").split("\n")[:-1] for f in (tmp_path / "out").glob("*/*.txt")}
    got = {k: [x.replace("PROC ", "PROC") for x in v] for k, v in files.items()}
    assert got["bare"] == plain(BARE) and got["full"] == plain(FULL) and len(got) == 2


def test_optional_inputs_and_no_applications(inputs):
    apps, settings, sql, io, *_ = inputs
    lines = [r.line for r in S.report_lines(apps, settings, sql, io, generator="me").filter("app_name = 'bare'").orderBy(*S.KEYS).collect()]
    assert lines == plain(BARE)
    assert S.report_lines(apps.limit(0), settings, sql, io).collect() == []
