"""Reports in sections, of all applications in one job: a row for each line, keyed by application, section and place within it.

No report is collected: lines are sorted by their keys and written as they come, a file for each application. What a report has no rows for is told from
one aggregate over each input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.labels import confidence_label
from portolan.operators.report import cell, shown_findings, shown_io

# ---- what the reports say; fixed values

DRAFT = "Este es un primer borrador — revisar antes de usarlo como fuente final."
NO_CONNECTIONS = "_No se encontraron connection strings. Puede que el Settings.cs no se haya incluido en la decompilacion, o que la app no use `ApplicationSettingsBase` para su conexion._"
NO_PATHS = "_No se encontraron settings que parezcan rutas de archivo/carpeta._"
NO_SQL = (
    "_No se detecto ningun uso de SqlConnection/OracleConnection/CommandText en el codigo decompilado. Revisar manualmente — puede ser una app sin SQL propio (launcher, watchdog, "
    "o vista MVVM sin el ViewModel incluido)._"
)
NO_SHAPE = (
    "_SQL Server no pudo determinar automaticamente las columnas de salida de este SP (comun si usa SQL dinamico, tablas temporales o multiples result sets) — revisar "
    "el codigo de la SP arriba manualmente._"
)
NO_IO = (
    "_No se detecto acceso directo a archivos/carpetas, impresoras (BarTender/PrintDocument), puertos seriales, otros ejecutables (Process.Start) o llamadas HTTP/SMTP en el codigo._"
)
NO_REFLECTION = "_No se detecto invocacion via Reflection (MethodInfo.Invoke, Activator.CreateInstance) ni COM/CLSID (Marshal.GetTypeFromCLSID) en el codigo._"
REFLECTION_NOTE = "> ⚠️ El comportamiento real de estas llamadas depende de resolucion en tiempo de ejecucion -- ningun analisis estatico puede saber con certeza que se invoca."
COMPANIONS = "- **Ensamblados adicionales decompilados** (referenciados por el .exe, ej. una ClassLib con settings/logica propia): "
SQL_HEAD = "| Clase | Funcion | Conexion | Tipo | Tabla / SP | SQL / Query | Parametros | Columnas de resultado | Evidencia | Confianza |"

KEYS = ("section", "a", "b", "c", "n")


def _s(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _lines(rows: DataFrame, section: int, lines: list[Column | str], a: Column | str = "", b: Column | int = 0, c: Column | str = "") -> DataFrame:
    """A row for each of ``lines`` that isn't null, by their order; ``a, b, c``: the rows' own order within the section (a null comes first)."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    held = F.filter(F.array(*[as_column(x).cast("string") for x in lines]), lambda x: x.isNotNull())
    return rows.select("app_name", F.lit(section).alias("section"), as_column(a).cast("string").alias("a"), as_column(b).cast("bigint").alias("b"), as_column(c).cast("string").alias("c"), F.posexplode(held).alias("n", "line"))


def _table(columns: str) -> list[str]:
    return [columns, "|" + "---|" * (columns.count("|") - 1)]


def report_lines(
    apps: DataFrame, settings: DataFrame, sql: DataFrame, io: DataFrame, flags: DataFrame | None = None, procedures: DataFrame | None = None, tables: DataFrame | None = None, generator: str = "portolan",
) -> DataFrame:
    """``app_name, section, a, b, c, n, line``: the lines of each application's report, in the order of these columns.

    ``apps``: app_name, build_date, activity_date, activity_source, activity_confidence, language, dotnet_target, ui_framework, db_drivers, companions (arrays), db_notes. ``settings``: app_name, file, line,
    name, value, category, extractor, confidence. ``sql``, ``io``: findings; ``flags``: app_name, severity, description, location. ``procedures``: app_name, schema_name, object_name, status, definition, parameters
    (name, type, max_length, is_output, has_default, default), result_columns (name, type, nullable; null: not known). ``tables``: app_name, schema_name, table_name, columns (name, type, nullable, max_length, default),
    foreign_keys (column, ref_table, ref_column, fk_name). Only applications of ``apps`` have a report; nulls are shown as nothing, missing dates as unknown.
    """
    app = F.col("app_name")
    told = shown_findings(sql, None, ("parameters", "result_columns", "evidence"))
    marks = [
        settings.select("app_name", F.col("category").alias("mark")), sql.select("app_name", F.lit("sql").alias("mark")),
        io.select("app_name", F.when(F.col("category") == "reflection", "reflection").otherwise("io").alias("mark")),
        *[x.select("app_name", F.lit(name).alias("mark")) for x, name in ((flags, "flags"), (procedures, "procedures"), (tables, "tables")) if x is not None],
    ]
    known = ("sql_or_oracle", "local_path", "other", "sql", "io", "reflection", "flags", "procedures", "tables")
    has = reduce(DataFrame.unionByName, marks).groupBy("app_name").agg(*[F.max(F.col("mark") == m).alias(f"has_{m}") for m in known])
    heads = apps.join(has, "app_name", "left").na.fill(False, [f"has_{m}" for m in known])
    only = apps.select("app_name")
    there = lambda x: x.join(only, "app_name", "left_semi")
    when = lambda mark, yes, no=None: F.when(F.col(f"has_{mark}"), F.lit(yes)).otherwise(F.lit(no)) if no is not None else F.when(F.col(f"has_{mark}"), F.lit(yes))
    of = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    db = F.col("has_procedures") | F.col("has_tables") | (F.coalesce("db_notes", F.lit("")) != "")
    parts = [
        _lines(heads, 0, [_s("# ", app, " — Inventario automatico (borrador)"), "", f"> Generado por {generator}. {DRAFT}", ""]),
        _lines(heads, 10, [
            "## Ciclo de vida", "", _s("- **Build date** (proxy, fecha de modificacion del ensamblado): ", of("build_date")), _s("- **Last activity evidence**: ", of("activity_date")),
            _s("- **Activity source**: ", F.col("activity_source")), _s("- **Activity confidence**: ", confidence_label(F.col("activity_confidence"))), "",
        ]),
        _lines(heads, 20, [
            "## Tecnologia", "", _s("- **Lenguaje**: ", F.col("language")), _s("- **Target .NET**: ", F.col("dotnet_target")), _s("- **UI Framework**: ", listed(F.col("ui_framework"))), _s("- **Drivers de BD detectados**: ", listed(F.col("db_drivers"))),
            F.when(F.size(F.coalesce("companions", F.array().cast("array<string>"))) > 0, _s(COMPANIONS, listed(F.col("companions")))), "",
        ]),
        _lines(heads, 30, [when("flags", x) for x in ("## ⚠️ Alertas de seguridad", "", *_table("| Severidad | Descripcion | Ubicacion |"))]),
        _lines(heads, 32, [when("flags", "")]),
        _lines(heads, 40, ["## Connection strings", "", when("sql_or_oracle", _table("| Setting | Valor por defecto | Archivo | Evidencia | Confianza |")[0], NO_CONNECTIONS), when("sql_or_oracle", "|---|---|---|---|---|")]),
        _lines(heads, 50, ["", "## Rutas / archivos locales configurados", "", when("local_path", "| Setting | Valor por defecto |", NO_PATHS), when("local_path", "|---|---|")]),
        _lines(heads, 60, ["", *[when("other", x) for x in ("### Otras configuraciones", "", "| Setting | Valor por defecto |", "|---|---|")]]),
        _lines(heads, 70, [when("other", ""), "## Funciones -> SQL / Stored Procedures", "", when("sql", '<div class="table-sql-findings" markdown="1">', NO_SQL), *[when("sql", x) for x in ("", *_table(SQL_HEAD))]]),
        _lines(heads, 72, [when("sql", ""), when("sql", "</div>"), ""]),
        _lines(heads, 80, [F.when(db, "## Extraccion de esquema desde la base de datos (solo lectura)"), F.when(db, ""), F.when(F.coalesce("db_notes", F.lit("")) != "", _s("> ⚠️ No se pudo conectar a alguna(s) de las conexiones: ", F.col("db_notes"))), F.when(F.coalesce("db_notes", F.lit("")) != "", "")]),
        _lines(heads, 81, [when("procedures", "### Definiciones de Stored Procedures"), when("procedures", "")]),
        _lines(heads, 83, [when("tables", "### Esquema de tablas"), when("tables", "")]),
        _lines(heads, 90, ["## Archivos, impresoras, procesos y red en codigo", "", when("io", "| Clase | Funcion | Operacion | Detalle |", NO_IO), when("io", "|---|---|---|---|")]),
        _lines(heads, 100, ["", "## Invocacion indirecta / tardia (Reflection, COM)", "", when("reflection", REFLECTION_NOTE, NO_REFLECTION), *[when("reflection", x) for x in ("", *_table("| Clase | Funcion | API | Detalle |"))]]),
        _lines(heads, 110, [""]),
    ]

    def evidence(extractor: Column, line: Column) -> Column:
        return F.concat(F.coalesce(extractor, F.lit("")), F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(", linea "), line.cast("string"))).otherwise(""))

    found = there(settings)
    at = dict(a=F.col("file"), b=F.col("line"), c=F.col("name"))
    plain = _s("| `", F.col("name"), "` | `", cell(F.col("value")), "` |")
    parts += [
        _lines(found.filter("category = 'sql_or_oracle'"), 41, [_s(plain, " ", F.col("file"), " | ", evidence(F.col("extractor"), F.col("line")), " | ", F.col("confidence"), "% |")], **at),
        _lines(found.filter("category = 'local_path'"), 51, [plain], **at), _lines(found.filter("category = 'other'"), 61, [plain], **at),
    ]
    kind = F.when(F.col("category") == "stored_procedure", "Stored Procedure").when(F.col("category") == "oracle_package_call", "PL/SQL (Oracle)").otherwise("Query")
    quoted = lambda c, by: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("`"), cell(x), F.lit("`"))), by)
    row = _s(
        "| `", F.col("class_name"), "` | `", F.col("method"), "` | ", F.col("connection"), " | ", kind, " | ", F.coalesce(F.nullif("target", F.lit("")), F.lit("?")), " | `", cell(F.col("text")), "` | ", quoted(F.col("parameters"), "<br>"),
        " | ", quoted(F.col("result_columns"), ", "), " | ", evidence(F.lit(""), F.col("evidence.line_number")), " | ", F.coalesce("evidence.confidence", F.lit(20)), "% |",
    )
    begins = told.groupBy("app_name", "class_name", "method").agg(F.min(F.struct("file", "line")).alias("first"))
    told = there(told.join(begins, ["app_name", "class_name", "method"]))
    method = F.concat_ws(" ", "first.file", F.lpad(F.col("first.line").cast("string"), 10, "0"), "class_name", "method")
    parts.append(_lines(told, 71, [row], method, F.col("line"), F.col("text")))
    for section, category in ((91, "io"), (101, "reflection")):
        rows = there(shown_io(io)).filter(F.col("category") == category)
        parts.append(_lines(rows, section, [_s("| `", F.col("class_name"), "` | `", F.col("method"), "` | ", F.col("operation"), " | `", cell(F.col("raw")), "` |")], F.col("file"), F.col("line"), F.col("raw")))
    if flags is not None:
        line = _s("| ", F.col("severity"), " | ", cell(F.col("description")), " | ", cell(F.col("location")), " |")
        parts.append(_lines(there(flags), 31, [line], F.col("severity"), 0, F.col("description")))
    if procedures is not None:
        parts.append(_procedures(there(procedures)))
    if tables is not None:
        parts.append(_tables(there(tables)))
    return reduce(DataFrame.unionByName, parts)


def _blocks(rows: DataFrame, section: int, blocks: Column, name: Column) -> DataFrame:
    return rows.select("app_name", F.lit(section).alias("section"), name.alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c"), F.posexplode(blocks).alias("n", "line"))


def _procedures(rows: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "schema_name", "object_name")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    given = F.transform("parameters", lambda p: F.concat(F.lit("| "), text(p["name"]), F.lit(" | "), text(p.type), F.lit(" | "), F.when(F.coalesce(p.max_length, F.lit(0)) != 0, p.max_length.cast("string")).otherwise(""), F.lit(" | "), F.when(p.is_output, "Si").otherwise(""), F.lit(" | "), F.when(p.has_default, cell(p.default)).otherwise(""), F.lit(" |")))
    shape = F.transform("result_columns", lambda c: F.concat(F.lit("| "), text(c["name"]), F.lit(" | "), text(c.type), F.lit(" | "), F.when(c.nullable, "Si").otherwise("No"), F.lit(" |")))
    none = F.array().cast("array<string>")
    lines = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    good = F.concat(
        lines(_s("#### `", name, "`"), ""),
        F.when(F.size("parameters") > 0, F.concat(lines("**Parametros de entrada/salida:**", "", *_table("| Parametro | Tipo | Longitud | Salida | Default |")), given, lines(""))).otherwise(none),
        F.when(F.col("result_columns").isNull(), lines(NO_SHAPE, "")).when(F.size("result_columns") > 0, F.concat(lines("**Columnas que devuelve (determinado por SQL Server, solo lectura):**", "", *_table("| Columna | Tipo | Nulo |")), shape, lines(""))).otherwise(none),
        lines(_s("**Codigo de `", name, "`:**"), "", "```sql"), F.split(F.btrim("definition", F.lit(" \t\n\r\x0b\x0c")), "\n"), lines("```", ""),
    )
    bad = lines(_s("#### `", name, "` — no disponible (", F.col("status"), ")"), "")
    return _blocks(rows, 82, F.when((F.col("status") == "ok") & (F.coalesce("definition", F.lit("")) != ""), good).otherwise(bad), name)


def _tables(rows: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "schema_name", "table_name")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    columns = F.transform("columns", lambda c: F.concat(F.lit("| "), text(c["name"]), F.lit(" | "), text(c.type), F.lit(" | "), text(c.nullable), F.lit(" | "), F.when(F.coalesce(c.max_length, F.lit(0)) != 0, c.max_length.cast("string")).otherwise(""), F.lit(" | "), cell(c.default), F.lit(" |")))
    keys = F.transform("foreign_keys", lambda k: F.concat(F.lit("- `"), text(k.column), F.lit("` -> `"), text(k.ref_table), F.lit("."), text(k.ref_column), F.lit("` (`"), text(k.fk_name), F.lit("`)")))
    lines = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    none = F.array().cast("array<string>")
    whole = F.concat(lines(_s("#### `", name, "`"), "", *_table("| Columna | Tipo | Nulo | Longitud | Default |")), F.coalesce(columns, none), F.when(F.size("foreign_keys") > 0, F.concat(lines("", "Claves foraneas:"), keys)).otherwise(none), lines(""))
    return _blocks(rows, 84, whole, name)


def write_reports(lines: DataFrame, path: str) -> None:
    """A folder for each application with its report as one text file. An application's lines are in one range and are written as they come."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, "app_name").sortWithinPartitions("app_name", *KEYS)
    ranged.select("app_name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("app_name").text(path)
