"""The sheets of each application's workbook, as rows for ``sources.office``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators.report import shown_findings, shown_io
from portolan.sources.office import sheet_rows

def _named(*parts: str) -> Column:
    return F.concat_ws(".", *parts)


def _filled(c: Column) -> Column:
    """A number as text; none and nought are empty."""
    return F.when(F.coalesce(c.cast("long"), F.lit(0)) != 0, c.cast("string"))


def workbook_rows(apps: DataFrame, settings: DataFrame, sql: DataFrame, io: DataFrame, flags: DataFrame | None = None, procedures: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """``app_name, place, title, a, b, c, cells`` of each of ``apps``, from the tables that ``sectioned.report_lines`` takes.

    Five sheets are always there; those of reflection, procedures, their parameters and result columns, tables and foreign keys only where an
    application has such rows. Rows of applications that aren't in ``apps`` are left out; texts are whole.
    """
    only = apps.select("app_name").distinct()
    there = lambda x: x.join(only, "app_name", "left_semi")
    joined = lambda c, by: F.array_join(F.coalesce(c, F.array().cast("array<string>")), by)
    about = [("Lenguaje", F.col("language")), ("Target .NET", F.col("dotnet_target")), ("UI Framework", joined(F.col("ui_framework"), ", ")), ("Drivers de BD", joined(F.col("db_drivers"), ", "))]
    more = F.when(F.size(F.coalesce("companions", F.array().cast("array<string>"))) > 0, joined(F.col("companions"), ", "))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for n, v in about], F.struct(F.lit("Ensamblados adicionales decompilados").alias("field"), more.alias("value")))
    tech = apps.select("app_name", F.posexplode(F.filter(fields, lambda x: x["value"].isNotNull())).alias("n", "x"))
    parts = [sheet_rows(tech, 1, "Tecnologia", {"Campo": F.col("x.field"), "Valor": F.col("x.value")}, only, ("", F.col("n"), ""))]
    if flags is None:
        flags = only.limit(0).select("app_name", *[F.lit(None).cast("string").alias(c) for c in ("severity", "description", "location")])
    parts.append(sheet_rows(there(flags), 2, "Seguridad", {"Severidad": F.col("severity"), "Descripcion": F.col("description"), "Ubicacion": F.col("location")}, only, (F.col("severity"), 0, F.col("description"))))
    given = {"Setting": "name", "Valor por defecto": "value", "Archivo": "file", "Categoria": "category", "Extractor": "extractor", "Linea": "line", "Confianza": "confidence"}
    parts.append(sheet_rows(there(settings), 3, "Conexiones y config", {k: F.col(c) for k, c in given.items()}, only, (F.col("file"), F.col("line"), F.col("name"))))

    told = shown_findings(sql, None, ("parameters", "result_columns", "evidence"))
    begins = told.groupBy("app_name", "class_name", "method").agg(F.min(F.struct("file", "line")).alias("first"))
    told = there(told.join(begins, ["app_name", "class_name", "method"]))
    kind = F.when(F.col("category") == "stored_procedure", "Stored Procedure").when(F.col("category") == "oracle_package_call", "PL/SQL (Oracle)").otherwise("Query")
    found = {
        "Clase": F.col("class_name"), "Funcion": F.col("method"), "Conexion": F.col("connection"), "Tipo": kind, "Tabla o SP": F.coalesce(F.nullif("target", F.lit("")), F.lit("?")), "SQL / Query": F.col("text"),
        "Parametros": joined(F.col("parameters"), "\n"), "Columnas resultado": joined(F.col("result_columns"), ", "), "Extractor": F.lit(""), "Linea": _filled(F.col("evidence.line_number")), "Confianza": F.coalesce("evidence.confidence", F.lit(20)),
    }
    method = F.concat_ws(" ", "first.file", F.lpad(F.col("first.line").cast("string"), 10, "0"), "class_name", "method", "file")
    parts.append(sheet_rows(told, 4, "Funciones-SQL-SP", found, only, (method, F.col("line"), "")))

    used = there(shown_io(io))  # once per class, method and text
    reflection = used.filter("category = 'reflection'")
    for place, title, third, rows, on in ((5, "Archivos-Impresoras-Red", "Operacion", used.filter("category <> 'reflection'"), only), (6, "Reflection-COM", "API", reflection, reflection.select("app_name").distinct())):
        parts.append(sheet_rows(rows, place, title, {"Clase": F.col("class_name"), "Funcion": F.col("method"), third: F.col("operation"), "Detalle": F.col("raw")}, on, (F.col("file"), F.col("line"), "")))

    def where_any(rows: DataFrame, place: int, title: str, columns: dict[str, Column], order: tuple) -> None:
        parts.append(sheet_rows(rows, place, title, columns, rows.select("app_name").distinct(), order))

    if procedures is not None:
        name, held = _named("schema_name", "object_name").alias("name"), there(procedures)
        where_any(held.select("*", name), 7, "Definiciones SP (BD)", {"Schema.Objeto": F.col("name"), "Estado": F.col("status"), "Definicion": F.trim("definition")}, (F.col("name"), 0, ""))
        p = held.select("app_name", name, F.posexplode("parameters").alias("n", "p"))
        where_any(p, 8, "Parametros SP (BD)", {
            "Schema.Objeto": F.col("name"), "Parametro": F.col("p.name"), "Tipo": F.col("p.type"), "Longitud": _filled(F.col("p.max_length")), "Salida": F.when(F.col("p.is_output"), "Si"), "Default": F.when(F.col("p.has_default"), F.col("p.default")),
        }, (F.col("name"), F.col("n"), ""))
        p = held.select("app_name", name, F.posexplode("result_columns").alias("n", "p"))
        where_any(p, 9, "Columnas resultado SP (BD)", {"Schema.Objeto": F.col("name"), "Columna": F.col("p.name"), "Tipo": F.col("p.type"), "Nulo": F.when(F.col("p.nullable"), "Si").otherwise("No")}, (F.col("name"), F.col("n"), ""))
    if tables is not None:
        name, held = _named("schema_name", "table_name").alias("name"), there(tables)
        p = held.select("app_name", name, F.posexplode("columns").alias("n", "p"))
        where_any(p, 10, "Esquema tablas (BD)", {"Tabla": F.col("name"), "Columna": F.col("p.name"), "Tipo": F.col("p.type"), "Nulo": F.col("p.nullable"), "Longitud": _filled(F.col("p.max_length")), "Default": F.col("p.default")}, (F.col("name"), F.col("n"), ""))
        p = held.select("app_name", name, F.posexplode("foreign_keys").alias("n", "p"))
        where_any(p, 11, "Claves foraneas (BD)", {"Tabla": F.col("name"), "Columna": F.col("p.column"), "Tabla referida": F.col("p.ref_table"), "Columna referida": F.col("p.ref_column"), "FK": F.col("p.fk_name")}, (F.col("name"), F.col("n"), ""))
    return reduce(DataFrame.unionByName, parts)
