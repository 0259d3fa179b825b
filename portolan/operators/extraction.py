"""Facts of C# files as DataFrames: read per file, then resolved by joins.

``files`` has (app_name, path, text); null texts count as empty. The reading is one pass of Python over each file's lines behind a cheap
filter; what depends on other files is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.labels import setting_category
from portolan.functions.sqltext import with_classes
from portolan.operators.csharp import FORMS, WINDOWS, Source, config_settings
from portolan.operators.tracing import CONNECTIONS
from portolan.sources.store import grown

FINDING = "app_name string, file string, found string, line int, class_name string, method string, kind string, raw string, resolved string, confidence int, source_line int, procedure boolean, parameters array<string>, result_columns array<string>"
FACT = "app_name string, file string, fact string, line int, class_name string, method string, a string, b string"
#: Files without any of these have no findings.
HINTS = r"SqlConnection|OracleConnection|SqlCommand|OracleCommand|CommandText|File|Directory|Stream|Process\.Start|Print|SerialPort|Http|Web|Smtp|BarTender|Modbus|Activator|GetTypeFromCLSID|Invoke"


def _read(files: DataFrame, schema: str, rows: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in target]
            for app, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for row in rows(path or "", text or ""):
                    for column, value in zip(out, (app, path, *row)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    return files.select("app_name", "path", "text").mapInArrow(run, schema)


def raw_findings(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in FINDING.split(", ")[2:]]

    def rows(path: str, text: str) -> Iterator[tuple]:
        for f in Source(path, text).findings():
            yield tuple(f.get(n) for n in names)

    return _read(with_hints(files), FINDING, rows)


def with_hints(files: DataFrame) -> DataFrame:
    """The files that may have findings."""
    return files.filter(~F.regexp_extract("path", r"[^\\/]*$", 0).contains("Settings") & F.col("text").rlike(HINTS))


def sql_findings(files: DataFrame) -> DataFrame:
    """SQL commands with what they run: category, target, parameters, columns that are read, and where the text comes from."""
    return sql_of(raw_findings(files))


def sql_of(found: DataFrame) -> DataFrame:
    """The SQL commands of ``raw_findings``."""
    rows = found.filter("found = 'sql'")
    text = F.coalesce(F.nullif("resolved", F.lit("")), "raw")
    rows = with_classes(rows, text, F.col("procedure"), F.col("kind").isin(*CONNECTIONS))
    evidence = F.struct(F.when(F.col("resolved").isNotNull(), F.col("file")).alias("source_file"), F.col("source_line").alias("line_number"), F.coalesce("confidence", F.lit(20)).alias("confidence"))
    return rows.select("app_name", "file", "line", "class_name", "method", "kind", "raw", "resolved", "c.category", "c.target", F.col("c.is_procedure").alias("is_stored_procedure"), "parameters", "result_columns", evidence.alias("evidence"))


def io_findings(files: DataFrame) -> DataFrame:
    return io_of(raw_findings(files))


def io_of(found: DataFrame) -> DataFrame:
    """Input, output and reflection of ``raw_findings``."""
    rows = found.filter("found <> 'sql'")
    return rows.select("app_name", "file", "line", "class_name", "method", F.col("kind").alias("operation"), "raw", F.col("found").alias("category"))


def facts(files: DataFrame) -> DataFrame:
    """Everything structural that single files say (``FACT``); store it (``store.stored``) where several of the functions below are used."""
    return _read(files, FACT, lambda path, text: Source(path, text).structure())


def classes(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("a").isin(*FORMS), "form").when(F.col("a").isin(*WINDOWS), "window").otherwise("class")
    return rows.filter("fact = 'class'").select("app_name", "file", "line", "class_name", F.col("b").alias("namespace"), F.col("a").alias("base_type"), kind.alias("class_type"))


def methods(rows: DataFrame) -> DataFrame:
    return rows.filter("fact = 'method'").select("app_name", "file", "line", "class_name", "method", F.col("a").alias("signature"))


def entry_points(rows: DataFrame) -> DataFrame:
    sure = F.when(F.col("a") == "application_run", 95).when(F.col("a") == "wpf_app_run", 90).otherwise(70)
    return rows.filter("fact = 'entry'").select("app_name", "file", "line", "class_name", "method", F.col("a").alias("pattern"), sure.alias("confidence"))


def navigation(rows: DataFrame) -> DataFrame:
    """Screens shown: resolved where the type is a screen of the application, else what is missing."""
    screens = classes(rows).filter("class_type <> 'class'").select("app_name", F.col("class_name").alias("a"), F.lit(True).alias("known")).distinct()
    shown = rows.filter("fact = 'show'").join(grown(screens), ["app_name", "a"], "left")
    status = F.when(F.col("a").isNull(), "unresolved_navigation_target_unknown").when(F.col("known"), "resolved").otherwise("unresolved_target_not_a_known_screen")
    return shown.select("app_name", "file", "line", "class_name", "method", F.col("a").alias("target_class"), F.col("b").alias("operation"), status.alias("status"), F.when(F.col("a").isNull(), 30).when(F.col("known"), 90).otherwise(50).alias("confidence"))


def event_wirings(rows: DataFrame) -> DataFrame:
    return rows.filter("fact = 'wiring'").select("app_name", "file", "line", "class_name", F.substring_index("method", ".", 1).alias("control"), F.substring_index("method", ".", -1).alias("event"), F.col("a").alias("handler"), F.col("b").alias("status"))


def calls(rows: DataFrame) -> DataFrame:
    """Unqualified calls: to the only method of that name in the class, to one of several, to an inherited one, or unknown. Names
    are counted within a file, so that copies of a file aren't overloads."""
    named = rows.filter("fact = 'method'").groupBy("app_name", "file", "class_name", F.col("method").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    base = rows.filter("fact = 'class'").groupBy("app_name", "class_name").agg(F.min_by("a", F.struct("file", "line")).alias("base")).filter("base is not null")
    inherited = rows.filter("fact = 'method'").select("app_name", F.col("class_name").alias("base"), F.col("method").alias("a")).distinct()
    inherited = base.join(grown(inherited), ["app_name", "base"]).select("app_name", "class_name", "a", F.lit(True).alias("above"))
    made = rows.filter("fact = 'call'").join(grown(named), ["app_name", "file", "class_name", "a"], "left").join(grown(inherited), ["app_name", "class_name", "a"], "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "unresolved_call_target_ambiguous").when(F.col("above"), "unresolved_call_target_inherited").otherwise("unresolved_call_target_unknown")
    return made.select("app_name", "file", "line", "class_name", F.col("method").alias("caller"), F.when(status != "unresolved_call_target_unknown", F.col("a")).alias("target_method"), status.alias("resolution_status"))


def controls(rows: DataFrame) -> DataFrame:
    return rows.filter("fact = 'control'").select("app_name", "file", "line", "class_name", F.col("method").alias("control"), F.col("a").alias("control_type"), F.col("b").alias("label"), F.when(F.col("a").isNull(), "unresolved_control_type_unknown").otherwise("resolved").alias("status"))


def unknowns(rows: DataFrame) -> DataFrame:
    """What can't be seen in source: the events and controls of each window defined in markup."""
    reasons = F.array(F.lit("wpf_event_wiring_not_observable_in_cs"), F.lit("wpf_control_surface_not_observable_in_cs"))
    return classes(rows).filter("class_type = 'window'").select("app_name", "class_name", "file", F.explode(reasons).alias("reason"))


def first_values(rows: DataFrame, by: list[str], rank: str, order: list[str]) -> DataFrame:
    """``rows`` (by, value, ``rank``, …) without those whose trimmed ``value`` one of a lower rank has in their ``by``: all of rank 0 stay, and of
    the others the first of each value in ``order``."""
    rows = rows.withColumn("_v", F.trim("value"))
    used = rows.filter(F.col(rank) == 0).select(*by, "_v").distinct()
    rest = rows.filter(F.col(rank) > 0).join(grown(used), [*by, "_v"], "left_anti")
    key, cols = [*by, "_v"], [c for c in rows.columns if c not in by and c not in order and c != "_v"]
    first = rest.groupBy(*key).agg(F.min(F.struct(*order, *cols)).alias("x"))
    kept = first.select(*by, *[F.col(f"x.{c}").alias(c) for c in [*order, *cols]])
    return rows.filter(F.col(rank) == 0).select(*kept.columns).unionByName(kept)


def settings(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Settings of code and of configuration files; of equal trimmed values in an application the first one stays, code first."""
    schema = "app_name string, file string, line int, name string, value string, marked boolean"
    code = _read(files.filter(F.col("path").contains("Settings")), schema, lambda path, text: Source(path, text).settings())
    xml = _read(configs, schema, lambda path, text: ((line, n, v, True) for line, n, v in config_settings(text)))
    both = code.withColumn("rank", F.lit(0)).unionByName(xml.withColumn("rank", F.lit(1)))
    kept = first_values(both, ["app_name"], "rank", ["rank", "file", "line", "name"])
    return kept.select("app_name", "file", "line", "name", "value", "marked", setting_category(F.col("value"), F.col("marked")).alias("category"))
