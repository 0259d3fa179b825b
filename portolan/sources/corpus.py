"""Source trees as tables: code, configuration, project files, assemblies, logs; and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.labels import folder_class

#: Folders that hold no program of their own, by name or beginning; libraries of other makers; fixed values.
SKIPPED_FOLDERS, SKIPPED_PREFIX = ("obj", ".vs", ".git", "packages"), "logs"
THIRD_PARTY = (
    r"(?i)(?:System(\..+)?|Microsoft(\..+)?|mscorlib|netstandard|WindowsBase|PresentationCore|PresentationFramework|Newtonsoft.*|GalaSoft.*|MaterialDesign.*|CommonServiceLocator|"
    r"Oracle\..*|EntityFramework.*|log4net|NLog|Serilog.*|ICSharpCode.*|DevExpress.*|Telerik.*|ClosedXML|DocumentFormat\.OpenXml.*|EPPlus|iTextSharp.*|WindowsAPICodePack.*|Costura.*|"
    r"Antlr3.*|Autofac.*|AutoMapper.*|Castle\..*|Dapper|FluentValidation.*|Google\..*|Grpc.*|Ionic\.Zip.*|Mono\..*|Polly|protobuf-net|RestSharp|StackExchange.*|Unity(\..+)?)"
)
BUSY_ENTRIES = 500


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``, with forward slashes."""
    cut = root.rstrip("/").removeprefix("file:").replace("\\", "/")
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^.*?{_escaped(cut)}/", "")


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, modified, length`` of files below ``root`` that match and aren't empty; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select(relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified"), "length")


def texts(spark: SparkSession, root: str, pattern: str, skip: list[str] | None = None) -> DataFrame:
    """``app_name, path, text`` of files below ``root``: an application is the first folder, bytes that aren't UTF-8 are left out.

    ``skip``: second-level folders that are left out (third parties'); the filter is on the listing, so that their bytes aren't read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = relative(F.col("path"), root)
    rows = rows.withColumn("p", path).withColumn("app_name", F.substring_index("p", "/", 1)).withColumn("path", F.substring(F.col("p"), F.length("app_name") + 2, F.length("p")))
    if skip:
        rows = rows.filter(~F.substring_index("path", "/", 1).isin(skip))
    return rows.select("app_name", "path", F.regexp_replace(_valid(F.col("content").cast("string")), "^\ufeff", "").alias("text"))


def _valid(text: Column) -> Column:
    """``text`` without bytes that aren't UTF-8; valid texts stay as they are."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def code(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    return texts(spark, root, "*.cs", skip)


def configs(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    return texts(spark, root, "*.config", skip)


def target_framework(projects: DataFrame) -> DataFrame:
    """``app_name, target`` from project files (app_name, path, text): that of the first by path that names one."""
    target = F.coalesce(*[F.nullif(F.regexp_extract("text", f"<{tag}>([^<]+)</{tag}>", 1), F.lit("")) for tag in ("TargetFramework", "TargetFrameworkVersion")])
    return projects.withColumn("target", target).filter("target is not null").groupBy("app_name").agg(F.min_by("target", "path").alias("target"))


def executables(files: DataFrame) -> DataFrame:
    """Programs of a listing (path): not in skipped folders, no debugger hosts; by path."""
    folders = F.transform(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.lower)
    skipped = F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | f.startswith(SKIPPED_PREFIX))
    return files.filter(F.lower("path").endswith(".exe") & ~F.lower("path").endswith(".vshost.exe") & ~skipped).orderBy("path")


def companions(files: DataFrame, program: str) -> DataFrame:
    """Libraries beside a program that aren't a third party's."""
    folder = program.rpartition("/")[0]
    name = F.substring_index("path", "/", -1)
    beside = F.col("path") == (F.concat(F.lit(folder + "/"), name) if folder else name)
    return files.filter(beside & F.lower("path").endswith(".dll") & (F.col("path") != program) & ~F.regexp_replace(name, r"(?i)\.dll$", "").rlike(f"^(?:{THIRD_PARTY})$")).orderBy("path")


def folders(files: DataFrame, own: list[str], third_party: str = THIRD_PARTY) -> DataFrame:
    """``folder, folder_class`` of the first folders of code files."""
    rows = files.select(F.substring_index("path", "/", 1).alias("folder")).distinct()
    return rows.select("folder", folder_class(F.col("folder"), F.col("folder").isin(own), third_party).alias("folder_class"))


def project_label(path: Column) -> Column:
    """The folder above the innermost ``bin`` in a program's path, else the folder it is in; null for a bare name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    above = F.regexp_extract(F.array_join(parts, "/"), r"(?i)^(?:.*/)?([^/]+)/bin/", 1)
    return F.coalesce(F.nullif(above, F.lit("")), F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1))))


def application_name(root: Column, module: Column) -> Column:
    """``Root/Module``, or the root alone where the two are equal or there is no module."""
    return F.when(module.isNull() | (root == module), root).otherwise(F.concat_ws("/", root, module))


#: Signs of frameworks and drivers in code; fixed values.
FRAMEWORKS = {"WinForms": r"using System\.Windows\.Forms;|:\s*Form\b|:\s*UserControl\b.*System\.Windows\.Forms", "WPF": r"using System\.Windows\.Controls;|InitializeComponent\(\).*\.xaml|:\s*Window\b", "Console/Service": r"static\s+(?:async\s+)?(?:void|Task)\s+Main\s*\("}
DRIVERS = {
    "System.Data.SqlClient (SQL Server)": r"using System\.Data\.SqlClient;", "Microsoft.Data.SqlClient (SQL Server)": r"using Microsoft\.Data\.SqlClient;",
    "Oracle.ManagedDataAccess (Oracle)": r"using Oracle\.ManagedDataAccess", "Oracle.DataAccess (Oracle, unmanaged)": r"using Oracle\.DataAccess",
}


NO_FRAMEWORK, NO_DRIVER = "(no detectado)", "(ninguno detectado)"


def markers(files: DataFrame, by: str, marks: dict[str, dict[str, str]]) -> DataFrame:
    """``by`` with a sorted array for each group of ``marks`` (column: name: pattern): the names seen in any of its texts. One pass, one flag a mark."""
    seen = files.groupBy(by).agg(*[F.max(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(f"{c}.{n}") for c, of in marks.items() for n, p in of.items()])
    return seen.select(by, *[F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`{c}.{n}`"), F.lit(n)) for n in of]))).alias(c) for c, of in marks.items()])


def without_beside(names: Column, plain: str, richer: tuple[str, ...]) -> Column:
    """``names`` without the ``plain`` one where a ``richer`` one is there."""
    return F.when(F.arrays_overlap(names, F.array(*[F.lit(r) for r in richer])), F.array_remove(names, plain)).otherwise(names)


def tech_stack(files: DataFrame) -> DataFrame:
    """``app_name, ui_framework, db_drivers`` arrays, sorted; a console beside a window framework isn't named, and where nothing is seen they say so."""
    seen = markers(files, "app_name", {"ui": FRAMEWORKS, "drivers": DRIVERS})
    shown = lambda names, none: F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(none)))
    return seen.select("app_name", shown(without_beside(F.col("ui"), "Console/Service", ("WinForms", "WPF")), NO_FRAMEWORK).alias("ui_framework"), shown(F.col("drivers"), NO_DRIVER).alias("db_drivers"))


def last_activity(logs: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """``app_name, date, source, confidence`` from listings of log folders (app_name, path, modified): the newest file, the first by
    path among equals; 70 where all entries were within the limit, 60 beyond it, where only the newest of the first by path would be known.

    A folder without files is listed by itself, its path with a slash at the end: it counts where an application has nothing else (50). With
    ``apps`` (app_name), those without anything are there too: no date, ``no_evidence``, 20.
    """
    folder = F.col("path").endswith("/")
    newest = F.max(F.struct((~folder).alias("file"), "modified")).alias("m")
    found = logs.groupBy("app_name").agg(newest, F.min_by("path", F.struct(folder.alias("f"), (-F.unix_micros("modified")).alias("t"), "path")).alias("source"), F.count_if(~folder).alias("n"))
    sure = F.when(F.col("n") == 0, 50).when(F.col("n") <= BUSY_ENTRIES, 70).otherwise(60)
    out = found.select("app_name", F.date_format("m.modified", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "source", sure.alias("confidence"))
    if apps is None:
        return out
    every = apps.select("app_name").distinct().join(out, "app_name", "left")
    return every.select("app_name", "date", F.coalesce("source", F.lit("no_evidence")).alias("source"), F.coalesce("confidence", F.lit(20)).alias("confidence"))


def new_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """Folders of ``after`` that weren't in ``before`` (both: app_name, folder): those that a program's own decompiling made."""
    return after.select("app_name", "folder").distinct().join(before.select("app_name", "folder"), ["app_name", "folder"], "left_anti")


def catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``kind, name`` from a JSON list of column names, in capitals."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return rows.select(F.lit(kind).alias("kind"), F.upper(F.trim("name")).alias("name")).distinct()


#: What a SQL Server's catalog is asked for one object; fixed values of its system views.
CATALOG_SQL = {
    "definition": "SELECT OBJECT_DEFINITION(OBJECT_ID('{object}')) AS definition",
    "parameters": "SELECT p.name, t.name AS type, p.max_length, p.is_output, p.has_default_value FROM sys.parameters p JOIN sys.types t ON t.user_type_id = p.user_type_id WHERE p.object_id = OBJECT_ID('{object}')",
    "columns": "SELECT column_name, data_type, is_nullable, character_maximum_length, column_default FROM information_schema.columns WHERE table_schema = '{schema}' AND table_name = '{name}'",
    "result_set": "SELECT name, column_ordinal, system_type_name, is_nullable FROM sys.dm_exec_describe_first_result_set_for_object(OBJECT_ID('{object}'), 0)",
    "foreign_keys": "SELECT f.name AS fk_name, OBJECT_SCHEMA_NAME(f.referenced_object_id) + '.' + OBJECT_NAME(f.referenced_object_id) AS ref_table, COL_NAME(c.parent_object_id, c.parent_column_id) AS column_name, COL_NAME(c.referenced_object_id, c.referenced_column_id) AS ref_column FROM sys.foreign_keys f JOIN sys.foreign_key_columns c ON c.constraint_object_id = f.object_id WHERE f.parent_object_id = OBJECT_ID('{object}')",
}


def catalog_query(what: str, name: str, schema: str = "dbo") -> str:
    """One of ``CATALOG_SQL`` for an object, to be read by ``spark.read.jdbc``; names must be plain identifiers."""
    if not all(part.replace("_", "").isalnum() for part in (name, schema)):
        raise ValueError(f"{schema}.{name} isn't a plain name")
    return CATALOG_SQL[what].format(object=f"{schema}.{name}", schema=schema, name=name)


def catalog_rows(spark: SparkSession, url: str, what: str, name: str, schema: str = "dbo", **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=catalog_query(what, name, schema), **options).load()
