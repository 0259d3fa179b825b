"""Labels by first matching rule, and the small dimensions behind them. All lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.textops import first_match

SEVERITY_WEIGHT = {"critica": 3, "alta": 2, "media": 1, "info": 0}
SEVERITY_RANK = {"critica": 0, "alta": 1, "media": 2, "info": 3}
FACTOR_WEIGHTS = {"riesgo": 2.0, "dependencias": 1.5, "reutilizacion_potencial": 0.5, "reglas_negocio": 0.5, "complejidad_tecnica": -0.5, "complejidad_integracion": -0.5}
BUCKETS = {"Baja": 0, "Media": 1, "Alta": 2}
ROLES = ("productor_numerico", "productor_passfail", "consumidor_medicion", "consumidor_resultado", "consumidor_general", "mixto", "indeterminado")
IO_LABELS = [(r"^(File|Directory|Stream)", "Archivos"), ("Http|WebClient|WebRequest", "Red / HTTP"), ("Print", "Impresion"), ("SerialPort", "Puerto serial"), (r"Process\.Start", "Proceso externo"), ("SmtpClient", "Correo (SMTP)")]
DEFAULT_CONFIDENCE = 20


def setting_category(value: Column, marked: Column) -> Column:
    """sql_or_oracle, local_path or other; a setting marked as a connection is one."""
    return F.when(marked | value.rlike(r"(?i)(Server|Data Source|Database|User Id|UID)\s*="), "sql_or_oracle").when(value.rlike(r"^([A-Za-z]:\\|\\\\|/)"), "local_path").otherwise("other")


def folder_class(folder: Column, owned: Column, third_party: str) -> Column:
    """Whether a folder is the application's own, a known third party's (the whole name matches), or unknown."""
    return F.when(owned, "APPLICATION").when(folder.rlike(f"^(?:{third_party})$"), "THIRD_PARTY").otherwise("UNKNOWN_COMPANION")


def io_label(operation: Column) -> Column:
    """The group of an input or output operation in scores."""
    return first_match(F.coalesce(operation, F.lit("")), IO_LABELS, "Otro")


#: Resources in diagrams: other groups than in scores, by what stands in the operation; fixed values.
DIAGRAM_LABELS = [
    (r"File\.|Directory\.|StreamReader|StreamWriter|FileStream|DirectoryInfo", "Archivos / carpetas"),
    ("PrintDocument|PrintDialog|PrinterSettings|BarTender|PrintOut", "Impresora"),
    ("SerialPort", "Puerto serial"),
    ("ModbusClient", "PLC / Modbus"),
    (r"Process\.Start", "Proceso externo"),
    ("HttpClient|WebClient|HttpWebRequest|WebRequest|SmtpClient", "Red (HTTP/SMTP)"),
]


def diagram_label(operation: Column, category: Column) -> Column:
    """The group of an operation in diagrams; findings of the category ``reflection`` have one of their own whatever they call."""
    return F.when(category == "reflection", "Reflection / COM").otherwise(first_match(F.coalesce(operation, F.lit("")), DIAGRAM_LABELS, "Otro I/O"))


def confidence_label(value: Column) -> Column:
    return F.when(value.isNull() | (value <= 20), "unknown").when(value < 55, "low").when(value < 70, "medium").otherwise("high")


def looked_up(frame: DataFrame, key: str, dimension: DataFrame, default: int = DEFAULT_CONFIDENCE) -> DataFrame:
    """``frame`` with ``confidence`` by ``key`` from a dimension (key, confidence); ``default`` where it has none."""
    of = dimension.select(F.col("key").alias("_k"), F.col("confidence").alias("_c"))
    return frame.join(of, F.col(key) == F.col("_k"), "left").withColumn("confidence", F.coalesce("_c", F.lit(default))).drop("_k", "_c")


def severity_weight(severity: Column) -> Column:
    """The weight of a severity; 0 for an unknown one."""
    return _mapped(severity, SEVERITY_WEIGHT, 0)


def severity_rank(severity: Column) -> Column:
    return _mapped(severity, SEVERITY_RANK, 99)


def _mapped(key: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def role_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ROLES)), "place int, role string")


#: Signs in a connection string.
PASSWORD = r"(?i)(password|pwd)\s*=\s*([^;]+)"
PLACEHOLDER = r"^[a-z]{4,10}$"
CONCATENATED = r'"\s*\+\s*\w|\+\s*"'


def has_password(value: Column) -> Column:
    return F.trim(F.regexp_extract(value, PASSWORD, 2)) != ""


def is_placeholder(value: Column) -> Column:
    return F.trim(value).rlike(PLACEHOLDER)


def maybe_injected(category: Column, text: Column) -> Column:
    """A query put together from strings, without parameters."""
    return (category == "query") & text.rlike(CONCATENATED) & ~F.contains(text, F.lit("@"))


def reason_of(frame: DataFrame, code: str, catalog: DataFrame, fallback: str = "UNKNOWN") -> DataFrame:
    """``frame`` with ``reason`` and ``action`` of a failure code from a catalog (code, reason, action); the ``fallback`` row's for others."""
    of = catalog.select(F.col("code").alias("_code"), F.col("reason").alias("_reason"), F.col("action").alias("_action"))
    other = catalog.filter(F.col("code") == fallback).select("reason", "action").first()
    out = frame.join(of, F.col(code) == F.col("_code"), "left")
    return out.withColumns({"reason": F.coalesce("_reason", F.lit(other["reason"] if other else fallback)), "action": F.coalesce("_action", F.lit(other["action"] if other else None))}).drop("_code", "_reason", "_action")


#: How sure each kind of evidence is; fixed values.
CONFIDENCE = {
    "DB_INTROSPECT_DEFINITION": 100, "DB_INTROSPECT_SCHEMA": 100, "APP_CONFIG_EXPLICIT_CONNECTION": 98, "SETTINGS_DEFAULT_VALUE": 95, "HARDCODED_METHOD_LITERAL": 90, "SETTINGS_CLASS_LITERAL": 85,
    "PARTIAL_RECONSTRUCTION": 80, "REGEX_KEYWORD_MATCH": 70, "INFERRED": 60, "DYNAMIC_SQL": 40, "REFLECTION": 40,
    "FILE_LOG_FILE_MTIME_EXHAUSTIVE": 70, "FILE_LOG_FILE_MTIME_BOUNDED": 60, "FILE_LOG_FOLDER_MTIME": 50,
    "CONNECTION_CTOR_DIRECT_SETTING": 95, "CONNECTION_AMBIGUOUS_CONDITIONAL": 55, "DATA_ROLE_COLUMNS_FROM_RESULT_COLUMNS": 90, "DATA_ROLE_COLUMNS_FROM_LITERAL_SQL": 80,
    "APP_STRUCTURE_ENTRY_POINT_APPLICATION_RUN": 95, "APP_STRUCTURE_ENTRY_POINT_WPF_APP_RUN": 90, "APP_STRUCTURE_ENTRY_POINT_BARE_MAIN": 70, "APP_STRUCTURE_CLASS_DECLARATION": 90, "APP_STRUCTURE_METHOD_DECLARATION": 85,
    "APP_NAVIGATION_INSTANTIATION_AND_SHOW": 90, "APP_NAVIGATION_TARGET_TYPE_UNKNOWN": 30, "APP_NAVIGATION_TARGET_NOT_CONFIRMED_SCREEN": 50, "APP_EVENT_WIRING_EXPLICIT": 95, "APP_EVENT_WIRING_HANDLER_UNKNOWN": 40,
    "APP_CALL_INTRA_CLASS": 90, "APP_CALL_TARGET_AMBIGUOUS": 40, "APP_CALL_TARGET_INHERITED": 50, "APP_CALL_TARGET_UNKNOWN": 30,
    "APP_DATA_METHOD_SQL_DIRECT": 90, "APP_DATA_METHOD_SQL_MAPPING_AMBIGUOUS": 30, "APP_DATA_INDIRECT_VIA_CALL_FLOW": 70, "APP_CONTROL_DECLARATION_AND_TYPE": 90, "APP_CONTROL_LABEL_TEXT": 90, "APP_CONTROL_TYPE_UNKNOWN": 30,
    "UNKNOWN": 20,
}

#: Why something wasn't resolved: code, category, severity, what users read, what to do; fixed values.
FAILURES = [
    ("DYNAMIC_SQL", "sql", "media", "SQL armado dinamicamente -- no se pudo determinar el texto completo.", "Revisar el codigo manualmente para confirmar el texto real de la consulta."),
    ("REFLECTION", "integration", "media", "Se detecto invocacion via Reflection -- el analisis estatico puede estar incompleto.", "Confirmar manualmente que metodos/tipos se invocan en tiempo de ejecucion."),
    ("SERVER_UNAVAILABLE", "connection", "alta", "Servidor {server} no disponible -- no se pudo conectar.", "Confirmar con infraestructura si el servidor sigue activo, o actualizar la connection string al reemplazo conocido."),
    ("UNRESOLVED_VARIABLE", "sql", "alta", "No se pudo resolver el valor de la variable -- declarada fuera del metodo actual.", "Revisar el codigo fuente manualmente para confirmar el valor real."),
    ("MISSING_SOURCE", "unknown", "info", "No se encontro la fuente de esta configuracion.", "Confirmar que la decompilacion incluyo todos los ensamblados relevantes (companion assemblies)."),
    ("UNKNOWN", "unknown", "info", "Causa no determinada.", "Revisar manualmente -- este es el residual honesto, no una clasificacion real."),
]


def confidence_dimension(spark: SparkSession) -> DataFrame:
    """``key, confidence`` of every kind of evidence, to look up with ``looked_up``."""
    return spark.createDataFrame(list(CONFIDENCE.items()), "key string, confidence int")


def failure_catalog(spark: SparkSession) -> DataFrame:
    """``code, category, severity, reason, action``, to look up with ``reason_of``."""
    return spark.createDataFrame(FAILURES, "code string, category string, severity string, reason string, action string")
