"""The decision report: what the score of each application rests on, in words. Nothing is calculated anew; texts are put together from
factors (``portfolio.contributions``), scores (``portfolio.priority``) and review states, for all applications at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.operators.portfolio import UNMATCHED, integration_labels

#: Names of factors in order, of review states, and what a factor's bucket means; fixed values.
FACTOR_LABELS = {
    "complejidad_tecnica": "Complejidad tecnica", "riesgo": "Riesgo", "dependencias": "Dependencias", "reglas_negocio": "Reglas de negocio", "complejidad_integracion": "Complejidad de integracion", "reutilizacion_potencial": "Reutilizacion potencial",
}
REVIEW_LABELS = {"borrador": "Sin revision de logica de negocio todavia", "logica_revisada": "Logica de negocio revisada", "listo_para_migrar": "Marcada como lista para migrar"}
INTERPRETATIONS = [
    ("complejidad_tecnica", "Alta", "Superficie de datos grande: muchas consultas/SP/tablas que reconstruir."),
    ("complejidad_tecnica", "Media", "Superficie de datos moderada."),
    ("complejidad_tecnica", "Baja", "Superficie de datos pequena: poco que reconstruir en la capa de datos."),
    ("riesgo", "Alta", "Concentra hallazgos de severidad alta/critica -- revisar antes de comprometer fecha de migracion."),
    ("riesgo", "Media", "Riesgo moderado, sin señales de severidad critica dominante."),
    ("riesgo", "Baja", "Sin hallazgos de riesgo relevantes detectados hasta ahora."),
    ("dependencias", "Alta", "Muy interconectada: conviene migrarla junto con las apps que comparten sus recursos, no de forma aislada."),
    ("dependencias", "Media", "Comparte algunos recursos con otras apps -- coordinar el orden de migracion."),
    ("dependencias", "Baja", "Poco o nada interconectada -- puede migrarse de forma independiente."),
    ("reglas_negocio", "Alta", "Mucho volumen documentado de logica de negocio -- probable esfuerzo funcional alto."),
    ("reglas_negocio", "Media", "Volumen medio de logica de negocio documentada."),
    ("reglas_negocio", "Baja", "Poco volumen de logica de negocio documentada hasta ahora."),
    ("complejidad_integracion", "Alta", "Depende de varias integraciones externas -- replicarlas es parte critica del esfuerzo."),
    ("complejidad_integracion", "Media", "Algunas integraciones externas a replicar."),
    ("complejidad_integracion", "Baja", "Pocas o ninguna integracion externa detectada."),
    ("reutilizacion_potencial", "Alta", "Comparte varios patrones con otras apps -- una solucion aqui es reutilizable en el resto del portafolio."),
    ("reutilizacion_potencial", "Media", "Comparte algunos patrones con otras apps."),
    ("reutilizacion_potencial", "Baja", "Poco o nada de conocimiento reutilizable detectado con otras apps todavia."),
]
NOT_YET = "No se puede interpretar todavia -- falta evidencia (ver columna Evidencia)."
ALWAYS_PENDING = ("Cantidad de usuarios", "Criticidad operacional")
#: What the conclusion says of a factor in a bucket: risks, strengths, and where there are none; fixed values.
RISKS = [
    ("riesgo", "Alta", "el riesgo (hallazgos/flags de seguridad) es alto y deberia revisarse antes de comprometer fecha de migracion"),
    ("dependencias", "Alta", "esta muy interconectada con otras apps, lo que puede forzar una migracion coordinada en vez de aislada"),
]
STRENGTHS = [
    ("reutilizacion_potencial", "Alta", "comparte patrones conocidos con otras apps, lo que abarata construir una solucion reutilizable"),
    ("complejidad_tecnica", "Baja", "su superficie tecnica de datos es pequena"),
    ("complejidad_integracion", "Baja", "no depende de integraciones externas complejas"),
]
NO_RISK, NO_STRENGTH = "no se detectaron riesgos dominantes con la evidencia disponible hoy", "ninguna fortaleza clara segun los factores calculados hoy"
CONCLUSION = "Prioridad recomendada: %s. Principal(es) riesgo(s): %s. Principal(es) fortaleza(s): %s. Pendiente de evaluar antes de decidir: %s. Estado de revision de logica de negocio: %s."
PLACED, MOVED = "Esta app quedo con prioridad **%s** (score %s).", "%s en nivel %s (%s el score en %s)"
INFLUENCE, EVEN, MISSING = (
    "El/los factor(es) con mayor influencia en el score fueron %s.", "Ningun factor tuvo un aporte distinto de cero para esta app -- valores parejos frente al resto del portafolio.",
    "Informacion que aun falta para completar la evaluacion: %s.",
)
SHARED_ASSEMBLY = "'%s' reutiliza el ensamblado '%s', tambien encontrado en: %s."


def readiness(status: Column) -> Column:
    """What a review state says; another state as it is, none as unknown."""
    return F.coalesce(F.element_at(_map(REVIEW_LABELS), status), F.nullif(status, F.lit("")), F.lit("Desconocido"))


def interpretation(factor: Column, bucket: Column) -> Column:
    """What a factor's bucket means."""
    texts = _map({f"{f} {b}": text for f, b, text in INTERPRETATIONS})
    return F.when(bucket.isNull(), NOT_YET).otherwise(F.coalesce(F.element_at(texts, F.concat_ws(" ", factor, bucket)), F.concat(F.lit("Bucket calculado: "), bucket, F.lit("."))))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def factor_rows(contributions: DataFrame) -> DataFrame:
    """``app_id, place, factor, label, bucket, raw, contribution, interpretation``: the report's table, factors in their fixed order."""
    place = F.array_position(F.array(*[F.lit(f) for f in FACTOR_LABELS]), F.col("factor"))
    return contributions.select("app_id", place.alias("place"), "factor", F.element_at(_map(FACTOR_LABELS), F.col("factor")).alias("label"), "bucket", "raw", "contribution", interpretation(F.col("factor"), F.col("bucket")).alias("interpretation"))


def _of_rules(rules: list[tuple[str, str, str]], none: str) -> Column:
    """The texts of the rules (factor, bucket, text) that hold of a group's rows, in order."""
    held = [F.max(F.when((F.col("factor") == f) & (F.col("bucket") == b), F.lit(text))) for f, b, text in rules]
    return F.coalesce(F.nullif(F.concat_ws("; ", *held), F.lit("")), F.lit(none))


def summaries(contributions: DataFrame, scores: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per application: ``app_id, app_name, priority, score, technical, integration, risk`` (buckets), ``readiness, pending`` (what still
    lacks evidence), ``narrative, conclusion``. One grouping by application; the two factors that move a score most are taken in it."""
    def bucket(factor: str) -> Column:
        return F.max(F.when(F.col("factor") == factor, F.col("bucket")))

    lacking = [F.max(F.when((F.col("factor") == f) & F.col("bucket").isNull(), F.lit(label))) for f, label in FACTOR_LABELS.items()]
    size = F.abs(F.coalesce("contribution", F.lit(0.0)))
    moved = F.format_string(MOVED, "label", "bucket", F.when(F.col("contribution") > 0, "subio").otherwise("bajo"), size.cast("string"))
    rows = factor_rows(contributions)
    moves = F.array_sort(F.collect_list(F.when(size > 0, F.struct((-size).alias("k"), "place", moved.alias("text")))))
    found = rows.groupBy("app_id").agg(
        bucket("complejidad_tecnica").alias("technical"), bucket("complejidad_integracion").alias("integration"), bucket("riesgo").alias("risk"),
        F.concat_ws(", ", *lacking, *[F.lit(x) for x in ALWAYS_PENDING]).alias("pending"), F.slice(moves, 1, 2).alias("moves"),
        _of_rules(RISKS, NO_RISK).alias("risks"), _of_rules(STRENGTHS, NO_STRENGTH).alias("strengths"),
    )
    out = apps.select("app_id", "app_name", readiness(F.col("review_status")).alias("readiness")).join(found, "app_id").join(scores.select("app_id", "score", F.col("bucket").alias("priority")), "app_id")
    led = F.array_join(F.transform("moves", lambda x: x["text"]), " y ")
    score = F.col("score").cast("string")
    narrative = F.concat_ws(" ", F.format_string(PLACED, "priority", score), F.when(F.size("moves") > 0, F.format_string(INFLUENCE, led)).otherwise(EVEN), F.format_string(MISSING, "pending"))
    conclusion = F.format_string(CONCLUSION, "priority", "risks", "strengths", "pending", "readiness")
    return out.select("app_id", "app_name", "priority", "score", "technical", "integration", "risk", "readiness", "pending", narrative.alias("narrative"), conclusion.alias("conclusion"))


def short_evidence(findings: DataFrame, tables: DataFrame, curated: DataFrame, flags: DataFrame, shared: DataFrame, io: DataFrame, members: DataFrame, contributions: DataFrame, apps: DataFrame) -> DataFrame:
    """``app_id, factor, evidence``: each factor's evidence in a line, from counts per application (of integrations, the most frequent kind first);
    a factor without evidence says so. ``shared`` as from ``portfolio.shared_resources``."""
    kind = F.format_string("%d integracion(es) de tipo '%s'", "n", "label")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label", kind.alias("text")))), lambda x: x["text"]), ", ")
    pairs = members.filter(F.col("category") != UNMATCHED).select("category", "app_name").distinct()
    known = pairs.join(pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "category").join(apps.select("app_id", "app_name"), "app_name")
    weighed = lambda x, by: x.groupBy(by).agg(F.count(F.lit(1)).alias("n_risks"), F.count_if(F.col("severity") == "critica").alias("n_critical"))
    severe = weighed(curated, "app_name").join(apps.select("app_id", "app_name"), "app_name").drop("app_name").unionByName(weighed(flags, "app_id"))
    counts = [
        findings.filter("target is not null").groupBy("app_id").agg(F.count_distinct("target").alias("n_targets")), tables.groupBy("app_id").agg(F.count_distinct("schema_name", "table_name").alias("n_tables")),
        severe.groupBy("app_id").agg(F.sum("n_risks").alias("n_risks"), F.sum("n_critical").alias("n_critical")),
        shared.select("app_id", F.col("n").alias("n_shared")),
        integration_labels(io).groupBy("app_id").agg(kinds.alias("kinds")), known.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_patterns")),
    ]
    rows = contributions.select("app_id", "factor", "raw", "bucket")
    for c in counts:
        rows = rows.join(c, "app_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_targets", "n_tables", "n_risks", "n_critical", "n_shared", "n_patterns")}
    critical = F.when(n["n_critical"] > 0, F.format_string(" (%d critico(s))", n["n_critical"])).otherwise("")
    lines = F.coalesce(F.col("raw"), F.lit(0.0)).cast("bigint")
    text = (
        F.when(F.col("raw").isNull(), "Sin evidencia disponible")
        .when(F.col("factor") == "complejidad_tecnica", F.format_string("%d consulta(s)/SP, %d tabla(s) introspectada(s)", n["n_targets"], n["n_tables"]))
        .when(F.col("factor") == "riesgo", F.when(n["n_risks"] == 0, "Sin hallazgos ni flags de seguridad detectados").otherwise(F.concat(F.format_string("%d hallazgo(s)/flag(s)", n["n_risks"]), critical)))
        .when(F.col("factor") == "dependencias", F.when(n["n_shared"] == 0, "No comparte tablas/SP ni servidor con otras apps").otherwise(F.format_string("comparte %d recurso(s) (tabla/SP/servidor) con otras apps", n["n_shared"])))
        .when(F.col("factor") == "reglas_negocio", F.format_string("%d linea(s) documentadas (proxy)", lines))
        .when(F.col("factor") == "complejidad_integracion", F.coalesce("kinds", F.lit("Sin integraciones externas detectadas")))
        .otherwise(F.when(n["n_patterns"] == 0, "No comparte patrones conocidos con otras apps").otherwise(F.format_string("comparte %d patron(es) con otras apps", n["n_patterns"])))
    )
    return rows.select("app_id", "factor", text.alias("evidence"))


def assembly_observations(companions: DataFrame, apps: DataFrame, app: int) -> DataFrame:
    """``assembly, text`` of one application: which others have an assembly of the same name. An inference, so told apart from scores. Only rows of
    the application's own assemblies are grouped."""
    named = companions.join(apps.select("app_id", "app_name"), "app_id").select("app_id", "app_name", F.trim("assembly").alias("assembly")).filter("assembly <> ''")
    mine = named.filter(F.col("app_id") == app).select("assembly", F.col("app_name").alias("own")).distinct()
    others = named.filter(F.col("app_id") != app).join(mine, "assembly").groupBy("assembly", "own").agg(F.array_join(F.array_sort(F.collect_set("app_name")), ", ").alias("names"))
    return others.select("assembly", F.format_string(SHARED_ASSEMBLY, "own", "assembly", "names").alias("text"))


def decision_report(contributions: DataFrame, scores: DataFrame, apps: DataFrame, app: int, k: int = 2) -> dict[str, DataFrame]:
    """The sections of one application's report: ``summary`` (a row) and ``factors`` in order, with the ``k`` that move the score most marked."""
    own = contributions.filter(F.col("app_id") == app)
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc(F.abs(F.coalesce("contribution", F.lit(0.0)))), "place"))
    rows = factor_rows(own).withColumn("decides", (place <= k) & (F.coalesce("contribution", F.lit(0.0)) != 0))
    return {"summary": summaries(own, scores.filter(F.col("app_id") == app), apps.filter(F.col("app_id") == app)), "factors": rows.orderBy("place")}
