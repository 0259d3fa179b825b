"""The portfolio as a whole: shared tables and servers, recurring patterns, factors, terciles and priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.labels import BUCKETS, FACTOR_WEIGHTS, confidence_label, io_label, severity_rank, severity_weight
from portolan.functions.sqltext import server_of
from portolan.operators.cooccurrence import degrees, pair_counts, pairs
from portolan.sources.store import stored

UNMATCHED = "Sin categorizar"

#: Categories of curated findings and what their texts say; fixed values.
PATTERN_CATEGORIES = [
    ("Inyeccion SQL / concatenacion sin parametros", r"(?i)sql injection|inyecci[oó]n sql|concatenaci[oó]n(?:\s+de\s+strings?)?\s*(?:sin|,)"),
    ("Credenciales en texto plano / hardcodeadas", r"(?i)texto plano|hardcode|password.*(claro|visible)"),
    ("Manejo de errores silencioso", r"(?i)silenc|catch\s+vac[ií]|traga(?:das|n)?\s+excepci|oculta.*(fall|error)"),
    ("Riesgo de caida por timer/thread sin manejo de excepciones", r"(?i)timer.*sin manejo|riesgo de (ca[ií]da|crash)|async void"),
    ("Codigo muerto / nunca invocado", r"(?i)c[oó]digo muerto|nunca (se usa|invocad|se invoca)|sin usar|hu[eé]rfan|inalcanzable"),
    ("Falta de transaccion / atomicidad", r"(?i)sin transacci[oó]n|atomicidad|TransactionScope"),
    ("Certificacion de operador nunca validada", r"(?i)certificaci[oó]n.*(nunca|no se valid)|cert_end_date"),
    ("Falso exito / perdida silenciosa de datos", r"(?i)falso.?exito|p[eé]rdida silenciosa|no inserta nada"),
    ("Autenticacion debil / sin re-verificar permisos", r"(?i)autenticaci[oó]n d[eé]bil|sin (volver a pedir|password de supervisor)|no distingue nivel"),
    ("Contaminacion de decompilacion (proyecto ajeno)", r"(?i)contaminad|Roslyn Compiler Server"),
    ("Bypass de autorizacion / control de permisos ausente", r"(?i)bypass|sin.*(autorizaci[oó]n|control de permisos)"),
]
#: States of a review that count as reviewed; fixed values.
REVIEWED = ("logica_revisada", "listo_para_migrar")


# ---- dictionary and dependencies


def table_dictionary(tables: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per (schema, table): applications in order of name, number of rows, whether their columns agree, the
    alphabetically first variant of columns. ``tables``: app_id, schema_name, table_name, columns_json."""
    named = tables.join(apps.select("app_id", "app_name"), "app_id")
    variant = F.coalesce("columns_json", F.lit(""))
    return named.groupBy("schema_name", "table_name").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("app_name", "app_id"))), lambda x: x["app_name"])).alias("apps"),
        F.count(F.lit(1)).alias("app_count"), (F.count_distinct(variant) <= 1).alias("schema_consistent"), F.min(variant).alias("columns"),
    )


def table_edges(findings: DataFrame) -> DataFrame:
    """``app_a, app_b, resource``: pairs of applications on one target, by ascending id. Only the first one's finding must
    be a query or a procedure. A target of very many applications is joined by tiles (``cooccurrence``)."""
    named = findings.filter("target is not null").select("target", "app_id", F.col("category").isin("query", "stored_procedure").alias("q"))
    sides = named.groupBy(F.col("target").alias("key"), F.col("app_id").alias("member")).agg(F.max("q").alias("q"))
    met = pairs(sides.filter("q"), sides)
    return met.filter("b > a").select(F.col("a").alias("app_a"), F.col("b").alias("app_b"), F.col("key").alias("resource"))


def shared_resources(findings: DataFrame, settings: DataFrame, apps: DataFrame) -> DataFrame:
    """``app_id, n``: how many of ``table_edges`` and ``server_edges`` each application is an end of, counted without the edges; stored, as it is used several times."""
    targets = findings.filter("target is not null").select(F.col("target").alias("key"), F.col("app_id").alias("member"), F.col("category").isin("query", "stored_procedure").alias("first"))
    named = _servers(settings, apps)
    sizes = named.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    servers = named.join(sizes, "key").select(F.col("member.app_id").alias("member"), "n")
    return stored(degrees(targets).unionByName(servers).groupBy(F.col("member").alias("app_id")).agg(F.sum("n").alias("n")))


def _servers(settings: DataFrame, apps: DataFrame) -> DataFrame:
    """``key, member``: each database server with the name and id of the applications on it, once."""
    rows = settings.filter("category = 'sql_or_oracle'").select("app_id", server_of(F.col("value")).alias("server")).filter("server is not null").distinct()
    return rows.join(apps.select("app_id", "app_name").distinct(), "app_id").select(F.col("server").alias("key"), F.struct("app_name", "app_id").alias("member"))


def server_edges(settings: DataFrame, apps: DataFrame) -> DataFrame:
    """``app_a, app_b, resource``: pairs of applications on one database server, by name (then id)."""
    named = _servers(settings, apps)
    return pairs(named, named).filter("a < b").select(F.col("a.app_id").alias("app_a"), F.col("b.app_id").alias("app_b"), F.col("key").alias("resource"))


# ---- patterns


def pattern_members(findings: DataFrame, patterns: list[tuple[str, str]] = PATTERN_CATEGORIES) -> DataFrame:
    """Each finding (id, app_name, title, description) once per category whose pattern it has; ``UNMATCHED`` with none. One
    pass over the text: the categories are an array built beside it."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    found = F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns]), lambda c: c.isNotNull())
    return findings.select("id", "app_name", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNMATCHED)))).alias("category"))


def pattern_catalog(members: DataFrame) -> DataFrame:
    """Findings and applications per category: the unmatched last, then by descending count, then by first appearance."""
    n = members.groupBy("category").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("app_name").alias("n_apps"), F.min("id").alias("first_id"))
    return n.orderBy(F.col("category") == UNMATCHED, F.desc("n_findings"), "first_id")


# ---- factors: (app_id, factor, raw); raw is null where there is no evidence


def _factor(rows: DataFrame, apps: DataFrame, name: str, missing=0) -> DataFrame:
    """``rows`` (app_id, raw) for every application; ``missing`` for one without rows."""
    return apps.select("app_id").join(rows, "app_id", "left").select("app_id", F.lit(name).alias("factor"), F.coalesce("raw", F.lit(missing)).cast("double").alias("raw"))


def complexity(findings: DataFrame, tables: DataFrame, apps: DataFrame) -> DataFrame:
    """Distinct targets and distinct tables an application touches."""
    a = findings.filter("target is not null").groupBy("app_id").agg(F.count_distinct("target").alias("n"))
    b = tables.groupBy("app_id").agg(F.count_distinct("schema_name", "table_name").alias("n"))
    return _factor(a.unionByName(b).groupBy("app_id").agg(F.sum("n").alias("raw")), apps, "complejidad_tecnica")


def sample_targets(findings: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` targets of each application by name."""
    place = F.row_number().over(Window.partitionBy("app_id").orderBy("target"))
    top = findings.filter("target is not null").select("app_id", "target").distinct().withColumn("p", place).filter(F.col("p") <= k)
    return top.groupBy("app_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("target"))).alias("targets"))


def risk(curated: DataFrame, flags: DataFrame, apps: DataFrame) -> DataFrame:
    """Weights of severities: findings join by name, automatic flags by id."""
    named = curated.groupBy("app_name").agg(F.sum(severity_weight(F.col("severity"))).alias("raw"))
    a = apps.select("app_id", "app_name").join(named, "app_name").select("app_id", "raw")
    b = flags.groupBy("app_id").agg(F.sum(severity_weight(F.col("severity"))).alias("raw"))
    return _factor(a.unionByName(b).groupBy("app_id").agg(F.sum("raw").alias("raw")), apps, "riesgo")


def dependencies(shared: DataFrame, apps: DataFrame) -> DataFrame:
    """Edges at either end; ``shared`` as from ``shared_resources``."""
    return _factor(shared.select("app_id", F.col("n").alias("raw")), apps, "dependencias")


def business_rules(apps: DataFrame) -> DataFrame:
    """Lines with text in the review notes; no evidence while the review is a draft."""
    lines = F.size(F.filter(F.split(F.coalesce("review_notes", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return apps.select("app_id", F.lit("reglas_negocio").alias("factor"), F.when(F.col("review_status") != "borrador", lines).cast("double").alias("raw"))


def integrations(io: DataFrame, apps: DataFrame) -> DataFrame:
    return _factor(io.groupBy("app_id").agg(F.count(F.lit(1)).alias("raw")), apps, "complejidad_integracion")


def integration_labels(io: DataFrame) -> DataFrame:
    """``app_id, label, n`` of input and output operations."""
    return io.groupBy("app_id", io_label(F.col("operation")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def reuse(members: DataFrame, apps: DataFrame) -> DataFrame:
    """Over the categories an application shares with others, the number of those others."""
    pairs = members.filter(F.col("category") != UNMATCHED).select("category", "app_name").distinct()
    n = pairs.groupBy("category").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    raw = pairs.join(n, "category").groupBy("app_name").agg(F.sum("others").alias("raw"))
    return _factor(apps.select("app_id", "app_name").join(raw, "app_name").select("app_id", "raw"), apps, "reutilizacion_potencial")


# ---- terciles and score


def terciles(values: DataFrame, by: list[str], value: str = "raw") -> DataFrame:
    """``values`` with ``bucket`` (Baja, Media, Alta) among all of ``by``.

    The limits are the values at a third and two thirds of the ascending order, counted from nought; values up to a
    limit are under it, so that ties share a bucket. All are Baja where the largest is 0; null has no bucket and doesn't count.

    The order is over distinct values with their counts, so that the sort is as long as the values differ.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*by)
    counts = counts.withColumns({"upto": F.sum("n").over(within.orderBy(value)), "total": F.sum("n").over(within), "top": F.max(value).over(within)})

    def limit(k: int) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * k / 3), F.col(value)))

    limits = counts.groupBy(*by).agg(limit(1).alias("low"), limit(2).alias("mid"), F.first("top").alias("top"))
    bucket = F.when(F.col(value).isNull(), None).when((F.col("top") == 0) | (F.col(value) <= F.col("low")), "Baja").when(F.col(value) <= F.col("mid"), "Media").otherwise("Alta")
    if not by:
        limits, by = limits.withColumn("_one", F.lit(1)), ["_one"]
        values = values.withColumn("_one", F.lit(1))
    return values.join(limits, by, "left").withColumn("bucket", bucket).drop("low", "mid", "top", "_one")


def ordinal(bucket: Column) -> Column:
    out = None
    for name, k in BUCKETS.items():
        out = F.when(bucket == name, k) if out is None else out.when(bucket == name, k)
    return out


def weight_of(factor: Column) -> Column:
    out = None
    for name, w in FACTOR_WEIGHTS.items():
        out = F.when(factor == name, w) if out is None else out.when(factor == name, w)
    return out.otherwise(0.0)


def contributions(factors: list[DataFrame]) -> DataFrame:
    """All factors in long form with bucket and contribution to the score."""
    rows = terciles(reduce(DataFrame.unionByName, factors), ["factor"])
    return rows.withColumn("contribution", weight_of(F.col("factor")) * ordinal(F.col("bucket")))


def priority(rows: DataFrame, analyzed: DataFrame | None = None) -> DataFrame:
    """``app_id, score, n_factors, bucket``, the highest score first, then the newest analysis where ``analyzed`` (app_id, analyzed_at) is
    given; a factor without evidence adds nothing."""
    score = rows.groupBy("app_id").agg(F.round(F.coalesce(F.sum("contribution"), F.lit(0.0)), 2).alias("score"), F.count("bucket").alias("n_factors"))
    out = terciles(score, [], "score")
    if analyzed is None:
        return out.orderBy(F.desc("score"), "app_id")
    return out.join(analyzed.select("app_id", "analyzed_at"), "app_id", "left").orderBy(F.desc("score"), F.desc_nulls_last("analyzed_at"), "app_id").drop("analyzed_at")


def top_contributions(rows: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` factors that move each application's score most, either way."""
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc(F.abs("contribution")), "factor"))
    return rows.filter("contribution <> 0").withColumn("place", place).filter(F.col("place") <= k).select("app_id", "place", "factor", "contribution")


# ---- lists


def listing(apps: DataFrame, procedures: DataFrame, tables: DataFrame) -> DataFrame:
    """Applications with their number of procedures and tables, and whether neither was found."""
    p = procedures.groupBy("app_id").agg(F.count(F.lit(1)).alias("sp_count"))
    t = tables.groupBy("app_id").agg(F.count(F.lit(1)).alias("table_count"))
    out = apps.join(p, "app_id", "left").join(t, "app_id", "left")
    sp, n = F.coalesce("sp_count", F.lit(0)), F.coalesce("table_count", F.lit(0))
    return out.select("app_id", "app_name", sp.alias("sp_count"), n.alias("table_count"), ((sp == 0) & (n == 0)).alias("none_found"))


def findings_with_apps(curated: DataFrame, apps: DataFrame) -> DataFrame:
    """All findings by severity, application and id; those of applications that aren't there too."""
    of = apps.select(F.col("app_name").alias("_name"), "app_id")
    return curated.join(of, F.col("app_name") == F.col("_name"), "left").select("id", "app_name", "app_id", "severity", severity_rank(F.col("severity")).alias("rank")).orderBy("rank", "app_name", "id")


def sidebar(apps: DataFrame) -> DataFrame:
    """Families by the name before its first slash: members, reviewed ones, newest analysis; a family of one isn't grouped."""
    family = F.substring_index("app_name", "/", 1)
    out = apps.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("review_status").isin(*REVIEWED)).alias("reviewed"), F.max("analyzed_at").alias("newest"))
    return out.withColumn("grouped", F.col("members") >= 2)


def search(rows: DataFrame, column: str, term: str, shown: list[str]) -> DataFrame:
    """Distinct ``shown`` of rows whose ``column`` has ``term`` in it; letters in either case, % and _ as wildcards."""
    return rows.filter(F.col(column).ilike(f"%{term}%")).select(*shown).distinct().orderBy(*shown)


def shared_companions(companions: DataFrame) -> DataFrame:
    """``app_a, app_b, n_shared``: assemblies (app_id, assembly) that two applications have in common."""
    rows = companions.select(F.col("assembly").alias("key"), F.col("app_id").alias("member"))
    return pair_counts(rows, rows, ascending=True).select(F.col("a").alias("app_a"), F.col("b").alias("app_b"), F.col("n").alias("n_shared"))


def snapshot_metrics(rows: DataFrame, by: list[str], member: str = "app_name", levels: dict[str, Column] | None = None) -> DataFrame:
    """``by`` (none: one row for all) with ``total``, the rows of each level (the labels of ``confidence`` unless given) and distinct ``members``."""
    levels = levels or {k: confidence_label(F.col("confidence")) == k for k in ("unknown", "low", "medium", "high")}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in levels.items()], F.count_distinct(member).alias("members"))


def without_obsolete(apps: DataFrame) -> DataFrame:
    """Applications that still count: all but those whose review says they are obsolete."""
    return apps.filter(~F.col("review_status").eqNullSafe("obsoleta"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each ``key`` in ``order``."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_p = 1").drop("_p")


def capped_nodes(edges: DataFrame, cap: int = 80) -> DataFrame:
    """Distinct edges (class_name, kind, target) of a diagram, by name, as long as there are fewer than ``cap`` nodes (classes, and resources of
    a kind) before the edge's resource; a report, so capped on purpose.

    With at most ``cap`` nodes there are at most cap * cap / 4 edges, so that only the first of these are numbered.
    """
    first = edges.select("class_name", "kind", "target").distinct().orderBy("class_name", "kind", "target").limit(cap * cap // 4 + cap)
    order = Window.orderBy("class_name", "kind", "target")
    new_class = (F.row_number().over(Window.partitionBy("class_name").orderBy("kind", "target")) == 1).cast("int")
    new_resource = (F.row_number().over(Window.partitionBy("kind", "target").orderBy("class_name")) == 1).cast("int")
    rows = first.withColumns({"_c": new_class, "_r": new_resource})
    before = F.sum("_c").over(order) + F.sum("_r").over(order) - F.col("_r")
    return rows.withColumn("_n", before).filter(F.col("_n") < cap).select("class_name", "kind", "target")
