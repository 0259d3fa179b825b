"""Data flow: what each application does to each table, and how applications relate through tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions import sqltext as S
from portolan.functions.labels import ROLES, role_dimension
from portolan.functions.textops import without_escapes
from portolan.operators.cooccurrence import pair_counts, pairs
from portolan.sources.store import stored


def operations(findings: DataFrame) -> DataFrame:
    """``findings`` (app_id, target, is_sp, raw, resolved, result_columns) with ``key``, ``op``, ``cols`` (null: none named) and ``conf``.

    Of a select the columns its reader takes count, where known (90), else those in its text (80); else 20. Each step is a
    projection of its own, so that no pattern is looked for twice.
    """
    rows = findings.withColumn("plain", without_escapes(S.statement(F.col("resolved"), F.col("raw"))))
    rows = rows.withColumn("upper", F.upper("plain"))
    rows = rows.withColumn("op", S.plain_operation(F.col("plain"), F.col("upper")))
    told = (F.col("op") == "select") & (F.col("result_columns") != "[]")
    rows = rows.withColumns({"listed": S.column_list(F.col("op"), F.col("plain")), "results": F.when(told, S.result_columns(F.col("result_columns")))})
    rows = rows.withColumn("marked", S.marked_calls(F.col("op"), F.col("listed")))
    rows = rows.withColumn("named", S.without_calls(F.col("marked"), F.col("listed")))
    rows = rows.withColumn("names", S.names_of(F.col("op"), F.col("named")))
    read, named = F.col("results").isNotNull(), F.size("names") > 0
    read_out = F.struct(S.table_key(F.col("target")).alias("key"), "op", F.when(read, F.col("results")).when(named, F.col("names")).alias("cols"), F.when(read, 90).when(named, 80).otherwise(20).alias("conf"))
    # one element a row: filters and aggregates above read what is made here and aren't pushed into the parsing
    return rows.select(*findings.columns, F.inline_outer(F.array(read_out)))


def context(ops: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS) -> DataFrame:
    """``key, confirmed``: whether any application names a column of the table that only test results have. Procedures and
    code-like targets tell nothing about a table's columns."""
    rows = ops.filter("not is_sp and key is not null and op is not null").select("key", F.coalesce("cols", F.array().cast("array<string>")).alias("named"))
    rows = rows.withColumn("shown", S.shown(F.col("named")))
    return rows.groupBy("key").agg(F.max(S.any_strong(F.col("named"), F.col("shown"), measurements)).alias("confirmed"))


def context_label(confirmed: Column) -> Column:
    return F.when(F.coalesce(confirmed, F.lit(False)), "confirmado").otherwise("desconocido")


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def marked(ops: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """``app_id, target, key, is_sp, op, writes, reads, known, measured, strong, ambiguous`` of each statement with a target and an operation: what its columns
    are by catalogs of names, which are looked up once for each."""
    rows = ops.filter("target is not null and op is not null").select("app_id", "target", "key", "is_sp", "op", F.coalesce("cols", F.array().cast("array<string>")).alias("named"))
    rows = rows.withColumn("shown", S.shown(F.col("named")))
    named, shown = F.col("named"), F.col("shown")
    return rows.select(
        "app_id", "target", "key", "is_sp", "op", F.col("op").isin("insert", "update", "delete", "merge").alias("writes"), (F.col("op") == "select").alias("reads"), (F.size(named) > 0).alias("known"),
        S.any_member(shown, measurements).alias("measured"), S.any_strong(named, shown, measurements).alias("strong"), S.any_member(shown, status).alias("ambiguous"),
    )


def _evidence(ops: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """A row per application, table as spelled and key: what its statements do and name, by catalogs of column names."""
    return _gathered(marked(ops, measurements, status))


def _gathered(rows: DataFrame) -> DataFrame:
    """``_evidence`` of statements as ``marked``."""
    writes, reads, measured, strong, ambiguous, known = (F.col(c) for c in ("writes", "reads", "measured", "strong", "ambiguous", "known"))
    return rows.groupBy("app_id", "target", "key").agg(
        F.count_if(writes).alias("n_writes"), F.count_if(reads).alias("n_reads"),
        _any(writes & measured).alias("wm"), _any(writes & (known | (F.col("op") == "delete"))).alias("wk"),
        _any(reads & measured).alias("rm"), _any(reads & strong).alias("rs"), _any(reads & ambiguous).alias("ra"), _any(reads & known).alias("rk"),
        _any(~F.col("is_sp") & strong).alias("tells"),
    )


def _with_role(rows: DataFrame) -> DataFrame:
    w, r = F.col("n_writes") > 0, F.col("n_reads") > 0
    role = (
        F.when(w & r, "mixto")
        .when(w & F.col("wm"), "productor_numerico").when(w & F.col("wk"), "productor_passfail").when(w, "indeterminado")
        .when(F.col("rm"), "consumidor_medicion").when(F.col("rs") | (F.col("ra") & F.coalesce("confirmed", F.lit(False))), "consumidor_resultado").when(F.col("rk"), "consumidor_general")
        .otherwise("indeterminado")
    )
    return rows.select("app_id", "target", "key", role.alias("role"), F.when(role == "indeterminado", "unresolved_no_columns").otherwise("resolved").alias("status"), "n_reads", "n_writes")


def roles(ops: DataFrame, confirmed: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """``app_id, target, role, status, n_reads, n_writes``: one row per application and table as spelled."""
    return _with_role(_evidence(ops, measurements, status).join(confirmed, "key", "left"))


def key_roles(findings: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """``app_id, key, role, status, n_reads, n_writes``: one row per application and table, all its spellings taken together."""
    seen = _evidence(operations(findings), measurements, status).filter("key is not null")
    marks = [F.max(c).alias(c) for c in ("wm", "wk", "rm", "rs", "ra", "rk", "tells")]
    rows = seen.groupBy("app_id", "key").agg(F.min("target").alias("target"), F.sum("n_writes").alias("n_writes"), F.sum("n_reads").alias("n_reads"), *marks)
    return _with_role(rows.withColumn("confirmed", F.max("tells").over(Window.partitionBy("key")))).drop("target")


def portfolio_roles(findings: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """The roles of all applications. Statements are read once: the context of a table comes from the rows per application
    that the roles are made of, by a window over its applications."""
    told = F.max("tells").over(Window.partitionBy("key"))
    return _with_role(_evidence(operations(findings), measurements, status).withColumn("confirmed", F.when(F.col("key").isNotNull(), told)))


def bounded_roles(findings: DataFrame, app: int, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """The roles of one application; the context comes from the rows of its tables only, which is all it depends on."""
    keys = findings.filter(F.col("app_id") == app).select(S.table_key(F.col("target")).alias("key")).filter("key is not null").distinct()
    near = findings.join(keys, S.table_key(F.col("target")) == keys["key"], "left_semi")
    return roles(operations(findings.filter(F.col("app_id") == app)), context(operations(near), measurements), measurements, status)


def grouped(rows: DataFrame, by: str) -> DataFrame:
    """Roles (app_id, target, role) for display, with ``section`` and ``place`` of the role: by ``role`` in fixed order, by ``table`` whatever the
    case, or by ``app``. Rows stay rows; the sort is one over ranges."""
    section = {"role": F.col("role"), "table": F.col("target"), "app": F.col("app_id").cast("string")}[by]
    out = rows.withColumns({"section": section, "place": F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))})
    return out.orderBy({"role": F.col("place"), "table": F.upper("section"), "app": F.col("app_id")}[by], "section", "place", "app_id", "target")


def role_counts(rows: DataFrame) -> DataFrame:
    """Edges per role, with the roles nobody has, in their fixed order."""
    n = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return role_dimension(rows.sparkSession).join(n, "role", "left").select("place", "role", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


PRODUCES, CONSUMES = ("productor_numerico", "productor_passfail", "mixto"), ("consumidor_medicion", "consumidor_resultado", "consumidor_general", "mixto")


def _side() -> Column:
    return F.when(F.col("role").isin(*PRODUCES), 1).otherwise(0).bitwiseOR(F.when(F.col("role").isin(*CONSUMES), 2).otherwise(0))


def _sides(rows: DataFrame) -> DataFrame:
    """One row per application and table key, whatever the spellings: ``side`` has 1 where it produces, 2 where it consumes. Both sides of a
    relation read this one column, so that the exchange behind it is made once."""
    return rows.filter("role <> 'indeterminado' and key is not null").groupBy("key", "app_id").agg(F.bit_or(_side()).alias("side"))


def strong_relations(rows: DataFrame) -> DataFrame:
    """``producer, consumer, n_tables``: one application writes what another reads."""
    s = stored(_sides(rows)).withColumnRenamed("app_id", "member")
    found = pair_counts(s.filter("side & 1 <> 0"), s.filter("side & 2 <> 0")).filter("a <> b")
    return found.select(F.col("a").alias("producer"), F.col("b").alias("consumer"), F.col("n").alias("n_tables"))


def weak_relations(rows: DataFrame) -> DataFrame:
    """``app_a, app_b, n_tables``: two applications share a table and neither feeds the other through it: both only write it, or both only read it."""
    s = _sides(rows).filter("side < 3").select(F.struct("key", "side").alias("key"), F.col("app_id").alias("member"))
    return pair_counts(s, s, ascending=True).select(F.col("a").alias("app_a"), F.col("b").alias("app_b"), F.col("n").alias("n_tables"))


def relation_evidence(ops: DataFrame, rows: DataFrame) -> DataFrame:
    """``producer, consumer, key, written, read, write_ops, read_ops``: for each strong relation and table what the one writes and the other reads:
    the distinct statements (op, cols, conf) of either side, and the table as either spells it. ``ops`` as from ``operations``, ``rows`` their roles."""
    known = ops.filter("key is not null and op is not null")
    writes = F.col("op").isin("insert", "update", "delete", "merge")
    found = F.struct("op", F.coalesce("cols", F.array().cast("array<string>")).alias("cols"), "conf")
    told = known.groupBy("app_id", "key").agg(
        F.min("target").alias("table"), F.sort_array(F.collect_set(F.when(writes, found))).alias("w"), F.sort_array(F.collect_set(F.when(F.col("op") == "select", found))).alias("r")
    )
    sides = stored(_sides(rows).join(told, ["app_id", "key"]))
    side = lambda bit, ops: sides.filter(F.col("side").bitwiseAND(bit) != 0).select("key", F.struct("app_id", "table", F.col(ops).alias("ops")).alias("member"))  # noqa: E731  statements go with the applications when these are paired
    met = pairs(side(1, "w"), side(2, "r")).filter("a.app_id <> b.app_id")
    return met.select(F.col("a.app_id").alias("producer"), F.col("b.app_id").alias("consumer"), "key", F.col("a.table").alias("written"), F.col("b.table").alias("read"), F.col("a.ops").alias("write_ops"), F.col("b.ops").alias("read_ops"))


def spelled_sides(ops: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, app_id, side, table``: ``_sides`` of the roles ``rows`` with the table as the application spells it in ``ops``; stored."""
    spelled = ops.filter("key is not null and op is not null").groupBy("app_id", "key").agg(F.min("target").alias("table"))
    return stored(_sides(rows).join(spelled, ["app_id", "key"]).select("key", "app_id", "side", "table"))


def relation_tables(sides: DataFrame) -> DataFrame:
    """``producer, consumer, key, written, read``: as ``relation_evidence`` without statements, from ``spelled_sides``. Spellings go with the applications when these are
    paired, so that the pairs, which are many times the applications, aren't moved again to be joined with them."""
    named = sides.select("key", "side", F.struct("app_id", "table").alias("member"))
    met = pairs(named.filter("side & 1 <> 0"), named.filter("side & 2 <> 0")).filter("a.app_id <> b.app_id")
    return met.select(F.col("a.app_id").alias("producer"), F.col("b.app_id").alias("consumer"), "key", F.col("a.table").alias("written"), F.col("b.table").alias("read"))


def named_sides(findings: DataFrame, measurements: tuple[str, ...] = S.MEASUREMENTS, status: tuple[str, ...] = S.STATUS_METADATA) -> DataFrame:
    """``key, app_id, side, table``: as ``spelled_sides`` of the ``portfolio_roles``, from findings that are read once. Statements move once, to their table, where all
    that is done by table follows; an application has few on each, so that combining them before would move as many rows once more."""
    seen = _gathered(marked(operations(findings), measurements, status).filter("key is not null").repartition("key"))
    rows = _with_role(seen.withColumn("confirmed", F.max("tells").over(Window.partitionBy("key"))))
    return rows.groupBy("key", "app_id").agg(F.bit_or(_side()).alias("side"), F.min("target").alias("table")).filter("side > 0")


def table_sizes(findings: DataFrame) -> DataFrame:
    """``key, n``: how many findings each table has; statements aren't parsed."""
    spelled = findings.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    keyed = spelled.select("n", F.explode_outer(F.array(S.table_key(F.col("target")))).alias("key"))  # so that no filter on keys is pushed to each finding
    return keyed.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"))


def self_loops(rows: DataFrame) -> DataFrame:
    """``app_id, n_tables``: applications that read what they write."""
    return _sides(rows).filter("side = 3").groupBy("app_id").agg(F.count(F.lit(1)).alias("n_tables"))


def relations_of(rows: DataFrame, app: int) -> DataFrame:
    """Strong relations of one application: only its own tables are joined."""
    mine = rows.filter(F.col("app_id") == app).select("key").distinct()
    near = rows.join(mine, "key", "left_semi")
    return strong_relations(near).filter((F.col("producer") == app) | (F.col("consumer") == app))


def footprint(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """``app_id, target, server, status``: where a finding's data lives, by the connection it names.

    A finding joins its application's connection settings by variable (``connection``); one candidate resolves it, several
    servers make it ambiguous, none leaves it unresolved. An interpretation: only the states are given by design.
    """
    servers = settings.filter("category = 'sql_or_oracle'").select("app_id", F.col("name").alias("connection"), S.server_of(F.col("value")).alias("server")).filter("server is not null")
    found = servers.groupBy("app_id", "connection").agg(F.count_distinct("server").alias("n"), F.min("server").alias("server"))
    rows = findings.select("app_id", "target", "connection").distinct().join(found, ["app_id", "connection"], "left")
    return rows.select("app_id", "target", F.when(F.col("n") == 1, F.col("server")).alias("server"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"))


def footprint_counters(rows: DataFrame) -> DataFrame:
    """One row: ``total, resolved, ambiguous, unresolved, servers`` of a footprint."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "ambiguous", "unresolved")], F.count_distinct("server").alias("servers"))
