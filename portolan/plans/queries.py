"""Queries by name: each operator on whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.functions import labels, sqltext
from portolan.operators import connections, containment, cooccurrence, decision, diagrams, enrich, extraction, flow, maintained, portfolio, search, sectioned, structure, workbook
from portolan.plans import rendered as R
from portolan.sources import corpus, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- SQL text and data flow


@query
def flow_operation(spark, sf_dir):
    """Findings per operation."""
    return flow.operations(R.flow_findings(spark, sf_dir)).groupBy(F.coalesce("op", F.lit("none")).alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query
def flow_columns(spark, sf_dir):
    """Each column a finding names, with how sure that is."""
    ops = flow.operations(R.flow_findings(spark, sf_dir))
    named = ops.select("app_id", "seq", "target", "op", F.explode_outer("cols").alias("col"), F.col("conf").cast("bigint").alias("conf"))  # outer: no filter on all of the parsing is inferred
    return named.filter("col is not null").groupBy("app_id", "seq", "target", "op", "col", "conf").agg(F.count(F.lit(1)).alias("n"))


@query
def flow_context(spark, sf_dir):
    found = flow.context(flow.operations(R.flow_findings(spark, sf_dir)))
    return found.select(F.col("key").alias("table_key"), flow.context_label(F.col("confirmed")).alias("context"))


@query
def flow_roles(spark, sf_dir):
    return flow.portfolio_roles(R.flow_findings(spark, sf_dir)).select("app_id", "target", "role", "status", "n_reads", "n_writes")


@query
def flow_role_counts(spark, sf_dir):
    return flow.role_counts(flow.portfolio_roles(R.flow_findings(spark, sf_dir))).select(F.col("place").cast("bigint").alias("place"), "role", "n")


@query
def flow_key_roles(spark, sf_dir):
    """Roles per application and table, all spellings taken together."""
    return flow.key_roles(R.flow_findings(spark, sf_dir)).select("app_id", F.col("key").alias("table_key"), "role", "status", "n_reads", "n_writes")


@query
def flow_grouped(spark, sf_dir):
    """Roles by table, in the order of display."""
    return flow.grouped(flow.portfolio_roles(R.flow_findings(spark, sf_dir)), "table").select("section", F.col("place").cast("bigint").alias("place"), "app_id", "role")


@query
def data_op_roles(spark, sf_dir):
    """The role of each finding's application at its table, for every second line; those of every fourth are on tables without roles."""
    rows = R.flow_findings(spark, sf_dir)
    asked = rows.filter("seq % 2 = 0").select("app_id", "seq", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("no_"), "target")).otherwise(F.col("target")).alias("target"))
    return structure.with_roles(asked, flow.key_roles(rows)).groupBy("app_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query
def flow_bounded(spark, sf_dir):
    """One application's roles, from its tables' rows only."""
    return flow.bounded_roles(R.flow_findings(spark, sf_dir), 7).select("app_id", "target", "role", "status")


@query
def app_relations_strong(spark, sf_dir):
    return flow.strong_relations(flow.portfolio_roles(R.flow_findings(spark, sf_dir)))


@query
def app_relations_weak(spark, sf_dir):
    return flow.weak_relations(flow.portfolio_roles(R.flow_findings(spark, sf_dir)))


def _evidence(spark, sf_dir):
    ops = store.stored(flow.operations(R.flow_findings(spark, sf_dir)))
    roles = store.stored(flow.roles(ops, flow.context(ops)))
    return flow.relation_evidence(ops, roles), roles, ops


@query
def app_relation_evidence(spark, sf_dir):
    """The table behind each strong relation, as either side spells it, with what the one writes and the other reads."""
    found, _, _ = _evidence(spark, sf_dir)
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.concat(x.op, F.lit("("), F.array_join(x.cols, ","), F.lit(")"))))), " ")
    return found.select("producer", "consumer", F.col("key").alias("table_key"), "written", "read", said("write_ops").alias("write_ops"), said("read_ops").alias("read_ops"))


@query
def diagram_relations(spark, sf_dir):
    """The diagram of each order as an application in the middle of those it feeds and is fed by."""
    found = R.flow_findings(spark, sf_dir)
    sides = flow.named_sides(found).withColumnRenamed("app_id", "member")
    texts = diagrams.relation_texts(sides, flow.table_sizes(found), lambda c: F.concat(F.lit("App"), c.cast("string")))
    return texts.select("app_name", "n_lines", F.md5("mermaid").alias("mermaid_md5"))


@query
def diagram_classes(spark, sf_dir):
    """The diagram of each of seven applications: suppliers and users as classes, with what they touch."""
    app, of = F.concat(F.lit("A"), (F.col("app_id") % 7).cast("string")), F.concat(F.lit("Class "), F.col("app_id").cast("string"))
    found = R.supplier_findings(spark, sf_dir).select(app.alias("app_name"), of.alias("class_name"), "category", "target")
    io = R.io_findings(spark, sf_dir).select(app.alias("app_name"), of.alias("class_name"), "operation", F.when(F.contains("operation", F.lit("Invoke")), "reflection").otherwise("io").alias("category"))
    lines = diagrams.class_diagrams(diagrams.class_resources(found, io))
    return lines


def _maintained(spark, sf_dir):
    """A store after two changes: all statements but a third, then that third instead of each order's first."""
    found = R.flow_findings(spark, sf_dir)
    kept = maintained.new_store(spark)
    kept.change(None, found.filter("seq % 3 <> 0"))
    kept.change(found.filter("seq = 1"), found.filter("seq % 3 = 0"))
    return kept


@query
def maintained_roles(spark, sf_dir):
    """Roles after statements have come and gone."""
    return _maintained(spark, sf_dir).roles().select("app_id", "target", "role", "status", "n_reads", "n_writes")


@query
def maintained_relations(spark, sf_dir):
    return _maintained(spark, sf_dir).relations()


def _described(spark, sf_dir):
    """What reports of the parts' applications are made from: applications, settings, SQL, input and output, flags, tables."""
    code, configs = R.settings_files(spark, sf_dir)
    files = R.repository_files(spark, sf_dir)
    named = R.table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").withColumn("app_name", F.concat(F.lit("App"), F.col("p_partkey").cast("string")))
    text = lambda c: F.lit(c).cast("string")
    apps = named.select(
        "app_name", text("2024-01-02").alias("build_date"), text(None).alias("activity_date"), text("no_evidence").alias("activity_source"), F.lit(None).cast("int").alias("activity_confidence"), text("C#").alias("language"),
        text("net48").alias("dotnet_target"), F.array(F.lit("WinForms")).alias("ui_framework"), F.array(F.lit("SQL Server"), F.lit("Oracle")).alias("db_drivers"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Own.dll"))).alias("companions"),
        text(None).alias("db_notes"),
    )
    settings = extraction.settings(code, configs).withColumns({"extractor": F.lit("SETTINGS"), "confidence": F.lit(95)})
    flags = named.filter("p_partkey % 3 = 0").select("app_name", F.lit("alta").alias("severity"), F.concat(F.lit("a|b "), "p_type").alias("description"), F.lit("line 1\nline 2").alias("location"))
    column = F.struct(F.lit("A").alias("name"), F.lit("int").alias("type"), F.lit("NO").alias("nullable"), F.lit(None).cast("int").alias("max_length"), F.lit("(0)").alias("default"))
    key = F.struct(F.lit("A").alias("column"), F.lit("dbo.R").alias("ref_table"), F.lit("B").alias("ref_column"), F.lit("fk").alias("fk_name"))
    tables = named.filter("p_partkey % 4 = 0").select("app_name", F.lit("dbo").alias("schema_name"), F.concat(F.lit("Direct_"), F.col("p_partkey").cast("string")).alias("table_name"), F.array(column).alias("columns"), F.array(key).alias("foreign_keys"))
    found = store.stored(extraction.raw_findings(files))
    return apps, store.stored(settings), store.stored(extraction.sql_of(found)), store.stored(extraction.io_of(found)), flags, tables


@query
def app_reports(spark, sf_dir):
    """The sectioned report of each part's application, line by line."""
    *given, tables = _described(spark, sf_dir)
    lines = sectioned.report_lines(*given, None, tables)
    place = F.row_number().over(Window.partitionBy("app_name").orderBy(*sectioned.KEYS))
    return lines.select("app_name", place.cast("bigint").alias("place"), "line")


@query
def app_workbooks(spark, sf_dir):
    """The rows of the sheets of each part's workbook, their cells parted by tabs."""
    *given, tables = _described(spark, sf_dir)
    rows = workbook.workbook_rows(*given, None, tables)
    place = F.row_number().over(Window.partitionBy("app_name", "place").orderBy("a", "b", "c", "cells"))
    return rows.select("app_name", "title", place.cast("bigint").alias("row"), F.array_join("cells", "\t").alias("cells"))


@query
def app_relations_selfloop(spark, sf_dir):
    return flow.self_loops(flow.portfolio_roles(R.flow_findings(spark, sf_dir)))


@query
def app_relations_of_one(spark, sf_dir):
    return flow.relations_of(flow.portfolio_roles(R.flow_findings(spark, sf_dir)), 7)


@query
def sql_classified(spark, sf_dir):
    """Category and target of each finding's text."""
    rows = R.flow_findings(spark, sf_dir).withColumn("c", sqltext.classified(F.col("raw"), F.col("is_sp"), F.lit(False)))
    return rows.groupBy("c.category", "c.target", "c.is_procedure").agg(F.count(F.lit(1)).alias("n"))


@query
def connection_strings(spark, sf_dir):
    rows = R.settings(spark, sf_dir)
    return rows.select("app_id", sqltext.server_of(F.col("value")).alias("server"), sqltext.database_of(F.col("value")).alias("database"))


def _footprint(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    findings = orders.select(F.col("o_custkey").alias("app_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 10).cast("string")).alias("target"), F.concat(F.lit("Conn"), (F.col("o_custkey") % 3).cast("string")).alias("connection"))
    rows = R.settings(spark, sf_dir).withColumn("category", labels.setting_category(F.col("value"), F.col("marked")))
    second = rows.filter("app_id % 16 = 0").withColumn("value", F.lit("server=other"))
    return flow.footprint(findings, rows.unionByName(second))


@query
def server_footprint(spark, sf_dir):
    """Where each order's data lives, by its customer's connections."""
    return _footprint(spark, sf_dir)


@query
def footprint_counters(spark, sf_dir):
    return flow.footprint_counters(_footprint(spark, sf_dir))


def _code_footprint(spark, sf_dir):
    code, configs = R.settings_files(spark, sf_dir)
    files = R.repository_files(spark, sf_dir)
    read = store.stored(connections.with_findings(files))
    found = extraction.sql_of(read)
    lost = found.filter("method = 'Direct'").withColumn("file", F.lit("Data/Gone.cs"))  # findings whose file isn't there any more
    return connections.footprint(found.unionByName(lost), files, extraction.settings(code, configs), ("gl_lines",), read.filter("found = 'connection'").select("app_name", "file", "line", "sources"))


@query
def footprint_from_code(spark, sf_dir):
    """Server and database of each command, by the sources that reach its connection."""
    rows = _code_footprint(spark, sf_dir)
    return rows.select("app_name", "file", "class_name", "method", "target", "connection", "server", "database", "status", F.col("confidence").cast("bigint").alias("confidence"), "is_erp")


@query
def footprint_code_counters(spark, sf_dir):
    return connections.footprint_counters(_code_footprint(spark, sf_dir))


@query
def batch_names(spark, sf_dir):
    """Names of programs found in folders: root and project, or the root alone."""
    rows = R.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    root, module = F.concat(F.lit("Root"), (F.col("o_custkey") % 7).cast("string")), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Root").otherwise("Mod"), (F.col("o_orderkey") % 7).cast("string"))
    rows = rows.withColumns({"root": root, "path": F.concat(F.lit("C:\\apps\\"), root, F.lit("\\"), module, F.when(F.col("o_orderkey") % 3 == 0, "\\bin\\Release\\a.exe").otherwise("\\a.exe"))})
    return rows.select("o_orderkey", corpus.application_name(F.col("root"), corpus.project_label(F.col("path"))).alias("app_name"))


@query
def failure_reasons(spark, sf_dir):
    """Events as unresolved findings, with the catalog's reason and action."""
    code = F.when(F.col("event_type") == "click", "DYNAMIC_SQL").when(F.col("event_type") == "view", "MISSING_SOURCE").otherwise(F.col("event_type"))
    rows = R.table(spark, sf_dir, "events", "event_id", "event_type").withColumn("failure", code)
    return labels.reason_of(rows, "failure", labels.failure_catalog(spark)).select("event_id", "reason", "action")


# ---- dependencies and catalog


@query
def dep_table_edges(spark, sf_dir):
    return portfolio.table_edges(R.supplier_findings(spark, sf_dir))


def _categorised(spark, sf_dir):
    return R.settings(spark, sf_dir).withColumn("category", labels.setting_category(F.col("value"), F.col("marked")))


def _server_edges(spark, sf_dir):
    rows = _categorised(spark, sf_dir)
    return portfolio.server_edges(rows, rows.select("app_id", "app_name"))


@query
def cooccurrence_hot(spark, sf_dir):
    """Customers as applications on the tables of their nation and segment, every other one on one table besides: partners of each and tables shared with them."""
    rows = R.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    own = rows.select(F.concat_ws(".", "c_nationkey", "c_mktsegment").alias("key"), F.col("c_custkey").alias("member"))
    hot = rows.filter("c_custkey % 2 = 0").select(F.lit("Calendar").alias("key"), F.col("c_custkey").alias("member"))
    used = own.unionByName(hot)
    return cooccurrence.partners(used).select(F.col("member").alias("app_id"), "n_partners", "n_shared")


@query
def dep_server_edges(spark, sf_dir):
    return _server_edges(spark, sf_dir)


@query
def table_dictionary(spark, sf_dir):
    return portfolio.table_dictionary(R.supplier_tables(spark, sf_dir), R.suppliers(spark, sf_dir))


def _members(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents", "doc_id", "text", "source").select(F.col("doc_id").alias("id"), F.col("source").alias("app_name"), F.lit("").alias("title"), F.col("text").alias("description"))
    return portfolio.pattern_members(docs, R.TEXT_PATTERNS)


@query
def pattern_catalog(spark, sf_dir):
    return portfolio.pattern_catalog(_members(spark, sf_dir))


@query
def finding_categories(spark, sf_dir):
    """Orders as curated findings, and the categories of what they say."""
    rows = R.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("App"), (F.col("o_custkey") % 100).cast("string")).alias("app_name"), R.chosen(F.col("o_orderkey") % len(R.TITLES), R.TITLES).alias("title"), F.lit(None).cast("string").alias("description"))
    return portfolio.pattern_catalog(portfolio.pattern_members(rows))


@query
def object_names(spark, sf_dir):
    """Names of objects as findings spell them: schema and name, nothing for what isn't a name."""
    rows = R.table(spark, sf_dir, "part", "p_partkey")
    shapes = ("dbo.P{p}", "[dbo].[P{p}]", "P{p}", " [P{p}] ", "a.b.P{p}", "P {p}", "")
    target = F.replace(R.chosen(F.col("p_partkey") % len(shapes), shapes), F.lit("{p}"), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", enrich.object_name(target).alias("o")).select("p_partkey", "o.schema", "o.name")


@query
def connection_kinds(spark, sf_dir):
    """Which of the customers' settings are SQL Server connections, and how their failures read."""
    rows = R.settings(spark, sf_dir)
    message = F.when(F.col("app_id") % 2 == 0, "('08001', '[08001] gone')").otherwise("timeout")
    return rows.select("app_id", enrich.is_sql_server(F.col("value")).alias("sql_server"), enrich.short_error(message).alias("note"))


# ---- factors and priority


def _reuse_members(spark, sf_dir):
    return R.supplier_tables(spark, sf_dir).join(R.suppliers(spark, sf_dir), "app_id").select("app_name", F.when(F.col("table_name") == "P_9", portfolio.UNMATCHED).otherwise(F.concat("schema_name", "table_name")).alias("category"))


def _shared(spark, sf_dir):
    return portfolio.shared_resources(R.supplier_findings(spark, sf_dir), _categorised(spark, sf_dir), R.suppliers(spark, sf_dir))


def _factors(spark, sf_dir, shared=None):
    apps, findings = R.suppliers(spark, sf_dir), R.supplier_findings(spark, sf_dir)
    return {
        "complexity": portfolio.complexity(findings, R.supplier_tables(spark, sf_dir), apps),
        "risk": portfolio.risk(R.curated_findings(spark, sf_dir), R.security_flags(spark, sf_dir), apps),
        "dependencies": portfolio.dependencies(_shared(spark, sf_dir) if shared is None else shared, apps),
        "rules": portfolio.business_rules(apps),
        "integration": portfolio.integrations(R.io_findings(spark, sf_dir), apps),
        "reuse": portfolio.reuse(_reuse_members(spark, sf_dir), apps),
    }


def _factor_query(name: str) -> None:
    def run(spark, sf_dir):
        return _factors(spark, sf_dir)[name]

    QUERIES[f"factor_{name}"] = run


for _name in ("complexity", "risk", "dependencies", "rules", "integration", "reuse"):
    _factor_query(_name)


@query
def factor_integration_labels(spark, sf_dir):
    return portfolio.integration_labels(R.io_findings(spark, sf_dir))


@query
def factor_sample_targets(spark, sf_dir):
    return portfolio.sample_targets(R.supplier_findings(spark, sf_dir))


@query
def terciles(spark, sf_dir):
    """Buckets of balances per nation; those of the first nation all at or under nought, every seventh missing."""
    rows = R.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    raw = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_nationkey") == 0, -F.floor(F.abs("c_acctbal") / 1000)).otherwise(F.floor(F.col("c_acctbal") / 1000)).cast("double")
    return portfolio.terciles(rows.select("c_custkey", "c_nationkey", raw.alias("raw")), ["c_nationkey"])


@query
def priority_score(spark, sf_dir):
    return portfolio.priority(portfolio.contributions(list(_factors(spark, sf_dir).values())))


@query
def priority_top_factors(spark, sf_dir):
    out = portfolio.top_contributions(portfolio.contributions(list(_factors(spark, sf_dir).values())))
    return out.withColumn("place", F.col("place").cast("bigint"))


def _decision(spark, sf_dir, shared=None):
    rows = portfolio.contributions(list(_factors(spark, sf_dir, shared).values()))
    return rows, portfolio.priority(rows), R.suppliers(spark, sf_dir)


@query
def decision_summary(spark, sf_dir):
    """Each supplier's decision report in a row."""
    return decision.summaries(*_decision(spark, sf_dir))


@query
def decision_factors(spark, sf_dir):
    rows = decision.factor_rows(_decision(spark, sf_dir)[0])
    return rows.select("app_id", F.col("place").cast("bigint").alias("place"), "label", "bucket", "raw", "interpretation")


@query
def decision_evidence(spark, sf_dir):
    """Each factor's evidence in a line."""
    apps, findings = R.suppliers(spark, sf_dir), R.supplier_findings(spark, sf_dir)
    shared = _shared(spark, sf_dir)
    return decision.short_evidence(findings, R.supplier_tables(spark, sf_dir), R.curated_findings(spark, sf_dir), R.security_flags(spark, sf_dir), shared, R.io_findings(spark, sf_dir), _reuse_members(spark, sf_dir), _decision(spark, sf_dir, shared)[0], apps)


@query
def assembly_observations(spark, sf_dir):
    """Other suppliers of the parts of one."""
    rows = R.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("app_id"), F.concat(F.lit("Lib"), F.col("l_partkey").cast("string")).alias("assembly"))
    return decision.assembly_observations(rows, R.suppliers(spark, sf_dir), 7)


# ---- lists, labels, sinks


@query
def app_listing(spark, sf_dir):
    rows = R.supplier_findings(spark, sf_dir).filter("category = 'stored_procedure' and app_id % 3 <> 0").select("app_id", "target").distinct()
    return portfolio.listing(R.suppliers(spark, sf_dir), rows, R.supplier_tables(spark, sf_dir).filter("app_id % 6 <> 0"))


@query
def findings_left(spark, sf_dir):
    return portfolio.findings_with_apps(R.curated_findings(spark, sf_dir), R.suppliers(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query
def sidebar_groups(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    name = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("Solo"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("Root"), (F.col("o_custkey") % 97).cast("string"), F.lit("/Mod"), F.col("o_orderkey").cast("string")))
    return portfolio.sidebar(orders.select(name.alias("app_name"), F.when(F.col("o_orderstatus") == "F", "logica_revisada").otherwise("borrador").alias("review_status"), F.col("o_orderdate").alias("analyzed_at")))


@query
def search_target(spark, sf_dir):
    return portfolio.search(R.supplier_findings(spark, sf_dir), "target", "t_1_1%", ["app_id", "target"])


@query
def search_connection(spark, sf_dir):
    return portfolio.search(R.settings(spark, sf_dir), "value", "srv1-", ["app_name", "name"])


@query
def security_password(spark, sf_dir):
    from portolan.functions.textops import masked_secrets

    rows = R.settings(spark, sf_dir).filter(F.col("value").rlike("(?i)=") & labels.has_password(F.col("value")))
    return rows.select("app_id", F.lit("alta").alias("severity"), masked_secrets(F.col("value")).alias("shown"))


@query
def security_placeholder(spark, sf_dir):
    return R.settings(spark, sf_dir).filter(F.col("marked") & labels.is_placeholder(F.col("value"))).select("app_id", F.lit("info").alias("severity"))


@query
def security_concat(spark, sf_dir):
    """Findings whose text is put together by concatenation; source text and template are both looked at."""
    rows = R.flow_findings(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 2 == 0, F.concat(F.lit('"'), "raw", F.lit('" + x'))).otherwise(F.col("raw")))
    rows = rows.filter(labels.maybe_injected(F.when(F.col("is_sp"), "stored_procedure").otherwise("query"), F.col("text")))
    return rows.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))


@query
def setting_category(spark, sf_dir):
    return R.settings(spark, sf_dir).select("app_id", labels.setting_category(F.col("value"), F.col("marked")).alias("category"))


@query
def io_labels_report(spark, sf_dir):
    return R.io_findings(spark, sf_dir).groupBy(labels.io_label(F.col("operation")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def io_labels_diagram(spark, sf_dir):
    return R.io_findings(spark, sf_dir).groupBy(labels.diagram_label(F.col("operation"), F.when(F.contains("operation", F.lit("Invoke")), "reflection").otherwise("io")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def confidence_lookup(spark, sf_dir):
    """Events as kinds of evidence, and how sure those are."""
    event = F.col("event_type")
    kind = F.when(event == "click", "HARDCODED_METHOD_LITERAL").when(event == "view", "REGEX_KEYWORD_MATCH").when(event == "signup", "INFERRED").when(event == "error", "APP_CALL_TARGET_UNKNOWN").otherwise(event)
    rows = labels.looked_up(R.table(spark, sf_dir, "events", "event_id", "event_type").withColumn("kind", kind), "kind", labels.confidence_dimension(spark))
    return rows.select("event_id", F.col("confidence").cast("bigint").alias("confidence"), labels.confidence_label(F.col("confidence")).alias("label"))


@query
def folder_class(spark, sf_dir):
    rows = R.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    return rows.select("p_partkey", labels.folder_class(F.col("p_brand"), F.col("p_size") > 45, r"Brand#1[0-9]|Brand#2").alias("folder_class"))


@query
def techstack(spark, sf_dir):
    """Markers of pages per host: sorted, the plain one dropped beside the richer."""
    rows = R.table(spark, sf_dir, "pages", "url", "html").select(F.regexp_extract("url", r"^(?:https?://)?([^/?#]*)", 1).alias("app"), F.col("html").alias("text"))
    seen = corpus.markers(rows, "app", {"stack": {"Script": "<script", "Table": "<table", "Form": "<form", "Plain": "<p"}})
    return seen.select("app", F.array_join(corpus.without_beside(F.col("stack"), "Plain", ("Table", "Form")), ",").alias("stack"))


@query
def csharp_techstack(spark, sf_dir):
    """Frameworks and drivers of each application's code."""
    rows = corpus.tech_stack(R.source_files(spark, sf_dir))
    return rows.select("app_name", F.array_join("ui_framework", ",").alias("ui_framework"), F.array_join("db_drivers", ",").alias("db_drivers"))


@query
def config_add_tags(spark, sf_dir):
    """Links of every page in document order."""
    rows = R.table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), 1)).alias("place", "href"))
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query
def dedupe_value(spark, sf_dir):
    """Settings whose trimmed value no segment in use has: the smallest id of each value."""
    rows = R.settings(spark, sf_dir).select(F.lit(1).alias("rank"), "app_id", F.trim("value").alias("value"))
    used = R.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").filter("c_custkey % 9 = 0").select(F.lit(0).alias("rank"), F.col("c_custkey").alias("app_id"), F.col("c_mktsegment").alias("value"))
    return extraction.first_values(rows.unionByName(used), [], "rank", ["rank", "app_id"]).filter("rank = 1").select("value", "app_id")


@query
def upsert_identity(spark, sf_dir):
    rows = R.table(spark, sf_dir, "customer", "c_custkey", "c_name")
    old = rows.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("app_name"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("/src/"), F.col("c_custkey").cast("string"))).alias("source_path"), F.lit("logica_revisada").alias("review_status"))
    new = rows.filter("c_custkey % 2 = 0").select(F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("-new"))).otherwise(F.col("c_name")).alias("app_name"), F.concat(F.lit("/src/"), F.col("c_custkey").cast("string")).alias("source_path"))
    return store.upserted(old, new).select(F.when(F.col("state") != "added", F.col("app_id")).alias("app_id"), "app_name", "source_path", "review_status", "state")


@query
def latest_activity(spark, sf_dir):
    """Each user's events as a folder of logs: the last one; ties go to the smallest id; more sure where all could be read."""
    rows = R.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    logs = rows.select(F.col("user_id").alias("app_name"), F.concat_ws("/", F.lpad(F.col("event_id").cast("string"), 19, "0"), "event_type").alias("path"), F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))).alias("modified"))
    return corpus.last_activity(logs).select(F.col("app_name").alias("user_id"), F.substring_index("source", "/", 1).cast("bigint").alias("event_id"), F.substring_index("source", "/", -1).alias("event_type"), F.col("confidence").cast("bigint").alias("confidence"))


@query
def brace_depth(spark, sf_dir):
    """Running depth over a conversation's turns, and the last user turn up to each."""
    rows = R.table(spark, sf_dir, "conversations", "conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return structure.running_depth(rows, "conv_id", "turn", step, F.col("role") == "user").select("conv_id", "turn", "depth", F.col("last_mark").alias("last_user"))


@query
def dedupe_text_first(spark, sf_dir):
    rows = R.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"), "turn")
    return portfolio.first_of_each(rows, ["conv_id", "digest"], ["turn"])


@query
def method_sql_map(spark, sf_dir):
    """Methods of parts and findings of line items on the same class and method, where the finding's path ends as the method's does."""
    parts = R.table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type").select(F.concat(F.lit("C"), (F.col("p_partkey") % 200).cast("string")).alias("class_name"), F.concat(F.lit("M"), (F.col("p_size") % 7).cast("string")).alias("method"), F.concat_ws("/", F.lit("app"), "p_type", F.concat(F.lit("F"), (F.col("p_partkey") % 200).cast("string"), F.lit(".cs"))).alias("path"), F.col("p_partkey").alias("method_id"))
    lines = R.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    lines = lines.select(F.concat(F.lit("C"), (F.col("l_partkey") % 200).cast("string")).alias("class_name"), F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("method"), F.concat(F.when(F.col("l_returnflag") == "A", "").otherwise("x"), F.lit("F"), (F.col("l_partkey") % 200).cast("string"), F.lit(".cs")).alias("suffix"), "l_orderkey")
    return structure.findings_by_method(parts, lines, "method_id", "l_orderkey")


@query
def one_hop(spark, sf_dir):
    """Orders that reach a part through a line item whose supplier is of the customer's nation: one hop, a row per line."""
    calls = R.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("class_name"), F.col("o_orderkey").alias("caller"), F.concat(F.lit("M"), (F.col("o_orderkey") % 40).cast("string")).alias("target_method"), F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise("resolved").alias("resolution_status"))
    direct = R.table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("class_name"), F.concat(F.lit("M"), (F.col("p_size") % 40).cast("string")).alias("method"), F.col("p_partkey").alias("operation"))
    return structure.one_hop_counts(calls, direct)


@query
def companion_overlap(spark, sf_dir):
    rows = R.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("app_id"), F.concat(F.lit("Lib"), F.col("l_partkey").cast("string"), F.lit(".dll")).alias("assembly"))
    return portfolio.shared_companions(rows)


@query
def snapshot_metrics(spark, sf_dir):
    rows = R.table(spark, sf_dir, "events", "user_id", "event_type", "value")
    levels = {"low": F.col("value") < 10, "mid": (F.col("value") >= 10) & (F.col("value") < 50), "high": F.col("value") >= 50}
    return portfolio.snapshot_metrics(rows, ["event_type"], "user_id", levels).withColumnRenamed("members", "users")


@query
def csharp_snapshot(spark, sf_dir):
    """Findings per extractor with how sure they are, and the applications they are in."""
    rows = extraction.sql_findings(R.source_files(spark, sf_dir)).select("app_name", "kind", F.col("evidence.confidence").alias("confidence"))
    return portfolio.snapshot_metrics(rows, ["kind"])


@query
def priority_order(spark, sf_dir):
    """Places by score, then by the newest analysis, then by application."""
    analyzed = R.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("app_id"), F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("s_nationkey") % 3 + 1).cast("string"), 2, "0"))).alias("analyzed_at"))
    rows = portfolio.priority(portfolio.contributions(list(_factors(spark, sf_dir).values())), analyzed)
    numbered = rows.select("app_id", "score", F.monotonically_increasing_id().alias("at"))
    return numbered.select("app_id", "score", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"))


@query
def enrich_asked(spark, sf_dir):
    """Which parts as objects are asked on which of their suppliers' servers; servers of every seventh nation are dead."""
    rows = R.table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    name = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("not a name "), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("DBO.Obj"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("[obj"), F.col("l_partkey").cast("string"), F.lit("]")))
    targets = rows.select((F.col("l_suppkey") % 50).alias("app_id"), name.alias("target"), (F.col("l_linenumber") <= 3).alias("is_procedure"))
    servers = R.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").filter("s_suppkey < 50").select(F.col("s_suppkey").alias("app_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("place"), F.concat(F.lit("SRV"), (F.col("s_nationkey") + k).cast("string")).alias("server")) for k in (0, 1)])).alias("x")).select("app_id", "x.*")
    return enrich.asked(targets, servers, [f"srv{k}" for k in range(0, 30, 7)]).select("app_id", "is_procedure", "schema", "name", "place", "server")


@query
def store_replaced(spark, sf_dir):
    """Line items per supplier after the rows of every third supplier were replaced."""
    kept = maintained.new_store(spark).path
    rows = R.table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber").select((F.col("l_suppkey") % 40).alias("app_id"), F.col("l_orderkey").alias("object"), F.col("l_linenumber").cast("bigint").alias("n"))
    store.replace_app_rows(rows, kept)
    store.replace_app_rows(rows.filter("app_id % 3 = 0 and n = 1").withColumn("n", F.lit(100).cast("bigint")), kept)
    return store.read_app_rows(spark, kept, "app_id bigint, object bigint, n bigint, missing string")


@query
def store_backfill(spark, sf_dir):
    """Customers whose missing market segment or comment is taken from a later look; what is there stays."""
    old = R.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    found = R.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("found "), F.col("c_nationkey").cast("string")).alias("c_mktsegment"))
    return store.filled(old, found, "c_custkey", ["c_mktsegment"])


@query
def store_latest_review(spark, sf_dir):
    """The last order of each customer as the last entry of a log of reviews."""
    log = R.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    return store.latest_state(log, "o_custkey", "o_orderkey", ["o_orderstatus"])


@query
def enrich_pick(spark, sf_dir):
    """For each object the first connection that answers: for a procedure the first one asked, for a table the first with columns."""
    rows = R.table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    answers = rows.select(F.lit(0).alias("app_id"), F.lit("dbo").alias("schema"), F.lower(F.concat(F.lit("Obj"), F.col("l_partkey").cast("string"))).alias("name"), (F.col("l_linenumber") <= 3).alias("is_procedure"), F.col("l_suppkey").alias("place"), (F.col("l_returnflag") == "N").cast("int").alias("n_columns"), F.lit(None).cast("string").alias("error"))
    return enrich.picked(answers).select(F.when(F.col("is_procedure"), "procedure").otherwise("table").alias("kind"), F.col("name").alias("object"), F.col("place").alias("connection"))


@query
def enrich_counters(spark, sf_dir):
    """Line items as objects that their supplier's databases were asked about."""
    rows = R.table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag")
    return enrich.counters(rows.select(F.col("l_suppkey").alias("app_id"), (F.col("l_linenumber") <= 3).alias("is_procedure"), F.when(F.col("l_returnflag") == "N", "ok").otherwise("not_found").alias("status")))


@query
def folder_diff(spark, sf_dir):
    """Types that a brand has only in large sizes: folders that came later."""
    rows = R.table(spark, sf_dir, "part", "p_brand", "p_type", "p_size").select(F.col("p_brand").alias("app_name"), F.col("p_type").alias("folder"), "p_size")
    return corpus.new_folders(rows.filter("p_size <= 25"), rows.filter("p_size > 25"))


@query
def diagram_top_nodes(spark, sf_dir):
    rows = R.supplier_findings(spark, sf_dir).select(F.concat(F.lit("Class"), F.col("app_id").cast("string")).alias("class_name"), F.col("category").alias("kind"), "target")
    return portfolio.capped_nodes(rows)


@query
def ranked_findings_first(spark, sf_dir):
    """The first line of each order and part, by line number and supplier."""
    rows = R.table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_partkey")
    return portfolio.first_of_each(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_suppkey", "l_partkey"])


# ---- source text


@query
def csharp_settings(spark, sf_dir):
    rows = extraction.settings(*R.settings_files(spark, sf_dir))
    return rows.select("app_name", "file", F.col("line").cast("bigint").alias("line"), "name", F.trim("value").alias("value"), "marked", "category")


@query
def csharp_sql_findings(spark, sf_dir):
    rows = extraction.sql_findings(R.source_files(spark, sf_dir))
    return rows.select("app_name", "file", "class_name", "method", "kind", "category", "target", "is_stored_procedure", F.array_join("parameters", "|").alias("parameters"), F.array_join("result_columns", "|").alias("result_columns"))


@query
def csharp_reconstruct(spark, sf_dir):
    """The texts of commands as their methods build them; null where a branch decides."""
    rows = extraction.sql_findings(R.source_files(spark, sf_dir))
    return rows.select("app_name", "file", "method", "resolved", F.col("evidence.confidence").cast("bigint").alias("confidence"), F.col("evidence.line_number").cast("bigint").alias("source_line"))


@query
def csharp_io(spark, sf_dir):
    return extraction.io_findings(R.source_files(spark, sf_dir)).select("app_name", "file", "class_name", "method", "operation", "category")


@query
def csharp_structure(spark, sf_dir):
    """Classes with their kind and number of methods."""
    rows = store.stored(extraction.facts(R.source_files(spark, sf_dir)))
    n = extraction.methods(rows).groupBy("app_name", "file", "class_name").agg(F.count(F.lit(1)).alias("n_methods"))
    return extraction.classes(rows).join(n, ["app_name", "file", "class_name"], "left").select("app_name", "file", "class_name", "namespace", "base_type", "class_type", F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


@query
def csharp_entry_points(spark, sf_dir):
    rows = extraction.entry_points(extraction.facts(R.source_files(spark, sf_dir)))
    return rows.select("app_name", "file", "class_name", "method", "pattern", F.col("confidence").cast("bigint").alias("confidence"))


@query
def csharp_navigation(spark, sf_dir):
    rows = extraction.navigation(store.stored(extraction.facts(R.source_files(spark, sf_dir))))
    return rows.select("app_name", "class_name", "method", "target_class", "operation", "status", F.col("confidence").cast("bigint").alias("confidence"))


@query
def csharp_events(spark, sf_dir):
    return extraction.event_wirings(extraction.facts(R.source_files(spark, sf_dir))).select("app_name", "class_name", "control", "event", "handler", "status")


@query
def csharp_calls(spark, sf_dir):
    return extraction.calls(store.stored(extraction.facts(R.source_files(spark, sf_dir)))).groupBy("app_name", "class_name", "caller", "target_method", "resolution_status").agg(F.count(F.lit(1)).alias("n"))


@query
def csharp_controls(spark, sf_dir):
    return extraction.controls(extraction.facts(R.source_files(spark, sf_dir))).select("app_name", "class_name", "control", "control_type", "label", "status")


@query
def csharp_unknowns(spark, sf_dir):
    """What source can't show of windows that are defined in markup."""
    return extraction.unknowns(extraction.facts(R.window_files(spark, sf_dir)))


@query
def csharp_window_methods(spark, sf_dir):
    """Methods of windows and of the classes inside them, with what they call and show."""
    rows = store.stored(extraction.facts(R.window_files(spark, sf_dir)))
    made = extraction.methods(rows).select("app_name", "file", "class_name", "method", F.lit("declared").alias("what"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("status"))
    called = extraction.calls(rows).select("app_name", "file", "class_name", F.col("caller").alias("method"), F.lit("calls").alias("what"), F.col("target_method").alias("target"), F.col("resolution_status").alias("status"))
    shown = extraction.navigation(rows).select("app_name", "file", "class_name", "method", F.lit("shows").alias("what"), F.col("target_class").alias("target"), "status")
    return made.unionByName(called).unionByName(shown)


@query
def line_containment(spark, sf_dir):
    """Class and method around every line of the screens, programs and repositories."""
    return containment.containment_by_file(R.source_files(spark, sf_dir).unionByName(R.repository_files(spark, sf_dir))).select("app_name", "file", F.col("n").cast("bigint").alias("n"), "class_name", "method")


@query
def search_indexed(spark, sf_dir):
    """Documents with a term in them, by a trigram index: words in either case, and a wildcard between two pieces."""
    docs = R.table(spark, sf_dir, "documents", "doc_id", "text")
    index = search.TrigramIndex.build(R.spread(docs), "doc_id", "text")
    found = [index.search(docs, term).select(F.lit(term).alias("term"), "doc_id") for term in ("LICENSE", "copy_ight", "the%and", "ed")]
    return reduce(DataFrame.unionByName, found).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("sum_of_ids"))


@query
def csharp_data_ops(spark, sf_dir):
    """What each method does to data, directly and one call away."""
    files = R.source_files(spark, sf_dir)
    rows = store.stored(extraction.facts(files))
    found = extraction.sql_findings(files).withColumn("operation", F.when(F.col("is_stored_procedure"), "stored_procedure").otherwise(sqltext.operation(F.coalesce("resolved", "raw"))))
    direct = store.stored(structure.method_operations(extraction.methods(rows).withColumnRenamed("file", "path"), found.select("class_name", "method", "file", "operation", "target")))
    near = structure.one_hop_callers(extraction.calls(rows), direct.filter("status = 'resolved'").select("class_name", "method", F.concat_ws(" ", "operation", "target").alias("operation")))
    own = direct.select("class_name", "method", F.concat_ws(" ", "operation", "target").alias("operation"), F.lit("direct").alias("distance"), F.col("confidence").cast("bigint").alias("confidence"))
    return own.unionByName(near.select("class_name", F.col("caller").alias("method"), "operation", F.lit("one_hop").alias("distance"), F.lit(70).cast("bigint").alias("confidence")))
