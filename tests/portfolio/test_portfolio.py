from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portolan.functions import labels as L
from portolan.operators import portfolio as P
from portolan.sources import store


@pytest.mark.parametrize("values, want", [
    ([1, 2, 3], ["Baja", "Baja", "Media"]), ([1, 2], ["Baja", "Media"]), ([1, 1, 1, 9], ["Baja"] * 3 + ["Alta"]), ([-1, -1, 0], ["Baja"] * 3), ([-2, -1], ["Baja", "Media"]),
    ([5], ["Baja"]), ([0, 0], ["Baja"] * 2), ([None, 3, 4], [None, "Baja", "Media"]), ([None], [None]), (list(range(1, 10)), ["Baja"] * 4 + ["Media"] * 3 + ["Alta"] * 2),
])
def test_terciles(spark, values, want):
    rows = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in enumerate(values)], "k long, raw double")
    assert [r.bucket for r in P.terciles(rows, []).orderBy("k").collect()] == want
    grouped = rows.withColumn("g", F.lit("x")).unionByName(rows.withColumn("g", F.lit("y")))
    assert [r.bucket for r in P.terciles(grouped, ["g"]).orderBy("g", "k").collect()] == want * 2


def test_table_edges_keep_their_asymmetry(spark):
    rows = spark.createDataFrame([(1, "T", "query"), (1, "T", "query"), (2, "T", "oracle_package_call"), (3, "T", "query"), (2, "U", "oracle_package_call"), (3, "U", "query"), (4, "t", "query"), (5, None, "query"), (6, None, "query")], "app_id long, target string, category string")
    assert sorted((r.app_a, r.app_b, r.resource) for r in P.table_edges(rows).collect()) == [(1, 2, "T"), (1, 3, "T")]


def test_server_edges_are_by_name(spark):
    apps = spark.createDataFrame([(1, "z"), (2, "a"), (3, "m"), (4, "m")], "app_id long, app_name string")
    settings = spark.createDataFrame([(i, "server=S", "sql_or_oracle") for i in (1, 2, 3, 4)] + [(2, "Data Source=s", "sql_or_oracle"), (1, "server=q", "other")], "app_id long, value string, category string")
    assert sorted((r.app_a, r.app_b) for r in P.server_edges(settings, apps).collect()) == [(2, 1), (2, 3), (2, 4), (3, 1), (3, 4), (4, 1)]


def test_table_dictionary(spark):
    apps = spark.createDataFrame([(1, "b"), (2, "a")], "app_id long, app_name string")
    tables = spark.createDataFrame([(1, "dbo", "T", "[2]"), (2, "dbo", "T", "[1]"), (1, "dbo", "U", None)], "app_id long, schema_name string, table_name string, columns_json string")
    assert sorted(map(tuple, P.table_dictionary(tables, apps).collect())) == [("dbo", "T", "a,b", 2, False, "[1]"), ("dbo", "U", "b", 1, True, "")]


def test_patterns_label_each_finding_with_all_that_match(spark):
    rows = spark.createDataFrame([(1, "a", "SQL injection", "texto plano"), (2, "a", "x", None), (3, "b", None, "SQL\ninjection"), (4, "b", "texto plano", "")], "id long, app_name string, title string, description string")
    members = P.pattern_members(rows, [("inj", "(?i)sql injection"), ("plain", "(?i)texto plano")])
    got = [(r.category, r.n_findings, r.n_apps) for r in P.pattern_catalog(members).collect()]
    assert got == [("plain", 2, 2), ("inj", 1, 1), (P.UNMATCHED, 2, 2)]


def test_factors_and_score(spark):
    apps = spark.createDataFrame([(1, "a", "logica_revisada", "x\n \ny"), (2, "b", "borrador", "x"), (3, "c", "logica_revisada", None)], "app_id long, app_name string, review_status string, review_notes string")
    curated = spark.createDataFrame([("a", "critica"), ("a", "rara"), ("gone", "alta")], "app_name string, severity string")
    flags = spark.createDataFrame([(1, "media"), (2, "alta")], "app_id long, severity string")
    raw = lambda f: {r.app_id: r.raw for r in f.collect()}
    risk, rules = P.risk(curated, flags, apps), P.business_rules(apps)
    assert raw(risk) == {1: 4.0, 2: 2.0, 3: 0.0} and raw(rules) == {1: 2.0, 2: None, 3: 0.0}
    rows = P.contributions([risk, rules])
    got = {r.app_id: (r.score, r.n_factors) for r in P.priority(rows).collect()}
    # risk 0, 2, 4: Baja, Baja, Media by terciles of three; rules 0, 2: Baja, Media
    assert got == {1: (2.5, 2), 2: (0.0, 1), 3: (0.0, 2)}
    assert [(r.factor, r.contribution) for r in P.top_contributions(rows).orderBy("place").collect()] == [("riesgo", 2.0), ("reglas_negocio", 0.5)]


def test_labels(spark):
    def of(expression, value, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first().x

    assert [of(L.io_label, v) for v in ("File.Exists", "new HttpClient", "MethodInfo.Invoke", None)] == ["Archivos", "Red / HTTP", "Otro", "Otro"]
    assert of(lambda c: L.diagram_label(c, F.lit("reflection")), "MethodInfo.Invoke") == "Reflection / COM" and of(lambda c: L.diagram_label(c, F.lit("io")), "Thread.Sleep") == "Otro I/O"
    assert [of(L.confidence_label, v, "int") for v in (20, 54, 55, 70, None)] == ["unknown", "low", "medium", "high", "unknown"]
    assert [of(lambda c: L.setting_category(c, F.lit(False)), v) for v in ("UID = x", "C:\\x", "/x", "\\\\s", "x")] == ["sql_or_oracle", "local_path", "local_path", "local_path", "other"]
    assert of(lambda c: L.setting_category(c, F.lit(True)), "/x") == "sql_or_oracle"
    assert [of(L.has_password, v) for v in ("Password=x", "pwd= ;a=1", "x")] == [True, False, False]
    assert [of(lambda c: L.folder_class(c, F.lit(False), "Sys.*|Lib"), v) for v in ("System", "Library", "Lib")] == ["THIRD_PARTY", "UNKNOWN_COMPANION", "THIRD_PARTY"]


def test_upsert_keeps_identities(spark):
    old = spark.createDataFrame([(5, "a", "/a", "logica_revisada"), (6, "b", None, "borrador"), (9, "c", "/c", "logica_revisada")], "app_id long, app_name string, source_path string, review_status string")
    new = spark.createDataFrame([("renamed", "/a"), ("b", "/b"), ("new", "/n"), ("new2", "/m")], "app_name string, source_path string")
    got = {(r.app_name, r.source_path, r.review_status, r.state): r.app_id for r in store.upserted(old, new).collect()}
    assert got[("a", "/a", "logica_revisada", "updated")] == 5 and got[("b", "/b", "borrador", "updated")] == 6 and got[("c", "/c", "logica_revisada", "kept")] == 9
    assert {i for k, i in got.items() if k[3] == "added"} == {10, 11} and len(got) == 5
    again = {(r.app_name, r.source_path): r.app_id for r in store.upserted(store.upserted(old, new), new).collect()}
    assert again == {(k[0], k[1]): i for k, i in got.items()}


def test_rows_of_an_application_are_replaced(spark, tmp_path):
    path = str(tmp_path / "rows")
    frame = lambda *rows: spark.createDataFrame(rows, "app_id long, x string")
    store.replace_app_rows(frame((1, "a"), (1, "b"), (2, "c")), path)
    store.replace_app_rows(frame((1, "d")), path)
    got = store.read_app_rows(spark, path, "app_id long, x string, later int")
    assert sorted((r.app_id, r.x, r.later) for r in got.collect()) == [(1, "d", None), (2, "c", None)]
    assert [r.x for r in store.read_app_rows(spark, path, "app_id long, x string", [2]).collect()] == ["c"]


def test_curated_log_and_fills(spark):
    log = spark.createDataFrame([(1, 1, "abierto"), (1, 2, "resuelto"), (2, 1, "abierto")], "id long, at long, status string")
    assert {(r.id, r.status) for r in store.latest_state(log, "id", "at", ["status"]).collect()} == {(1, "resuelto"), (2, "abierto")}
    old, found = (spark.createDataFrame(x, "k long, a string") for x in ([(1, None), (2, "x")], [(1, "n"), (2, "n")]))
    assert {(r.k, r.a) for r in store.filled(old, found, "k", ["a"]).collect()} == {(1, "n"), (2, "x")}
    assert store.checked("alta", store.SEVERITIES) == "alta"
    with pytest.raises(ValueError, match="nope"):
        store.checked("nope", store.SEVERITIES)


def test_shared_resources_are_counted_without_their_edges(spark, monkeypatch):
    import random
    from collections import Counter

    from portolan.operators import cooccurrence

    rng = random.Random(3)
    findings = spark.createDataFrame([(rng.choice([None, *range(40)]), rng.choice([None, "Hot", "Hot", "T1", "T2"]), rng.choice(["query", "stored_procedure", "other", None])) for _ in range(300)], "app_id long, target string, category string")
    settings = spark.createDataFrame([(k % 30, "sql_or_oracle" if k % 4 else "path", f"server=s{k % 7}") for k in range(60)], "app_id long, category string, value string")
    apps = spark.createDataFrame([(k, None if k % 9 == 0 else f"a{k % 11}") for k in range(25)] + [(3, "other")], "app_id long, app_name string")
    edges = P.table_edges(findings).unionByName(P.server_edges(settings, apps)).collect()
    want = Counter(x for e in edges for x in (e.app_a, e.app_b))

    def fails(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(P, "pairs", fails)
    assert {r.app_id: r.n for r in P.shared_resources(findings, settings, apps).collect()} == want
    monkeypatch.setattr(cooccurrence, "RUN", 7)
    rows = findings.selectExpr("target AS key", "app_id AS member", "category IN ('query', 'stored_procedure') AS first")
    light, dealt = ({r.member: r.n for r in cooccurrence.degrees(rows, most).collect()} for most in (1000, 80))
    assert light == dealt and len(light) > 30
    assert cooccurrence.degrees(rows.limit(0)).collect() == []
