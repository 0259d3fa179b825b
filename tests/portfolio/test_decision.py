from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from portolan.functions import labels as L
from portolan.operators import decision as D
from portolan.operators import enrich, report, structure
from portolan.operators import portfolio as P
from portolan.sources import corpus

CONTRIBUTIONS = "app_id long, factor string, raw double, bucket string, contribution double"


def test_summary_takes_the_two_strongest_factors_either_way(spark):
    rows = spark.createDataFrame([
        (1, "riesgo", 9.0, "Alta", 4.0), (1, "dependencias", 1.0, "Media", 1.5), (1, "complejidad_tecnica", 7.0, "Alta", -1.0), (1, "reglas_negocio", None, None, None), (1, "complejidad_integracion", 0.0, "Baja", 0.0),
        (1, "reutilizacion_potencial", 0.0, "Baja", 0.0), (2, "riesgo", 0.0, "Baja", 0.0), (2, "complejidad_tecnica", 0.0, "Baja", 0.0),
    ], CONTRIBUTIONS)
    apps = spark.createDataFrame([(1, "a", "borrador"), (2, "b", None), (3, "c", "x")], "app_id long, app_name string, review_status string")
    scores = spark.createDataFrame([(1, 4.5, "Alta"), (2, 0.0, "Baja")], "app_id long, score double, bucket string")
    a, b = D.summaries(rows, scores, apps).orderBy("app_id").collect()
    assert (a.priority, a.technical, a.integration, a.risk, a.readiness) == ("Alta", "Alta", "Baja", "Alta", "Sin revision de logica de negocio todavia")
    assert a.pending == "Reglas de negocio, Cantidad de usuarios, Criticidad operacional"
    assert "Riesgo en nivel Alta (subio el score en 4.0) y Dependencias en nivel Media (subio el score en 1.5)." in a.narrative and "Complejidad tecnica en" not in a.narrative
    assert "el riesgo" in a.conclusion and "no depende de integraciones externas complejas" in a.conclusion
    assert b.readiness == "Desconocido" and "Ningun factor tuvo un aporte" in b.narrative and "no se detectaron riesgos" in b.conclusion
    parts = D.decision_report(rows, scores, apps, 1)
    assert [(r.factor, r.decides) for r in parts["factors"].filter("decides").collect()] == [("riesgo", True), ("dependencias", True)]
    assert parts["factors"].filter("bucket is null").first().interpretation == D.NOT_YET
    assert D.summaries(rows.limit(0), scores, apps).count() == 0


def test_observations_are_of_shared_names_only(spark):
    apps = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "app_id long, app_name string")
    rows = spark.createDataFrame([(1, " X "), (1, ""), (1, "Own"), (2, "X"), (2, "X"), (3, "X"), (3, None), (2, "")], "app_id long, assembly string")
    assert [tuple(r) for r in D.assembly_observations(rows, apps, 1).collect()] == [("X", "'a' reutiliza el ensamblado 'X', tambien encontrado en: b, c.")]


def test_every_kind_of_evidence_and_failure_is_known_once(spark):
    assert L.confidence_dimension(spark).count() == len(L.CONFIDENCE) == 39
    rows = spark.createDataFrame([("REFLECTION",), ("odd",), (None,)], "code string")
    found = {r.code: r.reason for r in L.reason_of(rows, "code", L.failure_catalog(spark)).collect()}
    assert found["odd"] == found[None] == "Causa no determinada." and "Reflection" in found["REFLECTION"]


def test_shown_findings_stand_in_for_methods_without_a_text(spark):
    schema = "app_name string, class_name string, method string, resolved string, raw string, category string, target string, evidence struct<confidence int>, file string, line int"
    rows = spark.createDataFrame([
        ("a", "C", "m", None, "new SqlConnection(Settings.Main)", "connection", None, (20,), "f", 1), ("a", "C", "m", "SELECT 1", "x", "query", "T", (80,), "f", 3), ("a", "C", "m", "SELECT 1", "x", "query", "T", (80,), "f", 2),
        ("a", "C", "n", None, "new SqlConnection(other)", "connection", None, (20,), "f", 9), ("a", "C", "o", None, None, "query", None, (20,), "f", 10),
    ], schema)
    got = {(r.method, r.connection, r.text, r.line) for r in report.shown_findings(rows).collect()}
    assert got == {("m", "Settings.Main", "SELECT 1", 2), ("n", "other", report.UNRESOLVED, 9), ("o", "?", report.UNRESOLVED, 10)}
    assert report.shown_findings(rows.limit(0)).count() == 0


def test_sections_come_in_order(spark):
    table = report.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, y int"), ["x", "y"], ["y"])
    assert [r.markdown for r in report.sections([("Second", table), ("First", table)]).collect()] == ["## Second\n\n| x | y |\n|---|---|\n| a\\|b | 1 |", "## First\n\n| x | y |\n|---|---|\n| a\\|b | 1 |"]


def test_activity_prefers_files_to_folders(spark):
    at = lambda day: datetime.datetime(2026, 1, day)
    logs = spark.createDataFrame([("a", "logs/", at(9)), ("a", "logs/2", at(3)), ("a", "logs/1", at(3)), ("b", "logs/", at(4))], "app_name string, path string, modified timestamp")
    apps = spark.createDataFrame([("a",), ("b",), ("c",)], "app_name string")
    got = {r.app_name: (r.date, r.source, r.confidence) for r in corpus.last_activity(logs, apps).collect()}
    assert got == {"a": ("2026-01-03T00:00:00", "logs/1", 70), "b": ("2026-01-04T00:00:00", "logs/", 50), "c": (None, "no_evidence", 20)}


def test_stack_says_what_it_did_not_find(spark):
    rows = spark.createDataFrame([("a", "static void Main("), ("b", "using System.Windows.Controls;\nusing Oracle.DataAccess.Client;"), ("b", "static void Main("), ("c", None)], "app_name string, text string")
    got = {r.app_name: (r.ui_framework, r.db_drivers) for r in corpus.tech_stack(rows).collect()}
    assert got == {"a": (["Console/Service"], ["(ninguno detectado)"]), "b": (["WPF"], ["Oracle.DataAccess (Oracle, unmanaged)"]), "c": (["(no detectado)"], ["(ninguno detectado)"])}


def test_equal_scores_are_ordered_by_the_newest_analysis(spark):
    rows = spark.createDataFrame([(k, "riesgo", 1.0, "Baja", 0.0) for k in (1, 2, 3)], CONTRIBUTIONS)
    analyzed = spark.createDataFrame([(1, "2026-01-01"), (3, "2026-02-01")], "app_id long, analyzed_at string")
    assert [r.app_id for r in P.priority(rows, analyzed).collect()] == [3, 1, 2]


def test_counters_roles_and_obsolete_rows(spark):
    rows = spark.createDataFrame([(1, True, "ok"), (1, True, "not_found"), (1, False, "ok"), (2, True, None)], "app_id long, is_procedure boolean, status string")
    assert sorted(map(tuple, enrich.counters(rows).collect())) == [(1, 1, 2, 1), (2, 0, 1, 0)]
    roles = spark.createDataFrame([(1, "T", "mixto")], "app_id long, key string, role string")
    asked = spark.createDataFrame([(1, "dbo.t"), (1, "u"), (2, "t"), (1, None)], "app_id long, target string")
    assert sorted(r.role for r in structure.with_roles(asked, roles).collect()) == ["indeterminado"] * 3 + ["mixto"]
    apps = spark.createDataFrame([(1, "obsoleta"), (2, None), (3, "borrador")], "app_id long, review_status string")
    assert sorted(r.app_id for r in P.without_obsolete(apps).select(F.col("app_id")).collect()) == [2, 3]


def test_catalog_queries_of_plain_names_only():
    assert "OBJECT_ID('dbo.T_1')" in corpus.catalog_query("foreign_keys", "T_1") and "dbo.P" in corpus.catalog_query("result_set", "P")


def test_bytes_that_are_not_text_are_left_out(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "bad.cs").write_bytes(b"caf\xe9 \xc3\xa9")
    (tmp_path / "A" / "good.cs").write_bytes("\ufeffx \ufffd é".encode())
    got = {r.path: r.text for r in corpus.code(spark, str(tmp_path)).collect()}
    assert got == {"bad.cs": "caf é", "good.cs": "x \ufffd é"}
