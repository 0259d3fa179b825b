from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portolan.functions import sqltext as S
from portolan.operators import flow

SCHEMA = "app_id long, target string, is_sp boolean, resolved string, raw string, result_columns string"


@pytest.fixture
def findings(spark):
    def make(*rows):
        """rows of (app, target, sql[, result columns[, is a procedure]])"""
        return spark.createDataFrame([(r[0], r[1], r[4] if len(r) > 4 else False, r[2], "raw C#", r[3] if len(r) > 3 else None) for r in rows], SCHEMA)

    return make


def column(spark, expression, *values):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, t string").select("k", expression(F.col("t")).alias("x")).orderBy("k").collect()]


def test_operations(spark):
    sql = ["INSERT INTO t SELECT a FROM b", "update t set a=1", "delete  from t", "MERGE INTO t USING s", "merge t as x using s", "SELECT 1", "exec p", "selection", "UPDATE t \\r\\n SET a=1", None, ""]
    assert column(spark, S.operation, *sql) == ["insert", "update", "delete", "merge", "merge", "select", None, None, "update", None, None]


def test_columns(spark):
    assert column(spark, lambda c: S.columns("insert", c), "insert into t (a, [b], c) values (1,2,3)", "insert into t (a) OUTPUT inserted.Id values (1)", "insert into t values (1)", "insert into t (*) values(1)") == [["a", "b", "c"], ["a"], None, None]
    assert column(spark, lambda c: S.columns("update", c), "update t set a = f(x, y), b=2 where c = 3", "update t set a = case when d = 1 then 2 end") == [["a", "b"], ["a", "d"]]
    assert column(spark, lambda c: S.columns("select", c), "select top 5 g.A as x, [B], ISNULL(c, d, 0), COUNT(*), 1 from t", "select * from t", "select a,\n b\nfrom t", "select f(g(h(1, z), y), w), q from t") == [["A", "B"], None, ["a", "b"], ["q"]]
    assert column(spark, S.result_columns, '["a","b"]', "[]", "no json", None, '{"a":1}') == [["a", "b"], None, None, None, None]


def test_keys_and_names(spark):
    assert column(spark, S.table_key, " dbo.Tests ", "other.T", "cmd.CommandText", "using (x", None, "DBO.dbo.T") == ["TESTS", "OTHER.T", None, None, None, "DBO.T"]
    assert column(spark, S.is_strong, "TEST_DATE", "test_x_id", "TEST_ID", "il", "STATUS", "WAVE") == [True, True, False, True, False, False]
    assert column(spark, S.server_of, "Server=A;Database=b", "data  source = X ; initial catalog=y", "Server=a;SERVER=B", "Observer=z", "Server= ;x=1") == ["a", "x", "b", None, None]


def test_classification(spark):
    def of(text, procedure=False, connection=False):
        r = spark.createDataFrame([(text,)], "t string").select(S.classified(F.col("t"), F.lit(procedure), F.lit(connection)).alias("c")).first().c
        return r.category, r.target, r.is_procedure

    assert of('cmd.CommandText = "app_pkg.run(1)"') == ("oracle_package_call", "app_pkg.run", False)
    assert of('c = new SqlCommand("dbo.Run", x)') == ("stored_procedure", "dbo.Run", True)
    assert of("c = new SqlCommand(\"Run 'a','b'\", x)") == ("stored_procedure", "Run", True)
    assert of('c = new SqlCommand("select a from [dbo.T] where 1=1", x)') == ("query", "dbo.T", False)
    assert of('c = new SqlConnection("Run")', connection=True) == ("query", None, False)
    assert of("INSERT INTO x SELECT a FROM y") == ("query", "y", False)
    assert of('x = "WITH"', procedure=True) == ("stored_procedure", "WITH", True)


ROLES = [
    ("insert into T (IL, ReflA) values (1,2)", None, "productor_numerico"),
    ("update T set STATUS=1, DEVICE=2 where x=1", None, "productor_passfail"),
    ("insert into T (ILEndA, STATUS) values (1,2)", None, "productor_numerico"),
    ("select * from T", '["ILEndB", "x"]', "consumidor_medicion"),
    ("select STATUS, TEST_DATE from T", None, "consumidor_resultado"),
    ("select PassFail from T", None, "consumidor_resultado"),
    ("select Customer, Qty from T", None, "consumidor_general"),
    ("update T \\r\\n set STATUS = 1", None, "productor_passfail"),
    ("insert into T values (1)", None, "indeterminado"),
    ("select * from T", None, "indeterminado"),
    ("insert into T (WAVE, ILPassLimit, RLPassLimit) values (1,2,3)", None, "productor_passfail"),
    ("delete from T", None, "productor_passfail"),
    ("merge into T using s", None, "indeterminado"),
    ("select g.IL as x from T g", None, "consumidor_medicion"),
]


@pytest.mark.parametrize("sql, results, role", ROLES)
def test_role_of_one_statement(findings, sql, results, role):
    (r,) = flow.portfolio_roles(findings((1, "T", sql, results))).collect()
    assert (r.role, r.status) == (role, "unresolved_no_columns" if role == "indeterminado" else "resolved")


def test_context_confirms_an_ambiguous_read(findings):
    read = (1, "T", "select STATUS from T")
    role = lambda *rows: {r.app_id: r.role for r in flow.portfolio_roles(findings(read, *rows)).collect()}[1]
    assert role() == "consumidor_general"
    assert role((2, "dbo.t", "select TEST_DATE from dbo.t")) == "consumidor_resultado"
    assert role((2, "T", "select TEST_DATE from T", None, True)) == "consumidor_general"
    assert role((2, "U", "select TEST_DATE from U")) == "consumidor_general"


def test_both_ways_is_mixed_and_spellings_stay_apart(findings):
    rows = findings((1, "T", "select a from T"), (1, "T", "delete from T"), (1, "dbo.T", "select a from T"), (1, None, "select a from x"), (1, "T", "nothing"))
    assert {(r.target, r.role, r.n_reads, r.n_writes) for r in flow.portfolio_roles(rows).collect()} == {("T", "mixto", 1, 1), ("dbo.T", "consumidor_general", 1, 0)}


def test_relations(findings):
    rows = findings((1, "T", "insert into T (IL) values (1)"), (2, "dbo.T", "select a from T"), (3, "t", "select a from T"), (4, "T", "select * from T"), (5, "T", "select a from T"), (5, "T", "delete from T"))
    roles = flow.portfolio_roles(rows)
    assert {(r.producer, r.consumer) for r in flow.strong_relations(roles).collect()} == {(1, 2), (1, 3), (1, 5), (5, 2), (5, 3)}
    assert {(r.app_a, r.app_b) for r in flow.weak_relations(roles).collect()} == {(2, 3)}
    assert [r.app_id for r in flow.self_loops(roles).collect()] == [5]
    assert {(r.producer, r.consumer) for r in flow.relations_of(roles, 2).collect()} == {(1, 2), (5, 2)}


def test_one_application_alone_gives_what_the_portfolio_gives(spark, sf):
    from portolan.plans import rendered

    rows = rendered.flow_findings(spark, sf)
    for app in (7, 100, 1000, -1):
        want = flow.portfolio_roles(rows).filter(F.col("app_id") == app).select("target", "role", "status")
        got = flow.bounded_roles(rows, app).select("target", "role", "status")
        assert sorted(got.collect()) == sorted(want.collect())


def test_order_and_partitions_dont_matter(spark, sf):
    from portolan.plans import rendered

    rows = rendered.flow_findings(spark, sf)
    a, b = flow.portfolio_roles(rows), flow.portfolio_roles(rows.orderBy(F.desc("raw")).repartition(7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_counts_name_every_role(findings):
    got = [(r.role, r.n) for r in flow.role_counts(flow.portfolio_roles(findings((1, "T", "delete from T")))).orderBy("place").collect()]
    assert len(got) == 7 and sum(n for _, n in got) == 1


def test_footprint(spark):
    findings = spark.createDataFrame([(1, "T", "c"), (1, "U", "d"), (2, "T", "c")], "app_id long, target string, connection string")
    settings = spark.createDataFrame([(1, "c", "server=a", "sql_or_oracle"), (1, "d", "server=a", "sql_or_oracle"), (1, "d", "server=b", "sql_or_oracle"), (2, "c", "server=a", "other")], "app_id long, name string, value string, category string")
    assert {(r.app_id, r.target, r.server, r.status) for r in flow.footprint(findings, settings).collect()} == {(1, "T", "a", "resolved"), (1, "U", None, "ambiguous"), (2, "T", None, "unresolved")}


def test_relation_tables_as_their_evidence_without_moving_pairs(spark, sf):
    from portolan.operators import flow
    from portolan.plans import rendered
    from portolan.sources.store import stored

    ops = stored(flow.operations(rendered.flow_findings(spark, sf)))
    roles = stored(flow.roles(ops, flow.context(ops)))
    columns = ["producer", "consumer", "key", "written", "read"]
    frame = flow.relation_tables(flow.spelled_sides(ops, roles))
    want = flow.relation_evidence(ops, roles).select(*columns)
    assert frame.count() > 0 and frame.exceptAll(want).count() == 0 and want.exceptAll(frame).count() == 0
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
