from __future__ import annotations

from portolan.operators import enrich
from portolan.sources import catalogs


def connect(text):
    """A stand-in for a database: answers by question, as the text says."""

    class Connection:
        def cursor(self):
            return self

        def execute(self, sql, given):
            question = next(k for k, v in catalogs.QUESTIONS.items() if v == sql)
            if given[1].startswith("broken"):
                raise RuntimeError("denied")
            if question == "result_columns" and given[1].startswith("dynamic"):
                raise RuntimeError("can't tell")
            there = text != "Server=empty"
            self.rows = {
                "definition": [("CREATE " + given[1] if there else None,)], "parameters": [("@a", "int", 4, 1, 0, 7)], "result_columns": [("C", "int", 0)],
                "columns": [("A", "int", "NO", None, None), ("B", "char", "YES", 8, "x")] if there else [], "foreign_keys": [("A", "dbo.R", "X", "fk")],
            }[question]

        def fetchall(self):
            return self.rows

        def close(self):
            self.rows = None

    if text == "Server=gone":
        raise OSError("unreachable")
    return Connection()


def test_all_objects_in_one_job(spark):
    names = [("p", True), ("dynamic", True), ("broken", True), ("t", False)] + [(f"t{k}", False) for k in range(40)]
    rows = [(a, k, c, "dbo", n, p) for a in (1, 2) for k, c in enumerate(("Server=gone", "Server=empty", "Server=full")) for n, p in names]
    asked = spark.createDataFrame([(*r, "x") for r in rows], "app_id long, place int, connection string, schema string, name string, is_procedure boolean, status string")
    found = catalogs.read(asked, connect)
    got = {(r.app_id, r.place, r.name): r for r in found.collect()}
    assert len(got) == len(rows)
    full = got[1, 2, "p"]
    assert (full.status, full.definition, [tuple(x) for x in full.parameters], [tuple(x) for x in full.result_columns]) == ("ok", "CREATE p", [("@a", "int", 4, True, False, "7")], [("C", "int", False)])
    assert got[2, 2, "dynamic"].result_columns is None and got[2, 2, "dynamic"].status == "ok"
    assert (got[1, 2, "broken"].status, got[1, 2, "broken"].error, got[1, 0, "t"].error, got[1, 1, "p"].status) == ("error", "denied", "unreachable", "not_found")
    assert [tuple(x) for x in got[1, 2, "t"].columns] == [("A", "int", "NO", None, None), ("B", "char", "YES", 8, "x")] and [tuple(x) for x in got[1, 2, "t"].foreign_keys] == [("A", "dbo.R", "X", "fk")]
    chosen = {(r.app_id, r.name): r.place for r in enrich.picked(found).collect()}
    assert chosen[1, "t"] == 2 and chosen[1, "p"] == 0


def test_nothing_asked(spark):
    none = spark.createDataFrame([], "app_id long, place int, connection string, schema string, name string, is_procedure boolean")
    assert catalogs.read(none, connect).collect() == []
