from __future__ import annotations

import random

from portolan.operators import structure


def test_findings_by_method_as_by_pairs(spark):
    rng = random.Random(2)
    paths, suffixes = ("app/a/F1.cs", "app\\b\\F1.cs", "F1.cs", "x/F2.cs", None, ""), ("F1.cs", "a/F1.cs", "b\\F1.cs", "xF1.cs", "2.cs", None, "")
    methods = [(f"C{rng.randint(0, 2)}", f"M{rng.randint(0, 2)}", rng.choice(paths), k) for k in range(60)]
    findings = [(f"C{rng.randint(0, 2)}", f"M{rng.randint(0, 2)}", rng.choice(suffixes), k) for k in range(90)]
    m, f = spark.createDataFrame(methods, "class_name string, method string, path string, id long"), spark.createDataFrame(findings, "class_name string, method string, suffix string, k long")
    want = m.join(f, ["class_name", "method"]).filter(structure.ends_with_path(m["path"], f["suffix"])).collect()
    grouped = {r.id: [x.k for x in want if x.id == r.id] for r in want}
    got = structure.findings_by_method(m, f, "id", "k").collect()
    assert grouped and {r.id: (r.n_findings, r.first_finding) for r in got} == {i: (len(x), min(x)) for i, x in grouped.items()}


def test_findings_of_one_method_are_counted_before_they_meet_methods(spark):
    """Four thousand methods and four thousand findings of one name: sixteen million pairs are never rows."""
    m = spark.range(4000).selectExpr("'C' AS class_name", "'M' AS method", "'app/F.cs' AS path", "id")
    f = spark.range(4000).selectExpr("'C' AS class_name", "'M' AS method", "'F.cs' AS suffix", "id AS k")
    plan = structure.findings_by_method(m, f, "id", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.index("Join")


def test_one_hop_counts_as_by_rows(spark):
    rng = random.Random(3)
    calls = spark.createDataFrame([(f"C{rng.randint(0, 2)}", k % 40, f"M{rng.randint(0, 3)}", rng.choice(("resolved", "unknown"))) for k in range(80)], "class_name string, caller long, target_method string, resolution_status string")
    direct = spark.createDataFrame([(f"C{rng.randint(0, 2)}", f"M{rng.randint(0, 2)}", k) for k in range(50)], "class_name string, method string, operation long")
    rows = structure.one_hop_callers(calls, direct).collect()
    want = {c: [r.operation for r in rows if r.caller == c] for c in {r.caller for r in rows}}
    frame = structure.one_hop_counts(calls, direct)
    assert want and {r.caller: (r.n_operations, r.first_operation) for r in frame.collect()} == {c: (len(x), min(x)) for c, x in want.items()}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")
