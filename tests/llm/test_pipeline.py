from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import pytest

from tests.llm.test_jaccard_join import brute
from tests.llm.test_toxicity import corpus

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies and leaks among them, beside labels and a benchmark."""
    path = tmp_path_factory.mktemp("data")
    rng = random.Random(11)
    rows, labels = corpus(500, seed=7)
    clean = [i for (i, _), (_, t) in zip(rows, labels) if not t]
    word = lambda: "".join(rng.choice("pqrstuv") for _ in range(7))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(5)]
    copies = [(1000 + k, rows[i][1]) for k, i in enumerate(clean[:40])]
    near = []
    for k in range(20):
        w = [word() for _ in range(80)]
        near += [(2000 + 2 * k, " ".join(w)), (2001 + 2 * k, " ".join(w[:-1] + ["changed"]))]
    leaks = [(3000 + k, " ".join([word() for _ in range(30)] + [items[k % 5][1]])) for k in range(10)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + copies + near + leaks], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, labels, copies, near, leaks


def test_stages_and_results_as_by_brute_force(spark, folder):
    import corpus_pipeline as P

    path, rows, labels, copies, near, leaks = folder
    toxic = {i for i, t in labels if t}
    left = {i: t for i, t in rows + copies + near + leaks if i not in toxic}
    by_text = {}
    for i, t in left.items():
        by_text[t] = max(i, by_text.get(t, -1))
    left = {i: t for t, i in by_text.items()}
    left = {i: left[i] for i in {c for c, _ in brute(list(left.items())).values()}}
    left = {i: t for i, t in left.items() if i < 3000}
    got = P.run(spark, path).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()} and len(got) == len(left)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
    assert len(P.STAGES) == 5


def test_odd_rows_pass_every_stage(spark, folder, odd):
    import corpus_pipeline as P

    docs = odd
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder[0])
    texts = [r.decoded_sha256 for r in docs.collect()]
    assert len(texts) == len(set(texts)) == 6


def test_each_stage_reads_what_the_one_before_has_written(spark, folder, monkeypatch):
    import corpus_pipeline as P

    seen = []

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            plan = docs._jdf.queryExecution().executedPlan().toString()
            seen.append((name, "Exchange" in plan or "Python" in plan or "Arrow" in plan, "Scan parquet" in plan or "FileScan parquet" in plan))
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(P, "STAGES", [watched(*s) for s in P.STAGES])
    P.run(spark, folder[0])
    assert [s[1:] for s in seen] == [(False, True)] * 5


def test_an_empty_table_passes_every_stage(spark, folder, docs):
    import corpus_pipeline as P

    found = docs([])
    for _, stage in P.STAGES:
        found = stage(spark, found, folder[0])
    assert found.collect() == []
