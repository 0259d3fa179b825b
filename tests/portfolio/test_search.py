from __future__ import annotations

import random

from portolan.operators.search import TrigramIndex, trigrams


def test_finds_what_a_scan_finds(spark):
    random.seed(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "x_y", "100%", "İstanbul", "中文字", "a\nb", ""]
    rows = [(k % 50 if k != 7 else None, " ".join(random.choices(words, k=random.randint(0, 6)))) for k in range(120)] + [(200, None), (201, "ab"), (202, "long " * 30_000 + "needle")]
    frame = spark.createDataFrame(rows, "id long, text string").cache()
    index = TrigramIndex.build(frame, "id", "text")
    for term in ["alpha", "BETA g", "ma%alp", "b_ta", "x_y", "100%", "ÉLT", "文字", "中文字", "ab", "", "needle", "nothing here", "a\nb", "İst", "ta délt"]:
        want = sorted(map(str, frame.filter(frame.text.ilike(f"%{term}%")).collect()))
        assert sorted(map(str, index.search(frame, term).collect())) == want, term


def test_only_the_folders_of_the_term_are_read(spark):
    frame = spark.createDataFrame([(k, f"word{k} text{k * 7}") for k in range(300)], "id long, text string")
    index = TrigramIndex.build(frame, "id", "text")
    grams = index.grams_of("word12")
    assert grams == ["d12", "ord", "rd1", "wor"] and index.grams_of("a_b%c") == []
    found = index.candidates(grams)
    assert len(found.inputFiles()) > 0 and "folder" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert sorted(r.key for r in found.collect()) == [12, *range(120, 130)]
    assert spark.range(1).select(trigrams(__import__("pyspark").sql.functions.lit("ABCAB"))).first()[0] == ["abc", "bca", "cab"]


def test_empty_rows(spark):
    frame = spark.createDataFrame([], "id long, text string")
    index = TrigramIndex.build(frame.union(spark.createDataFrame([(1, "abc")], "id long, text string")), "id", "text")
    assert index.search(frame, "abc").collect() == []
