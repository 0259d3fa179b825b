from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from portolan.llm import quality as Q


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries over tuples of characters."""
    pad = lambda t: ["\0"] * (Q.ORDER - 1) + list(t) + ["\0"]
    counts = {Q.ORDER: Counter(tuple(p[k : k + Q.ORDER]) for t in texts for p in [pad(t)] for k in range(len(p) - Q.ORDER + 1))}
    for n in range(Q.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, gamma = {}, defaultdict(Counter), defaultdict(lambda: defaultdict(float))
    for n, c in counts.items():
        d[n] = Q.discounts([sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)])
        for g, v in c.items():
            total[n][g[:-1]] += v
            gamma[n][g[:-1]] += d[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / (Q.EDGE + 1)
        c, t = counts[n].get(g, 0), total[n].get(g[:-1], 0)
        if not t:
            return p(g[1:])
        return (c - d[n][min(c, 3) - 1] if c else 0) / t + gamma[n][g[:-1]] / t * p(g[1:])

    return lambda text: sum(math.log10(p(tuple(x[k : k + Q.ORDER]))) for x in [pad(text)] for k in range(len(x) - Q.ORDER + 1))


@pytest.mark.parametrize("letters, block", [("abcé .X", 32_000_000), ("ab中丁\U0001f600é", 300), (None, 700)])
def test_scores_as_by_brute_force(spark, monkeypatch, letters, block):
    monkeypatch.setattr(Q, "BLOCK_CHARS", block)
    monkeypatch.setattr(Q, "SLICE", block // 3)
    rng = random.Random(2)
    letters = letters or [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000)]  # more than fit into one number
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60 if block > 1000 or len(letters) < 10 else 4000))) for _ in range(60)]
    train, test = texts[:40], texts[30:] + ["zzzz new", ""]
    model = Q.KneserNey(Q.count_grams(spark.createDataFrame([(t,) for t in train], "text string")))
    got = {r.doc_id: r.log_prob for r in Q.perplexity(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model).collect()}
    score = brute_model(train)
    assert got == {k: pytest.approx(score(t)) for k, t in enumerate(test)}


def test_noise_is_told_from_prose_and_thresholds_are_by_language(spark):
    rng = random.Random(4)
    prose = lambda lang: " ".join(rng.choice({"en": ["the", "and", "stone", "river", "hill"], "de": ["der", "und", "stein", "fluss", "berg"]}[lang]) for _ in range(60))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000 + i, "".join(rng.choice("!#%&/()=?XQZ") for _ in range(200)), "en") for i in range(10)] + [(2000, prose("en"), None), (2001, None, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(10)] + [(2000, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(frame, labels).collect()}
    assert len(got) == len(rows) and not any(got[1000 + i].keep for i in range(10))
    assert sum(got[i].keep for i in range(300)) >= 0.95 * 300 and got[2000].keep
    assert got[0].threshold != got[1].threshold


def test_odd_rows_without_labels_and_empty_tables(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.classify(odd, none).collect()
    assert len(got) == odd.count() and all(r.keep and r.threshold is None and math.isfinite(r.perplexity) for r in got)
    assert Q.classify(docs([]), none).collect() == []


def test_discounts_stay_within_bounds():
    assert Q.discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)
    assert all(0 < x <= k + 0.95 for k, x in enumerate(Q.discounts([1, 50, 1, 90])))


def test_characters_beyond_the_basic_plane_and_ideographs_are_told_apart():
    codes, sizes = Q.codes_of(["中", "丁", "\U0001f600", "a"])
    assert sizes.tolist() == [2] * 4 and len(set(codes.tolist())) == 5
    f, g = Q.exact_grams(codes, sizes)
    assert len(set(zip(f.tolist(), g.tolist()))) == 8
    alphabet = Q.Alphabet(codes)
    assert [x.tolist() for x in alphabet.apart(alphabet.keys(codes, sizes))] == [f.tolist(), g.tolist()]


def test_input_whose_order_changes_between_reads(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    rows = [(i, f"text {i % 13} of some words {i % 7}") for i in range(150)]
    dealt = docs(rows).repartition(6).withColumn("at", F.rand()).sortWithinPartitions("at").drop("at")
    of = lambda d: {r.doc_id: (round(r.log_prob, 6), r.keep) for r in Q.classify(d, labels).collect()}
    assert of(dealt) == of(docs(rows))
