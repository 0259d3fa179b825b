from __future__ import annotations

import random
from zlib import crc32

import pytest

from portolan.llm import toxicity as T


def test_grammar_tells_the_kinds_apart():
    g = T.grammar()
    kinds = lambda s: [k for k, _ in g.run(s)]
    assert kinds("OAO") == ["plain"] and kinds("YOA") == ["targeted"] and kinds("YOOOOOA") == ["plain"]
    assert kinds("NOA") == ["negated"] and kinds("NOOOOA") == ["plain"] and kinds("ROOOOA") == ["reported"] and kinds("RNA") == ["reported"]
    assert kinds("YT") == ["threat"] and kinds("OT") == [] and kinds("OOO") == []
    assert dict(g.run("AOC"))["plain"] == pytest.approx(0.4) and next(g.run("A"))[1] == 1.0


def test_composition_reads_what_the_first_writes():
    a = T.Transducer(1, ("x", "y"), lambda s, c: (0, c.upper(), 2.0))
    b = T.Transducer(2, ("X", "Y"), lambda s, c: (1 - s, c + str(s), 3.0))
    assert list(a.then(b).run("xyx")) == [("X0", 6.0), ("Y1", 6.0), ("X0", 6.0)]


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    words = [a + b for a in "ta re mo li ske bra".split() for b in "ndo vi lus per gat".split()]
    bad = ["grobble", "snarkx"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(words))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_stems_generalise_to_held_out_rows(spark, docs):
    rows, labels = corpus()
    frame, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(frame, marks)
    assert model.stems and all(s.startswith((b"grob", b"snar")) for s in model.stems)
    truth = dict(labels)
    got = {r.doc_id: r.score for r in T.score(frame, model).collect()}
    out = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    assert out and all((got[i] >= 0.5) == bool(truth[i]) for i in out)


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    rows, labels = corpus(300)
    flipped = [(i, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    frame = docs(rows)
    a, b = (T.fit(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.stems == b.stems and (a.weights == b.weights).all()


def test_copies_of_a_text_teach_no_words(spark, docs):
    rows, labels = corpus(500)
    rows += [(1000 + k, "quixel wobbet zandor plimth, you know") for k in range(40)]
    labels += [(1000 + k, 1) for k in range(40)]
    model = T.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not any(s.startswith((b"quix", b"wobb", b"zand", b"plim")) for s in model.stems)


def test_odd_rows_and_no_labels(spark, docs, odd):
    model = T.fit(odd, spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int"))
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.5 for r in got)
    assert T.score(docs([]), model).collect() == []
    assert odd.filter(T.score_column(model, odd["text"]) < 0.5).columns == odd.columns
    seeded = {r.doc_id: r for r in T.score(docs([(1, "You are an idiot."), (2, "nobody is not an idiot"), (3, "fine")]), model).collect()}
    assert seeded[1].targeted > 0 and seeded[1].score > seeded[3].score and seeded[2].negated > 0


def test_targets_behind_a_threat_or_an_insult_count():
    g = T.grammar()
    kinds = lambda s: [k for k, _ in g.run(s)]
    assert kinds("TY") == kinds("TOY") == kinds("OOTY") == kinds("TOOOY") == ["threat"] and kinds("TOOOOY") == kinds("TO") == []
    assert kinds("AY") == kinds("AOY") == ["targeted"] and kinds("AOOOOY") == ["plain"] and kinds("ATY") == ["targeted", "threat"]
    assert kinds("NTY") == kinds("NAY") == ["negated"] and kinds("RAY") == ["reported"] and dict(g.run("COY")) == {"targeted": pytest.approx(0.4)}
    for k in range(8):  # as far as before it
        assert kinds("A" + "O" * k + "Y") == kinds("Y" + "O" * k + "A")


def test_a_threat_in_the_usual_word_order_is_toxic():
    model = T.Model({}, T.PRIOR)
    score = lambda text: model.score(model.matches(text))
    for text in ("I will kill you", "We shoot your family!", "Tomorrow. Voy a matar a tu hermano."):
        assert score(text) >= 0.5 and model.matches(text) == {"threat": 1.0}
    assert score("The frost will kill. You may sow again.") < 0.5 and model.matches("Idiot, you") == {"targeted": 0.7}
