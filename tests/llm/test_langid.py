from __future__ import annotations

import itertools
import random
from zlib import crc32

import numpy as np
import pytest

from portolan.llm import langid as L

SYLLABLES = {"en": "the ing tion and er wh sh".split(), "de": "sch ung ein keit ich pf ü".split(), "fr": "eau oi ment ère que aux é".split()}


def text(lang, rng, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_forward_backward_as_by_enumeration():
    rng = np.random.default_rng(0)
    transition, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sequences = [rng.normal(size=(n, 3)) for n in (5, 4, 1, 0)]
    got, pairs, logz = L.forward_backward(sequences, transition, start)
    want_pairs, want_z = np.zeros((3, 3)), 0.0
    for s, m in zip(sequences, got):
        paths = list(itertools.product(range(3), repeat=len(s)))
        w = np.exp([start[p[0]] + sum(s[t, p[t]] for t in range(len(p))) + sum(transition[a, b] for a, b in zip(p, p[1:])) if p else 0 for p in paths])
        want_z += np.log(w.sum())
        p = w / w.sum()
        for t in range(len(s)):
            assert m[t] == pytest.approx([sum(q for x, q in zip(paths, p) if x[t] == k) for k in range(3)])
        for x, q in zip(paths, p):
            for a, b in zip(x, x[1:]):
                want_pairs[a, b] += q
    assert pairs == pytest.approx(want_pairs) and logz == pytest.approx(want_z)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(2)
    return L.train([(lang, text(lang, rng)) for lang in SYLLABLES for _ in range(60)])


def test_languages_of_new_texts_and_of_words_in_mixed_ones(tagger):
    rng = random.Random(9)
    for lang in SYLLABLES:
        found = tagger.classify([text(lang, rng) for _ in range(20)])
        assert all(f[0] == lang and 0.5 < f[1] <= 1 for f in found)
    parts = [("de", text("de", rng, 12)), ("fr", text("fr", rng, 12))]
    m = tagger.marginals([" ".join(t for _, t in parts)])[0]
    truth = [lang for lang, t in parts for _ in L.words(t)]
    assert sum(tagger.languages[k] == x for k, x in zip(m.argmax(axis=1), truth)) >= len(truth) - 2


def test_results_dont_depend_on_the_batch(tagger):
    rng = random.Random(1)
    texts = [text(rng.choice(list(SYLLABLES)), rng, rng.randint(0, 50)) for _ in range(30)] + [""]
    together, alone = tagger.classify(texts), [tagger.classify([t])[0] for t in texts]
    assert [(a[0], round(a[1], 9), a[2]) for a in together] == [(b[0], round(b[1], 9), b[2]) for b in alone]


def test_fit_uses_labelled_rows_outside_the_held_out_fold_only(spark, docs, odd):
    rng = random.Random(3)
    rows = [(i, text(lang, rng), lang if crc32(str(i).encode()) % 5 else "xx") for i, lang in enumerate(list(SYLLABLES) * 40)] + [(999, None, "yy"), (998, "abc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tagger = L.fit(frame)
    assert tagger.languages == ["de", "en", "fr"]
    out = {r.doc_id: r for r in L.identify(frame, tagger).collect()}
    held = [(i, t) for i, (_, t, lang) in enumerate(rows[:120]) if lang == "xx"]
    names = list(SYLLABLES) * 40
    assert sum(out[i].lang_pred == names[i] for i, _ in held) >= 0.95 * len(held)
    assert (out[999].lang_pred, out[999].score) == ("und", 0.0)
    got = L.identify(odd, tagger).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 6, 8)} == {"und"}
    none = L.fit(docs([(1, "abc")], lang=None))
    assert none.languages == [] and L.identify(docs([(1, "abc"), (2, None)]), none).collect()[0].lang_pred == "und"
    assert L.identify(docs([]), tagger).collect() == []
    words = L.label_words(docs([(1, "the schung eau")]), tagger).collect()[0]
    assert words.word == ["the", "schung", "eau"] and len(words.lang) == len(words.probability) == 3


def test_only_letters_count_and_long_runs_are_read_whole(tagger):
    assert L.words("a² ½b Ⅷ① x_y 3z") == ["a", "b", "x", "y", "z"]
    assert [f[0] for f in tagger.classify(["² ½ ① Ⅷ 12", "٣"])] == ["und", "und"]
    assert "".join(L.words("ab" * 400)) == "ab" * 400 and max(map(len, L.words("ab" * 400))) == L.LONGEST


def test_each_language_has_its_own_sample(spark):
    rng = random.Random(5)
    rows = [(i, text("en", rng), "en") for i in range(2000)] + [(5000 + i, text("fr", rng), "fr") for i in range(4)] + [(7, "same text", "en")] * 300
    tagger = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=40)
    assert tagger.languages == ["en", "fr"]
