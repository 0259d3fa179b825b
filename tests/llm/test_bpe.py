from __future__ import annotations

import hashlib
import random

import pytest

from portolan.llm import bpe
from portolan.llm.queries import tokenizer_path

PATH = tokenizer_path()
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(3)
    latin = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0abcthe'sdlvre0189²½ªµº×÷ßéÿĀɏ!?.,;<|>_") + ["'s", "'LL", "'ll", "   ", "aaaa", "\n\n", SPECIAL]
    wide = latin + list(" 　٣漢字🙂‍́퟿")
    out = ["", " ", SPECIAL, SPECIAL * 2, f"a{SPECIAL} b", "aaaaaaa" * 50, "x" * 30_000, "The the  the\n\nthe 's 'S don't"]
    return out + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 70))) for chars in (latin, wide) for _ in range(1500)]


def test_ids_and_text_are_the_librarys(library):
    texts, c = samples(), bpe.PairIndexBPE(PATH)
    got = [x for a in range(0, len(texts), 500) for x in c.encode(texts[a : a + 500])]
    for text, ids in zip(texts, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert c.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = samples()[:300]
    want = [x.tolist() for x in bpe.PairIndexBPE(PATH).encode(texts)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 1)
    c = bpe.PairIndexBPE(PATH)
    assert [c.encode([t])[0].tolist() for t in texts] == want


def test_round_trip_of_odd_rows(odd, library):
    rows = odd.collect()
    got = bpe.round_trip(odd, PATH).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in rows]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.lossless) for r in got), key=str) == sorted(((i, len(ids), digest(",".join(map(str, ids))), digest(t), True) for i, ids, t in want), key=str)


def test_encode_then_decode(docs):
    frame = docs([(1, "naïve text " + SPECIAL), (2, None)])
    back = bpe.decode(bpe.encode(frame, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "naïve text " + SPECIAL, 2: ""}
    assert bpe.round_trip(docs([]), PATH).collect() == []


def test_other_files_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="prefix space"):
        bpe.PairIndexBPE(str(tmp_path / "t.json"))
