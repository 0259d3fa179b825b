"""Language identification by a linear-chain conditional random field over words.

Each word has features: itself (lexicon), its beginnings and endings of up to three letters (affixes), and the letter
pairs and triples in it (n-grams), hashed into a fixed number of weights per language. Transition weights
between the languages of neighbouring words are learned with them, by gradient ascent on the conditional likelihood. Training
sequences are lines of labelled documents, put one behind the other in random order, so that they switch languages.
Forward-backward over every word of a text gives each word's distribution; a text's language is the one with
the most words in expectation.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import arrow_map, bounded_batches, held_out, joined, record_batch, text_slices, texts_of

FIT_ROWS, BUCKETS, STEPS, SEQUENCE = 250, 1 << 16, 25, 120
#: Longer runs of letters count as several words of this length, so that scripts without spaces are read whole.
LONGEST, SLICE = 128, 12_000_000
KEPT_WORDS, SLICE_WORDS = 300_000, 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters (as ``str.isalpha`` tells them), lower-cased; of runs above ``LONGEST`` its pieces."""
    found = _WORD.findall(text.lower())
    if all(w.isalpha() and len(w) <= LONGEST for w in found):
        return found
    runs = (r for w in found for r in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()))
    return [r[k : k + LONGEST] for r in runs for k in range(0, len(r), LONGEST)]


def features(word: str) -> list[int]:
    """Buckets of a word's lexicon, affix and n-gram features."""
    b = f"^{word}$".encode("utf-8", "surrogatepass")
    n = len(b)
    parts = [b, b[:2], b[:3], b[:4], b[-2:], b[-3:], b[-4:]]
    parts += [b[i : i + 3] for i in range(n - 2)]
    parts += [b[i : i + 4] for i in range(n - 3)]
    return [crc32(p, k << 8 if k < 7 else 7) & (BUCKETS - 1) for k, p in enumerate(parts)]


class Tagger:
    """Weights of a trained field: ``emission`` (buckets, languages), ``transition`` and ``start`` (languages)."""

    def __init__(self, languages: list[str], emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> None:
        self.languages, self.emission, self.transition, self.start = languages, emission, transition, start
        self._forget()

    def __getstate__(self):
        return self.languages, self.emission, self.transition, self.start

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    def _look_up(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > KEPT_WORDS:
            self._forget()
        known = len(self.index)
        out = []
        for text in texts:
            ws = words(text)
            out.append(np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws)))
        if fresh := list(self.index)[known:]:
            self.scores = np.concatenate([self.scores, emissions(self.emission, *flattened(fresh))])
        return out

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the distribution over languages of each of its words."""
        rows = self._look_up(texts)
        order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)))] * len(rows)
        at = 0
        while at < len(order):
            end, total = at, 0
            while end < len(order) and (end == at or total + len(rows[order[end]]) <= SLICE_WORDS):
                total += len(rows[order[end]])
                end += 1
            part = [rows[k] for k in order[at:end]]
            for k, m in zip(order[at:end], forward_backward([self.scores[p] for p in part], self.transition, self.start)[0]):
                out[k] = m
            at = end
        return out

    def classify(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """Language (``und`` without letters), its share in expectation, and the number of words."""
        out = []
        for m in self.marginals(texts):
            if not len(m):
                out.append(("und", 0.0, 0))
                continue
            share = m.mean(axis=0)
            best = int(np.argmax(share))
            out.append((self.languages[best], float(min(1.0, share[best])), len(m)))
        return out


def flattened(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [features(w) for w in ws]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((x for f in found for x in f), np.int32, int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes


def emissions(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The score of each word for each language: the sum of its features' weights."""
    out = np.empty((len(starts), weights.shape[1]), np.float32)
    for a in range(0, len(starts), 65536):
        b = min(len(starts), a + 65536)
        x, y = starts[a], starts[b] if b < len(starts) else len(flat)
        out[a:b] = np.add.reduceat(weights[flat[x:y]], starts[a:b] - x)
    return out


def forward_backward(sequences: list[np.ndarray], transition: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Marginals of each of ``sequences`` of scores (longest first), expected transitions, log of the partition functions."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    longest, languages = int(sizes[0]) if len(sizes) else 0, len(start)
    if not longest:
        return [np.zeros((0, languages)) for _ in sequences], np.zeros((languages, languages)), 0.0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # sequences of at least t + 1 words
    first = np.concatenate([[0], np.cumsum(alive)])
    flat = np.concatenate(sequences)
    begins = np.cumsum(sizes) - sizes
    place = np.concatenate([begins[:n] + t for t, n in enumerate(alive)])  # time-major
    score = flat[place].astype(np.float64)
    top = score.max(axis=1, keepdims=True)
    e, a = np.exp(np.maximum(score - top, -80.0)), np.exp(transition)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    x = e[: alive[0]] * np.exp(start)
    for t in range(longest):
        if t:
            x = (alpha[first[t - 1] : first[t - 1] + alive[t]] @ a) * e[first[t] : first[t + 1]]
        s = x.sum(axis=1)
        scale[first[t] : first[t + 1]] = s
        alpha[first[t] : first[t + 1]] = x / s[:, None]
    pairs = np.zeros((languages, languages))
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        here, there = slice(first[t], first[t] + n), slice(first[t + 1], first[t + 1] + n)
        ahead = e[there] * beta[there] / scale[there][:, None]
        pairs += (alpha[here].T @ ahead) * a
        beta[here] = ahead @ a.T
    m = alpha * beta
    m /= m.sum(axis=1, keepdims=True)
    back = np.empty_like(m)
    back[place] = m
    return np.split(back, begins[1:]), pairs, float(np.log(scale).sum() + top.sum())


def train(rows: list[tuple[str, str]], seed: int = 42, steps: int = STEPS) -> Tagger:
    """Learns from (language, text)."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    lines = [(number[lang], ws) for lang, text in rows for line in text.split("\n") if (ws := words(line))]
    random.Random(seed).shuffle(lines)
    vocabulary: defaultdict[str, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    sequences: list[tuple[list[int], list[int]]] = [([], [])]
    for lang, ws in lines:
        for a in range(0, len(ws), SEQUENCE):
            part = ws[a : a + SEQUENCE]
            if len(sequences[-1][0]) + len(part) > SEQUENCE:
                sequences.append(([], []))
            sequences[-1][0].extend(map(vocabulary.__getitem__, part))
            sequences[-1][1].extend([lang] * len(part))
    sequences.sort(key=lambda s: -len(s[0]))
    n = len(languages)
    emission, transition, start = np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)), np.zeros(n)
    if not sequences[0][0]:
        return Tagger(languages, emission, transition, start)
    flat, starts = flattened(list(vocabulary))
    word_of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(flat))))
    ids = [np.array(s[0]) for s in sequences]
    gold = np.concatenate([s[1] for s in sequences])
    tokens = np.concatenate(ids)
    seen = np.zeros((n, n))
    for s in sequences:
        np.add.at(seen, (s[1][:-1], s[1][1:]), 1)
    firsts = np.bincount([s[1][0] for s in sequences if s[1]], minlength=n)
    truth = np.zeros((len(starts), n))
    np.add.at(truth, (tokens, gold), 1.0)
    squares, square_t = np.full((BUCKETS, n), 1e-6), np.full((n, n), 1e-6)
    for _ in range(steps):  # AdaGrad
        scores = emissions(emission, flat, starts)
        got, pairs, _ = forward_backward([scores[i] for i in ids], transition, start)
        flatly = np.concatenate(got)
        expected = np.stack([np.bincount(tokens, flatly[:, k], len(starts)) for k in range(n)], axis=1)
        slope = truth - expected
        by_bucket = np.stack([np.bincount(flat, slope[word_of, k], BUCKETS) for k in range(n)], axis=1) - 0.05 * emission
        squares += by_bucket**2
        emission += (0.3 * by_bucket / np.sqrt(squares)).astype(np.float32)
        slope_t = seen - pairs - 0.05 * transition
        square_t += slope_t**2
        transition = transition + 0.3 * slope_t / np.sqrt(square_t)
        start = np.log((firsts + 1) / (firsts.sum() + n))
    return Tagger(languages, emission, transition, start)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fit_rows: int = FIT_ROWS) -> Tagger:
    """Learns from about ``fit_rows`` different texts of each language (by a hash of id and text; all of them where there are fewer; whole
    texts), outside fold 0. Rows without a text or a language aren't used."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = named.filter("text is not null and lang is not null").filter(~held_out("doc_id", folds))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return train([])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, -(-fit_rows * 1_000_000 // n)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(42)), F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text").distinct()
    return train([(r["lang"], r["text"]) for r in sample.orderBy("lang", "text").collect()])


def identify(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_words`` of every row's whole text; ``und`` and 0 for null texts, texts without
    letters, and where nothing was learned. Repeated rows and null ids are kept; an empty table gives an empty result;
    other columns aren't looked at. Ties go to the language that is first by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType


    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_words long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in joined(batches, SLICE):
            for part, texts in text_slices(batch, SLICE):
                found = tagger.classify(texts) if tagger.languages else [("und", 0.0, 0)] * part.num_rows
                yield record_batch({"doc_id": part.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "n_words": [f[2] for f in found]}, target)

    return bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def label_words(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, word, lang, probability`` arrays in reading order: the labels of every word of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        found = tagger.marginals(texts) if tagger.languages else [np.zeros((0, 1))] * len(texts)
        return {"doc_id": batch.column(0), "word": [words(t)[: len(m)] for t, m in zip(texts, found)], "lang": [[tagger.languages[k] for k in m.argmax(axis=1)] if len(m) else [] for m in found], "probability": [m.max(axis=1) if len(m) else [] for m in found]}

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), f"doc_id {docs.schema[id_col].dataType.simpleString()}, word array<string>, lang array<string>, probability array<double>", run)
