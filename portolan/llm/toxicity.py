"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites each word of a clause as a symbol: an insult of one of three strengths, a threat, a target
(the person addressed), a negation, a reporting verb, or other. Transducers for insults, negation, reported speech, targets and
threats are composed into one machine that reads the symbols of a clause and writes what it matched: a plain, targeted,
negated or reported insult, or a threat at a target, each with the weight of its path. A target counts on either side: a
first transducer reads the clause from its end and marks insults and threats that a target follows. A document is scored by the weights
of its matched clauses through a logistic model.

What is learned from labelled rows: the insult lexicon (words and stems that mark toxic documents beyond chance, found
in many contexts rather than in copies of one text) and the weights of the logistic model, which start from
the grammar's own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from math import exp, log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import arrow_map, held_out, labelled_sample, text_slices, texts_of, written

FIT_ROWS = 20_000
#: A stem is a beginning of a word of four to this many letters, or the whole word.
LONGEST_STEM = 7
FIT_SLICE = 500_000

#: Words of each class, in the languages of the corpus; fixed values.
TARGETS = "you your yours yourself du dich dir dein deine ihr euch tu toi te vous votre tú ti usted ustedes tus".split()
NEGATIONS = "not never no neither nor nicht kein keine nie pas jamais aucun nunca ningún tampoco".split()
REPORTS = "said says called wrote reported claimed quoted sagte nannte berichtete dit appelle rapporte dijo llamó escribió".split()
THREATS = "kill murder stab shoot strangle umbringen töten erschießen tuer assassiner matar asesinar".split()
SEEDS = "idiot idiots moron morons scumbag imbecile arschloch connard gilipollas".split()

#: Symbols: insults by strength, threat, target, negation, report, other; what the machine writes.
INSULTS, SYMBOLS = "ABC", "ABCTYNRO"
KINDS = ("plain", "targeted", "threat", "negated", "reported")
STRENGTH = {"A": 1.0, "B": 0.7, "C": 0.4}
PRIOR = np.array([-3.0, 5.0, 6.0, 6.0, 3.0, 3.0])


class Transducer:
    """States from 0; ``step(state, symbol) -> (state, symbol written, weight)`` over a finite alphabet."""

    def __init__(self, states: int, alphabet: tuple, step) -> None:
        self.states, self.alphabet = states, alphabet
        self.arcs = {(s, a): step(s, a) for s in range(states) for a in alphabet}
        self.written = tuple(sorted({w for _, w, _ in self.arcs.values()}))

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: ``other`` reads what this one writes; weights multiply."""

        def step(state: int, symbol):
            a, b = divmod(state, other.states)
            a, between, weight = self.arcs[a, symbol]
            b, written, factor = other.arcs[b, between]
            return a * other.states + b, written, weight * factor

        return Transducer(self.states * other.states, self.alphabet, step)

    def run(self, symbols: Iterable[str]):
        state = 0
        for a in symbols:
            state, written, weight = self.arcs[state, a]
            if weight:
                yield written, weight


class FromBothEnds:
    """``forward`` reads what ``backward`` wrote for each symbol, which read them from the end."""

    def __init__(self, backward: Transducer, forward: Transducer) -> None:
        self.backward, self.forward = backward, forward

    def run(self, symbols: str):
        return self.forward.run([written for written, _ in self.backward.run(symbols[::-1])][::-1])


def grammar(reach: int = 3) -> FromBothEnds:
    """From the end: targets ahead. Then insult | threat, negation, reported speech, target; ``reach``: for how many words a cue counts."""

    def ahead(s, a):  # words left in which a target counts; insults and threats before one become small letters
        if a == "Y":
            return reach + 1, a, 1.0
        return max(0, s - 1), a.lower() if s and a in INSULTS + "T" else a, 1.0

    def lexical(_, a):
        strong = a.upper()
        return 0, ("I" if a == strong else "i") if strong in INSULTS else a, STRENGTH.get(strong, 1.0 if strong == "T" else 0.0)

    def negation(s, a):  # words left under a negation
        if a == "N":
            return reach, a, 1.0
        return max(0, s - 1), "n" if s and a in "ITit" else a, 1.0

    def report(s, a):  # until the clause ends
        return (1, a, 1.0) if a == "R" else (s, "r" if s and a in "Iin" else a, 1.0)

    def target(s, a):  # words left in which a target counts
        if a == "Y":
            return reach + 1, a, 1.0
        kind = {"I": "targeted" if s else "plain", "i": "targeted", "T": "threat" if s else "", "t": "threat", "n": "negated", "r": "reported"}.get(a, "")
        return max(0, s - 1), kind, 1.0 if kind else 0.0

    zeroth = Transducer(reach + 2, tuple(SYMBOLS), ahead)
    first = Transducer(1, zeroth.written, lexical)
    second = Transducer(reach + 1, first.written, negation)
    third = Transducer(2, second.written, report)
    fourth = Transducer(reach + 2, third.written, target)
    return FromBothEnds(zeroth, first.then(second).then(third).then(fourth))


#: Ends of clauses become line ends, everything else that isn't part of a word a space.
_CLAUSES = bytes(0x0A if chr(c) in ".!?;\n\r" else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words and line ends between clauses."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLAUSES).replace(b"\n", b" \n ").split(b" ")


def _stems(word: bytes) -> list[bytes]:
    """Whole word (marked by a space behind it) and its beginnings of at least four letters."""
    w = word[: 4 * LONGEST_STEM].decode("utf-8", "ignore")  # as many letters at least, if the word has them
    return [word + b" ", *(w[:k].encode() for k in range(4, min(len(w), LONGEST_STEM) + 1))]


class Lexicon(dict):
    """Symbols by token; unknown ones are looked up by stem and kept, up to a bound."""

    def __init__(self, stems: dict[bytes, str]) -> None:
        super().__init__()
        self.stems = stems
        fixed = [(b"", ""), (b"\n", "\n"), *((w.encode(), c) for c, ws in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("B", SEEDS)) for w in ws)]
        self.fixed = dict(fixed)
        self.update(self.fixed)

    def __missing__(self, token: bytes) -> str:
        if len(self) > 500_000:
            self.clear()
            self.update(self.fixed)
        symbol = min((s for k in _stems(token) if (s := self.stems.get(k))), default="O")
        self[token] = symbol
        return symbol


class Model:
    """Learned stems (stem -> insult strength) and weights (intercept, then one for each kind)."""

    def __init__(self, stems: dict[bytes, str], weights: np.ndarray) -> None:
        self.stems, self.weights = stems, weights
        self.ready: tuple | None = None

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "ready": None}

    def matches(self, text: str) -> dict[str, float]:
        """The weight matched of each kind, over all clauses of the whole text."""
        lexicon, machine = self.ready = self.ready or (Lexicon(self.stems), grammar())
        symbols = "".join([lexicon[t] for t in tokens(text)])
        out: dict[str, float] = {}
        if any(c in symbols for c in "ABCT"):
            for clause in symbols.split("\n"):
                for kind, weight in machine.run(clause):
                    out[kind] = out.get(kind, 0.0) + weight
        return out

    def features(self, found: dict[str, float]) -> list[float]:
        return [1.0, *(log1p(found.get(k, 0.0)) / log(2) for k in KINDS)]

    def score(self, found: dict[str, float]) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, float(np.dot(self.weights, self.features(found)))))))


def _marks(clean: Column, candidates: int, share: float) -> Column:
    """Whether a stem (n toxic rows, contexts) with ``clean`` clean rows marks toxic rows: mostly in toxic rows, in contexts of its own rather than in
    copies of a text, and beyond chance over all candidates (Chernoff's bound on a binomial's tail; ``share``: of toxic rows)."""
    own = F.least("n", "contexts").cast("double")
    total = own + clean
    q = own / total
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    tail = F.when(q <= share, 0.0).otherwise(-total * (q * F.log(q / share) + rest))
    return (F.col("contexts") >= 0.5 * F.col("n")) & (F.col("n") >= 4 * clean) & (own >= 3) & (tail + log(max(1, candidates)) < log(0.01))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from about ``fit_rows`` labelled rows at most (by a hash of the id) outside fold 0; rows with null labels
    aren't used. Without any, the model has the seed words and the grammar's own weights. All stems of the sampled rows are
    candidates for the lexicon; the driver gets those that mark toxic rows beyond chance.
    """
    marked = labels.select(F.col("doc_id").alias("k"), (F.col(label_col) == 1).alias("toxic")).filter("toxic is not null").groupBy("k").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(~held_out("doc_id", folds))
    rows = labelled_sample(known, marked, fit_rows)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        return Model({}, PRIOR)

    def toxic_stems(batch: pa.RecordBatch):
        for _, texts in text_slices(batch, FIT_SLICE):
            seen: dict[bytes, list] = {}
            for text in texts:
                here: dict[bytes, int] = {}
                ts = [t for t in tokens(text) if t not in (b"", b"\n")]
                for before, word, after in zip([b"", *ts], ts, [*ts[1:], b""]):
                    context = hash_of(before + b" " + after)
                    for stem in _stems(word):
                        here.setdefault(stem, context)
                for stem, context in here.items():
                    seen.setdefault(stem, []).append(context)
            yield {"stem": list(seen), "n": [len(x) for x in seen.values()], "contexts": [list(set(x)) for x in seen.values()]}

    found = arrow_map(rows.filter("toxic").select("doc_id", "text"), "stem binary, n long, contexts array<int>", toxic_stems)
    found = written(found.groupBy("stem").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("contexts")))).alias("contexts")).filter("n >= 3"))
    n_candidates = found.count()
    share = min(0.9, (n_toxic + 1) / (n_toxic + n_clean + 2))
    hopeful = found.filter(_marks(F.lit(0), n_candidates, share))  # some would still do if no clean row had them

    def clean_stems(batch: pa.RecordBatch):
        for _, texts in text_slices(batch, FIT_SLICE):
            counts: Counter = Counter()
            for text in texts:
                counts.update({s for word in set(tokens(text)) for s in _stems(word)})
            yield {"stem": list(counts), "n": list(counts.values())}

    clean = arrow_map(rows.filter("not toxic").select("doc_id", "text"), "stem binary, n long", clean_stems).groupBy("stem").agg(F.sum("n").alias("c"))
    judged = hopeful.join(clean, "stem", "left").withColumn("c", F.coalesce("c", F.lit(0))).filter(_marks(F.col("c"), n_candidates, share)).collect()
    stems = choose({bytes(r["stem"]): (r["n"], r["c"]) for r in judged}, n_toxic, n_clean)
    model = Model(stems, PRIOR)

    def described(batch: pa.RecordBatch) -> dict:
        return {"x": [model.features(model.matches(t)) for t in texts_of(batch)], "y": batch.column(batch.schema.get_field_index("toxic"))}

    seen = arrow_map(rows.select("doc_id", "text", "toxic"), "x array<double>, y boolean", described).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # at most fit_rows
    x, y, n = np.array([r["x"] for r in seen]), np.array([float(r["y"]) for r in seen]), np.array([float(r["n"]) for r in seen])
    return Model(stems, logistic(x, y, n, PRIOR))


def hash_of(data: bytes) -> int:
    return crc32(data) - (1 << 31)


def choose(pure: dict[bytes, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[bytes, str]:
    """Of the stems that mark toxic rows (numbers of toxic and clean rows) those listed, with their strength. Of stems in the same rows the longest
    one stands for all, and words that begin with a stem aren't listed beside it."""
    names = sorted(pure)
    out: dict[bytes, str] = {}
    for stem in sorted(pure, key=lambda s: (len(s), s)):
        if any(stem[:k] in out for k in range(1, len(stem))):
            continue
        longer = names[bisect_left(names, stem) + 1 : bisect_left(names, stem + b"\xff")]
        n, c = pure[stem]
        if any(pure[t][0] >= 0.95 * n for t in longer):
            continue
        weight = log((n + 0.5) / (n_toxic + 1)) - log((c + 0.5) / (n_clean + 1))
        out[stem] = "A" if weight >= 3 else "B" if weight >= 2 else "C"
    return out


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a logistic model of weighted rows, drawn to ``prior``."""
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * (w - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, plain, targeted, threat, negated, reported`` of every row's whole text: the probability that it
    is toxic and the weights matched. Null texts count as empty and get the intercept's score; repeated rows and null ids
    are kept; an empty table gives an empty result; other columns aren't looked at."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [model.matches(t) for t in texts_of(batch)]
        return {"doc_id": batch.column(0), "score": [model.score(m) for m in found]} | {k: [m.get(k, 0.0) for m in found] for k in KINDS}

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, " + ", ".join(f"{k} double" for k in KINDS), run)


def score_column(model: Model, text: Column) -> Column:
    """The score as a column, for filters that keep a table's own columns."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(model.matches(t or "")) for t in texts.to_pylist()], pa.float64())

    return toxic(text)
