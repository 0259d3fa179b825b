"""Quality by an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Counts of character n-grams (up to ``ORDER``) come from all trusted texts of the training folds; discounts D1, D2, D3+ of each
order from its counts of counts; lower orders use continuation counts. All tables are sharded by n-gram: blocks of
texts give their distinct n-grams, these are joined with the tables of every order to interpolated probabilities, and
each block's texts are scored with the block's share. A text is kept when its perplexity is at most the quantile that
trusted, held-out texts of its language reach.

An n-gram is a pair of numbers: ``g``, the last three code points, and ``f``, those before them, ``BITS`` bits each.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.textio import Block, by_blocks, cut, held_out, marked, packed, packed_by_block, settled, texts_of, unpack, written

ORDER, BITS = 5, 21
#: What stands before and behind a text; code points end below it.
EDGE = 0x110000
#: The share of trusted held-out texts that are kept.
QUANTILE, BINS = 0.97, 100
SLICE, BLOCK_CHARS = 1_000_000, 32_000_000
_KEY = ["f", "g"]
_LOW = (1 << BITS) - 1


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each with its edges (``ORDER - 1`` before it, one behind), and the number of n-grams of each."""
    edge = np.full(ORDER - 1, EDGE, np.int32)
    parts: list[np.ndarray] = []
    for text in texts:
        parts += [edge, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32), edge[:1]]
    return np.concatenate(parts) if parts else edge[:0], np.array([len(t) + 1 for t in texts], np.int64)


class Alphabet:
    """The code points of some texts, numbered; n-grams of them as single sorted numbers where these fit, else by rank."""

    def __init__(self, codes: np.ndarray) -> None:
        here = np.zeros(EDGE + 1, bool)
        here[codes] = True
        self.points = np.flatnonzero(here)
        self.number = np.full(EDGE + 1, -1, np.int32)
        self.number[self.points] = np.arange(len(self.points), dtype=np.int32)
        self.bits = max(1, int(len(self.points)).bit_length())
        self.fits = self.bits * ORDER < 64

    def keys(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each character of texts as ``codes_of`` gives them."""
        numbers = self.number[codes].astype(np.int64)
        n = len(codes) - ORDER + 1
        key = np.zeros(max(0, n), np.int64)
        for k in range(ORDER):
            key = key << self.bits | numbers[k : k + n]
        wanted = np.ones(len(key), bool)  # those that reach into the next text are none
        ends = np.cumsum(sizes + ORDER - 1)
        for k in range(ORDER - 1):
            wanted[(ends - ORDER + 1 + k)[ends - ORDER + 1 + k < len(key)]] = False
        return key[wanted]

    def apart(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.points[(keys >> self.bits * (ORDER - 1 - k)) & ((1 << self.bits) - 1)].astype(np.int64) for k in range(ORDER)]
        return parts[0] << BITS | parts[1], parts[2] << 2 * BITS | parts[3] << BITS | parts[4]


def exact_grams(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``f`` and ``g`` of the n-gram that ends at each character of texts as ``codes_of`` gives them."""
    wide = codes.astype(np.int64)
    n = len(codes) - ORDER + 1
    f, g = (wide[:n] << BITS | wide[1 : n + 1], wide[2 : n + 2] << 2 * BITS | wide[3 : n + 3] << BITS | wide[4 : n + 4]) if n > 0 else (wide[:0], wide[:0])
    wanted = np.repeat(np.tile([True, False], len(sizes)), np.stack([sizes, np.full(len(sizes), ORDER - 1)], axis=1).ravel())[:n] if len(sizes) else np.zeros(0, bool)
    return f[wanted], g[wanted]


def distinct(f: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, each once, with the sums of ``n`` (else how often they occur)."""
    order = np.lexsort((g, f))
    f, g = f[order], g[order]
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    starts = np.flatnonzero(first)
    total = np.diff(np.append(starts, len(f))) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n[:0]
    return f[starts], g[starts], total


class Grams(Block):
    """The distinct n-grams of a block with how often they occur."""

    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: pa.RecordBatch) -> Iterable[dict]:
        codes, sizes = codes_of(texts_of(rows))
        alphabet = Alphabet(codes)
        if alphabet.fits:
            keys, n = np.unique(alphabet.keys(codes, sizes), return_counts=True)
            self.parts.append((*alphabet.apart(keys), n))
        else:
            self.parts.append(distinct(*exact_grams(codes, sizes)))
        if sum(len(p[0]) for p in self.parts[1:]) > max(400_000, len(self.parts[0][0])):
            self.merge()
        return ()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [distinct(*(np.concatenate(x) for x in zip(*self.parts)))]

    def end(self) -> Iterable[dict]:
        self.merge()
        f, g, n = self.parts[0]
        for a in range(0, len(f), 100_000):
            yield {"block": pa.array(np.full(len(f[a : a + 100_000]), self.number)), "f": pa.array(f[a : a + 100_000]), "g": pa.array(g[a : a + 100_000]), "c": pa.array(n[a : a + 100_000])}


def grams(texts: DataFrame) -> DataFrame:
    """``block, f, g, c``: the n-grams of each block of texts."""
    return by_blocks(texts, "block long, f long, g long, c long", Grams, BLOCK_CHARS, SLICE)


def count_grams(texts: DataFrame) -> DataFrame:
    """``f, g, c``: counts of the highest order in column ``text``, combined where they are read."""
    return grams(texts.select("text")).groupBy(*_KEY).agg(F.sum("c").alias("c"))


def _suffix(order: int, f: str = "f", g: str = "g") -> list[Column]:
    """The last ``order`` characters of an n-gram."""
    kept = [max(0, order - 3), min(order, 3)]
    return [F.col(c).bitwiseAND(F.lit((1 << BITS * k) - 1)).alias(c) if k else F.lit(0).cast("bigint").alias(c) for c, k in zip((f, g), kept)]


def _context(f: str = "f", g: str = "g") -> list[Column]:
    """All characters of an n-gram but the last, as ``hf`` and ``hg``."""
    return [F.shiftright(f, BITS).alias("hf"), F.shiftright(g, BITS).bitwiseOR(F.shiftleft(F.col(f).bitwiseAND(F.lit(_LOW)), 2 * BITS)).alias("hg")]


class KneserNey:
    """For each order a table of n-grams (alpha) and one of contexts (gamma), both by ``f, g``."""

    def __init__(self, highest: DataFrame) -> None:
        self.alpha: dict[int, DataFrame] = {}
        self.gamma: dict[int, DataFrame] = {}
        counts = highest
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                counts = written(counts.select(*_suffix(order)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c")))
            n = {r["c"]: r["n"] for r in counts.filter("c < 5").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
            d = discounts([n.get(k, 0) for k in (1, 2, 3, 4)])
            with_context = counts.select(*_KEY, "c", *_context())
            by_context = with_context.groupBy("hf", "hg").agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == k if k < 3 else F.col("c") >= 3).alias(f"n{k}") for k in (1, 2, 3)])
            by_context = by_context.select("hf", "hg", "total", (sum((F.col(f"n{k}") * F.lit(d[k - 1]) for k in (1, 2, 3)), F.lit(0.0)) / F.col("total")).alias("gamma"))
            off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            self.alpha[order] = with_context.join(by_context, ["hf", "hg"]).select(*_KEY, ((F.col("c") - off) / F.col("total")).alias("alpha"))
            self.gamma[order] = by_context.select("hf", "hg", "gamma")

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """``f, g, logp``: log10 of the interpolated probability of the last character of each distinct n-gram."""
        needed = {ORDER: wanted}
        for order in range(ORDER - 1, 0, -1):
            needed[order] = written(needed[order + 1].select(*_suffix(order)).distinct())
        lower = None
        for order in range(1, ORDER + 1):
            rows = needed[order].join(self.alpha[order], _KEY, "left").select(*_KEY, "alpha", *_context(), *[c.alias(f"s{n}") for c, n in zip(_suffix(order - 1), _KEY)])
            rows = rows.join(self.gamma[order], ["hf", "hg"], "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1.0 / (EDGE + 1)))
            else:
                rows = rows.join(lower.select(F.col("f").alias("sf"), F.col("g").alias("sg"), F.col("p").alias("below")), ["sf", "sg"])
            lower = written(rows.select(*_KEY, (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p")))
        return lower.select(*_KEY, F.log10("p").cast("float").alias("logp"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams met once to four times; within 0 to the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw))  # type: ignore[return-value]


class Shares:
    """A block's n-grams with their log probabilities, looked up for texts of the block."""

    def __init__(self, f: np.ndarray, g: np.ndarray, logp: np.ndarray) -> None:
        self.alphabet = Alphabet(np.concatenate([[EDGE], g & _LOW]).astype(np.int64))  # an n-gram ends at each character
        if self.alphabet.fits:
            number, bits = self.alphabet.number.astype(np.int64), self.alphabet.bits
            keys = np.zeros(len(f), np.int64)
            for part, shift in ((f, BITS), (f, 0), (g, 2 * BITS), (g, BITS), (g, 0)):
                keys = keys << bits | number[(part >> shift) & _LOW]
        else:
            self.f, self.g = np.unique(f), np.unique(g)
            keys = self._rank(f, g)
        order = np.argsort(keys)
        self.key, self.logp = keys[order], logp[order]

    def _rank(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        x, y = np.minimum(np.searchsorted(self.f, f), len(self.f) - 1), np.minimum(np.searchsorted(self.g, g), len(self.g) - 1)
        return np.where((self.f[x] == f) & (self.g[y] == g), x * len(self.g) + y, -1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of n-grams of each text and the sum of their log probabilities."""
        codes, sizes = codes_of(texts)
        keys = self.alphabet.keys(codes, sizes) if self.alphabet.fits else self._rank(*exact_grams(codes, sizes))
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        if (self.key[at] != keys).any():
            raise RuntimeError("a block holds other texts than when its n-grams were listed: the input isn't read in the same order each time")
        return sizes, np.add.reduceat(self.logp[at].astype(np.float64), np.cumsum(sizes) - sizes)


def perplexity(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``n_chars``, ``log_prob`` and ``perplexity`` of each whole text with its end, and without ``text``."""
    others = [c for c in docs.columns if c != "text"]
    in_blocks = written(grams(docs).select("block", *_KEY))
    table = model.probabilities(written(in_blocks.select(*_KEY).distinct()))
    wanted = in_blocks.join(table, _KEY).select("block", *_KEY, "logp")

    def scored(packs: pa.Table, tables: pa.Table) -> pa.Table:
        right = pa.concat_tables([unpack(p.as_py()) for p in tables.column("payload")])
        shares = Shares(*(right.column(c).to_numpy() for c in (*_KEY, "logp")))
        out: list[pa.Table] = []
        for p in packs.column("payload"):
            for part in unpack(p.as_py()).to_batches():
                n, total = shares.scores(texts_of(part))
                out.append(pa.table({c: part.column(c) for c in others} | {"n_chars": pa.array(n, pa.int64()), "log_prob": pa.array(total, pa.float64())}))
        return pa.concat_tables(out)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + ", n_chars long, log_prob double"
    found = packed(docs, BLOCK_CHARS, SLICE).groupBy("block").cogroup(packed_by_block(wanted).groupBy("block")).applyInArrow(scored, schema)
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log_prob") / F.col("n_chars")))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, threshold``: of rows ``trusted`` and held out, the perplexity that ``quantile`` of a language don't exceed, on a grid of a
    hundredth of a decade; the row of null holds for all languages together."""
    binned = scored.filter("trusted and held").select("lang", F.ceil(F.log10("perplexity") * BINS).alias("bin"))
    counts = binned.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    counts = counts.filter("lang is not null").unionByName(every)
    up = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) / F.sum("n").over(Window.partitionBy("lang"))
    return counts.withColumn("up", up).filter(F.col("up") >= quantile).groupBy("lang").agg(F.pow(F.lit(10.0), F.min("bin") / BINS).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", folds: int = 5, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_chars, log_prob, perplexity, threshold, keep`` for each row of ``docs``.

    Trusted are rows whose label is 1; the model counts those outside fold 0, thresholds come from those in it. A
    language without trusted held-out rows, or null, has the threshold of all; without any threshold all is kept.
    Null texts count as empty; repeated rows are scored each, and count each in training; of several labels of an id the largest holds; an empty table gives
    an empty result. Other columns aren't looked at.
    """
    good = labels.select(F.col("doc_id").alias("k"), (F.col(label_col) == 1).alias("t")).groupBy("k").agg(F.max("t").alias("t")).filter("t and k is not null").select("k")
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    learned = marked(rows.filter(~held_out("doc_id", folds)), good)
    scored = cut(perplexity(rows, KneserNey(written(count_grams(learned)))))
    scored = scored.join(good.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("k"), "left").withColumns({"trusted": F.coalesce("trusted", F.lit(False)), "held": held_out("doc_id", folds)})
    limits = cut(thresholds(scored, quantile))
    every = limits.filter("lang is null").first()
    of = limits.filter("lang is not null").select(F.col("lang").alias("l"), F.col("threshold").alias("own"))
    limit = F.coalesce("own", F.lit(every["threshold"] if every else None).cast("double"))
    scored = scored.join(of, F.col("lang") == F.col("l"), "left")
    return scored.withColumn("threshold", limit).select("doc_id", "lang", "n_chars", "log_prob", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
