"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive tokens of which only some positions count, so that a hit survives substitutions at the
others. Hashes of all places of the benchmark under each mask are joined with those of the documents; around each hit the
two texts are laid side by side without gaps and the best overlap is verified token by token, allowing substitutions.

A bitmap of the benchmark's hashes, with at least 512 bits for each up to a bound (``MAX_BITS``), tells on the executors which places of a document
can't be in the join, so that only the few others are shuffled. Beyond the bound it lets more places pass; the result is the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import arrow_map, bitmap, cut, in_bitmap, texts_of, windows, word_hashes

#: Masks of weight 7 over at most 13 tokens: 1 counts, 0 may differ. Every stretch of 13 tokens or more with 0.8 equal has a hit (any such
#: stretch holds one of 13 to 25 tokens, which the tests enumerate).
MASKS = ("100010011111", "111101011", "11001110011", "1101100000111", "1101001101001", "11110100101")
MIN_OVERLAP, MIN_IDENTITY = 13, 0.8
MIN_BITS, MAX_BITS = 16, 28


def _places(mask: str) -> list[int]:
    return [p for p, c in enumerate(mask) if c == "1"]


def _whole_masks(size: int, identity: float) -> list[str]:
    """Masks for a whole item of ``size`` tokens. At most d substitutions meet ``identity``: its tokens are dealt into d + 2 groups (or
    one each), and each mask leaves out d of them, so that one mask is free of any d substitutions."""
    d = int((1 - identity) * size + 1e-9)
    groups = min(size, d + 2)
    return ["".join("0" if p * groups // size in out else "1" for p in range(size)) for out in combinations(range(groups), d)] if d < size else []


def _seeds(words: np.ndarray, masks: tuple[str, ...], least: int, identity: float) -> list[tuple[int, int, int]]:
    """(mask, hash, place) of a benchmark text; one shorter than ``least`` or a mask is hashed as a whole under masks of its own length,
    numbered below 0."""
    out = []
    for k, mask in enumerate(masks):
        out += [(k, h, p) for p, h in enumerate(windows(words, _places(mask)).view(np.int64).tolist())] if len(mask) <= len(words) else []
    if 0 < len(words) < max(least, *map(len, masks)):
        for k, mask in enumerate(_whole_masks(len(words), identity)):
            out.append((-(len(words) << 16) - k, int(windows(words, _places(mask)).view(np.int64)[0]), 0))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """A row for each document and benchmark item that overlap: ``doc_id, item_id, overlap, matches, doc_at, item_at``.

    The overlap is the best of the ungapped stretches around hits that have at least ``min_overlap`` tokens, or the whole item where that
    is shorter, of which at least ``min_identity`` are equal (see ``_overlap``). Tokens are lower-cased runs of letters, digits and
    non-ASCII characters. Null, empty and wordless texts on either side overlap with nothing; of rows that repeat an id, on either side, each
    text is compared and the best overlap counts; rows with a null id are left out (see ``clean_documents``). Of overlaps at several shifts
    the longest counts, then the one with more matches, then the earlier one. An empty table on either side gives an empty result. Other columns aren't looked at.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null").distinct().withColumn("ih", F.xxhash64("text"))

    def tests(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("item_id", "ih", "words", "k", "h", "at")}
        for i, text, ih in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
            words = word_hashes(text)
            for n, (k, h, p) in enumerate(_seeds(words, masks, min_overlap, min_identity)):
                for c, v in zip(out, (i, ih, words.tobytes() if not n else None, k, h, p)):
                    out[c].append(v)
        return out

    seeds = cut(arrow_map(items, f"item_id {item_type}, ih long, words binary, k int, h long, at int", tests))
    bits = min(MAX_BITS, max(MIN_BITS, (512 * seeds.count()).bit_length()))
    known = bitmap(seeds.select("h"), "h", bits)
    short = sorted(r[0] for r in seeds.filter("k < 0").select("k").distinct().collect())  # a few for each length below min_overlap or a mask's
    offsets = {k: _places(mask) for k, mask in enumerate(masks)} | {k: _places(_whole_masks(-k >> 16, min_identity)[-k & 65535]) for k in short}

    def trains(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("id", "th", "words", "hits")}
        for i, text, th in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
            words, hits = word_hashes(text), []
            for k, places in offsets.items():
                hashes = windows(words, places)
                for p in np.flatnonzero(in_bitmap(known, hashes, bits)).tolist():
                    hits.append({"k": k, "h": int(hashes[p].view(np.int64)), "at": p})
            if hits:
                for c, v in zip(out, (i, th, words.tobytes(), hits)):
                    out[c].append(v)
        return out

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col)).filter("id is not null")
    hit = cut(arrow_map(texts, f"id {id_type}, th long, words binary, hits array<struct<k: int, h: bigint, at: int>>", trains))
    places = hit.select("id", "th", F.inline("hits")).withColumnRenamed("at", "doc_at")
    met = places.join(seeds.select("item_id", "ih", "k", "h", "at"), ["k", "h"]).select("id", "th", "item_id", "ih", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    test_words = seeds.filter("words is not null").select("item_id", "ih", F.col("words").alias("test"))
    train_words = hit.select("id", "th", "words").groupBy("id", "th").agg(F.max("words").alias("train"))
    laid = met.groupBy("id", "th", "item_id", "ih").agg(F.collect_set("shift").alias("shifts")).join(test_words, ["item_id", "ih"]).join(train_words, ["id", "th"])

    def verify(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("doc_id", "item_id", "overlap", "matches", "doc_at", "item_at")}
        for r in batch.to_pylist():
            test, train = np.frombuffer(r["test"], np.uint64), np.frombuffer(r["train"], np.uint64)
            found = [x for s in sorted(r["shifts"]) if (x := _overlap(train, test, s, min(min_overlap, len(test)), min_identity))]
            if found:
                for c, v in zip(out, (r["id"], r["item_id"], *max(found, key=lambda x: (x[0], x[1], -x[2])))):
                    out[c].append(v)
        return out

    found = arrow_map(laid.select("id", "item_id", "shifts", "test", "train"), f"doc_id {id_type}, item_id {item_type}, overlap int, matches int, doc_at int, item_at int", verify)
    best = F.max(F.struct("overlap", "matches", (-F.col("doc_at")).alias("before"), "item_at")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.overlap", "x.matches", (-F.col("x.before")).alias("doc_at"), "x.item_at")


def _stretch(train: np.ndarray, test: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """The best-scoring stretch (a match 1, a substitution -2) with ``test`` laid at ``shift`` of ``train``: tokens, matches, places in both."""
    a, b = max(0, shift), min(len(train), shift + len(test))
    same = train[a:b] == test[a - shift : b - shift]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    start = int(np.argmin(total[: end + 1]))
    return end - start, int(same[start:end].sum()), a + start, a + start - shift


def _overlap(train: np.ndarray, test: np.ndarray, shift: int, least: int, identity: float) -> tuple[int, int, int, int] | None:
    """A stretch at ``shift`` of at least ``least`` tokens of which at least ``identity`` are equal, wherever there is one: the best-scoring
    one if it is such, else the longest such one (of equal ones that with more matches, then the earlier)."""
    a, b = max(0, shift), min(len(train), shift + len(test))
    if b - a < max(1, least):
        return None
    best = _stretch(train, test, shift)
    if best[0] >= max(1, least) and best[1] >= identity * best[0]:
        return best
    matches = np.concatenate([[0], np.cumsum(train[a:b] == test[a - shift : b - shift])])
    over = matches - identity * np.arange(len(matches)) + 1e-9 * np.arange(len(matches))  # never falls from start to end of such a stretch
    start = np.searchsorted(-np.minimum.accumulate(over), -over)  # the earliest one for each end
    size = np.arange(len(over)) - start
    end = max(range(len(size)), key=lambda e: (size[e], matches[e] - matches[start[e]]))
    n, same, at = int(size[end]), int(matches[end] - matches[start[end]]), a + int(start[end])
    return (n, same, at, at - shift) if n >= max(1, least) else None


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns. Texts are told apart by their SHA-256, so that rows
    with null or repeated ids are treated like others."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    named = docs.select(digest.alias("key"), F.col(text_col).alias("text"))
    gone = leaks(named, benchmark, id_col="key", text_col="text", **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, digest == F.col("_gone"), "left_anti")
