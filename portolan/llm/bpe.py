"""Byte-level BPE by a pair occurrence index.

Texts of a partition are cut into words by the pattern of byte-level tokenizers; words not met before are laid one after
the other as symbols of single bytes. An index maps each adjacent pair that has a rank to all its places. Ranks that are
active are applied in ascending order from a heap: all places of the pair are merged at once, and the lists of the pairs
that arise on either side are extended. Merges never cross words, so the order within each word is BPE's own.

Words met are kept for the partition (up to a bound, then forgotten), which changes the work and not the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from portolan.llm.textio import arrow_map, slices, texts_of

#: How byte-level BPE splits a text before merging; white space as in Unicode's property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts below U+0250, spelled out for the faster engine of the standard library; only a contraction begins with an apostrophe, so letters can come first.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORDS = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SLICE_CHARS, KEPT_WORDS = 16_000_000, 500_000


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``starts`` and have ``sizes``, for each of ``rows``, one after the other."""
    sizes = sizes[rows]
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[rows] - ends + sizes, sizes) + np.arange(ends[-1])]


def _laid(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


class PairIndexBPE:
    """Encoder and decoder for a tokenizer file with a byte-level BPE model and no normalizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word boundaries aren't read")
        chars = _byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.base = np.array([vocab[c] for c in chars], np.int32)
        size = max(chain(vocab.values(), (t["id"] for t in spec["added_tokens"]))) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.decimals = _laid([b"%d," % i for i in range(size)])
        self.token_bytes = _laid(self.bytes_of)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.pair = keys
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.words, self.latin_words, self.beyond_latin = regex.compile(WORDS), re.compile(LATIN_WORDS), re.compile("[^\0-\u024f]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text; strings of added tokens in it are their ids."""
        if len(self.index) > KEPT_WORDS:
            self._forget()
        known = len(self.index)
        parts = [self._words(t) for t in texts]
        if fresh := list(self.index)[known:]:
            flat, sizes = self._merge(fresh)
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return [self._gather(p) for p in parts]

    def _words(self, text: str) -> np.ndarray:
        """The text's words as places in the index; ``-1 - id`` for an added token."""
        look, found = self.index.__getitem__, []
        split = (self.latin_words if text.isascii() or not self.beyond_latin.search(text) else self.words).findall
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                found += map(look, split(text[at : m.start()]))
                found.append(-1 - self.added[m[0]])
                at = m.end()
        if at or found:
            found += map(look, split(text[at:]))
            return np.array(found, np.int64)
        words = split(text)
        return np.fromiter(map(look, words), np.int64, len(words))

    def _gather(self, words: np.ndarray) -> np.ndarray:
        special = words < 0
        at = np.where(special, 0, words)
        sizes = np.where(special, 1, self.starts[at + 1] - self.starts[at]) if len(self.starts) > 1 else np.ones(len(words), np.int64)
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.int32)
        first = ends - sizes
        places = np.repeat(self.starts[at] - first, sizes) + np.arange(ends[-1])
        if not special.any():
            return self.flat[places]
        places[first[special]] = 0
        out = self.flat[places] if len(self.flat) else np.zeros(len(places), np.int32)
        out[first[special]] = -1 - words[special]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], -1) if len(self.keys) else np.full(len(keys), -1)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, one after the other, and how many each has."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"\0" + b"\0".join(data) + b"\0", np.uint8)
        symbols = self.base[raw]
        walls = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols[walls] = -1
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, at: np.ndarray) -> None:
            good = ranks >= 0
            ranks, at = ranks[good], at[good]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if rank in places:
                    places[rank].append(group)
                else:
                    places[rank] = [group]
                    heapq.heappush(active, rank)

        enter(self._rank(symbols[:-1], symbols[1:]), np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            groups = places.pop(rank)
            at = np.sort(np.concatenate(groups) if len(groups) > 1 else groups[0])
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            left, right = int(self.pair[rank] >> 32), int(self.pair[rank] & 0xFFFFFFFF)
            at = at[symbols[at] == left]
            at = at[symbols[after[at]] == right]
            if left == right and len(at) > 1:  # of overlapping places, every other one from the left
                begins = np.concatenate([[True], at[1:] != after[at[:-1]]])
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = self.made[rank], -2
            after[at], before[beyond] = beyond, at
            prior = before[at]
            enter(np.concatenate([self._rank(symbols[prior], symbols[at]), self._rank(symbols[at], symbols[beyond])]), np.concatenate([prior, at]))
        ids = symbols[symbols >= 0]
        left_over = np.add.reduceat((symbols >= 0).astype(np.int64), walls[:-1]) if len(words) else np.zeros(0, np.int64)
        return ids, left_over

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return ragged(*self.token_bytes, ids).tobytes().decode("utf-8", "replace")

    def joined(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by commas."""
        return ragged(*self.decimals, ids).tobytes()[:-1]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_codecs: dict[str, PairIndexBPE] = {}


def codec(path: str) -> PairIndexBPE:
    """The codec of a file, once a process."""
    if path not in _codecs:
        _codecs[path] = PairIndexBPE(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every row's whole text (null: empty, no ids). Repeated rows and null ids are kept;
    an empty table gives an empty result; other columns aren't looked at. ``path`` is read on each executor."""

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch, "text")
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            yield {"doc_id": batch.column(0).slice(a, b - a), "ids": codec(path).encode(texts[a:b])}

    return arrow_map(_named(docs, id_col, text_col, "text"), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", run)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row of ids (null: the empty text)."""

    def run(batch: pa.RecordBatch):
        ids = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "text": [codec(path).decode(np.array(x or [], np.int32)) for x in ids]}

    return arrow_map(_named(coded, id_col, ids_col, "ids"), f"doc_id {coded.schema[id_col].dataType.simpleString()}, text string", run)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256, lossless``. Nulls and repeated rows as in ``encode``."""

    def run(batch: pa.RecordBatch):
        texts, c = texts_of(batch, "text"), codec(path)
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            out: dict = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "lossless": []}
            for text, ids in zip(texts[a:b], c.encode(texts[a:b])):
                back = c.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(c.joined(ids)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                out["lossless"].append(back == text)
            yield out

    return arrow_map(_named(docs, id_col, text_col, "text"), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", run)


def _named(frame: DataFrame, id_col: str, col: str, name: str) -> DataFrame:
    return frame.select(frame[id_col].alias("doc_id"), frame[col].alias(name))
