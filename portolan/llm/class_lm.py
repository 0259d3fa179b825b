"""Class-based n-gram language model (Brown et al.) with exchange clustering of the whole vocabulary.

Words are counted over all training texts. The frequent words are clustered first, by moves between classes as long as the
likelihood of the class bigrams rises, and every other training word starts in the class that its neighbours among these speak for
most, by a heuristic. Exchange then goes on over all training words, frequent or not, with all their neighbours (``rounds``, one unless asked
for otherwise): in a round each word with ``places`` in training takes the class that makes these most likely by
the counts without it, all words at once (``_swept``), and a round is taken back if the likelihood with each place left out falls. The number of classes and that
of frequent words grow with the vocabulary (``classes_for``, ``frequent_for``). A token's probability is that of its class after the class
before, counted over all neighbours in training texts, times that of the word in its class; both are smoothed.

Words are told apart by 64-bit hashes. Texts are read in blocks (``by_blocks``): each block gives its distinct words, these are joined
with the counts and classes, and the block's texts are scored with the block's share of that table. The driver gets the bigrams of
the frequent words and the transitions of the classes; both are bounded by the numbers of these, which grow far more slowly than the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import END, Block, Tally, arrow_map, by_blocks, held_out, pack, packed, packed_by_block, record_batch, settled, token_hashes, unpack, written

SWEEPS, GROWTH, FREQUENT_PER_CLASS, ROUNDS, PLACES = 6, 0.3, 24, 1, 1
BLOCK_CHARS, SLICE, SHARD = 32_000_000, 2_000_000, 2_000_000  # characters of a block and a slice; training tokens whose words make a shard
PRIOR = 0.1
_SIDES = 1 << 15


def classes_for(kinds: int) -> int:
    """The number of classes for a vocabulary of ``kinds`` words: 64 for a million, 251 for a hundred million."""
    return max(2, min(_SIDES - 1, round(kinds**GROWTH)))


def frequent_for(classes: int) -> int:
    """The number of words that are clustered by exchange among each other."""
    return FREQUENT_PER_CLASS * classes


def exchange(first: np.ndarray, second: np.ndarray, n: np.ndarray, items: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of ``items`` from the counts ``n`` of their bigrams (``first``, ``second``, each pair once): starting from the most frequent
    ones apart, each item in turn goes to the class that gives the highest likelihood of the class bigrams, until none moves or for
    ``sweeps`` rounds."""
    n = n.astype(np.float64)
    after, before = _Neighbours(first, second, n, items), _Neighbours(second, first, n, items)
    order = np.argsort(-(np.bincount(first, n, items) + np.bincount(second, n, items)), kind="stable")
    k = min(classes, items)
    of = np.empty(items, np.int64)
    of[order] = np.arange(items) % k
    table = np.bincount(of[first] * k + of[second], n, k * k).reshape(k, k)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    value = f(table)
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            old = int(of[w])
            right, left, own = after.by_class(w, of, k), before.by_class(w, of, k), after.own[w]
            right[old] -= own
            left[old] -= own
            ahead, behind = np.flatnonzero(right), np.flatnonzero(left)
            if not len(ahead) and not len(behind) and not own:
                continue
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            value[old], value[:, old] = f(table[old]), f(table[:, old])
            row, column = table[:, ahead] + right[ahead], table[behind] + left[behind, None]
            gain = f(row).sum(axis=1) - value[:, ahead].sum(axis=1) + f(column).sum(axis=0) - value[behind].sum(axis=0)
            on = np.diag(table)  # the cell on the diagonal grows by all three at once
            gain += f(on + right + left + own) - f(on + right) - f(on + left) + f(on)
            gain -= _margin(table.sum(axis=1), left, right.sum() + own, f) + _margin(table.sum(axis=0), right, left.sum() + own, f)
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + 1e-9:
                best = old
            moved += best != old
            of[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            value[best], value[:, best] = f(table[best]), f(table[:, best])
        if not moved:
            break
    return np.unique(of, return_inverse=True)[1]


class _Neighbours:
    def __init__(self, of: np.ndarray, other: np.ndarray, n: np.ndarray, items: int) -> None:
        order = np.argsort(of, kind="stable")
        self.start, self.other, self.n = np.searchsorted(of[order], np.arange(items + 1)), other[order], n[order]
        self.own = np.bincount(of[of == other], n[of == other], items)

    def by_class(self, item: int, classes: np.ndarray, k: int) -> np.ndarray:
        a, b = self.start[item], self.start[item + 1]
        return np.bincount(classes[self.other[a:b]], self.n[a:b], k)


def _margin(sums: np.ndarray, from_others: np.ndarray, own: float, f) -> np.ndarray:
    """What the sum of f over class margins gains with each choice; what it gains with any choice is left out."""
    grown = sums + from_others
    return f(grown + own) - f(grown)


def neighbour_gains(bigrams: np.ndarray) -> np.ndarray:
    """For each class before a word, then each class behind it, what such a neighbour speaks for each class of the word: the logarithm of
    how much more often the two classes meet than by chance, damped where they rarely do."""
    chance = (np.outer(bigrams.sum(axis=1), bigrams.sum(axis=0)) + 1) / (bigrams.sum() + 1)
    gain = np.log1p(bigrams / chance)
    return np.concatenate([gain, gain.T])


def transitions(n: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each, smoothed by that of the class alone with the weight of the kinds seen."""
    k = len(n)
    alone = (n.sum(axis=0) + 1) / (n.sum() + k)
    kinds = (n > 0).sum(axis=1, keepdims=True) + 1.0
    return np.log10((n + kinds * alone) / (n.sum(axis=1, keepdims=True) + kinds))


def _codes(classes: int) -> tuple[str, type]:
    return ("binary", np.uint8) if classes < 256 else ("binary", np.uint16)


class Words(Block):
    """The distinct words of a block with their counts in training texts (0 for others)."""

    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.tally = Tally()

    def add(self, rows: pa.RecordBatch) -> Iterable[dict]:
        hashes, sizes = token_hashes(rows.column("text"))
        learned = np.repeat(~np.array(rows.column("held").to_pylist(), bool), sizes)
        words, at = np.unique(hashes, return_inverse=True)
        self.tally.add(words, np.bincount(at, learned, len(words)).astype(np.int64))
        return ()

    def end(self) -> Iterable[dict]:
        self.tally.merge()
        keys, sums = self.tally.keys.view(np.int64), self.tally.sums
        for a in range(0, len(keys), 100_000):
            yield {"block": pa.array(np.full(len(keys[a : a + 100_000]), self.number)), "w": pa.array(keys[a : a + 100_000]), "n": pa.array(sums[a : a + 100_000])}


def _learned(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the training texts of some rows, and for each whether it is a text's first; its left neighbour is an end in any case."""
    hashes, sizes = token_hashes(rows.column("text").filter(pa.array([not h for h in rows.column("held").to_pylist()])))
    first = np.zeros(len(hashes), bool)
    first[(np.cumsum(sizes) - sizes)[: len(sizes)]] = True
    return hashes, first


def _shard_packs(words: np.ndarray, of: np.ndarray, place: np.ndarray, code: np.ndarray, n: np.ndarray, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The counts ``n`` of words (by ``place`` in ``words``, ascending; their classes ``of``) beside classes (``code``) as a pack for each shard of the words' hashes."""
    shard = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard[place], kind="stable")
    place, code, n = place[order], code[order], n[order]
    edges = np.searchsorted(shard[place], np.arange(shards + 1))
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if a < b:
            met, sizes = np.unique(place[a:b], return_counts=True)
            listed = pa.table({"w": pa.array(words[met].view(np.int64)), "c": pa.array(of[met].astype(np.int32)), "size": pa.array(sizes.astype(np.int32))})
            yield s, pack(listed), pack(pa.table({"code": pa.array(code[a:b].astype(np.uint16)), "n": pa.array(n[a:b].astype(np.uint32))}))


def _of_shard(packs: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a shard in order with their classes, where the counts of each begin and end, and their codes and counts, those of all blocks added."""
    listed = pa.concat_tables([unpack(p.as_py()) for p in packs.column("words")])
    counts = pa.concat_tables([unpack(p.as_py()) for p in packs.column("counts")])
    words, first, at = np.unique(listed.column("w").to_numpy(), return_index=True, return_inverse=True)
    keys, inverse = np.unique(np.repeat(at, listed.column("size").to_numpy()) * (2 * k) + counts.column("code").to_numpy(), return_inverse=True)
    n = np.bincount(inverse, counts.column("n").to_numpy(), len(keys)).astype(np.int64)
    place, code = np.divmod(keys, 2 * k)
    return words, listed.column("c").to_numpy()[first], np.searchsorted(place, np.arange(len(words) + 1)), code, n


def _numbered(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted ``frequent``; -1 where it isn't there."""
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, at, -1)


def _frequent_bigrams(rows: DataFrame, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of frequent words over all training texts: numbers of both and how often."""
    size = len(frequent)

    class Pairs(Block):
        def __init__(self, number: int) -> None:
            super().__init__(number)
            self.tally = Tally()

        def add(self, part: pa.RecordBatch) -> Iterable[dict]:
            hashes, first = _learned(part)
            at = _numbered(hashes, frequent)
            before = np.concatenate([[0], at[:-1]])
            before[first] = _numbered(np.array([END], np.uint64), frequent)[0]
            met = (at >= 0) & (before >= 0)
            keys, n = np.unique(before[met] * size + at[met], return_counts=True)
            self.tally.add(keys.astype(np.uint64), n)
            return ()

        def end(self) -> Iterable[dict]:
            self.tally.merge()
            yield {"pair": pa.array(self.tally.keys.view(np.int64)), "n": pa.array(self.tally.sums)}

    found = by_blocks(rows, "pair long, n long", Pairs, BLOCK_CHARS, SLICE).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found.column("pair").to_numpy(), found.column("n").to_numpy()
    return pair // size, pair % size, n


def _assigned(rows: DataFrame, counts: DataFrame, frequent: np.ndarray, class_of: np.ndarray, gains: np.ndarray, shards: int) -> DataFrame:
    """``w, n, c``: the class of each training word; -1 for those that have no frequent neighbour."""
    k = int(class_of.max()) + 1
    end = class_of[_numbered(np.array([END], np.uint64), frequent)[0]]

    class Contexts(Block):  # for each word that isn't frequent the classes beside it: before as they are, behind from k on
        def __init__(self, number: int) -> None:
            super().__init__(number)
            self.met: list[tuple[np.ndarray, np.ndarray]] = []

        def add(self, part: pa.RecordBatch) -> Iterable[dict]:
            hashes, first = _learned(part)
            at = _numbered(hashes, frequent)
            known = np.where(at >= 0, class_of[at], -1)
            left = np.concatenate([[end], known[:-1]])
            left[first] = end
            right = np.concatenate([known[1:], [-1]])  # the token behind an end is never asked for: ends are frequent
            rare = np.flatnonzero(at < 0)
            word = np.concatenate([hashes[rare], hashes[rare]])
            code = np.concatenate([left[rare], np.where(right[rare] >= 0, right[rare] + k, -1)])
            self.met.append((word[code >= 0], code[code >= 0].astype(np.uint16)))
            return ()

        def end(self) -> Iterable[dict]:
            words, at = np.unique(np.concatenate([w for w, _ in self.met]), return_inverse=True)
            keys, n = np.unique(at * (2 * k) + np.concatenate([c for _, c in self.met]), return_counts=True)
            for shard, listed, counted in _shard_packs(words, np.zeros(len(words)), *np.divmod(keys, 2 * k), n, shards):
                yield {"shard": [shard], "words": [listed], "counts": [counted]}

    seen = by_blocks(rows, "shard int, words binary, counts binary", Contexts, BLOCK_CHARS, SLICE)

    def choose(packs: pa.Table) -> pa.Table:
        words, _, edges, code, n = _of_shard(packs, k)
        best = [np.zeros(0, np.int32)]
        for a in range(0, len(words), 4096):  # bounded rows of gains at once
            b = min(a + 4096, len(words))
            span = slice(edges[a], edges[b])
            best.append(_summed(gains, code[span], n[span], edges[a : b + 1] - edges[a]).argmax(axis=1).astype(np.int32))
        return pa.table({"w": pa.array(words), "c": pa.array(np.concatenate(best))})

    rare = seen.groupBy("shard").applyInArrow(choose, "w long, c int")
    common = rows.sparkSession.createDataFrame(pa.table({"w": pa.array(frequent.view(np.int64)), "c": pa.array(class_of.astype(np.int32))}))
    return counts.join(rare.unionByName(common), "w", "left").select("w", "n", F.coalesce("c", F.lit(-1)).alias("c"))


def _summed(gains: np.ndarray, codes: np.ndarray, n: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each run of ``codes`` between ``edges`` (none is empty) the sum of their rows of ``gains``, ``n`` times each, in pieces of bounded size."""
    out = np.zeros((len(edges) - 1, gains.shape[1]))
    run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for a in range(0, len(codes), 50_000):
        part = run[a : a + 50_000]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[starts]] += np.add.reduceat(gains[codes[a : a + 50_000]] * n[a : a + 50_000, None], starts)
    return out


def exchange_gains(table: np.ndarray, code: np.ndarray, n: np.ndarray, edges: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The log probability of each word's places in training with the word in each class, less what is the same for all classes.

    A word has the neighbours ``code`` (the class before it, or that behind it plus the number of classes; each once) between two of the
    ``edges``, ``n`` times each, and is in class ``old``. It is left out of the class bigrams ``table`` that it is judged by: by counts that hold
    it, a rare word would find its own places likely wherever it is. Cells in which it meets its own class are left out for each side alone.
    """
    k = len(table)
    kinds, alone = (table > 0).sum(axis=1) + 1.0, (table.sum(axis=0) + 1) / (table.sum() + k)
    smoothed = table + kinds[:, None] * alone
    cells_of = np.concatenate([smoothed, smoothed.T])  # what each neighbour meets each class with
    value_of = np.log(cells_of)
    run = np.repeat(np.arange(len(old)), np.diff(edges))
    out = np.zeros((len(old), k))
    for a in range(0, len(code), 8192):  # bounded rows of classes at once
        word, c, x = run[a : a + 8192], code[a : a + 8192], n[a : a + 8192].astype(np.float64)
        value, at, mine = value_of[c], np.arange(len(c)), old[word]
        value[at, mine] = np.log(np.maximum(cells_of[c, mine] - x, 1e-9))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] += np.add.reduceat(value * x[:, None], starts)
    each = np.arange(len(old))
    before, behind = (np.bincount(run[side], n[side], len(old)) for side in (code < k, code >= k))
    ahead = np.tile(table.sum(axis=1) + kinds, (len(old), 1))
    ahead[each, old] -= behind
    tokens = table.sum(axis=0) + before[:, None]
    tokens[each, old] -= before
    return out - behind[:, None] * np.log(ahead) - before[:, None] * np.log(tokens)


def left_out_likelihood(table: np.ndarray) -> float:
    """The logarithm of the likelihood of class bigrams and of the words in their classes, less what the classes don't change, each place judged by the counts
    without it."""
    kinds, alone, into = (table > 0).sum(axis=1, keepdims=True) + 1.0, (table.sum(axis=0) + 1) / (table.sum() + len(table)), table.sum(axis=0)
    step = np.log(np.maximum(table - 1, 0) + kinds * alone) - np.log(np.maximum(table.sum(axis=1, keepdims=True) - 1, 0) + kinds)
    return float((table * step).sum() - (into * np.log(np.maximum(into, 1))).sum())


def _listed(table: pa.Table, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block in order, their counts and their classes."""
    right = pa.concat_tables([unpack(p.as_py()) for p in table.column("payload")])
    w = right.column("w").to_numpy().view(np.uint64)
    order = np.argsort(w)
    of = right.column("c").to_numpy()[order]
    return w[order], right.column("n").to_numpy()[order].astype(np.float64), np.where(of < 0, shared, of)


def _found(hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(w, hashes), len(w) - 1)
    if (w[at] != hashes).any():
        raise RuntimeError("a block holds other texts than when its words were listed: the input isn't read in the same order each time")
    return at


def _with_words(rows: DataFrame, in_blocks: DataFrame, words: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the texts of each block and the counts and classes of its words."""
    wanted = in_blocks.select("block", "w").join(words, "w", "left").select("block", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(-1)).alias("c"))
    return packed(rows, BLOCK_CHARS, SLICE).groupBy("block").cogroup(packed_by_block(wanted).groupBy("block")).applyInArrow(run, schema)


def _swept(rows: DataFrame, in_blocks: DataFrame, words: DataFrame, k: int, shared: int, shards: int, places: int) -> tuple[DataFrame, np.ndarray]:
    """One round of exchange over all training words at once, and the class bigrams before it.

    Neighbours are counted by word and class beside it: combined in each block, which gives a pack for each shard of the words, then added by shard, where each word, with
    2 ``k`` counts at most, takes its best class while the others stand as they are (``exchange_gains``). Only the ``k`` x ``k`` bigrams reach the driver.
    """

    def contexts(packs: pa.Table, table: pa.Table) -> pa.Table:
        w, _, of = _listed(table, shared)
        tally, end = Tally(), int(np.searchsorted(w, np.uint64(END)))
        for p in packs.column("payload"):
            for batch in unpack(p.as_py()).to_batches():
                hashes, first = _learned(batch)
                at = _found(hashes, w)
                before = np.concatenate([[end], at[:-1]]) if len(at) else at
                before[first] = end
                keys, n = np.unique(np.concatenate([at * (2 * k) + of[before], before * (2 * k) + k + of[at]]), return_counts=True)
                tally.add(keys.astype(np.uint64), n)
        tally.merge()
        place, code = np.divmod(tally.keys.astype(np.int64), 2 * k)
        ahead = code >= k
        pair, at = np.unique(of[place[ahead]].astype(np.int64) * k + code[ahead] - k, return_inverse=True)
        pairs = pack(pa.table({"pair": pair, "n": np.bincount(at, tally.sums[ahead], len(pair)).astype(np.int64)}))
        found = [(None, None, None, pairs), *((*x, None) for x in _shard_packs(w, of, place, code, tally.sums, shards))]
        return pa.table(list(zip(*found)), schema=pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary())]))

    seen = written(_with_words(rows, in_blocks, words, contexts, "shard int, words binary, counts binary, pairs binary"))
    both = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0):
                yield from unpack(p.as_py()).cast(both).to_batches()

    table = np.zeros(k * k)
    for r in seen.filter("pairs is not null").select("pairs").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_batches():  # k * k rows at most
        table[r.column(0).to_numpy()] = r.column(1).to_numpy()
    table = table.reshape(k, k)

    def choose(packs: pa.Table) -> pa.Table:
        w, old, edges, code, n = _of_shard(packs, k)
        total, best = np.zeros(len(w), np.int64), old.astype(np.int64)
        for a in range(0, len(w), 2048):
            b = min(a + 2048, len(w))
            span, begins, each, was = slice(edges[a], edges[b]), edges[a : b + 1] - edges[a], np.arange(b - a), best[a:b].copy()
            gains = exchange_gains(table, code[span], n[span], begins, was)
            total[a:b] = np.add.reduceat(np.where(code[span] < k, n[span], 0), begins[:-1])
            to = gains.argmax(axis=1)
            best[a:b] = np.where((total[a:b] >= places) & (gains[each, to] > gains[each, was] + 1e-9), to, was)
        return pa.table({"w": pa.array(w), "n": pa.array(total), "c": pa.array(best.astype(np.int32))})

    moved = seen.filter("shard is not null").select("shard", "words", "counts").groupBy("shard").applyInArrow(choose, "w long, n long, c int")
    return written(moved), table


def _emissions(words: DataFrame, k: int, none: int) -> tuple[np.ndarray, int]:
    """log10 of what the counts of words are divided by in each class, and the class of unseen words: that of most words counted once,
    which stand where unseen ones will. ``none``: 1 where nothing was learned."""
    sizes = {r["c"]: r for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()}  # k rows
    words_of, tokens_of, once = (np.array([float(sizes[c][name]) if c in sizes else 0.0 for c in range(k)]) for name in ("words", "n", "once"))
    shared = int(np.argmax(once))
    for of, name in ((words_of, "words"), (tokens_of, "n")):
        of[shared] += sizes[-1][name] if -1 in sizes else 0
    return np.log10(np.maximum(tokens_of + PRIOR * (words_of + (np.arange(k) == shared)) + none, PRIOR)), shared


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, frequent: int | None = None, classes: int | None = None, rounds: int = ROUNDS, places: int = PLACES) -> DataFrame:
    """Learns from the texts outside fold 0 and scores all:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    ``base_score`` is the additively smoothed unigram score in log10, ``score`` the class model's log10 probability of the
    whole text with its end, ``perplexity`` per token. ``classes`` and ``frequent`` follow the vocabulary unless they are given. Training words
    without a frequent neighbour, and words never met in training, share the class that holds most of the words counted once; a word never met
    has the probability of one that is counted 0 there. Null texts count as empty (the end alone); repeated rows count
    and are scored each; null ids are held out; an empty table gives an empty result. Other columns aren't looked at. Each of ``rounds``
    moves all words at once; one that lowers the likelihood is taken back and ends them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).withColumn("held", held_out("doc_id", folds))
    in_blocks = written(by_blocks(rows, "block long, w long, n long", Words, BLOCK_CHARS, SLICE))
    counts = written(in_blocks.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 0"))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = classes or classes_for(kinds)
    top = counts.orderBy(F.desc("n"), "w").limit(frequent or frequent_for(classes)).toArrow().column("w").to_numpy().view(np.uint64)
    top = np.unique(np.append(top, np.uint64(END)))
    first, second, n = _frequent_bigrams(rows, top)
    class_of = exchange(first, second, n, len(top), classes)
    k = int(class_of.max()) + 1
    bigrams = np.bincount(class_of[first] * k + class_of[second], n, k * k).reshape(k, k)
    shards = -(-max(int(total), 1) // SHARD)
    words = written(_assigned(rows, counts, top, class_of, neighbour_gains(bigrams), shards))

    unigram, kind = np.log10(total + PRIOR * (kinds + 1)), np.uint8 if k < 256 else np.uint16

    def read(words: DataFrame) -> DataFrame:
        denominator, shared = _emissions(words, k, 0 if total else 1)

        def described(packs: pa.Table, table: pa.Table) -> pa.Table:
            w, count, of = _listed(table, shared)
            end, out = int(of[np.searchsorted(w, np.uint64(END))]), []
            for p in packs.column("payload"):
                for batch in unpack(p.as_py()).to_batches():
                    hashes, size = token_hashes(batch.column("text"))
                    at = _found(hashes, w)
                    simple, c = np.log10(count[at] + PRIOR), of[at]
                    begins = np.cumsum(size) - size
                    sums = [np.add.reduceat(x, begins) for x in ((count[at] > 0).astype(np.int64), simple - unigram, simple - denominator[c])]
                    data = c.astype(kind)
                    offsets = pa.array(np.append(begins, len(data)).astype(np.int64) * data.itemsize)
                    classes_in = pa.Array.from_buffers(pa.large_binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(data.tobytes())]).cast(pa.binary())
                    out.append(pa.table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held"), "n_tokens": size, "n_known": sums[0], "base_score": sums[1], "emitted": sums[2], "classes": classes_in, "end": np.full(len(size), end, np.int32)}))
            return pa.concat_tables(out)

        return written(_with_words(rows, in_blocks, words, described, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary, end int"))

    def pairs(data: bytes, end: int) -> np.ndarray:
        c = np.frombuffer(data, kind).astype(np.int64)
        return np.concatenate([[end], c[:-1]]) * k + c

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for batch in batches:
            for data, end in zip(batch.column(0), batch.column(1).to_pylist()):
                n += np.bincount(pairs(data.as_py(), end), minlength=k * k) if len(data.as_py()) > k * k else 0
                if len(data.as_py()) <= k * k:
                    np.add.at(n, pairs(data.as_py(), end), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    def met(found: DataFrame) -> np.ndarray:
        n = np.zeros(k * k)
        for r in found.filter("not held_out").select("classes", "end").mapInArrow(follow, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_batches():
            n[r.column(0).to_numpy()] = r.column(1).to_numpy()  # at most k * k
        return n.reshape(k, k)

    earlier = words
    for _ in range(rounds if total else 0):
        swept, table = _swept(rows, in_blocks, words, k, _emissions(words, k, 0)[1], shards, places)
        if words is not earlier and left_out_likelihood(table) < reached:
            words = earlier
            break
        earlier, words, reached = words, swept, left_out_likelihood(table)
    found = read(words)
    n = met(found)
    if words is not earlier and left_out_likelihood(n) < reached:
        found = read(earlier)
        n = met(found)
    step = transitions(n).ravel()

    def finished(batch: pa.RecordBatch) -> dict:
        moved = [float(step[pairs(data.as_py(), end)].sum()) for data, end in zip(batch.column("classes"), batch.column("end").to_pylist())]
        return {c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")} | {"score": np.array(moved) + batch.column("emitted").to_numpy() if moved else []}

    out = arrow_map(found, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double", finished)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
