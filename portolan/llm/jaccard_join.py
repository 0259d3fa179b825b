"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Each of ``trees`` tries holds the signatures (``max_depth`` minima in order) of all texts. A text starts in every trie with its
longest prefix; its prefixes are shortened one level at a time, each time in the trie where that adds the fewest texts for the
recall it brings, until a text at the threshold would share one of them with the target recall (``stop_levels``). So a
text stays deep where its branch is crowded and goes up where it is thin. All texts below the node where a prefix ends (of
those that themselves end there or deeper) are candidates; a pair counts in the first trie where it meets. A trie level
is a hash of the prefix, so that nodes are groups of equal hashes and tries need not be in one place.

Candidates are verified by the exact Jaccard similarity of their shingle sets. Texts with equal sets are one class from
the start and take part once, with a weight; classes go by the digest of their set, never by ids. A node with many texts is dealt into
blocks, and each pair of blocks is a task of bounded size. A task gives a count of links for each text and a spanning forest of the links
it found, never the pairs, so that its output is as long as its input; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import arrow_map, bitmap, bounded_batches, cut, in_bitmap, mixed, record_batch, shingles, text_slices, word_hashes, written

SHINGLE, THRESHOLD, RECALL, TREES, MAX_DEPTH, MIN_DEPTH = 5, 0.8, 0.9998, 12, 6, 2
BLOCK_TEXTS, BLOCK_SHINGLES, SLICE = 512, 1 << 19, 2_000_000
_BITS = 23
_KEY = ["d1", "d2"]


def least_depth(threshold: float, recall: float, trees: int, depth: int = MIN_DEPTH) -> int:
    """The shortest prefix needed: the longest, up to ``depth``, at which all tries together reach the recall at the threshold."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def stop_levels(sizes: np.ndarray, shortest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """For texts (first axis) the level in each trie (second) where their prefix ends, 0 for ``shortest`` tokens, from the ``sizes`` of the nodes on
    their path by level (third). A pair at ``threshold`` shares a prefix of d minima with the probability threshold**d, in each trie
    by itself; prefixes are shortened until it is missed in all tries with at most 1 - ``recall``."""
    texts, trees, levels = sizes.shape
    missed = np.log(np.maximum(1 - threshold ** np.arange(shortest, shortest + levels, dtype=np.float64), 1e-300))
    level = np.full((texts, trees), levels - 1)
    row, column = np.arange(texts)[:, None], np.arange(trees)[None, :]
    for _ in range(trees * (levels - 1)):
        open_ = missed[level].sum(axis=1) > np.log(max(1 - recall, 1e-300))
        if not open_.any():
            break
        up = np.maximum(level - 1, 0)
        worth = (missed[level] - missed[up]) / (sizes[row, column, up] - sizes[row, column, level] + 1e-3)
        worth[level == 0] = -1.0
        tree = worth.argmax(axis=1)
        go = np.flatnonzero(open_ & (worth.max(axis=1) >= 0))
        if not len(go):
            break
        level[go, tree[go]] -= 1
    return level


def _minima(sets: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent minima of a non-empty shingle set, 32 bits of each."""
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 8192):
        np.minimum(least, np.multiply.outer(seeds, sets[at : at + 8192]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _nodes(signatures: list[bytes], trees: int, shortest: int) -> np.ndarray:
    """The hash of the prefix of each text (first axis) in each trie at each level from ``shortest`` tokens on."""
    minima = np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), trees, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), minima.shape[:2])
    out = []
    for depth in range(minima.shape[2]):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + minima[:, :, depth])
        out.append(h)
    return np.stack(out[shortest - 1 :], axis=2)


def _digest(sets: np.ndarray) -> tuple[int, int]:
    a, b = mixed(sets ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95)), mixed(sets + np.uint64(0x2545F4914F6CDD1D))
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in (a, b))  # type: ignore[return-value]


def _row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _sketches(docs: DataFrame, size: int, count: int) -> DataFrame:
    """A row for each document: number of shingles, digest of their set, minima."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, texts in text_slices(batch, SLICE):
            sets = [shingles(word_hashes(t), size) for t in texts]
            digests = [_digest(s) for s in sets]
            signatures = [_minima(s, count).tobytes() if len(s) else None for s in sets]
            yield {"id": part.column(0), "rh": part.column(2), "n": [len(s) for s in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "p": signatures}

    return arrow_map(docs.select("id", "text", _row_hash("id", "text")), f"id {id_type}, rh long, n int, d1 long, d2 long, p binary", run)


def _sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """``rh, d1, d2, s``: the shingle sets of the documents whose row hash is in the bitmap ``wanted``."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        batch = batch.filter(pa.array(in_bitmap(wanted, batch.column(1).to_numpy().view(np.uint64), _BITS)))
        for part, texts in text_slices(batch, SLICE):
            sets = [shingles(word_hashes(t), size) for t in texts]
            digests = [_digest(s) for s in sets]
            yield {"rh": part.column(1), "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "s": [s.tobytes() for s in sets]}

    return arrow_map(docs.select("text", _row_hash("id", "text")), "rh long, d1 long, d2 long, s binary", run)


def _grouped(docs: DataFrame, size: int, threshold: float, recall: float, trees: int, max_depth: int) -> DataFrame:
    """Each row of ``docs`` (id, text): ``id, rh, n, rep, w, texts, weight``; ``rep`` names the row that is first in the group."""
    shortest = least_depth(threshold, recall, trees)
    depth = max(max_depth, shortest)
    rows = written(_sketches(docs, size, trees * depth))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "rh"))
    classes = rows.filter("n > 0").groupBy("n", *_KEY).agg(first.alias("rep"), F.min("rh").alias("rh"), F.count(F.lit(1)).alias("w"), F.first("p").alias("p"))
    classes = written(classes)

    def shallow(batch: pa.RecordBatch) -> dict:
        h = _nodes(batch.column(2).to_pylist(), trees, shortest)[:, :, 0] if batch.num_rows else np.zeros((0, trees), np.uint64)
        d1, d2 = (np.repeat(batch.column(k).to_numpy(), trees) for k in (0, 1))
        return {"d1": pa.array(d1), "d2": pa.array(d2), "h": pa.array(h.ravel().view(np.int64))}

    tops = arrow_map(classes.select(*_KEY, "p"), "d1 long, d2 long, h long", shallow)
    crowded = tops.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    near = written(tops.join(crowded, "h", "left_semi").select(*_KEY).distinct().join(classes, _KEY).select(*_KEY, "n", "p", "w", "rh"))

    def path(batch: pa.RecordBatch) -> dict:  # all nodes on the path of each text
        h = _nodes(batch.column(2).to_pylist(), trees, shortest) if batch.num_rows else np.zeros((0, trees, 1), np.uint64)
        each = h.shape[1] * h.shape[2]
        d1, d2 = (np.repeat(batch.column(k).to_numpy(), each) for k in (0, 1))
        spot = np.tile(np.arange(each, dtype=np.int32), len(h))
        return {"d1": pa.array(d1), "d2": pa.array(d2), "spot": pa.array(spot), "h": pa.array(h.ravel().view(np.int64))}

    levels = depth - shortest + 1
    paths = arrow_map(near.select(*_KEY, "p"), "d1 long, d2 long, spot int, h long", path)
    sizes = paths.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    counted = paths.join(sizes, "h").groupBy(*_KEY).agg(F.collect_list(F.struct("spot", "m")).alias("sizes"))  # at most trees * levels

    def choose(batch: pa.RecordBatch) -> dict:
        found = np.ones((batch.num_rows, trees * levels))
        lists = batch.column(2)
        flat = lists.flatten()
        found[pc.list_parent_indices(lists).to_numpy(), flat.field("spot").to_numpy()] = flat.field("m").to_numpy()
        stop = stop_levels(found.reshape(-1, trees, levels), shortest, threshold, recall).astype(np.uint8)
        return {"d1": batch.column(0), "d2": batch.column(1), "stop": [x.tobytes() for x in stop]}

    chosen = arrow_map(counted, "d1 long, d2 long, stop binary", choose)
    near = written(near.join(chosen, _KEY))

    def ends(batch: pa.RecordBatch) -> dict:  # the nodes of each text down to where its prefix ends; ``here``: it ends there
        n = batch.num_rows
        h = _nodes(batch.column(2).to_pylist(), trees, shortest) if n else np.zeros((0, trees, levels), np.uint64)
        stop = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, trees)
        text, tree, level = np.nonzero(np.arange(levels)[None, None, :] <= stop[:, :, None])
        return {"d1": pa.array(batch.column(0).to_numpy()[text]), "d2": pa.array(batch.column(1).to_numpy()[text]), "n": pa.array(batch.column(4).to_numpy()[text]), "t": pa.array(tree.astype(np.int32)), "h": pa.array(h[text, tree, level].view(np.int64)), "here": pa.array(level == stop[text, tree])}

    spots = arrow_map(near.select(*_KEY, "p", "stop", "n"), "d1 long, d2 long, n int, t int, h long, here boolean", ends)
    own = F.xxhash64(*_KEY)
    at = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.bit_xor(own).alias("members"), F.count_if("here").alias("c"), F.coalesce(F.sum(F.when(F.col("here"), F.col("n"))), F.lit(0)).alias("total_c"), F.coalesce(F.bit_xor(F.when(F.col("here"), own)), F.lit(0)).alias("enders")]
    nodes = spots.groupBy("t", "h").agg(*at).filter("m > 1 and c > 0")
    nodes = nodes.groupBy("m", "total", "members", "c", "total_c", "enders").agg(F.min(F.struct("t", "h")).alias("node"))  # the same texts and ends in a later trie give no new pair
    blocks = lambda m, total: F.greatest(F.ceil(F.col(m) / BLOCK_TEXTS), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")
    nodes = nodes.select("node.h", blocks("m", "total").alias("nm"), blocks("c", "total_c").alias("nc"))
    members = written(spots.join(nodes, "h"))

    wanted = bitmap(members.select(*_KEY).distinct().join(near, _KEY).select("rh"), "rh", _BITS)
    sets = _sets(docs, size, wanted).join(near, ["rh", *_KEY]).dropDuplicates(_KEY).select(*_KEY, "n", "w", "p", "stop", "s")
    slot = lambda count: F.pmod(F.xxhash64("d2", "d1"), F.col(count)).cast("int")
    one = (F.col("nm") == 1) & (F.col("nc") == 1)
    task = lambda i, j, side: F.struct(F.lit(i).alias("i") if isinstance(i, int) else i.cast("int").alias("i"), F.lit(j).alias("j") if isinstance(j, int) else j.cast("int").alias("j"), F.lit(side).alias("side"))
    ending = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: task(slot("nc"), j, 0))
    below = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda i: task(i, slot("nm"), 1))
    places = F.when(one, F.array(task(0, 0, 2))).when(F.col("here"), F.concat(ending, below)).otherwise(below)
    dealt = members.select(*_KEY, "t", "h", "here", F.inline(places))
    work = dealt.join(sets, _KEY).select("h", "i", "j", "t", "side", "here", *_KEY, "n", "w", "p", "stop", "s")
    work = bounded_batches(work).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    found = cut(_verified(work, threshold, trees, shortest))

    name = F.struct(*_KEY)
    links = found.groupBy(*_KEY).agg(F.sum("texts").alias("texts"), F.sum("weight").alias("weight"))
    edges = found.filter("d1 != r1 or d2 != r2").select(name.alias("u"), F.struct(F.col("r1").alias("d1"), F.col("r2").alias("d2")).alias("v")).distinct()
    component = components(edges).select("u.d1", "u.d2", "low")
    of = classes.join(component, _KEY, "left").withColumn("low", F.coalesce("low", name))
    reps = of.groupBy("low").agg(F.min("rep").alias("top"))
    of = of.join(reps, "low").join(links, _KEY, "left").select(*_KEY, "top", "w", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("weight", F.lit(0)).alias("weight"))
    alone = F.struct(F.col("id").isNull().alias("unnamed"), "id", "rh")
    out = rows.select("id", "rh", "n", *_KEY).join(of, _KEY, "left")
    some = F.col("n") > 0
    return out.select("id", "rh", "n", F.when(some, F.col("top")).otherwise(alone).alias("rep"), F.when(some, F.col("w")).otherwise(1).alias("w"), F.when(some, F.col("texts")).otherwise(0).alias("texts"), F.when(some, F.col("weight")).otherwise(0).alias("weight"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Links between documents whose sets of ``size``-word shingles have a Jaccard similarity of ``threshold`` or more.

    One row per row of ``docs``: ``doc_id, class_id, n_links, n_texts, n_shingles``. ``class_id`` is the smallest id of the
    documents that are connected by links, ``n_links`` the number of other documents linked with this one (copies
    included), ``n_texts`` that of different shingle sets among them. ``recall`` is the expected share of found links among those exactly at
    the threshold; it is higher above.

    Words are lower-cased runs of letters, digits and non-ASCII characters; texts of under ``size`` words have one
    shingle of all words. Null, empty and wordless texts have none and link with nothing (their class is their own id).
    Rows that repeat an id are documents of their own with that id; a null id links like others, and the class is the
    smallest id that isn't null (null where all are). An empty table gives an empty result. Other columns aren't looked at.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _grouped(named, size, threshold, recall, trees, max_depth)
    return out.select(F.col("id").alias("doc_id"), F.col("rep.id").alias("class_id"), (F.col("w") - 1 + F.col("weight")).cast("bigint").alias("n_links"), F.col("texts").cast("bigint").alias("n_texts"), F.col("n").alias("n_shingles"))


def _verified(work: DataFrame, threshold: float, trees: int, shortest: int) -> DataFrame:
    """For each text of each pair of blocks that has links there: its links, their weight, and the root of its tree."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "d1 long, d2 long, r1 long, r2 long, texts long, weight long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in target}
        group: list[tuple] = []
        last = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:3] != last:
                    _pairs(group, threshold, trees, shortest, out)
                    group, last = [], row[:3]
                    if len(out["d1"]) > 10_000:
                        yield record_batch(out, target)
                        out = {f.name: [] for f in target}
                group.append(row[3:])
        _pairs(group, threshold, trees, shortest, out)
        yield record_batch(out, target)

    return work.mapInArrow(run, schema)


def _pairs(group: list[tuple], threshold: float, trees: int, shortest: int, out: dict[str, list]) -> None:
    """The links of a pair of blocks: rows (t, side, here, d1, d2, n, w, p, stop, s); sides: 0 ends here, 1 is below, 2 both blocks are one."""
    if len(group) < 2:
        return
    t = group[0][0]
    side, here, d1, d2, n, w = (np.array([g[k] for g in group]) for k in range(1, 7))
    left, right = np.flatnonzero((side == 0) | (side == 2) & here), np.flatnonzero(side > 0)
    if not len(left) or not len(right):
        return
    rank = np.empty(len(group), np.int64)  # texts by their digest: a text may stand on both sides
    order = np.lexsort((d2, d1))
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(d1[order]) != 0) | (np.diff(d2[order]) != 0)]))
    may = np.minimum.outer(n[left], n[right]) >= threshold * np.maximum.outer(n[left], n[right])
    may &= np.where(here[right][None, :], rank[left][:, None] < rank[right][None, :], rank[left][:, None] != rank[right][None, :])
    a, b = np.nonzero(may)
    a, b = left[a], right[b]
    if t and len(a):  # met in an earlier trie: the prefixes agree down to where one of them ends
        nodes = _nodes([g[7] for g in group], trees, shortest)
        stop = np.frombuffer(b"".join(g[8] for g in group), np.uint8).reshape(len(group), trees).astype(np.int64)
        for earlier in range(t):
            level = np.minimum(stop[a, earlier], stop[b, earlier])
            new = nodes[a, earlier, level] != nodes[b, earlier, level]
            a, b = a[new], b[new]
    if not len(a):
        return
    sets = [np.frombuffer(g[9], np.uint64) for g in group]
    shared = _shared(sets, n, a, b)
    good = shared >= threshold * (n[a] + n[b] - shared) - 1e-9
    a, b = rank[a[good]], rank[b[good]]
    if not len(a):
        return
    m = int(rank.max()) + 1
    row = np.empty(m, np.int64)
    row[rank] = np.arange(len(group))
    w = w[row].astype(np.int64)
    texts = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
    weight = np.bincount(a, w[b], minlength=m) + np.bincount(b, w[a], minlength=m)
    root = np.arange(m)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(texts)
    for c, v in zip(out, (d1[row[some]], d2[row[some]], d1[row[root[some]]], d2[row[root[some]]], texts[some], weight[some].astype(np.int64))):
        out[c].extend(v.tolist())


def _shared(sets: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact number of common shingles for each pair (a, b): one by one where pairs are few, else by products of
    the matrix of the shingles that occur more than once, in strips."""
    one_by_one = float((n[a] + n[b]).sum()) * 40e-9 + len(a) * 6e-6
    if one_by_one > 0.002:
        used = np.unique(np.concatenate([a, b]))
        values, inverse, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(used)), n[used])
        keep = counts[inverse] > 1
        rows, columns = rows[keep], (np.cumsum(counts > 1) - 1)[inverse[keep]]
        width = int((counts > 1).sum())
        if 2.0 * len(used) ** 2 * width / 2e10 + width * len(used) * 2e-9 < one_by_one:
            order = np.argsort(columns, kind="stable")
            rows, columns = rows[order], columns[order]
            total = np.zeros((len(used), len(used)), np.float32)
            for start in range(0, width, 4096):
                x, y = np.searchsorted(columns, [start, start + 4096])
                strip = np.zeros((len(used), min(4096, width - start)), np.float32)
                strip[rows[x:y], columns[x:y] - start] = 1
                total += strip @ strip.T
            place = np.zeros(len(sets), np.int64)
            place[used] = np.arange(len(used))
            return total[place[a], place[b]].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        both = np.concatenate([sets[x], sets[y]])
        both.sort(kind="stable")
        out[k] = (both[1:] == both[:-1]).sum()
    return out


def components(edges: DataFrame) -> DataFrame:
    """``u, low``: for each node of ``edges`` (u, v) the smallest node it is connected with, by large-star and small-star
    steps that are each written to the checkpoint folder."""
    from functools import reduce

    star, before = edges, None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = down.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        star = reduce(DataFrame.union, [small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")), least.select("u", F.col("m").alias("v"))]).distinct()
        star = cut(star)
        now = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    low = star.groupBy("u").agg(F.min("v").alias("low"))
    return low.unionByName(star.select(F.col("v").alias("u"), F.col("v").alias("low")).distinct().join(low, "u", "left_anti"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns: those of the smallest id; see ``ngram_jaccard_join``.

    Where that id occurs with several texts of the group, one of these texts stays. Rows with equal id and text stay or go together. A row
    with a null id stays only where its group has no other. Rows without words stay.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = _grouped(named, size, threshold, recall, trees, max_depth).filter("rh != rep.rh or not (id <=> rep.id)").select(F.col("id").alias("_gone"), F.col("rh").alias("_rh")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs[id_col], docs[text_col]) == F.col("_rh")), "left_anti")
