"""Conversation prefix trie by family-first merging.

Conversations that may share their beginning by construction are one family: they are cogrouped by the id of the one they branch from, rebuilt (its first turns, then their own), and
put into the family's small trie. Only the combined nodes of families are shuffled, without texts: a node is named by the sum (exclusive or) of 128-bit hashes of
its turns and their depths, so that equal prefixes of different families meet in one aggregate.

A node that only one family has keeps what the family's trie says of its subtree. The nodes of several families form the trie's crown; their subtrees are summed by doubling: in round k a
node adds what the nodes 2^k levels below it have gathered, so that a crown of depth d takes log2(d) rounds of joins, whatever its width.

A conversation of any length: its turns are numbered by ranges (``ordered``) and cogrouped in blocks of ``BLOCK`` turns; later blocks name their nodes relative to their first turn and
are completed by the blocks before them. The nodes of families with several blocks count as crown.

Turns are ordered by turn (null first), then by the SHA-256 of role and text; null roles and texts are empty. A null id is a conversation that branches from none; it counts as a
member and is left out of the smallest members and of the lists of ends. Repeated rows are turns of their own. Columns other than ``conv_id, turn, role, text`` are not read. An empty table gives no nodes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.ordered import ranged, running_sums
from portolan.llm.textio import bounded_batches, written

#: Conversations of a family; a conversation branches from the family's first after crc32 of its id modulo ``BRANCHES`` turns.
FAMILY, BRANCHES = 5, 9
BLOCK = 1024
_NO_FAMILY = -(1 << 63)
_ID = "x1 bigint, x2 bigint"
_NODE = (
    f"{_ID}, p1 bigint, p2 bigint, depth bigint, n bigint, conv_id bigint, bytes bigint, parent_conv bigint, children bigint, leaves bigint, saved bigint, "
    "families bigint, ends array<bigint>, chain bigint, block bigint"
)
_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, family, place, digest, bytes``: turns by their place from 1; no text goes further."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    placed = running_sums(rows, ["conv_id", "turn", "digest"], ["conv_id"], ["one"])
    family = F.coalesce(F.col("conv_id") - F.col("conv_id") % FAMILY, F.lit(_NO_FAMILY))
    return placed.select("conv_id", family.alias("family"), (F.col("one_before") + 1).alias("place"), "digest", "bytes")


def branch(conv_id: int | None) -> int:
    """How many turns of the family's first conversation come before a conversation's own."""
    return 0 if conv_id is None else zlib.crc32(str(conv_id).encode()) % BRANCHES


def _named(depth: int, digest: bytes) -> int:
    return int.from_bytes(blake2b(depth.to_bytes(8, "little") + digest, digest_size=16).digest(), "little")


def _longs(name: int) -> tuple[int, int]:
    low, high = name & ((1 << 64) - 1), name >> 64
    return low - ((low >> 63) << 64), high - ((high >> 63) << 64)


class Node:
    __slots__ = ("name", "parent", "depth", "n", "conv", "bytes", "below", "ends")

    def __init__(self, name: int, parent: Node | None, depth: int, size: int) -> None:
        self.name, self.parent, self.depth, self.bytes = name, parent, depth, size
        self.n, self.conv, self.below, self.ends = 0, None, {}, []


Turn = tuple[bytes, int]


def family_trie(conversations: list[tuple[int | None, list[Turn]]]) -> list[Node]:
    """The nodes of rebuilt conversations, parents first."""
    nodes = [Node(0, None, 0, 0)]
    for conv, turns in conversations:
        at = nodes[0]
        _passes(at, conv)
        for digest, size in turns:
            if digest not in at.below:
                at.below[digest] = Node(at.name ^ _named(at.depth + 1, digest), at, at.depth + 1, size)
                nodes.append(at.below[digest])
            at = at.below[digest]
            _passes(at, conv)
        if conv is not None:
            at.ends.append(conv)
    return nodes


def _passes(node: Node, conv: int | None) -> None:
    node.n += 1
    if conv is not None and (node.conv is None or conv < node.conv):
        node.conv = conv


def _of_family(left: pa.Table, right: pa.Table, size_of_block: int) -> Iterator[tuple]:
    """Rows of ``_NODE`` of one block of a family. ``left``: its turns; ``right``: one row with the block, the first conversation's first turns and all lengths."""
    about = right.to_pylist()[0]
    heads = [(h["digest"], h["bytes"]) for h in sorted(about["heads"], key=lambda h: h["place"])]
    lasts, block = {x["conv_id"]: x["last"] for x in about["lasts"]}, about["_block"]
    own: dict[int | None, list[tuple[int, bytes, int]]] = {}
    for conv, place, digest, size in zip(*(left.column(c).to_pylist() for c in ("conv_id", "place", "digest", "bytes"))):
        own.setdefault(conv, []).append((place, digest, size))
    long = max(lasts.values()) > size_of_block
    whole = []
    for conv, turns in sorted(own.items(), key=lambda x: (x[0] is None, x[0])):
        turns.sort()
        h = branch(conv)
        m = min(h, len(heads))
        if block == 0:
            whole.append((conv, heads[:m] + [(d, s) for place, d, s in turns if place > h]))
            continue
        at = 0
        for place, digest, size in turns:  # places are beyond any branch here
            before, at, depth = at, at ^ _named(m + place - h, digest), m + place - h
            ends = [conv] if place == lasts[conv] and conv is not None else []
            yield (*_longs(at), *_longs(before), depth, 1, conv, size, None, 0, 0, 0, 2, ends, conv, block)
        yield (*_longs(at), None, None, None, None, conv, None, None, None, None, None, None, None, conv, block)
    if block:
        return
    nodes = family_trie(whole)
    sums = {id(x): [0, 0] for x in nodes}
    for x in reversed(nodes):
        mine = sums[id(x)]
        mine[0] += not x.below
        mine[1] += (x.n - 1) * x.bytes
        if x.parent is not None:
            up = sums[id(x.parent)]
            up[0] += mine[0]
            up[1] += mine[1]
    cut = {c for c, n in lasts.items() if n > size_of_block}
    for x in nodes:
        parent = _longs(x.parent.name) if x.parent else (None, None)
        ends = [c for c in x.ends if c not in cut]
        yield (*_longs(x.name), *parent, x.depth, x.n, x.conv, x.bytes, x.parent.conv if x.parent else None, len(x.below), *sums[id(x)], 2 if long else 1, ends, None, 0)
    for conv, turns in whole:
        if conv in cut:
            at = 0
            for depth, (digest, _) in enumerate(turns, 1):
                at ^= _named(depth, digest)
            yield (*_longs(at), None, None, None, None, conv, None, None, None, None, None, None, None, conv, 0)


def _family_nodes(turns: DataFrame, size_of_block: int) -> DataFrame:
    """Rows of ``_NODE``: the combined nodes of each family's blocks, and (``depth`` null) the sum of names over each block of a conversation of several."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_NODE))
    lasts = turns.groupBy("family", "conv_id").agg(F.max("place").alias("last"))
    about = lasts.groupBy("family").agg(F.collect_list(F.struct("conv_id", "last")).alias("lasts"), F.max("last").alias("most"))  # a family has FAMILY conversations at most
    heads = turns.filter((F.col("conv_id") == F.col("family")) & (F.col("place") < BRANCHES)).groupBy("family").agg(F.collect_list(F.struct("place", "digest", "bytes")).alias("heads"))
    blocks = about.join(heads.withColumnRenamed("family", "_family"), F.col("family") == F.col("_family"), "left").select(
        F.col("family").alias("_of"), "lasts", F.coalesce("heads", F.array().cast("array<struct<place: bigint, digest: binary, bytes: bigint>>")).alias("heads"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / size_of_block))).alias("_block"),
    )

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_of_family(left, right, size_of_block))
        columns = list(zip(*rows)) if rows else [[] for _ in target]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    by_block = turns.withColumn("block", F.floor((F.col("place") - 1) / size_of_block))
    return by_block.groupBy("family", "block").cogroup(blocks.groupBy("_of", "_block")).applyInArrow(build, _NODE)


def _completed(rows: DataFrame) -> DataFrame:
    """The nodes of ``_family_nodes``, those of later blocks with the names of the blocks before them."""
    known = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter("depth is null")
    before = sums.select(F.col("chain").alias("_chain"), F.col("block").alias("_block"), F.bit_xor("x1").over(known).alias("_1"), F.bit_xor("x2").over(known).alias("_2")).filter("_block > 0")
    later = rows.filter("depth is not null and block > 0").join(before, F.col("chain").eqNullSafe(F.col("_chain")) & (F.col("block") == F.col("_block")))
    moved = later.select(*(F.col(c).bitwiseXOR(F.col(f"_{c[1]}")).alias(c) if c in ("x1", "x2", "p1", "p2") else F.col(c) for c in _NAMES))
    return rows.filter("depth is not null and block = 0").unionByName(moved)


def _end_digests(nodes: DataFrame) -> DataFrame:
    """``e1, e2, ends_sha256`` of the nodes where conversations end: their ids in ascending order, joined by commas and hashed as they pass. The ids are
    ordered by ranges, and each range's share of a node goes on as a few texts, as SHA-256 can only read them one after the other."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            x1, x2, ids = (batch.column(k).to_numpy() for k in range(3))
            starts = [0, *(1 + np.flatnonzero((np.diff(x1) != 0) | (np.diff(x2) != 0))).tolist()] if batch.num_rows else []
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], batch.num_rows])]
            yield pa.RecordBatch.from_pydict({"e1": pa.array(x1[starts]), "e2": pa.array(x2[starts]), "place": pa.array(range(place, place + len(starts)), pa.int64()), "ids": pa.array(texts, pa.string())})
            place += len(starts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, last = sha256(), None
        for batch in batches:
            done = []
            for e1, e2, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "ids"))):
                if (e1, e2) == last:
                    ids = "," + ids
                else:
                    if last is not None:
                        done.append({"e1": last[0], "e2": last[1], "ends_sha256": hash_.hexdigest()})
                    hash_, last = sha256(), (e1, e2)
                hash_.update(ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"e1": last[0], "e2": last[1], "ends_sha256": hash_.hexdigest()}], schema=schema)

    from pyspark import TaskContext

    schema = pa.schema([("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())])
    ends = nodes.filter(F.size("ends") > 0).select("x1", "x2", F.explode("ends").alias("conv_id"))
    texts = bounded_batches(ranged(ends, ["x1", "x2", "conv_id"])).mapInArrow(listed, "e1 bigint, e2 bigint, place bigint, ids string")
    return texts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "place").mapInArrow(hashed, "e1 bigint, e2 bigint, ends_sha256 string")


def _same(a: tuple[str, str], b: tuple[str, str]):
    return (F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))


def _crown_sums(crown: DataFrame, depth: int) -> DataFrame:
    """``x1, x2, leaves, saved`` of ``crown`` (x1, x2, p1, p2, depth, leaves, saved of the node alone): summed over subtrees by doubling."""
    held = crown
    for k in range(max(0, math.ceil(math.log2(depth + 1)))):
        below = held.filter(F.col("depth") >= 2**k).groupBy(F.col("p1").alias("_1"), F.col("p2").alias("_2")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        added = held.join(below, _same(("x1", "x2"), ("_1", "_2")), "left")
        added = added.select("x1", "x2", "p1", "p2", "depth", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        upper = held.select(F.col("x1").alias("_1"), F.col("x2").alias("_2"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
        deep = added.filter(F.col("depth") >= 2 ** (k + 1)).join(upper, _same(("p1", "p2"), ("_1", "_2")))  # p: the node 2^k levels above
        none = F.lit(None).cast("long")
        rest = added.filter(F.col("depth") < 2 ** (k + 1)).select("x1", "x2", none.alias("p1"), none.alias("p2"), "depth", "leaves", "saved")
        held = written(rest.unionByName(deep.select("x1", "x2", F.col("_p1").alias("p1"), F.col("_p2").alias("p2"), "depth", "leaves", "saved")))
    return held.select("x1", "x2", "leaves", "saved")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node of the trie of rebuilt conversations.

    ``block``: turns of a conversation that one task takes at once (not less than ``BRANCHES``)."""
    nodes = _completed(written(_family_nodes(numbered(turns), max(block, BRANCHES))))
    keep = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "bytes", "children", "leaves", "saved", "parent_conv")]  # the same in all rows, or used only where there is one
    merged = written(nodes.groupBy("x1", "x2").agg(*keep, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("families").alias("families")))
    crown = merged.filter("families > 1")
    up = crown.select(F.col("x1").alias("_1"), F.col("x2").alias("_2"), F.col("conv_id").alias("_conv"))
    tops = written(merged.filter("depth > 0").join(up, _same(("p1", "p2"), ("_1", "_2"))))  # every node right below the crown or in it
    of_family = F.col("families") == 1
    below = tops.groupBy("_1", "_2").agg(
        F.count("*").alias("_children"), F.sum(F.when(of_family, F.col("leaves")).otherwise(0)).alias("_leaves"), F.sum(F.when(of_family, F.col("saved")).otherwise(0)).alias("_saved")
    )
    alone = written(
        crown.join(below, _same(("x1", "x2"), ("_1", "_2")), "left").select(
            "x1", "x2", "p1", "p2", "depth", "n", "conv_id", F.coalesce("_children", F.lit(0)).alias("children"),
            F.coalesce("_leaves", F.lit(1)).alias("leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("_saved", F.lit(0))).alias("saved"),
        )
    )
    depth = alone.agg(F.max("depth")).first()[0]
    summed = _crown_sums(alone.select("x1", "x2", "p1", "p2", "depth", "leaves", "saved"), depth or 0).select(F.col("x1").alias("_1"), F.col("x2").alias("_2"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    parents = tops.select(F.col("x1").alias("_c1"), F.col("x2").alias("_c2"), "_conv")
    shown = ["x1", "x2", "depth", "n", "conv_id", "parent", "children", "leaves", "saved"]
    top = alone.join(summed, _same(("x1", "x2"), ("_1", "_2"))).drop("leaves", "saved").withColumnsRenamed({"_leaves": "leaves", "_saved": "saved"})
    top = top.join(parents, _same(("x1", "x2"), ("_c1", "_c2")), "left").withColumn("parent", F.col("_conv")).select(*shown)
    low = merged.filter("families = 1").join(parents, _same(("x1", "x2"), ("_c1", "_c2")), "left").withColumn("parent", F.coalesce("_conv", "parent_conv")).select(*shown)
    ends = _end_digests(nodes)
    every = top.unionByName(low).join(ends, _same(("x1", "x2"), ("e1", "e2")), "left")
    return every.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
