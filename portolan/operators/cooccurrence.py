"""Pairs of members that have a key in common, where a few keys have very many members.

Keys are light or heavy by the pairs they make. Light ones are joined as they are. The members of heavy ones are numbered and held as bitmaps of
64 members a word, each word made by an aggregate that combines where rows are read. Words are put in tiles of ``TILE_WORDS``; pairs are counted by
multiplying tile with tile for all heavy keys together (a matrix product of bits), or listed tile by tile. So no task gets more than a tile of each side of
a key at a time, and what moves for a heavy key shrinks by some thousand times against its pairs. Both ways give the same rows.

Nulls: a null key or member pairs with nothing. Repeated rows count once. Empty sides give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.sources.store import grown, numbered, stored

#: A key is heavy from this number of pairs on; words of 64 members in a tile; heavy keys multiplied in one go.
HEAVY_PAIRS, TILE_WORDS, KEYS_AT_ONCE = 250_000, 8, 4096
#: About how many pairs of light keys are counted in one task.
PAIRS_AT_ONCE = 2_000_000
#: Rows of a key from which its members are dealt to runs by number, and the numbers of a run.
HEAVY_MEMBERS, RUN = 1_000_000, 65_536
_BITS = 64 * TILE_WORDS


def _sizes(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias(name))


class _Split:
    """Both sides (key, member) made distinct and split by the weight of their keys."""

    def __init__(self, left: DataFrame, right: DataFrame, heavy_pairs: int) -> None:
        clean = lambda x: stored(x.select("key", "member").filter("key is not null and member is not null").distinct())
        self.left = clean(left)
        self.right = self.left if right is left else clean(right)
        self.sizes = stored(_sizes(self.left, "n").join(_sizes(self.right, "m"), "key").withColumn("heavy", F.col("n").cast("double") * F.col("m") >= heavy_pairs))
        self.heavy = stored(self.sizes.filter("heavy").select("key", "n", "m"))
        self.n_heavy = self.heavy.count()

    def light(self) -> DataFrame:
        rest = lambda x: x.join(self.heavy.select("key"), "key", "left_anti") if self.n_heavy else x
        return rest(self.left).withColumnRenamed("member", "a").join(rest(self.right).withColumnRenamed("member", "b"), "key")

    def light_counts(self, ascending: bool) -> DataFrame:
        """``a, b, n`` over the light keys. The partners that a key gives a member move to the member as one list and are counted there, so that pairs aren't moved; tasks are as many
        as ``PAIRS_AT_ONCE`` asks for. The partners of members with more pairs than that are dealt to slots by hashes."""
        light = self.sizes.filter("not heavy")
        rest = lambda x: grown(x.join(grown(self.heavy.select("key")), "key", "left_anti")) if self.n_heavy else x
        most = rest(self.left).join(grown(light), "key").groupBy("member").agg(F.sum("m").alias("pairs")).agg(F.max("pairs"), F.sum("pairs")).first()
        if most[0] is None:
            return light.select(F.lit(None).cast(self.left.schema["member"].dataType).alias("a"), F.lit(None).cast(self.right.schema["member"].dataType).alias("b"), "n").limit(0)
        slots = -(-most[0] // PAIRS_AT_ONCE)
        own = ascending and self.right is self.left
        slot = [F.pmod(F.xxhash64("member"), F.lit(slots)).cast("int").alias("slot")] if slots > 1 else []
        lists = rest(self.right).groupBy("key", *slot).agg(F.sort_array(F.collect_list("member")).alias("bs"))
        met = rest(self.left).withColumnRenamed("member", "a").join(grown(lists), "key").drop("key")
        if own and not slot:  # a member is in the lists of its own keys
            met = met.withColumn("bs", F.expr("slice(bs, cast(array_position(bs, a) + 1 AS int), size(bs))")).filter("size(bs) > 0")
        by = ["a", "slot"] if slot else ["a"]
        tasks = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most[1] // PAIRS_AT_ONCE))
        each = met.repartition(tasks, *by).select(*by, F.explode("bs").alias("b"))
        found = (each.filter("a < b") if ascending else each).groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"))
        return found.select("a", "b", "n")

    def words(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``number, member`` of the members of heavy keys, and for each side ``key, tile, bits``: the words of a tile that aren't empty, by their place."""
        keys = self.heavy.select("key")
        sides = [x.join(keys, "key", "left_semi") for x in (self.left, self.right)]
        members = stored(numbered(sides[0].select("member").unionByName(sides[1].select("member")).distinct(), ["member"]).select("member", (F.col("place") - 1).alias("number")))

        def packed(rows: DataFrame) -> DataFrame:
            at = rows.join(members, "member").select("key", F.shiftright("number", 6).alias("word"), (F.col("number") % 64).cast("int").alias("bit"))
            words = at.groupBy("key", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
            one = F.struct((F.col("word") % TILE_WORDS).cast("int").alias("at"), "bits")
            return words.groupBy("key", F.floor(F.col("word") / TILE_WORDS).alias("tile")).agg(F.collect_list(one).alias("words"))  # TILE_WORDS at most

        left = stored(packed(sides[0]))
        return members, left, left if self.right is self.left else stored(packed(sides[1]))

    def tiles(self, slots: int) -> tuple[DataFrame, DataFrame]:
        """The members of heavy keys, and ``slot, i, j, key, l, r`` for each pair of tiles of a heavy key. Both sides are dealt to the other's tiles before they
        meet, so that a key's tiles don't meet in one task."""
        members, left, right = self.words()
        tiles = lambda x, name: x.groupBy("key").agg(F.collect_list("tile").alias(name))  # noqa: E731  a number for each 512 members
        ours = left.join(tiles(right, "others"), "key").select("key", F.col("tile").alias("i"), F.explode("others").alias("j"), F.col("words").alias("l"))
        theirs = right.join(tiles(left, "others"), "key").select("key", F.explode("others").alias("i"), F.col("tile").alias("j"), F.col("words").alias("r"))
        slot = F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot")
        return members, ours.join(theirs, ["key", "i", "j"]).select(slot, "i", "j", "key", "l", "r")


def _unpacked(column: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each list of (place, word)."""
    out = np.zeros((len(column), TILE_WORDS), np.int64)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return np.unpackbits(out.astype("<i8").view(np.uint8), axis=1, bitorder="little")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, j, a, b, n`` from rows sorted by (slot, i, j): the sum of products of each pair of tiles; one matrix of counts is held at a time."""
    last, total = None, np.zeros((_BITS, _BITS), np.float64)

    def counts(at: tuple[int, int, int]) -> pa.RecordBatch:
        a, b = np.nonzero(total)
        return pa.RecordBatch.from_pydict({"a": a + at[1] * _BITS, "b": b + at[2] * _BITS, "n": total[a, b].astype(np.int64)})

    for batch in batches:
        at = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        starts = [0, *(1 + np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1))).tolist()] if len(at) else []
        for x, y in zip(starts, [*starts[1:], len(at)]):
            if (here := tuple(at[x].tolist())) != last:
                if last is not None:
                    yield counts(last)
                    total[:] = 0
                last = here
            for k in range(x, y, 1024):
                part = batch.slice(k, min(1024, y - k))
                total += _unpacked(part.column(4)).astype(np.float32).T @ _unpacked(part.column(5)).astype(np.float32)
    if last is not None:
        yield counts(last)


def pair_counts(left: DataFrame, right: DataFrame, heavy_pairs: int = HEAVY_PAIRS, ascending: bool = False) -> DataFrame:
    """``a, b, n``: how many keys (key, member) of ``left`` and of ``right`` have in common, for each pair that has any; pairs of a member with itself too.
    ``ascending``: only pairs with ``a`` before ``b``."""
    split = _Split(left, right, heavy_pairs)
    light = split.light_counts(ascending)
    if not split.n_heavy:
        return light
    members, tiles = split.tiles(-(-split.n_heavy // KEYS_AT_ONCE))
    met = tiles.repartition("slot", "i", "j").sortWithinPartitions("slot", "i", "j").mapInArrow(_products, "a bigint, b bigint, n bigint")
    named = lambda x: members.select(F.col("number").alias(x), F.col("member").alias(f"_{x}"))
    heavy = met.join(named("a"), "a").join(named("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n")
    heavy = heavy.filter("a < b") if ascending else heavy
    return light.unionByName(heavy).groupBy("a", "b").agg(F.sum("n").alias("n"))


def pairs(left: DataFrame, right: DataFrame, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """``key, a, b``: every pair of members that a key has in ``left`` and in ``right``."""
    split = _Split(left, right, heavy_pairs)
    light = split.light().select("key", "a", "b")
    if not split.n_heavy:
        return light
    members, tiles = split.tiles(1)

    def ids(words: str, tile: str):
        return F.expr(f"flatten(transform({words}, w -> transform(filter(sequence(0, 63), k -> shiftrightunsigned(w.bits, k) & 1L = 1L), k -> k + w.at * 64 + {tile} * {_BITS})))")

    dealt = tiles.repartition("key", "i", "j")
    listed = dealt.select("key", F.explode(ids("l", "i")).alias("x"), F.col("r"), F.col("j")).select("key", "x", F.explode(ids("r", "j")).alias("y"))
    named = lambda x, to: members.select(F.col("number").alias(x), F.col("member").alias(to))
    return light.unionByName(listed.join(named("x", "a"), "x").join(named("y", "b"), "y").select("key", "a", "b"))


def degrees(rows: DataFrame, heavy_members: int = HEAVY_MEMBERS) -> DataFrame:
    """``member, n``: in how many pairs of a key each member of ``rows`` (key, member: bigint, first) is, where a pair is a member with ``first`` and any later one. No pairs are made:
    a member's are counted from its place among those of its key. Keys of more than ``heavy_members`` rows are dealt to runs of ``RUN`` members, whose sums come before and behind."""
    clean = rows.filter("key is not null and member is not null").select("key", "member", F.coalesce("first", F.lit(False)).alias("first"))
    hot = stored(clean.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_members).select("key"))
    any_hot = not hot.isEmpty()

    def placed(part: DataFrame, by: list[str]) -> DataFrame:
        """``q`` (0 or 1), ``qs`` up to the member, ``later`` members behind it, within ``by``."""
        sides = part.repartition(*by).groupBy(*by, "member").agg(F.max("first").cast("bigint").alias("q"))
        within = Window.partitionBy(*by).orderBy("member")
        out = sides.withColumns({"qs": F.sum("q").over(within), "place": F.row_number().over(within), "size": F.count(F.lit(1)).over(Window.partitionBy(*by))})
        return out.withColumn("later", F.col("size") - F.col("place"))

    own = F.col("q") * F.col("later") + F.col("qs") - F.col("q")
    found = placed(clean.join(hot, "key", "left_anti") if any_hot else clean, ["key"]).select("member", own.alias("n"))
    if any_hot:
        dealt = stored(placed(clean.join(hot, "key", "left_semi").withColumn("run", F.floor(F.col("member") / RUN)), ["key", "run"]))
        runs = dealt.groupBy("key", "run").agg(F.sum("q").alias("run_qs"), F.count(F.lit(1)).alias("run_size"))
        order = Window.partitionBy("key").orderBy("run")
        before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        runs = runs.select("key", "run", F.coalesce(F.sum("run_qs").over(before), F.lit(0)).alias("before"), F.coalesce(F.sum("run_size").over(behind), F.lit(0)).alias("behind"))
        found = found.unionByName(dealt.join(runs, ["key", "run"]).select("member", (own + F.col("q") * F.col("behind") + F.col("before")).alias("n")))
    return found.filter("n > 0").groupBy("member").agg(F.sum("n").alias("n"))


def partners(rows: DataFrame, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """``member, n_partners, n_shared``: with how many other members each member of ``rows`` (key, member) has a key in common, and the sum over these of how many;
    members without any are left out.

    Members of exactly the same keys are one class: pairs are counted between representatives and weighed by the members of their classes, so that the members of a
    hot key aren't paired one by one. Members are told apart by 256 bits of hashes of their keys, which combine where rows are read.
    """
    held = stored(rows.select("key", "member").filter("key is not null and member is not null").distinct())
    marks = [f"_h{k}" for k in range(4)]
    signed = held.groupBy("member").agg(F.count(F.lit(1)).alias("_n"), *[F.bit_xor(F.xxhash64("key", F.lit(k))).alias(h) for k, h in enumerate(marks)])
    signed = stored(signed)
    classes = stored(signed.groupBy("_n", *marks).agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("size")))
    of_reps = held.join(classes.select(F.col("rep").alias("member")), "member", "left_semi")
    met = pair_counts(of_reps, of_reps, heavy_pairs).join(classes.select(F.col("rep").alias("b"), "size"), "b")
    told = met.groupBy(F.col("a").alias("rep")).agg((F.sum("size") - 1).alias("n_partners"), F.sum(F.col("size") * F.col("n")).alias("_all"))  # the member itself is among them
    found = classes.join(told, "rep").select("_n", *marks, "n_partners", (F.col("_all") - F.col("_n")).alias("n_shared")).filter("n_partners > 0")
    return signed.join(found, ["_n", *marks]).select("member", "n_partners", "n_shared")
