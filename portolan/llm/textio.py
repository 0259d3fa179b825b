"""What the text operators share: reading documents, cutting lineage, blocks of texts, hashing words, fixed-size bitmaps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_BATCH = 4 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table ``documents`` of a data folder, by Spark's reader only."""
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the folder in spark.checkpoint.dir, which all machines share, and read from there.

    Where that setting is missing, a session of one machine takes a temporary folder; on a cluster it is an error.
    """
    _shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def bounded_batches(frame: DataFrame) -> DataFrame:
    """``frame``; from now on its session gives Python batches of 4 MB at most (an Arrow batch of 10,000 long texts takes many times that)."""
    conf = frame.sparkSession.conf
    if int(str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) != _BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))
    return frame


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` on all cores, where it is read in fewer parts than there are (a single small file); else as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` so that each of its partitions is read in the same order every time: what comes from an exchange is written first, as blocks of a
    shuffle arrive in any order; a scan of stored files is left as it is."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return written(frame) if "Exchange" in plan else frame


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="portolan-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written as a compressed table to the folder that ``cut`` uses, and read from there: for long tables of few bytes
    a row, which a checkpoint stores as they are."""
    path = f"{_shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def pack(rows: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as compressed bytes, for moving many of them as one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
        stream.write(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


class Block:
    """What ``by_blocks`` does with a block of texts: ``add`` gets its rows by slices, ``end`` comes after the last. Both give columns by name."""

    def __init__(self, number: int) -> None:
        self.number = number

    def add(self, rows: pa.RecordBatch) -> Iterable[dict]:
        return ()

    def end(self) -> Iterable[dict]:
        return ()


def by_blocks(docs: DataFrame, schema: str, start: Callable[[int], Block], chars: int, slice_chars: int) -> DataFrame:
    """Reads the rows of ``docs`` (with ``text``) in blocks: a block is a run of rows of one partition with about ``chars`` bytes of text (a
    longer text stands alone), and is read in slices of about ``slice_chars``, so that a task holds one slice and what the block gathers.

    The number of a block is that of its partition and its place there. A frame whose partitions are read in the same order each time,
    as those of a stored table, has the same blocks each time; whoever meets blocks again must check that it finds what it expects.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        block = None
        for batch in batches:
            sizes = text_sizes(batch)
            for a, b in slices(sizes, slice_chars):
                size = sum(sizes[a:b])
                if block is not None and total + size > chars:
                    yield from (record_batch(columns, target) for columns in block.end())
                    block, number, total = None, number + 1, 0
                block = start(number) if block is None else block
                total += size
                yield from (record_batch(columns, target) for columns in block.add(batch.slice(a, b - a)))
        if block is not None:
            yield from (record_batch(columns, target) for columns in block.end())

    return bounded_batches(docs).mapInArrow(run, schema)


def packed(docs: DataFrame, chars: int, slice_chars: int) -> DataFrame:
    """``block, payload``: the rows of ``docs`` by the blocks of ``by_blocks``, a pack for each slice."""

    class Packs(Block):
        def add(self, rows: pa.RecordBatch) -> Iterable[dict]:
            yield {"block": [self.number], "payload": [pack(rows)]}

    return by_blocks(docs, "block long, payload binary", Packs, chars, slice_chars)


def packed_by_block(rows: DataFrame, most: int = 400_000) -> DataFrame:
    """``block, payload``: the rows of ``rows`` (block, more), a pack for each block and run of about ``most`` rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield _packs(pa.Table.from_batches(held))
                held = []
        if held:
            yield _packs(pa.Table.from_batches(held))

    return bounded_batches(rows).mapInArrow(run, "block long, payload binary")


def _packs(table: pa.Table) -> pa.RecordBatch:
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    numbers, starts = np.unique(block[order], return_index=True)
    rest = table.drop_columns(["block"]).take(pa.array(order)).combine_chunks()
    payload = [pack(rest.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])]
    return pa.RecordBatch.from_pydict({"block": pa.array(numbers, pa.int64()), "payload": pa.array(payload, pa.binary())})


def fold(column: str, folds: int) -> Column:
    """crc32 of an id's text modulo ``folds``; a null id counts as fold 0, which is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0)).cast("int")


def held_out(column: str, folds: int) -> Column:
    return fold(column, folds) == 0


def labelled_sample(docs: DataFrame, marks: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows at most of ``docs`` (doc_id, text) with their mark (``marks``: k, more; an id at most once), taken by a hash.

    Ids alone are counted first; texts are filtered by the same hash before they meet the marks, so that the texts that move
    are bounded by the sample and not by the corpus.
    """
    n = docs.select("doc_id").join(marks.select("k"), F.col("doc_id") == F.col("k")).count()
    share = 1_000_000 if n <= rows else int(rows / n * 1_000_000)
    chosen = lambda column: F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1_000_000)) < share
    return cut(docs.filter(chosen("doc_id")).join(marks.filter(chosen("k")), F.col("doc_id") == F.col("k")).drop("k"))


def arrow_map(frame: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | dict[str, list]]) -> DataFrame:
    """mapInArrow with ``function`` from a batch to columns by name, or to several such."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield record_batch(columns, target)

    return bounded_batches(frame).mapInArrow(run, schema)


def record_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target], schema=target)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_sizes(batch: pa.RecordBatch, column: str = "text") -> list[int]:
    """The bytes of each text of a batch; null has none."""
    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()


def text_slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch by runs of rows of about ``most`` bytes of text, with their texts; only those of one run are Python strings at a time."""
    for a, b in slices(text_sizes(batch), most):
        part = batch.slice(a, b - a)
        yield part, texts_of(part)


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``most`` bytes, for work that gains from many texts at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``most`` in size together (an item above that stands alone)."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _U64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_tables: list[np.ndarray] = []


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased text, in order: runs of letters, digits and non-ASCII characters.

    A word of over a mebibyte counts as consecutive pieces of that size.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not _tables:
        _tables.extend((_powers(_BASE, _SEGMENT), _powers(pow(_BASE, -1, 1 << 64), _SEGMENT)))
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + _SEGMENT]
        word = _IS_WORD[piece]
        if at + _SEGMENT < len(data) and word[-1] and not word.all():  # end behind the last separator
            piece = piece[: len(word) - int(np.argmin(word[::-1]))]
            word = word[: len(piece)]
        at += len(piece)
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * _tables[0][: len(piece)], out=sums[1:])
            out.append(mixed((sums[ends] - sums[starts]) * _tables[1][starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SHIFT = _powers(0xD6E8FEB86659FD93, 64)


def windows(words: np.ndarray, offsets: Iterable[int]) -> np.ndarray:
    """A hash for each place of a mask: of the words at ``offsets`` from it."""
    offsets = list(offsets)
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        total += words[o : o + n] * _SHIFT[k % 64] + np.uint64(k)
    return mixed(total)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of hashed shingles of ``size`` words; a shorter text has one, of all its words."""
    if not len(words):
        return words
    return np.unique(windows(words, range(min(size, len(words)))))


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the 64-bit values in ``column``, two bits each; its size doesn't depend on the rows.

    The driver gets at most 2**bits / 64 partial words, whatever the number of keys.
    """
    mask = F.lit((1 << bits) - 1)
    spots = keys.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(F.col(column), 64 - bits))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if found.num_rows:
        out[found.column("i").to_numpy()] = found.column("w").to_numpy().view(np.uint64)
    return out


def marked(docs: DataFrame, marks: DataFrame, bits: int = 24) -> DataFrame:
    """``docs`` (doc_id, text) whose id is among ``marks`` (k, each once). A bitmap of the marks leaves most other texts where they
    are read; the join with the marks is exact."""
    known = bitmap(marks.select(F.xxhash64("k").alias("h")), "h", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known, batch.column(2).to_numpy().view(np.uint64), bits))).select([0, 1])

    near = bounded_batches(docs).select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(run, docs.select("doc_id", "text").schema)
    return near.join(marks.select("k"), F.col("doc_id") == F.col("k")).drop("k")


def in_bitmap(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """For each key, whether it may be in the set behind ``table``; never wrong with no."""
    first, second = keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)
    six, low = np.uint64(6), np.uint64(63)
    hit = (table[first >> six] >> (first & low)) & np.uint64(1)
    sure = np.flatnonzero(hit)
    out = np.zeros(len(keys), bool)
    out[sure] = ((table[second[sure] >> six] >> (second[sure] & low)) & np.uint64(1)).astype(bool)
    return out


_SPACED = np.ones(256, bool)
_SPACED[[0x20, *range(0x09, 0x0E)]] = False
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CODES[0x41:0x5B] = _CODES[0x61:0x7B]  # A-Z as a-z
_PIECE = 1 << 18
_INVERSE = pow(_BASE, -1, 1 << 64)
#: What stands for the end of a text among token hashes.
END = 0


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts in order, each text's words between ASCII white space (A-Z lower-cased) and then ``END``; and
    the number of tokens of each text. Works on the bytes as they are, piece by piece, so that words and texts may have any length."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))  # a space behind each text
    _, offsets, buffer = joined.buffers()
    at = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if len(joined) else np.zeros(0, np.uint8)
    if len(_tables) < 4:
        word_hashes("")
        _tables.extend((_powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)))
    edges = np.flatnonzero(np.diff(_SPACED[data], prepend=False, append=False))
    sums, total, scale = np.empty(len(edges), np.uint64), 0, 1
    for a in range(0, len(data), _PIECE):
        piece = data[a : a + _PIECE]
        local = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODES[piece] * _tables[2][: len(piece)], out=local[1:])
        x, y = np.searchsorted(edges, [a, a + _PIECE])
        sums[x:y] = local[edges[x:y] - a] * np.uint64(scale) + np.uint64(total)
        total = (total + int(local[-1]) * scale) & _U64
        scale = scale * pow(_BASE, _PIECE, 1 << 64) & _U64
    starts = edges[::2]
    back = np.array([pow(_INVERSE, k * _PIECE, 1 << 64) for k in range(len(data) // _PIECE + 1)], np.uint64)
    found = mixed((sums[1::2] - sums[::2]) * back[starts // _PIECE] * _tables[3][starts % _PIECE])
    n = np.diff(np.searchsorted(starts, at - at[0])) + 1
    out = np.full(len(found) + len(n), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(n) - 1] = False
    out[word] = found
    return out, n


class Tally:
    """Sorted 64-bit keys with sums, merged as they come."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.more.append((keys, sums))
        self.waiting += len(keys)
        if self.waiting > max(500_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.more:
            self.keys, at = np.unique(np.concatenate([self.keys, *(k for k, _ in self.more)]), return_inverse=True)
            self.sums = np.bincount(at, np.concatenate([self.sums, *(n for _, n in self.more)]), len(self.keys)).astype(np.int64)
            self.more, self.waiting = [], 0
