"""The class and the method around each line of source, in DataFrame operations only.

A file is a sequence of numbered lines, held in pieces of ``PIECE`` lines: depths are sums over a piece's lines beside sums over the pieces before (a
segmented scan), so that a file of any length is spread over tasks. A block begins at a heading and ends on the line whose braces come back to the depth before it: the next line
that closes this level behind the first opening brace. Every line then takes, level by level, the last heading whose block is still open, and of these the deepest.

``containment`` moves lines several times, as it spreads each file. Where files are many, ``containment_by_file`` gives the same for each file where it is read and moves nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.textops import split_lines
from portolan.operators.csharp import CLASS, METHOD
from portolan.sources.store import grown, stored

PIECE = 1000
#: Lines that are passed on at a time; the headings, with ASCII letters as in column expressions.
LINES_AT_ONCE = 100_000
_HEADS = (re.compile(CLASS.pattern, re.A), re.compile(METHOD.pattern, re.A))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``app_name, file, n, line``: the lines of files (app_name, path, text) from 1; null texts have none."""
    return files.filter("text is not null").select("app_name", F.col("path").alias("file"), F.posexplode(split_lines(F.col("text"))).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _scanned(rows: DataFrame, by: list[str], columns: dict[str, tuple[str, Column]], piece: int, ahead: bool = False) -> DataFrame:
    """``rows`` (by, n, more) with, for each of ``columns``, a running value over the rows of ``by`` in order of n, that row included: ``sum`` of a column, or ``last`` one
    that isn't null (``ahead``: the next one, backwards). Pieces are scanned on their own, then what the pieces before say is added."""
    at = F.desc if ahead else F.asc
    rows = rows.withColumn("_piece", F.floor(F.col("n") / piece))
    within = Window.partitionBy(*by, "_piece").orderBy(at("n")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(at("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "_piece").orderBy(at("n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda kind, c, w: F.sum(c).over(w) if kind == "sum" else F.last(c, ignorenulls=True).over(w)
    local = rows.withColumns({f"_l_{name}": of(kind, c, within) for name, (kind, c) in columns.items()})
    ends = rows.withColumns({f"_t_{name}": of(kind, c, whole) for name, (kind, c) in columns.items()}).groupBy(*by, "_piece").agg(*[F.first(f"_t_{name}").alias(f"_t_{name}") for name in columns])
    carried = ends.select(*by, "_piece", *[of(kind, F.col(f"_t_{name}"), before).alias(f"_c_{name}") for name, (kind, _) in columns.items()])
    both = local.join(grown(carried), [*by, "_piece"])
    out = {name: F.coalesce(f"_c_{name}", F.lit(0)) + F.col(f"_l_{name}") if kind == "sum" else F.coalesce(f"_l_{name}", f"_c_{name}") for name, (kind, _) in columns.items()}
    return both.select(*[c for c in rows.columns if c != "_piece"], *[v.alias(k) for k, v in out.items()])


def blocks(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """``app_name, file, kind, first, last, name, level``: the blocks of classes and methods; one that never closes ends with its file."""
    by = ["app_name", "file"]
    braces = lambda mark: F.size(F.split("line", mark)) - 1
    rows = lines.withColumns({"change": (braces(r"\{") - braces(r"\}")).cast("long"), "opens": F.when(F.contains("line", F.lit("{")), F.col("n"))})
    rows = _scanned(rows, by, {"depth": ("sum", F.col("change"))}, piece)
    rows = _scanned(rows, by, {"next_open": ("last", F.col("opens"))}, piece, ahead=True)
    held = rows.withColumn("level", F.col("depth") - F.col("change")).withColumnRenamed("line", "text")  # level: before the line
    kinds = F.array(
        *[F.when(F.regexp_extract("text", pattern.pattern, 1) != "", F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern.pattern, 1).alias("name"))) for kind, pattern in (("class", CLASS), ("method", METHOD))]
    )
    held = stored(held.select(*by, "n", "level", "depth", "change", "next_open", F.filter(kinds, lambda x: x.isNotNull()).alias("kinds")))
    heads = held.select(*by, "n", "level", "next_open", F.inline("kinds"))
    heads = heads.join(grown(held.select(*by, F.col("n").alias("next_open"), F.col("depth").alias("then"))), [*by, "next_open"], "left")
    closes = held.filter("change < 0").select(*by, F.col("n").alias("close"), F.explode(F.sequence("depth", F.col("level") - 1)).alias("level"))  # as many as there are braces
    none = F.lit(None).cast("string")
    seen = heads.select(*by, "level", F.col("next_open").alias("n"), F.lit(None).cast("int").alias("close"), F.col("n").alias("first"), "kind", "name", "then").filter("n is not null")
    events = seen.unionByName(closes.select(*by, "level", F.col("close").alias("n"), "close", F.lit(None).cast("int").alias("first"), none.alias("kind"), none.alias("name"), F.lit(None).cast("long").alias("then")))
    # a line that opens and closes: what closes on the line of the brace itself counts only by its depth, so look one line further on
    events = events.withColumn("n", F.col("n") * 2 + F.when(F.col("kind").isNotNull(), 1).otherwise(0))
    ended = _scanned(events, [*by, "level"], {"end": ("last", F.col("close"))}, 2 * piece, ahead=True).filter("kind is not null")
    size = grown(lines.groupBy(*by).agg(F.max("n").alias("_size")))
    ended = ended.join(size, by).select(*by, "kind", "first", F.when(F.col("then") <= F.col("level"), F.floor(F.col("n") / 2).cast("int")).otherwise(F.coalesce("end", "_size")).alias("last"), "name", "level")
    bare = heads.filter("next_open is null").join(size, by).select(*by, "kind", F.col("n").alias("first"), F.col("_size").alias("last"), "name", "level")
    return ended.unionByName(bare)


def containment(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """``app_name, file, n, class_name, method`` for each line: the innermost class and method around it, null where there is none."""
    lines = stored(numbered_lines(files))
    found = stored(blocks(lines, piece))
    by = ["app_name", "file"]
    key = [*by, "kind", "level"]
    levels = found.select(*key).distinct()
    starts = found.select(*key, (F.col("first") * 2).alias("n"), F.struct("first", "last", "name").alias("head"))
    none = F.lit(None).cast(starts.schema["head"].dataType)
    asks = lines.select(*by, "n").join(grown(levels), by).select(*key, (F.col("n") * 2 + 1).alias("n"), none.alias("head"))  # a heading comes before the question on its own line
    told = _scanned(asks.unionByName(starts), key, {"in_": ("last", F.col("head"))}, 2 * piece).filter("n % 2 = 1")
    told = told.withColumn("n", F.floor(F.col("n") / 2).cast("int")).filter(F.col("in_.last") >= F.col("n"))
    best = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("in_.name")), F.when(F.col("kind") == kind, F.struct("in_.first", "level")))
    around = told.groupBy(*by, "n").agg(best("class").alias("class_name"), best("method").alias("method"))
    return lines.select(*by, "n").join(grown(around), [*by, "n"], "left")


def around_lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, and for each line of a file the place of its class and of its method among them; -1: none. Time grows with the lines of all blocks."""
    lines = text.splitlines()
    n, names = len(lines), []
    opens = np.fromiter((x.count("{") for x in lines), np.int64, n)
    after = np.cumsum(opens - np.fromiter((x.count("}") for x in lines), np.int64, n))  # depths behind each line
    opening = np.flatnonzero(opens)
    found: tuple[list[tuple[int, int, str]], ...] = ([], [])  # (line, depth before it, name) of each heading
    for i, line in enumerate(lines):
        if line.lstrip()[:1] in ("p", "i", "["):  # headings begin with one of their modifiers or an attribute
            for heads, pattern in zip(found, _HEADS):
                if m := pattern.match(line):
                    heads.append((i, int(after[i - 1]) if i else 0, m[1]))
    out = []
    for heads in found:
        inside, next_at, spans = np.full(n, -1, np.int64), {}, []
        for i, level, name in reversed(heads):
            k = np.searchsorted(opening, i)
            end = _first_at_most(after, int(opening[k]), level) if k < len(opening) else n - 1
            spans.append((i, min(end, next_at.get(level, n) - 1), name))  # a later heading of its level takes its place
            next_at[level] = i
        for i, last, name in reversed(spans):  # later headings are further in
            inside[i : last + 1] = len(names)
            names.append(name)
        out.append(inside)
    return names, *out


def _first_at_most(values: np.ndarray, start: int, most: int) -> int:
    """The first place from ``start`` with a value of ``most`` or less, else the last one; looks at about as many as lie between."""
    size = 16
    while start < len(values):
        low = values[start : start + size] <= most
        if low.any():
            return start + int(low.argmax())
        start, size = start + size, size * 2
    return len(values) - 1


def containment_by_file(files: DataFrame) -> DataFrame:
    """``app_name, file, n, class_name, method`` as ``containment``, each file read where it is: one pass over a file's lines in Python (Arrow batches), which are written as they come."""
    schema = pa.schema([("app_name", pa.string()), ("file", pa.string()), ("n", pa.int32()), ("class_name", pa.string()), ("method", pa.string())])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        apps, paths, starts, names, classes, methods = zip(*held)
        sizes = [len(x) for x in classes]
        of = pa.array(np.repeat(np.arange(len(held)), sizes))
        shift = np.cumsum([0, *map(len, names[:-1])])
        known = pa.array([x for some in names for x in some], pa.string())
        n = np.concatenate([np.arange(a + 1, a + 1 + k) for a, k in zip(starts, sizes)])

        def named(parts: tuple) -> pa.Array:
            at = np.concatenate(parts)
            return known.take(pa.array(at + np.repeat(shift, sizes), mask=at < 0))

        columns = [pa.array(apps, pa.string()).take(of), pa.array(paths, pa.string()).take(of), pa.array(n, pa.int32()), named(classes), named(methods)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for some in batches:
            for app, path, text in zip(*(some.column(k).to_pylist() for k in range(3))):
                names, classes, methods = around_lines(text)
                for k in range(0, len(classes), LINES_AT_ONCE):
                    held.append((app, path, k, names, classes[k : k + LINES_AT_ONCE], methods[k : k + LINES_AT_ONCE]))
                    size += len(held[-1][4])
                    if size >= LINES_AT_ONCE:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return files.filter("text is not null").select("app_name", "path", "text").mapInArrow(run, "app_name string, file string, n int, class_name string, method string")
