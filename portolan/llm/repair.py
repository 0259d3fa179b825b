"""Conversation structure repair: error-correcting Earley parsing of role sequences.

The grammar of roles is left-linear: a conversation is empty, or an optional system turn and one or more exchanges of user and assistant. Its error
productions are weighted: a turn may be kept, get another role, or be deleted, and an empty turn may be inserted. An item of the chart is a rule with
the place of its dot; it keeps its least ``(cost, audit)``, where the audit is the string of the edits' initials. As all rules are left-recursive, every item begins at
column 0, so that a column has a fixed number of items and a conversation takes time in proportion to its turns. Of two derivations of equal cost
that end in the same column and item, neither audit begins with the other (more insertions would cost more), so that the lesser one stays the lesser whatever follows.

A conversation may be larger than a task: turns are sorted by ranges, and those of a conversation are cut into pieces. A conversation which lies within
one range in one piece is parsed at once. For all others each piece is parsed from every symbol with which it may begin, the pieces' tables are chained in order, and the pieces are
repaired by the edits chosen; only tables, not texts, meet in one task.

Turns are ordered by turn (null first), then by the SHA-256 of role and text. Null roles and texts count as one space; a null id is a conversation of its own. Equal rows are duplicates of each other. Columns
other than ``conv_id, turn, role, text`` are left out. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.ordered import ranged
from portolan.llm.textio import arrow_map, bounded_batches, record_batch, written

#: Fixed values of the grammar: each rule's symbol, the symbol before its dot moves over a role's initial, and that initial.
RULES = (("System", "Start", "s"), ("User", "Start", "u"), ("User", "System", "u"), ("User", "Exchange", "u"), ("Exchange", "User", "a"))
GOALS = ("Start", "Exchange")
SYMBOLS = ("Start", "System", "User", "Exchange")
#: Roles that a turn may be given; a system turn can only be kept.
ROLES = {"u": "user", "a": "assistant"}
RULES_BEHIND = {symbol: [(rule, after) for rule, before, after in RULES if before == symbol] for symbol in SYMBOLS}


class Costs(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


Best = tuple[int, str]


def chart(turns: str, entry: str = "Start", costs: Costs = Costs()) -> dict[str, Best]:
    """The least ``(cost, audit)`` of each symbol that may be complete behind ``turns``, begun with ``entry`` complete.

    A turn is one character: its role's initial (x: another), upper case where the text is truncated, or ``-`` where it must be deleted.
    """
    column: dict[str, Best] = _closed({entry: (0, "")}, costs)
    for turn in turns:
        after: dict[str, Best] = {}
        extra = costs.truncated if turn.isupper() else 0
        for symbol, (cost, audit) in column.items():
            _offer(after, symbol, (cost + costs.delete, audit + "D"))
            if turn == "-":
                continue
            for rule, initial in RULES_BEHIND[symbol]:
                if turn.lower() == initial:
                    _offer(after, rule, (cost + extra, audit + "K"))
                if initial in ROLES:
                    _offer(after, rule, (cost + costs.rerole + extra, audit + "R"))
        column = _closed(after, costs)
    return column


def _offer(column: dict[str, Best], symbol: str, best: Best) -> None:
    if symbol not in column or best < column[symbol]:
        column[symbol] = best


def _closed(column: dict[str, Best], costs: Costs) -> dict[str, Best]:
    """The column with what insertions complete in it: the least items first, so that each is final when its dot moves on."""
    agenda, done = [(best, symbol) for symbol, best in column.items()], {}
    heapq.heapify(agenda)
    while agenda:
        (cost, audit), symbol = heapq.heappop(agenda)
        if symbol in done:
            continue
        done[symbol] = (cost, audit)
        for rule, initial in RULES_BEHIND[symbol]:
            if initial in ROLES and rule not in done:
                heapq.heappush(agenda, ((cost + costs.insert, audit + "I"), rule))
    return done


def best_repair(turns: str, costs: Costs = Costs()) -> Best:
    """The least cost and audit of a whole conversation."""
    return _short(turns, costs) if len(turns) <= 24 else min(v for k, v in chart(turns, "Start", costs).items() if k in GOALS)


@lru_cache(100_000)
def _short(turns: str, costs: Costs) -> Best:
    return min(v for k, v in chart(turns, "Start", costs).items() if k in GOALS)


def repaired(audit: str, initials: str, last: str = "") -> Iterator[tuple[int, str]]:
    """For each turn of the repair its place among the old ones (-1: inserted) and its new role (empty: as it was); ``last``: the initial before."""
    at = 0
    for edit in audit:
        if edit == "K":
            last = initials[at]
            yield at, ""
        elif edit in "RI":
            last = "a" if last == "u" else "u"
            yield (at if edit == "R" else -1), ROLES[last]
        at += edit != "I"


_LAST = {"Start": "", "System": "s", "User": "u", "Exchange": "a"}
_SPACES = "\t\n\x0b\x0c\r "


def marked(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``digest`` (of role and text), ``initial`` (s, u, a or x) and ``fault`` (b: blank, t: truncated, or empty)."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("*", digest.alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))


_ROW = "struct<turn: bigint, role: string, text: string, digest: binary, initial: string, fault: string>"


def pieces(turns: DataFrame, rows: int = 4096, size: int = 4 << 20) -> DataFrame:
    """``conv_id, place, whole, turns``: the turns of ``marked`` in order, in pieces of at most about ``rows`` and ``size`` bytes of one conversation and range.

    ``place`` orders the pieces; ``whole``: this one is known to be its whole conversation.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    key = F.when(F.col("conv_id").isNotNull(), F.xxhash64("conv_id")).otherwise(F.lit(0)).alias("_run")
    ordered = ranged(turns, ["conv_id", "turn", "digest"]).select("conv_id", "turn", "role", "text", "digest", "initial", "fault", key)
    shape = f"conv_id {dict(turns.dtypes)['conv_id']}, place bigint, whole boolean, turns array<{_ROW}>"
    target = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, held = TaskContext.get().partitionId() << 32, True, None

        def out(ends: list[int], whole: list[bool], upto: int, table: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal place
            starts = [0, *ends[:-1]]
            body = pa.StructArray.from_arrays([table.column(k).slice(0, upto) for k in range(1, 7)], fields=list(target.field("turns").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), body)
            places = list(range(place, place + len(ends)))
            place += len(ends)
            return record_batch({"conv_id": table.column(0).take(pa.array(starts, pa.int64())), "place": places, "whole": whole, "turns": lists.cast(target.field("turns").type)}, target)

        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            runs = held.column(7).to_numpy()
            bounds = [*(1 + np.flatnonzero(np.diff(runs))).tolist()]
            closed = len(bounds)
            open_ = held.slice(bounds[-1] if bounds else 0)
            if open_.num_rows >= rows or open_.nbytes >= size:  # a piece, though its conversation may go on
                bounds.append(held.num_rows)
            if bounds:
                whole = [k < closed and not (first and k == 0) for k in range(len(bounds))]
                yield out(bounds, whole, bounds[-1], held)
                first = len(bounds) > closed  # the rest belongs to the last piece's conversation
                held = held.slice(bounds[-1]) if bounds[-1] < held.num_rows else None
        if held is not None:
            yield out([held.num_rows], [False], held.num_rows, held)

    return bounded_batches(ordered).mapInArrow(run, shape)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {"su", "ua", "au"}


class Piece(NamedTuple):
    """What the parser needs of a piece: its turns as characters, and what is counted in it."""

    turns: str
    initials: str
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first_turn: int | None
    last_turn: int | None
    distinct: int


def read_piece(initials: list[str], faults: list[str], digests: list[bytes], turns: list[int | None], before: Iterable[bytes] = ()) -> Piece:
    """``before``: digests of earlier pieces of the conversation."""
    seen, out, duplicate = set(before), [], 0
    repeats = bool(seen) or len(set(digests)) < len(digests)
    for initial, fault, digest in zip(initials, faults, digests):
        if fault == "b":
            out.append("-")
        elif repeats and digest in seen:
            duplicate += 1
            out.append("-")
        else:
            out.append(initial.upper() if fault else initial)
            if repeats:
                seen.add(digest)
    known, text = [t for t in turns if t is not None], "".join(out)
    roles = "".join(initials)
    illegal = sum(roles[k : k + 2] not in _LEGAL for k in range(len(roles) - 1))
    return Piece(text, roles, faults.count("b"), duplicate, sum(map(str.isupper, text)), illegal, known[0] if known else None, known[-1] if known else None, len(set(known)))


def _columns_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, dict[str, pa.Array]]]:
    """For each piece its number in the batch, its first and last row, and the rows' columns by name."""
    lists = batch.column(batch.schema.get_field_index("turns"))
    flat = lists.flatten()
    columns = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    plain = {k: columns[k].to_pylist() for k in ("turn", "role", "digest", "initial", "fault")}
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    for k, end in enumerate(ends.tolist()):
        yield k, (int(ends[k - 1]) if k else 0), end, {**plain, "text": columns["text"]}


def _piece(columns: dict, a: int, b: int, before: Iterable[bytes] = ()) -> Piece:
    return read_piece(columns["initial"][a:b], columns["fault"][a:b], columns["digest"][a:b], columns["turn"][a:b], before)


class Turns:
    """The repaired turns of a batch's pieces, as one list array."""

    def __init__(self) -> None:
        self.at: list[int | None] = []
        self.roles: list[str] = []
        self.ends = [0]
        self.texts: pa.Array | None = None

    def add(self, columns: dict, a: int, audit: str, initials: str, last: str = "") -> None:
        self.texts = columns["text"]
        for k, role in repaired(audit, initials, last):
            self.at.append(a + k if k >= 0 else None)
            self.roles.append(role or columns["role"][a + k])
        self.ends.append(len(self.at))

    def array(self) -> pa.Array:
        texts = self.texts.take(pa.array(self.at, pa.int64())).fill_null("") if self.at else pa.array([], pa.string())
        rows = pa.StructArray.from_arrays([pa.array(self.roles, pa.string()), texts], names=["role", "text"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), rows)


def repair(turns: DataFrame, costs: Costs = Costs(), rows: int = 4096) -> DataFrame:
    """``conv_id, place, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, turns`` for each piece of a conversation, which is nearly
    always the only one: the repaired turns (role, text) and the edits of the piece; counts and cost are those of the conversation."""
    cuts = written(pieces(marked(turns), rows))
    id_type = dict(turns.dtypes)["conv_id"]
    shape = f"conv_id {id_type}, place bigint, pieces bigint, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, turns array<struct<role: string, text: string>>"

    def whole(batch: pa.RecordBatch) -> dict:
        counts, audits, made = {c: [] for c in _COUNTS}, [], Turns()
        for _, a, b, columns in _columns_of(batch):
            piece = _piece(columns, a, b)
            cost, audit = best_repair(piece.turns, costs)
            for name, value in zip(_COUNTS, (_gaps(piece.first_turn, piece.last_turn, piece.distinct), piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost)):
                counts[name].append(value)
            audits.append(audit)
            made.add(columns, a, audit, piece.initials)
        return {"conv_id": batch.column(0), "place": batch.column(1), "pieces": [1] * batch.num_rows, **counts, "audit": audits, "turns": made.array()}

    return arrow_map(cuts.filter("whole"), shape, whole).unionByName(_in_pieces(cuts.filter("not whole"), shape, id_type, costs))


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None or last is None else last - first + 1 - distinct


def _in_pieces(cuts: DataFrame, shape: str, id_type: str, costs: Costs) -> DataFrame:
    """The repair of conversations of several pieces, or of one that isn't known to be whole."""
    rows = cuts.select("conv_id", "place", F.explode(F.array_distinct(F.transform(F.filter("turns", lambda t: t.fault != "b"), lambda t: t.digest))).alias("digest"))
    first = rows.groupBy(F.col("conv_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.min("place").alias("_first"), F.max("place").alias("_last")).filter("_first < _last")
    again = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).filter("place > _first")
    known = again.groupBy(F.col("place").alias("_at")).agg(F.collect_set("digest").alias("before"))  # not more than the piece has rows
    whole = written(cuts.join(known, F.col("place") == F.col("_at"), "left").select("conv_id", "place", "turns", F.coalesce("before", F.array().cast("array<binary>")).alias("before")))

    def tables(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"piece": [], "paths": []}
        before = batch.column(3).to_pylist()
        for k, a, b, columns in _columns_of(batch):
            piece = _piece(columns, a, b, before[k])
            out["piece"].append({**piece._asdict(), "turns": "", "initials": piece.initials[:1] + piece.initials[-1:]})
            out["paths"].append([{"entry": e, "exit": x, "cost": c, "audit": t} for e in SYMBOLS for x, (c, t) in chart(piece.turns, e, costs).items()])
        return {"conv_id": batch.column(0), "place": batch.column(1), **out}

    fields = "turns: string, initials: string, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, first_turn: bigint, last_turn: bigint, distinct: bigint"
    paths = arrow_map(whole, f"conv_id {id_type}, place bigint, piece struct<{fields}>, paths array<struct<entry: string, exit: string, cost: bigint, audit: string>>", tables)
    counted = ", ".join(f"{c} bigint" for c in _COUNTS)
    chained = _in_order(paths, f"conv_id {id_type}, at bigint, pieces bigint, {counted}, entry string, audit string", _chain)

    def apply(batch: pa.RecordBatch) -> dict:
        made, audits, entries = Turns(), batch.column(batch.schema.get_field_index("audit")).to_pylist(), batch.column(batch.schema.get_field_index("entry")).to_pylist()
        for k, a, b, columns in _columns_of(batch):
            made.add(columns, a, audits[k], "".join(columns["initial"][a:b]), _LAST[entries[k]])
        return {n: batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "place", "pieces", *_COUNTS, "audit")} | {"turns": made.array()}

    return arrow_map(whole.join(written(chained).drop("conv_id"), F.col("place") == F.col("at")), shape, apply)


def _in_order(rows: DataFrame, shape: str, function) -> DataFrame:
    """``function`` from a conversation's rows, one by one in the order of their places, to rows of ``shape``; a conversation is never held by the caller."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for _, group in groupby((r for batch in batches for r in _dicts(batch)), key=lambda r: (r["conv_id"] is None, r["conv_id"])):
            made: list[dict] = []
            for row in function(group):
                made.append(row)
                if len(made) == 500:
                    yield pa.RecordBatch.from_pylist(made, schema=target)
                    made = []
            yield pa.RecordBatch.from_pylist(made, schema=target)

    return bounded_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")).mapInArrow(run, shape)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for a in range(0, batch.num_rows, 4):
        yield from batch.slice(a, 4).to_pylist()


class Path(NamedTuple):
    """A way through the pieces so far: what the last one does and the way before it."""

    cost: int
    audit: str
    entry: str
    before: Path | None


def _less(a: Path, b: Path) -> bool:
    """Whether ``a`` costs less, or as much with the lesser audit; ways soon have their pieces in common, so that few are compared."""
    if a.cost != b.cost:
        return a.cost < b.cost
    left, right, x, y = [], [], a, b
    while x is not y and x is not None and y is not None:
        left.append(x.audit)
        right.append(y.audit)
        x, y = x.before, y.before
    return "".join(reversed(left)) < "".join(reversed(right))


def _chain(rows: Iterator[dict]) -> Iterator[dict]:
    """Puts the tables of a conversation's pieces together, and gives each piece the edits of the best way through all of them."""
    best: dict[str, Path | None] = {"Start": None}
    places: list[int] = []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
    first_turn = last_turn = None
    last = conv = None
    for row in rows:
        piece, after = row["piece"], {}
        conv = row["conv_id"]
        places.append(row["place"])
        for way in row["paths"]:
            if way["entry"] in best:
                before = best[way["entry"]]
                path = Path((before.cost if before else 0) + way["cost"], way["audit"], way["entry"], before)
                if way["exit"] not in after or _less(path, after[way["exit"]]):
                    after[way["exit"]] = path
        best = after
        for name in counts:
            counts[name] += piece[name]
        counts["illegal"] += last is not None and last + piece["initials"][0] not in _LEGAL
        counts["distinct"] -= last_turn is not None and last_turn == piece["first_turn"]
        first_turn = piece["first_turn"] if first_turn is None else first_turn
        last_turn = piece["last_turn"] if piece["last_turn"] is not None else last_turn
        last = piece["initials"][-1]
    path = None
    for goal in GOALS:
        if (found := best.get(goal)) is not None and (path is None or _less(found, path)):
            path = found
    total = {**{c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "gaps": _gaps(first_turn, last_turn, counts["distinct"]), "cost": path.cost if path else 0}
    for place in reversed(places):
        yield {"conv_id": conv, "at": place, "pieces": len(places), **total, "entry": path.entry, "audit": path.audit}
        path = path.before


def digests(repairs: DataFrame) -> DataFrame:
    """``repairs`` by conversation: ``conv_id``, the counts, the whole ``audit`` and ``repaired_sha256`` of the turns as ``role:text`` lines.

    SHA-256 reads its text in order, so that the turns of a conversation of several pieces pass through one task, one piece at a time.
    """
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    columns = ["conv_id", *_COUNTS, "audit"]
    one = repairs.filter("pieces = 1").select(*columns, F.sha2(text, 256).alias("repaired_sha256"))

    def hashed(rows: Iterator[dict]) -> Iterator[dict]:
        hash_, audit, begun, row = sha256(), [], False, {}
        for row in rows:
            audit.append(row["audit"])
            for turn in row["turns"]:
                hash_.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode("utf-8", "surrogatepass"))
                begun = True
        yield {**{c: row[c] for c in columns}, "audit": "".join(audit), "repaired_sha256": hash_.hexdigest()}

    shape = ", ".join(f"{c} {dict(repairs.dtypes)[c]}" for c in columns) + ", repaired_sha256 string"
    return one.unionByName(_in_order(repairs.filter("pieces > 1").select(*columns, "place", "turns"), shape, hashed))


def hits(conv_id: Column, turn: Column, folds: int = 20) -> Column:
    """crc32 of ``conv_id:turn`` modulo ``folds``; nulls are one space."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(text(conv_id), F.lit(":"), text(turn)).cast("binary")) % folds


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that ``hits`` deals: 0 drops a turn, 1 empties its text, 2 removes its sentence ends, 3
    repeats it, 4 makes it the user's."""
    hit = hits(F.col("conv_id"), F.col("turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("_copies"),
    )
    return rows.filter("_copies > 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_")).drop("_")


def repair_of_damaged(turns: DataFrame, rows: int = 4096) -> DataFrame:
    """``digests`` of the repair of ``damaged(turns)``, with noughts for conversations that the damage leaves nothing of."""
    found = digests(repair(damaged(turns), rows=rows))
    lost = turns.groupBy("conv_id").agg(F.max(hits(F.col("conv_id"), F.col("turn"))).alias("most")).filter("most = 0")
    empty = lost.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return found.unionByName(empty)
