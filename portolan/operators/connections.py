"""Which connection a command runs on, by reaching definitions over the statements of its method.

A method is read as blocks, branches, loops and plain statements. Every variable has the set of sources that may reach it at a statement: a named setting, a
text in the code, something from outside the method, or what can't be told. Branches join their sets, a branch that returns joins nothing. A
command takes the set of the connection it was given. What the names stand for is joined afterwards, for all applications at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.sqltext import database_of, server_of, table_key
from portolan.operators.csharp import Source
from portolan.operators.extraction import FINDING, _read, with_hints
from portolan.operators.tracing import CONNECTIONS, LITERAL, literal_value
from portolan.sources.store import grown

#: States of a connection and how sure each is; fixed values.
RESOLVED, AMBIGUOUS, OUTSIDE, UNKNOWN, NO_FILE = "resolved", "unresolved_ambiguous_conditional", "unresolved_out_of_scope", "unresolved_no_literal", "unresolved_no_source_file"
CONFIDENCE = {RESOLVED: 95, AMBIGUOUS: 55, OUTSIDE: 20, UNKNOWN: 20, NO_FILE: 20}

SOURCES = "sources array<struct<kind: string, name: string>>"
_TOKEN = re.compile(LITERAL + r"|//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])'|\{|\}|\(|\)|;", re.S)
_STRING, _BLANK = re.compile(f"(?:{LITERAL})", re.S), re.compile(r"\s*")
_HEAD = re.compile(r"(if|else|for|foreach|while|do|switch|try|catch|finally|using|lock|case|default)\b")
_SETTING = re.compile(r'(?:\w+\.)*Settings\.Default\.(\w+)|(?:\w+\.)*ConnectionStrings\[\s*"(\w+)"\s*\](?:\.ConnectionString)?|(?:\w+\.)*Settings\.Default\[\s*"(\w+)"\s*\](?:\.ToString\(\))?')
_ASSIGN = re.compile(r"(?:[\w<>\[\],.?]+\s+)?(?:this\.)?(\w+)(?:\.(ConnectionString|Connection|CommandText))?\s*=(?![=>])\s*(.*)", re.S)
_NEW = re.compile(r"new\s+(Sql|Oracle)(Connection|Command)\s*\((.*)\)\s*(?:\{.*\})?\s*", re.S)
_CREATED = re.compile(r"(?:this\.)?(\w+)\.CreateCommand\s*\(\s*\)")
_NAME, _GONE = re.compile(r"(?:this\.)?([A-Za-z_]\w*)"), re.compile(r"(?:return|throw|break|continue|goto)\b")

Value = tuple[str, str]
Values = frozenset[Value]
State = dict[str, Values]


class Statement:
    __slots__ = ("kind", "text", "at", "body", "other")

    def __init__(self, kind: str, text: str, at: int, body: list[Statement] | None = None, other: list[Statement] | None = None) -> None:
        self.kind, self.text, self.at, self.body, self.other = kind, text, at, body or [], other


class Reader:
    """Statements of a text; comments count as blanks, and what stands in literals as nothing."""

    def __init__(self, text: str) -> None:
        self.text = _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*")) else m[0], text) if "//" in text or "/*" in text else text
        self.marks = [(m.start(), m[0]) for m in _TOKEN.finditer(self.text) if m[0] in "{}();"]
        self.places = [p for p, _ in self.marks]

    def block(self, at: int) -> tuple[list[Statement], int]:
        """The statements from ``at`` to the brace that closes their block, and the place behind it."""
        out: list[Statement] = []
        while True:
            at = self._blank(at)
            if at >= len(self.text):
                return out, at
            if self.text[at] == "}":
                return out, at + 1
            statement, at = self.statement(at)
            if statement is None:
                continue
            if statement.kind in ("catch", "finally") and out and out[-1].kind == "try":
                out[-1].other = (out[-1].other or []) + [Statement("arm", "", statement.at, statement.body)]
            else:
                out.append(statement)

    def _blank(self, at: int) -> int:
        return _BLANK.match(self.text, at).end()  # type: ignore[union-attr]

    def _next(self, at: int, marks: str) -> int:
        """The place of the next of ``marks`` outside parentheses; the end of the text without one."""
        depth = 0
        for k in range(bisect_left(self.places, at), len(self.marks)):
            place, mark = self.marks[k]
            if depth == 0 and mark in marks:
                return place
            depth += (mark == "(") - (mark == ")")
        return len(self.text)

    def statement(self, at: int) -> tuple[Statement | None, int]:
        if self.text[at] == "{":
            body, end = self.block(at + 1)
            return Statement("block", "", at, body), end
        if self.text[at] in ";)":
            return None, at + 1
        head = _HEAD.match(self.text, at)
        if head and head[1] in ("case", "default"):
            colon = self.text.find(":", at)
            return Statement("case", head[1], at), (colon + 1 if colon >= 0 else len(self.text))
        if head:
            behind, inside, begin = self._blank(head.end()), "", at
            if behind < len(self.text) and self.text[behind] == "(":
                close = self._next(behind + 1, ")")
                inside, begin, behind = self.text[behind + 1 : close], behind + 1, self._blank(close + 1)
            if behind >= len(self.text):
                return None, behind
            if head[1] == "using" and self.text[behind] != "{" and not inside:
                return None, self._next(at, ";") + 1
            body, end = self.statement(behind)
            held = [] if body is None else body.body if body.kind == "block" else [body]
            if head[1] == "if":
                after = self._blank(end)
                if (m := _HEAD.match(self.text, after)) and m[1] == "else":
                    rest, end = self.statement(after)
                    return Statement("if", inside, at, held, rest.body if rest else []), end
            kind = {"for": "loop", "foreach": "loop", "while": "loop", "do": "loop", "lock": "using", "using": "using"}.get(head[1], head[1])
            return Statement(kind, inside, begin, held), end
        end = self._next(at, ";{}")
        while end < len(self.text) and self.text[end] == "{" and re.search(r"[=(]|\bnew\b", self.text[at:end]):  # an initialiser or a lambda belongs to the statement
            _, behind = self.block(end + 1)
            end = self._next(behind, ";{}")
        text = self.text[at:end]
        if end < len(self.text) and self.text[end] == "{":
            body, after = self.block(end + 1)
            return Statement("block", text, at, body), after
        return Statement("do", text, at), (end if end < len(self.text) and self.text[end] == "}" else end + 1)


def parts_of(text: str, marks: str) -> list[str]:
    """``text`` cut at ``marks`` outside literals and brackets."""
    out, depth, start = [], 0, 0
    for m in _cuts(marks).finditer(text):
        if len(c := m[0]) > 1 or c == '"':  # a literal
            continue
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and c in marks:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


@lru_cache
def _cuts(marks: str) -> re.Pattern:
    return re.compile("|".join([LITERAL, *map(re.escape, "([{)]}" + marks)]), re.S)


def joined(a: State | None, b: State | None) -> State | None:
    if a is None or b is None:
        return b if a is None else a
    return {k: a.get(k, _outside(k)) | b.get(k, _outside(k)) for k in a.keys() | b.keys()}


def _outside(name: str) -> Values:
    return frozenset() if name.startswith("@") else frozenset({("outside", name)})


class Method:
    """Runs the statements of a method over sets of sources and notes what each command is given."""

    def __init__(self) -> None:
        self.commands: list[tuple[int, str, Values | None]] = []

    def run(self, statements: list[Statement], state: State | None) -> State | None:
        for s in statements:
            if state is None:
                return None
            state = self.step(s, state)
        return state

    def step(self, s: Statement, state: State) -> State | None:
        if s.kind == "do":
            return None if _GONE.match(s.text) else self.plain(s.text, s.at, state)
        if s.kind == "if":
            return joined(self.run(s.body, dict(state)), self.run(s.other or [], dict(state)))
        if s.kind == "loop":
            held = dict(state)
            for _ in range(4):  # sets only grow, and each name passes through few others
                after = joined(held, self.run(s.body, dict(held)))
                if after == held:
                    break
                held = after or held
            return held
        if s.kind == "switch":
            arms: list[list[Statement]] = []
            for inner in s.body:
                if inner.kind == "case":
                    arms.append([])
                elif arms:
                    if not (inner.kind == "do" and inner.text.startswith("break")):
                        arms[-1].append(inner)
            out = None if any(x.kind == "case" and x.text == "default" for x in s.body) else dict(state)
            for arm in arms:
                out = joined(out, self.run(arm, dict(state)))
            return out
        if s.kind == "try":
            body = self.run(s.body, dict(state))
            out = body
            for arm in s.other or []:
                out = joined(out, self.run(arm.body, dict(joined(state, body) or state)))
            return out
        if s.kind == "using":
            held = self.plain(s.text, s.at, state) if s.text else state
            return self.run(s.body, held)
        return self.run(s.body, state)

    def plain(self, text: str, at: int, state: State) -> State:
        m = _ASSIGN.fullmatch(text.strip()) if "=" in text else None
        if not m:
            return state
        name, part, expression = m[1], m[2], m[3].strip()
        where = at + text.find("=")
        if part == "CommandText":
            self.commands.append((at, name, state.get(f"@{name}")))
        elif part == "ConnectionString":
            state[name] = self.value(expression, state)
        elif part == "Connection":
            state[f"@{name}"] = self.value(expression, state)
            self.commands = [(a, n, state[f"@{name}"] if n == name and not v else v) for a, n, v in self.commands]
        elif expression.startswith("new") and (new := _NEW.fullmatch(expression)) and new[2] == "Command":
            given = parts_of(new[3], ",")
            state[f"@{name}"] = self.value(given[1], state) if len(given) > 1 else frozenset()
            self.commands.append((where + text[text.find("=") :].find("new"), name, state[f"@{name}"] or None))
        elif "CreateCommand" in expression and (made := _CREATED.fullmatch(expression)):
            state[f"@{name}"] = state.get(made[1], _outside(made[1]))
        else:
            state[name] = self.value(expression, state)
        return state

    def value(self, expression: str, state: State) -> Values:
        text = expression.strip().rstrip(";").strip()
        while text.startswith("(") and text.endswith(")") and len(parts_of(text[1:-1], ")")) == 1:
            text = text[1:-1].strip()
        if ("Settings" in text or "ConnectionStrings" in text) and (m := _SETTING.fullmatch(text)):
            return frozenset({("setting", m[1] or m[2] or m[3])})
        if text[:1] in ('"', "$", "@") and (m := _STRING.fullmatch(text)):
            return frozenset({("text", literal_value(m[0]))})
        if text.startswith("new") and (new := _NEW.fullmatch(text)) and new[2] == "Connection":
            return self.value(new[3], state) if new[3].strip() else frozenset()
        if m := _NAME.fullmatch(text):
            return state.get(m[1], _outside(m[1]))
        if "?" not in text:
            return frozenset({("unknown", "")})
        if len(choice := parts_of(text, "?")) == 2 and len(ends := parts_of(choice[1], ":")) == 2:
            return self.value(ends[0], state) | self.value(ends[1], state)
        if len(choice) == 3 and not choice[1]:  # a ?? b
            return self.value(choice[0], state) | self.value(choice[2], state)
        return frozenset({("unknown", "")})


def connections_of(path: str, text: str, source: Source | None = None) -> Iterator[tuple[int, list[dict]]]:
    """(line, sources) of each command in a file; no sources where nothing was given to it. ``source``: the file's, where it is there already."""
    source = source or Source(path, text)
    starts = list(accumulate((len(x) + 1 for x in source.lines), initial=0))
    whole, seen = "\n".join(source.lines), set()
    for first, last, _, _ in source.methods():
        if first in seen:
            continue
        seen.add(first)
        body = whole[starts[first] : starts[min(last + 1, len(source.lines))]]
        if "Command" not in body:
            continue
        open_ = body.find("{")
        if open_ < 0:
            continue
        method = Method()
        try:
            method.run(Reader(body[open_ + 1 :]).block(0)[0], {})
        except RecursionError:  # blocks nested some hundred deep: nothing is told
            continue
        for at, _, values in method.commands:
            line = bisect_right(starts, starts[first] + open_ + 1 + at)
            yield line, [{"kind": k, "name": n} for k, n in sorted(values or ())]


def connections(files: DataFrame) -> DataFrame:
    """``app_name, file, line, sources`` of the commands of files (app_name, path, text)."""
    named = files.filter(F.col("text").contains("Command"))
    return _read(named, f"app_name string, file string, line int, {SOURCES}", connections_of)


def with_findings(files: DataFrame) -> DataFrame:
    """``raw_findings`` with ``sources``, and the ``connections`` of the same files (``found``: connection) beside them; files are read once for both."""
    names = [c.split()[0] for c in FINDING.split(", ")[2:]]

    def rows(path: str, text: str) -> Iterator[tuple]:
        source = Source(path, text)
        for f in source.findings():
            yield *(f.get(n) for n in names), None
        if "Command" in text:
            for line, sources in connections_of(path, text, source):
                yield *({"found": "connection", "line": line}.get(n) for n in names), sources

    return _read(with_hints(files), f"{FINDING}, {SOURCES}", rows)


def footprint(findings: DataFrame, files: DataFrame, settings: DataFrame, erp_tables: tuple[str, ...] = (), found: DataFrame | None = None) -> DataFrame:
    """``app_name, file, line, class_name, method, kind, target, connection, server, database, status, confidence, is_erp`` for each command with a target.

    Resolved is a command whose only source is one setting or text that names a server; several sources are ambiguous; one
    from outside the method is out of scope. ``is_erp``: an Oracle command on one of ``erp_tables``. ``found``: the ``connections`` of the files, where they are read already.
    """
    key = ["app_name", "file", "line"]
    wanted = findings.filter(F.col("target").isNotNull() & ~F.col("kind").isin(*CONNECTIONS)).select(*key, "class_name", "method", "kind", "target")
    known = files.select("app_name", F.col("path").alias("file")).distinct().withColumn("_there", F.lit(True))
    found = (connections(files) if found is None else found).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))  # commands of one line
    servers = settings.filter("category = 'sql_or_oracle'").groupBy("app_name", F.col("name").alias("_name")).agg(F.max(F.struct(server_of(F.col("value")).alias("server"), database_of(F.col("value")).alias("database"))).alias("s"))
    single = F.when(F.size("sources") == 1, F.col("sources")[0])
    rows = wanted.join(grown(found), key, "left").join(grown(known), ["app_name", "file"], "left").withColumns({"_kind": single["kind"], "_name": single["name"]})
    rows = rows.join(grown(servers), ["app_name", "_name"], "left")
    of_setting = F.col("_kind") == "setting"
    server = F.when(of_setting, F.col("s.server")).when(F.col("_kind") == "text", server_of(F.col("_name")))
    database = F.when(of_setting, F.col("s.database")).when(F.col("_kind") == "text", database_of(F.col("_name")))
    has = lambda kind: F.exists("sources", lambda x: x.kind == kind)
    status = (
        F.when(F.col("_there").isNull(), NO_FILE).when(F.coalesce(F.size("sources"), F.lit(0)) < 1, UNKNOWN).when(has("outside"), OUTSIDE)
        .when(has("unknown"), UNKNOWN).when(F.size("sources") > 1, AMBIGUOUS).when(server.isNull(), UNKNOWN).otherwise(RESOLVED)
    )
    rows = rows.withColumn("status", status)
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("status"))
    known_only = lambda c: F.when(F.col("status") == RESOLVED, c)
    erp = F.col("kind").startswith("Oracle") & table_key(F.col("target")).isin([x.upper() for x in erp_tables]) if erp_tables else F.lit(False)
    return rows.select(
        *key, "class_name", "method", "kind", "target", F.when(of_setting, F.col("_name")).alias("connection"), known_only(server).alias("server"), known_only(database).alias("database"),
        "status", sure.alias("confidence"), F.coalesce(erp, F.lit(False)).alias("is_erp"),
    )


def footprint_counters(rows: DataFrame) -> DataFrame:
    """One row: ``total_apps, total_targets, resolved, ambiguous, unresolved, erp`` of a footprint."""
    resolved, ambiguous = F.count_if(F.col("status") == RESOLVED), F.count_if(F.col("status") == AMBIGUOUS)
    return rows.agg(F.count_distinct("app_name").alias("total_apps"), F.count(F.lit(1)).alias("total_targets"), resolved.alias("resolved"), ambiguous.alias("ambiguous"), (F.count(F.lit(1)) - resolved - ambiguous).alias("unresolved"), F.count_if("is_erp").alias("erp"))
