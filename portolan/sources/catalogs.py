"""Catalogs of databases for all objects of a portfolio in one job.

Objects are dealt by connection and batch; a task opens each of its connections once and asks its objects over it, so that a database with very many objects is read by several tasks, and a
task holds the answer of one object at a time. Only catalog views are read. What can't be reached or told is an error in the row, never an end of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a SQL Server's catalog is asked for an object of a schema; fixed values of its system views.
QUESTIONS = {
    "definition": "SELECT OBJECT_DEFINITION(OBJECT_ID(? + '.' + ?))",
    "parameters": "SELECT p.name, t.name, p.max_length, p.is_output, p.has_default_value, CAST(p.default_value AS nvarchar(4000)) FROM sys.parameters p JOIN sys.types t ON t.user_type_id = p.user_type_id WHERE p.object_id = OBJECT_ID(? + '.' + ?) ORDER BY p.parameter_id",
    "result_columns": "SELECT name, system_type_name, is_nullable FROM sys.dm_exec_describe_first_result_set_for_object(OBJECT_ID(? + '.' + ?), 0) ORDER BY column_ordinal",
    "columns": "SELECT COLUMN_NAME, DATA_TYPE, IS_NULLABLE, CHARACTER_MAXIMUM_LENGTH, COLUMN_DEFAULT FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_SCHEMA = ? AND TABLE_NAME = ? ORDER BY ORDINAL_POSITION",
    "foreign_keys": "SELECT COL_NAME(c.parent_object_id, c.parent_column_id), OBJECT_SCHEMA_NAME(k.referenced_object_id) + '.' + OBJECT_NAME(k.referenced_object_id), COL_NAME(c.referenced_object_id, c.referenced_column_id), k.name FROM sys.foreign_keys k JOIN sys.foreign_key_columns c ON c.constraint_object_id = k.object_id WHERE k.parent_object_id = OBJECT_ID(? + '.' + ?)",
}
#: The answers' fields in the order in which they are asked.
PARAMETER = ("name", "type", "max_length", "is_output", "has_default", "default")
RESULT_COLUMN, COLUMN, FOREIGN_KEY = ("name", "type", "nullable"), ("name", "type", "nullable", "max_length", "default"), ("column", "ref_table", "ref_column", "fk_name")

ANSWER = (
    "status string, definition string, parameters array<struct<name: string, type: string, max_length: int, is_output: boolean, has_default: boolean, default: string>>, "
    "result_columns array<struct<name: string, type: string, nullable: boolean>>, columns array<struct<name: string, type: string, nullable: string, max_length: int, default: string>>, "
    "foreign_keys array<struct<column: string, ref_table: string, ref_column: string, fk_name: string>>, n_columns int, error string"
)
Connect = Callable[[str], Any]


def _rows(connection: Any, question: str, schema: str, name: str) -> list[tuple]:
    cursor = connection.cursor()
    cursor.execute(QUESTIONS[question], (schema, name))
    return [tuple(r) for r in cursor.fetchall()]


def _text(x: object) -> str | None:
    return None if x is None else str(x)


def procedure(connection: Any, schema: str, name: str) -> dict:
    """Definition, parameters and the shape of the first result (null where the server can't tell it)."""
    found = _rows(connection, "definition", schema, name)
    if not found or not found[0][0]:
        return {"status": "not_found"}
    given = [dict(zip(PARAMETER, (n, t, size, bool(out), bool(has), _text(value)))) for n, t, size, out, has, value in _rows(connection, "parameters", schema, name)]
    try:
        shape = [dict(zip(RESULT_COLUMN, (n, t, bool(null)))) for n, t, null in _rows(connection, "result_columns", schema, name)] or None
    except Exception:  # a procedure whose result can't be described is an answer, not a fault
        shape = None
    return {"status": "ok", "definition": found[0][0], "parameters": given, "result_columns": shape}


def table(connection: Any, schema: str, name: str) -> dict:
    """Columns and foreign keys."""
    columns = [dict(zip(COLUMN, (n, t, null, size, _text(default)))) for n, t, null, size, default in _rows(connection, "columns", schema, name)]
    keys = [dict(zip(FOREIGN_KEY, row)) for row in _rows(connection, "foreign_keys", schema, name)] if columns else []
    return {"status": "ok" if columns else "not_found", "columns": columns, "foreign_keys": keys, "n_columns": len(columns)}


def read(asked: DataFrame, connect: Connect, batches: int = 8) -> DataFrame:
    """The answers to ``asked`` (app_id, place, connection, schema, name, is_procedure; see ``enrich.asked``), a row each with the columns of ``ANSWER``.

    ``connect`` opens a connection of the Python database interface from its text; it runs in the tasks. ``batches``: how many
    tasks may read over one connection text. ``enrich.picked`` takes the rows as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = ["app_id", "place", "connection", "schema", "name", "is_procedure"]
    kinds = dict(asked.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + ANSWER
    target = to_arrow_schema(StructType.fromDDL(shape))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for part in parts for r in part.select(names).to_pylist())
        for text, group in groupby(rows, key=lambda r: r["connection"]):
            connection, error = None, None
            try:
                connection = connect(text)
            except Exception as e:
                error = str(e) or type(e).__name__
            try:
                for row in group:
                    answer: dict = {"status": "error", "error": error}
                    if connection is not None:
                        try:
                            answer = (procedure if row["is_procedure"] else table)(connection, row["schema"], row["name"])
                        except Exception as e:
                            answer = {"status": "error", "error": str(e) or type(e).__name__}
                    yield pa.RecordBatch.from_pylist([{**row, **answer}], schema=target)
            finally:
                if connection is not None:
                    connection.close()

    batch = F.pmod(F.xxhash64("schema", "name"), F.lit(batches)).alias("_batch")
    dealt = asked.select(*names, batch).repartition("connection", "_batch").sortWithinPartitions("connection", "_batch", "schema", "name")
    return dealt.mapInArrow(run, shape)
