"""Reading SQL text: operation, columns, table keys, targets; all as column expressions that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.textops import stripped, trimmed, without_escapes

#: Operations in order of precedence, and the clauses that hold column lists; fixed values.
OPERATIONS = (
    ("insert", r"(?i)\binsert\s+into\b"),
    ("update", r"(?i)\bupdate\s+\S+\s+set\b"),
    ("delete", r"(?i)\bdelete\s+from\b"),
    ("merge", r"(?i)\bmerge\s+into\b|\bmerge\s+\S+\s+as\b"),
    ("select", r"(?i)\bselect\b"),
)
INSERT_COLUMNS = r"(?is)insert\s+into\s+\S+\s*\(([^)]*)\).*?(?:values\s*\(|select\b)"
UPDATE_CLAUSE = r"(?is)update\s+\S+\s+set\s+(.*?)(?:\bwhere\b|$)"
ASSIGNED = r"(?i)\b([A-Za-z_]\w*)\s*="
SELECT_LIST = r"(?is)select\s+(?:top\s+\d+\s+)?(.*?)\s+from\b"
#: A list of names only, with qualifiers, brackets and aliases, and each name in it; longer lists are read item by item.
_PLAIN_ITEM = r"(?:\[*\w+\]*\.)*\[*[A-Za-z_]\w*\]*(?:\s+as\s+[^\s,()]+)?"
PLAIN_LIST = rf"(?i)^\s*(?:,\s*)?{_PLAIN_ITEM}(?:\s*,\s*{_PLAIN_ITEM})*\s*\z"
PLAIN_NAME = r"(?i)([A-Za-z_]\w*)\]*(?:\s+as\s+[^\s,()]+)?\s*(?:,|\z)"
PLAIN_LENGTH = 1000
#: Parentheses with what is in them, four deep; an item that has any (they are marked by then), with the comma before it.
_NESTED = r"\([^()]*+\)"
for _ in range(3):
    _NESTED = rf"\([^()]*+(?:{_NESTED}[^()]*+)*+\)"
MARK = "\x01"
MARKED_ITEM = rf"(?:^|,)[^,{MARK}]*{MARK}[^,]*"

#: Names of columns with a meaning of their own; fixed values. Catalogs of a real portfolio are passed in their place.
MEASUREMENTS = ("IL", "REFLA", "REFLB", "ILENDA", "ILENDB")
STATUS_METADATA = ("STATUS", "DEVICE", "CONNECTOR", "ENDS", "SERIAL_NUMBER", "EMPLOYEE_NUMBER", "WIP_ENTITY_NAME")
STRONG = ("TEST_DATE", "DEVICE_STATUS", "PASSFAIL")
STRONG_ID = r"(?i)^TEST_[A-Z0-9_]+_ID$"


def statement(resolved: Column, raw: Column) -> Column:
    """The text to read: what was reconstructed, then the source."""
    return F.concat(F.coalesce(resolved, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit("")))


def operation(text: Column) -> Column:
    """insert, update, delete, merge or select, in this order of precedence; else null."""
    return plain_operation(without_escapes(text))


def plain_operation(plain: Column, upper: Column | None = None) -> Column:
    """``upper``: the text in capitals where it is there already; a pattern is only looked for where its first word is."""
    upper, out = F.upper(plain) if upper is None else upper, None
    for name, pattern in OPERATIONS:
        found = F.contains(upper, F.lit(name.upper())) & plain.rlike(pattern)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out


def column_name(token: Column) -> Column:
    """The name a list item stands for, without alias, brackets and table; null for ``*``, calls and other expressions."""
    t = stripped(F.regexp_replace(stripped(token), r"(?i)\s+as\s+\S+$", ""))
    t = stripped(F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", ""))
    t = F.regexp_replace(F.element_at(F.split(t, r"\."), -1), r"^[\[\]]+|[\[\]]+$", "")
    return F.when(~F.contains(token, F.lit("(")) & ~F.contains(token, F.lit(")")) & t.rlike(r"^[A-Za-z_]\w*$"), t)


def top_level_items(text: Column) -> Column:
    """Items between commas that aren't within parentheses, however deep: pieces between all commas are put together again as long as
    a parenthesis is open. Lists without any are split at once."""
    pieces = F.split(text, ",")
    balance = lambda piece: F.length(F.translate(piece, ")", "")) - F.length(F.translate(piece, "(", ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(state: Column, piece: Column) -> Column:
        item = F.concat_ws(",", state["open"], piece)
        depth = state["depth"] + balance(piece)
        whole = depth == 0
        return F.struct(F.when(whole, F.array_append(state["done"], item)).otherwise(state["done"]).alias("done"), F.when(~whole, item).alias("open"), depth.alias("depth"))

    joined = F.aggregate(pieces, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit(")")), joined).otherwise(pieces)


def names_in(items: Column) -> Column:
    """The names among list items; empty where there are none."""
    return F.filter(F.transform(items, column_name), lambda c: c.isNotNull())


def marked_calls(op: Column, listed: Column) -> Column:
    """A ``column_list`` with marks for its parentheses and what is in them; null where it has none, is an update's or long, or they don't close or are deeper than four."""
    read = (op != "update") & F.contains(listed, F.lit("(")) & (F.length(listed) <= PLAIN_LENGTH) & ~F.contains(listed, F.lit(MARK))
    return F.when(read, F.regexp_replace(listed, _NESTED, MARK))


def without_calls(marked: Column, listed: Column) -> Column:
    """A list without the items that have parentheses, which name nothing, where they are ``marked``; else as it is."""
    closed = ~F.contains(marked, F.lit("(")) & ~F.contains(marked, F.lit(")"))
    return F.when(closed, F.regexp_replace(marked, MARKED_ITEM, "")).otherwise(listed)


def names_of(op: Column, listed: Column) -> Column:
    """``names_in`` of the ``list_items`` of a ``column_list``, whole or ``without_calls``; names alone are taken by one pattern."""
    none = F.array().cast("array<string>")
    plain = (F.length(listed) <= PLAIN_LENGTH) & listed.rlike(PLAIN_LIST)
    return (
        F.when(op == "update", F.regexp_extract_all(listed, F.lit(ASSIGNED), 1)).when(listed.isin("", "*"), none)
        .when(plain, F.regexp_extract_all(listed, F.lit(PLAIN_NAME), 1)).otherwise(names_in(top_level_items(listed)))
    )


def column_list(op: Column, plain: Column) -> Column:
    """The part of a statement that names its columns: an insert's list, an update's SET clause, a select's list; empty without one."""
    return F.when(op == "insert", F.regexp_extract(plain, INSERT_COLUMNS, 1)).when(op == "update", F.regexp_extract(plain, UPDATE_CLAUSE, 1)).when(op == "select", F.regexp_extract(plain, SELECT_LIST, 1))


def list_items(op: Column, listed: Column) -> Column:
    """What may be a column in a ``column_list``: of an update every name before an equals sign, those of comparisons too; else the items."""
    return F.when(op == "update", F.regexp_extract_all(listed, F.lit(ASSIGNED), 1)).otherwise(top_level_items(listed))


def columns(op: str, text: Column) -> Column:
    """The columns that a statement of a known operation names; null for none."""
    found = names_in(list_items(F.lit(op), column_list(F.lit(op), without_escapes(text))))
    return F.when(F.size(found) > 0, found)


def result_columns(json: Column) -> Column:
    """A JSON list of names as an array; null if it is empty or not such a list."""
    parsed = F.filter(F.from_json(json, "array<string>"), lambda c: c.isNotNull())
    return F.when(F.size(parsed) > 0, parsed)


def table_key(target: Column) -> Column:
    """Tables under one key whatever their spelling; null for what is code rather than a name."""
    upper = F.upper(trimmed(target))
    code = (F.contains(upper, F.lit("COMMANDTEXT")) | F.contains(upper, F.lit("USING"))) & target.rlike(r"(?i)commandtext|^\s*using\b")
    return F.when(target.isNotNull() & ~code, F.when(upper.startswith("DBO."), F.substr(upper, F.lit(5))).otherwise(upper))


def is_member(name: Column, catalog: tuple[str, ...]) -> Column:
    return F.upper(stripped(name)).isin(*[c.upper() for c in catalog])


def is_strong(name: Column, measurements: tuple[str, ...] = MEASUREMENTS) -> Column:
    """Columns that only test results have."""
    return is_member(name, STRONG) | stripped(name).rlike(STRONG_ID) | is_member(name, measurements)


def shown(names: Column) -> Column:
    """Names as catalogs are compared with."""
    return F.transform(names, lambda c: F.upper(trimmed(c)))


def any_member(shown: Column, catalog: tuple[str, ...]) -> Column:
    """Whether any of the names as ``shown`` is in a catalog."""
    return F.arrays_overlap(shown, F.array(*[F.lit(c.upper()) for c in catalog]).cast("array<string>"))


def any_strong(names: Column, shown: Column, measurements: tuple[str, ...] = MEASUREMENTS) -> Column:
    """Whether any of the names (and as ``shown``) is ``is_strong``."""
    by_id = F.contains(F.upper(F.array_join(names, " ")), F.lit("TEST_")) & F.exists(names, lambda c: stripped(c).rlike(STRONG_ID))
    return any_member(shown, (*STRONG, *measurements)) | by_id


#: How a command's text names what it runs; fixed values.
KEYWORDS = r"(?i)\b(select|insert\s+into|update|delete\s+from|with|create|alter|drop|exec(ute)?)\b"
PACKAGE_CALL = r"(\w+_pkg)\.(\w+)\s*\("
TABLE_PATTERNS = (r"(?i)\bupdate\s+\[?([\w\.]+)\]?", r"(?i)\bfrom\s+\[?([\w\.]+)\]?", r"(?i)\binto\s+\[?([\w\.]+)\]?")
QUALIFIED = r"^\[?(\w+)\]?\.\[?(\w+)\]?$"
BARE = r"^\s*(\w+)\s*(?:'|$)"


def classified(text: Column, procedure_evidence: Column, is_connection: Column) -> Column:
    """struct<category, target, is_procedure> of a statement: a package call; a procedure by qualified or bare name,
    never of a connection; else a query on the first table after UPDATE, FROM or INTO."""
    literal = literal_of(text)
    return _classified(text, F.upper(text), literal, trimmed(literal), procedure_evidence, is_connection)


def literal_of(text: Column) -> Column:
    """What stands in the first quotes of a command's source; without any the source behind quotes that aren't closed."""
    return F.when(text.rlike('"[^"]*"'), F.regexp_extract(text, '"([^"]*)"', 1)).otherwise(F.regexp_replace(text, r'^["$]+', ""))


def with_classes(rows: DataFrame, text: Column, procedure_evidence: Column, is_connection: Column) -> DataFrame:
    """``rows`` with ``c``: their texts as ``classified``. Each step is a projection of its own: no pattern is looked for twice, and the code made for it stays so short that the JVM compiles it."""
    kept = rows.columns
    rows = rows.withColumn("_text", text).withColumns({"_literal": literal_of(F.col("_text")), "_upper": F.upper("_text")}).withColumn("_plain", trimmed(F.col("_literal")))
    found = _classified(F.col("_text"), F.col("_upper"), F.col("_literal"), F.col("_plain"), procedure_evidence, is_connection)
    return rows.select(*kept, F.explode_outer(F.array(found)).alias("c"))  # one element a row: filters on what is found aren't pushed into the patterns


def _classified(text: Column, upper: Column, literal: Column, plain: Column, procedure_evidence: Column, is_connection: Column) -> Column:
    """``upper``: the text in capitals; a pattern is only looked for where its first word is."""
    keyword = text.rlike(KEYWORDS)
    open_ = ~is_connection & (procedure_evidence | ~keyword)
    table = F.coalesce(*[F.when(F.contains(upper, F.lit(word)) & text.rlike(p), F.regexp_extract(text, p, 1)) for word, p in zip(("UPDATE", "FROM", "INTO"), TABLE_PATTERNS)])

    def made(category: str, target: Column, procedure: bool) -> Column:
        return F.struct(F.lit(category).alias("category"), target.alias("target"), F.lit(procedure).alias("is_procedure"))

    return (
        F.when(F.contains(text, F.lit("_pkg")) & text.rlike(PACKAGE_CALL), made("oracle_package_call", F.concat_ws(".", F.regexp_extract(text, PACKAGE_CALL, 1), F.regexp_extract(text, PACKAGE_CALL, 2)), False))
        .when(open_ & plain.rlike(QUALIFIED), made("stored_procedure", F.concat_ws(".", F.regexp_extract(plain, QUALIFIED, 1), F.regexp_extract(plain, QUALIFIED, 2)), True))
        .when(open_ & literal.rlike(BARE), made("stored_procedure", F.regexp_extract(literal, BARE, 1), True))
        .otherwise(made("query", table, False))
    )


def connection_part(value: Column, *keys: str) -> Column:
    """What a connection string gives for any of ``keys`` (lower case); the last one given wins."""
    pattern = r"(?i)(?:^|;)\s*(?:" + "|".join(k.replace(" ", r"\s+") for k in keys) + r")\s*=\s*([^;]*)"
    return F.nullif(stripped(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(value, F.lit(pattern), 1)), -1)), F.lit(""))


def server_of(value: Column) -> Column:
    return F.lower(connection_part(value, "server", "data source"))


def database_of(value: Column) -> Column:
    return connection_part(value, "database", "initial catalog")
