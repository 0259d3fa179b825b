"""Text helpers shared by extractors: lines, escapes, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a line ends for source text: the usual ends and the Unicode and control separators; fixed values.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """The lines of a text; none for an empty one, and no empty line behind a final line end."""
    trimmed = F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, LINE_ENDS))


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def without_escapes(text: Column) -> Column:
    """Escaped line ends and tabs, written as two characters in source text, become spaces."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\[rnt]", " ")).otherwise(text)


def first_match(column: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that is found in ``column``."""
    out = None
    for pattern, label in rules:
        out = F.when(column.rlike(pattern), label) if out is None else out.when(column.rlike(pattern), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def masked_secrets(connection: Column) -> Column:
    """A connection string with the values of its password keys replaced."""
    return F.regexp_replace(connection, r"(?i)\b(password|pwd)\s*=\s*[^;]+", "$1=***")


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed(text: Column) -> Column:
    """As ``stripped`` without a pattern, for what is done for each row; only where a text ends in a line end that isn't white space the pattern decides."""
    odd = text.endswith("\x85") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(odd, stripped(text)).otherwise(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")))
