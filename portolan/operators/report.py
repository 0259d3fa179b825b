"""Reports, as text written by Spark in a fixed order; diagrams are in ``diagrams``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.labels import confidence_label
from portolan.operators.portfolio import first_of_each

SNIPPET = 200


def cell(text: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row ``markdown``: a table of a report's rows in ``order``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    lines = rows.select(F.struct(*order, line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return lines.select(F.concat_ws("\n", F.lit(head), F.nullif("body", F.lit(""))).alias("markdown"))


#: How code opens a connection, and what stands for a method whose texts aren't known; fixed values.
CONNECTION = r"new\s+(?:Sql|Oracle)Connection\s*\(\s*([\w.]+)\s*\)"
UNRESOLVED = "(conexion detectada, query no resuelta automaticamente — revisar manualmente)"


def shown_findings(findings: DataFrame, snippet: int | None = SNIPPET, more: tuple[str, ...] = ()) -> DataFrame:
    """SQL findings of a report: the texts that are known, once per class, method and text by first appearance, with how sure they are; a
    method without any has one row that says so. ``connection``: the first that the method opens, else ``?``.
    Texts end after ``snippet`` characters, if given; ``more``: further columns to keep (null where no text is known)."""
    method = ["app_name", "class_name", "method"]
    rows = findings.withColumns({"text": F.coalesce("resolved", "raw"), "known": F.coalesce(F.col("resolved").isNotNull() | F.contains("raw", F.lit('"')), F.lit(False)), "opens": F.nullif(F.regexp_extract("raw", CONNECTION, 1), F.lit(""))})
    groups = rows.groupBy(*method).agg(F.max("known").alias("any"), F.min(F.when(F.col("opens").isNotNull(), F.struct("file", "line", "opens"))).alias("first"), F.min(F.struct("file", "line")).alias("at"))
    groups = groups.select(*method, "any", "at", F.coalesce("first.opens", F.lit("?")).alias("connection"))
    first = first_of_each(rows.filter("known"), [*method, "text"], ["file", "line"]).join(groups.select(*method, "connection"), method)
    text = F.left("text", F.lit(snippet)) if snippet else F.col("text")
    shown = first.select(*method, "connection", text.alias("text"), "category", "target", confidence_label(F.col("evidence.confidence")).alias("confidence"), "file", "line", *more)
    rest = groups.filter("not any").select(*method, "connection", F.lit(UNRESOLVED).alias("text"), F.lit("?").alias("category"), F.lit(None).cast("string").alias("target"), F.lit("unknown").alias("confidence"), "at.file", "at.line", *[F.lit(None).cast(findings.schema[c].dataType).alias(c) for c in more])
    return shown.unionByName(rest)


def shown_io(io: DataFrame) -> DataFrame:
    """Input and output, and reflection apart from it: once per class, method and text."""
    return first_of_each(io, ["app_name", "class_name", "method", "raw"], ["file", "line"]).select("app_name", "category", "class_name", "method", "operation", "raw", "file", "line")


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """``place, markdown`` of a report: each part's title and its table (a row ``markdown``), in order; to be written as text."""
    rows = [table.select(F.lit(k).alias("place"), F.concat(F.lit(f"## {title}\n\n"), "markdown").alias("markdown")) for k, (title, table) in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).orderBy("place")


def write_csv_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report as a folder of CSV, written by the executors."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
