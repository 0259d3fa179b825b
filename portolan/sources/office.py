"""Workbooks and documents of all applications in one job, as a custom sink: tasks write packages, the commit puts them in place."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from pathlib import Path
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the formats.
SHEET_ROWS, CELL_CHARS, TITLE_CHARS = 1_048_576, 32_767, 31
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/"
SHEET, WORD = (f"http://schemas.openxmlformats.org/{x}/2006/main" for x in ("spreadsheetml", "wordprocessingml"))
TYPE = "application/vnd.openxmlformats-officedocument."
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_KEYS = ("place", "a", "b", "c")


def sheet_rows(rows: DataFrame, place: int, title: str, columns: dict[str, Column], apps: DataFrame, order: tuple[Column | str, Column | int, Column | str] = ("", 0, "")) -> DataFrame:
    """``app_name, place, title, a, b, c, cells``: a sheet of each of ``apps``, its header first, then its rows by ``order`` and then by their cells. Nulls are empty cells."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = [F.coalesce(as_column(x).cast(kind), F.lit(none)).alias(name) for x, kind, none, name in zip(order, ("string", "bigint", "string"), ("", 0, ""), "abc")]
    fixed = [F.lit(place).alias("place"), F.lit(title).alias("title")]
    head = apps.select("app_name", *fixed, *[F.lit(None).cast(t).alias(k) for k, t in zip("abc", ("string", "bigint", "string"))], F.array(*[F.lit(c) for c in columns]).alias("cells"))
    body = rows.select("app_name", *fixed, *keys, F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()]).alias("cells"))
    return head.unionByName(body)


def write_workbooks(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One XLSX file an application from rows of ``sheet_rows``. A sheet that is full goes on in another, a text longer than a cell in more cells behind the row's last."""
    _write(rows, ["app_name", *_KEYS, "cells"], ["app_name", "title", "cells"], "xlsx", path, mode)


def write_documents(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One DOCX file an application from lines of a report in Markdown (``sectioned.report_lines``): headings, tables and paragraphs."""
    _write(lines, ["app_name", "section", "a", "b", "c", "n"], ["app_name", "line"], "docx", path, mode)


def _write(rows: DataFrame, order: list[str], columns: list[str], kind: str, path: str, mode: str) -> None:
    rows.sparkSession.dataSource.register(OfficeSource)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "app_name").sortWithinPartitions(*order).select(*columns).write.format("office").option("kind", kind).mode(mode).save(path)


class OfficeSource(DataSource):
    """Writes sorted rows to the folder ``path``, which all machines share; ``kind`` is xlsx or docx. Each application lies in one partition."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def writer(self, schema: StructType, overwrite: bool) -> OfficeWriter:
        return OfficeWriter(self.options["path"].removeprefix("file:"), self.options["kind"], overwrite)


@dataclass
class Packages(WriterCommitMessage):
    names: dict[str, str] = field(default_factory=dict)  #: the file written by the task, by the name it is to have


class OfficeWriter(DataSourceWriter):
    """A task streams each application into a file of its attempt's own name; the commit renames those of the attempts that count. Attempts that were lost leave hidden files alone."""

    def __init__(self, path: str, kind: str, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite, self.run = Path(path), kind, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Packages:
        done = Packages()
        self.path.mkdir(parents=True, exist_ok=True)
        for app, rows in groupby(iterator, key=lambda r: r.app_name):
            name = f"{'%00' if app is None else quote(app, safe=' ')}.{self.kind}"
            own = f".{self.run}-{uuid.uuid4().hex}"
            done.names[name] = own
            with zipfile.ZipFile(self.path / own, "w", zipfile.ZIP_DEFLATED) as package:
                (workbook if self.kind == "xlsx" else document)(package, rows)
        return done

    def commit(self, messages: list) -> None:
        names = [x for m in messages if m for x in m.names.items()]
        if len({final for final, _ in names}) < len(names):
            self.abort(messages)
            raise ValueError("an application lies in several partitions")
        self.path.mkdir(parents=True, exist_ok=True)
        for final, own in names:
            os.replace(self.path / own, self.path / final)
        if self.overwrite:
            for old in self.path.glob(f"*.{self.kind}"):
                if old.name not in dict(names):
                    old.unlink()
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for left in self.path.glob(f".{self.run}-*"):
            left.unlink(missing_ok=True)


def _relations(package: zipfile.ZipFile, name: str, targets: list[tuple[str, str]]) -> None:
    each = "".join(f'<Relationship Id="r{i}" Type="{RELATIONS}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1))
    package.writestr(name, f'{HEAD}<Relationships xmlns="{PACKAGE}relationships">{each}</Relationships>')


def _types(package: zipfile.ZipFile, parts: list[tuple[str, str]]) -> None:
    each = "".join(f'<Override PartName="/{name}" ContentType="{TYPE}{kind}+xml"/>' for name, kind in parts)
    known = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{each}'
    package.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}content-types">{known}</Types>')


def cell_text(text: str) -> str:
    """Text of a cell: what XML can't hold, and text that looks like such an escape, as ``_xHHHH_``."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(_ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text).replace("\r", "_x000D_"))


def workbook(package: zipfile.ZipFile, rows: Iterator) -> None:
    """Streams rows (``title, cells``), sheet by sheet, into a package; only the titles are held."""
    titles: list[str] = []
    taken: set[str] = set()
    for title, part in groupby(rows, key=lambda r: r.title):
        plain, more = re.sub(r"[\[\]:*?/\\]", " ", title), 1
        row = next(part, None)
        while row is not None:
            name = plain[:TITLE_CHARS]
            while name.lower() in taken:  # a sheet that goes on, or another whose title is the same in a workbook
                more += 1
                tail = f" ({more})"
                name = plain[: TITLE_CHARS - len(tail)] + tail
            titles.append(name)
            taken.add(name.lower())
            with package.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as out:
                out.write(f'{HEAD}<worksheet xmlns="{SHEET}"><sheetData>'.encode())
                for _ in range(SHEET_ROWS):
                    if row is None:
                        break
                    out.write(f"<row>{''.join(_cells(row.cells))}</row>".encode())
                    row = next(part, None)
                out.write(b"</sheetData></worksheet>")
    sheets = "".join(f'<sheet name={quoteattr(_ILLEGAL.sub(" ", t))} sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(titles, 1))
    package.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets></workbook>')
    _relations(package, "xl/_rels/workbook.xml.rels", [("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(titles) + 1)])
    _relations(package, "_rels/.rels", [("officeDocument", "xl/workbook.xml")])
    _types(package, [("xl/workbook.xml", "spreadsheetml.sheet.main")] + [(f"xl/worksheets/sheet{i}.xml", "spreadsheetml.worksheet") for i in range(1, len(titles) + 1)])


def _cells(cells: list[str]) -> Iterator[str]:
    # a text's first piece stays in its column; the rest of long ones follows behind the last column
    pieces = [[text[a : a + CELL_CHARS] for a in range(0, len(text), CELL_CHARS)] or [""] for text in cells]
    for piece in [p[0] for p in pieces] + [x for p in pieces for x in p[1:]]:
        yield f'<c t="inlineStr"><is><t xml:space="preserve">{cell_text(piece)}</t></is></c>'


def document(package: zipfile.ZipFile, lines: Iterator) -> None:
    """Streams lines of Markdown into a package: headings by their depth, tables row by row, other lines that aren't empty as paragraphs."""
    with package.open("word/document.xml", "w", force_zip64=True) as out:
        out.write(f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>'.encode())
        open_table = False
        for row in lines:
            line = row.line or ""
            in_table = line.startswith("|")
            if in_table and re.fullmatch(r"\|(-+\|)+", line):
                continue
            if in_table != open_table:
                out.write(b"<w:tbl><w:tblPr/><w:tblGrid/>" if in_table else b"</w:tbl><w:p/>")
                open_table = in_table
            if in_table:
                cells = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)[1:-1]]
                out.write(f"<w:tr>{''.join(f'<w:tc>{_paragraph(c)}</w:tc>' for c in cells)}</w:tr>".encode())
            elif line.strip():
                depth, text = re.fullmatch(r"(?s)(?:(#{1,6}) )?(.*)", line).groups()
                out.write(_paragraph(text, len(depth or "")).encode())
        out.write((b"</w:tbl><w:p/>" if open_table else b"") + b"</w:body></w:document>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>' for i in range(1, 7))
    package.writestr("word/styles.xml", f'{HEAD}<w:styles xmlns:w="{WORD}">{styles}</w:styles>')
    _relations(package, "word/_rels/document.xml.rels", [("styles", "styles.xml")])
    _relations(package, "_rels/.rels", [("officeDocument", "word/document.xml")])
    _types(package, [("word/document.xml", "wordprocessingml.document.main"), ("word/styles.xml", "wordprocessingml.styles")])


def _paragraph(text: str, depth: int = 0) -> str:
    style = f'<w:pPr><w:pStyle w:val="Heading{depth}"/></w:pPr>' if depth else ""
    return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(_ILLEGAL.sub(chr(0xFFFD), text))}</w:t></w:r></w:p>'
