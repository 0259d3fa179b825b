"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Each response gives a ``metadata`` record (title, language, HTTP headers, outlinks) and a ``conversion`` record (its text), which both
refer to the response by ``WARC-Refers-To`` and keep its target URI, its date, its HTTP headers and its payload's digest beside their own.
Record ids are derived from content, so that a task that runs again writes the same records.

Pages are read in one pass from tag to tag, in time linear in their length whatever they hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.textio import arrow_map, slices

#: Records without a date of their own carry this one.
NO_DATE = "1970-01-01T00:00:00Z"
SLICE = 8_000_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, by RFC 9562

#: Elements whose content isn't text; elements that begin and end lines: fixed values.
DROPPED = "script style noscript template".split()
BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside blockquote pre title head body form main td th dl dt dd hr".split())
_SPECIAL = frozenset(["a", "html", "title", *DROPPED])
_OPEN = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[!?/])")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)?")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
_END_OF_TITLE = re.compile(r"</title", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BLANKS, _LINES = re.compile(r" ?[^\S\n ][^\S\n]*| {2,}[^\S\n]*"), re.compile(r" ?\n[ \n]*")

RECORD = "doc string, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_payload_digest string, source_headers string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, of: str, block_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {of} {block_digest}')}>"


class Page:
    """What one pass over a page finds: its text with tags resolved, title, language and the targets of its links, all as they stand in it."""

    def __init__(self, html: str) -> None:
        self.text: list[str] = []
        self.title: str | None = None
        self.lang = ""
        self.links: list[str] = []
        self.gone: set[str] = set()  # ends that don't come any more: never looked for again
        at, put, find = 0, self.text.append, html.find
        for m in iter(lambda: _OPEN.search(html, at), None):
            put(html[at : m.start()])
            name = m[1]
            if name is not None and name not in _SPECIAL and ">" not in self.gone and (end := find(">", m.end())) >= 0:  # most tags
                if name.lower() in BREAKS:
                    put("\n")
                elif name.lower() in _SPECIAL:
                    end = self._markup(html, m.start()) - 1
                at = end + 1
            else:
                at = self._markup(html, m.start())
        put(html[at:])

    def _find(self, html: str, what: str, at: int) -> int:
        """Where ``what`` stands from ``at`` on; the length of the page if nowhere."""
        found = -1 if what in self.gone else html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found if found >= 0 else len(html)

    def _markup(self, html: str, at: int) -> int:
        """Reads what begins at the ``<`` at ``at``; gives the place behind it."""
        if html.startswith("<!--", at):
            self.text.append(" ")
            return self._find(html, "-->", at + 4) + 3
        if html.startswith(("<!", "<?"), at):
            self.text.append(" ")
            return self._find(html, ">", at) + 1
        m = _NAME.match(html, at + 1)
        closing, name = m[1], (m[2] or "").lower()
        end = self._find(html, ">", at)
        if name in _CLOSE and not closing:
            self.text.append(" ")
            found = None if name in self.gone else _CLOSE[name].search(html, end)
            if found is None:
                self.gone.add(name)
            return found.end() if found else len(html)
        if not closing:
            self._attributes(html, name, html[at:end], end)
        self.text.append("\n" if name in BREAKS else "")
        return end + 1

    def _attributes(self, html: str, name: str, tag: str, end: int) -> None:
        if name == "a" and (m := _HREF.search(tag)):
            self.links.append(m[1] or m[2] or m[3] or "")
        elif name == "html" and not self.lang and (m := _LANG.search(tag)):
            self.lang = m[1]
        elif name == "title" and self.title is None and "</title" not in self.gone:
            m = _END_OF_TITLE.search(html, end)
            if m:
                self.title = html[end + 1 : m.start()]
            else:
                self.gone.add("</title")


def plain_text(html: str) -> str:
    """What a page says: comments, scripts and styles dropped, a line for each block, entities resolved."""
    return _text(Page(html))


def _text(page: Page) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", unescape("".join(page.text)))).strip()


def page_facts(url: str, html: str) -> dict[str, object]:
    return _facts(url, Page(html))


def _facts(url: str, page: Page) -> dict[str, object]:
    links: dict[str, None] = {}
    for link in page.links:
        target = unescape(link).strip()
        try:
            links[urljoin(url, target) if "://" not in target else target] = None
        except ValueError:
            links[target] = None
    return {"title": " ".join(unescape(page.title).split()) if page.title else "", "lang": page.lang.lower(), "links": [x for x in links if x]}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: ``doc, target_uri, date, headers, payload``. Nulls are empty."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.lit(NO_DATE).alias("date"), headers.alias("headers"), html.alias("payload"))


def derivatives(records: DataFrame) -> DataFrame:
    """Response, metadata and conversion record (``RECORD``) for each response (``doc, target_uri, date, headers, payload``).

    Null columns count as empty (a null date as ``NO_DATE``); a response without payload has an empty conversion. Repeated
    responses give the same records again. An empty table gives an empty result. Other columns aren't looked at.
    """

    def run(batch: pa.RecordBatch):
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for a, b in slices([len(p or "") for p in columns[4]], SLICE):
            out: dict = {c.split()[0]: [] for c in RECORD.split(", ")}
            for doc, url, date, headers, payload in zip(*(c[a:b] for c in columns)):
                for record in derived(doc, url or "", date or NO_DATE, headers or "", payload or ""):
                    for column, value in zip(out.values(), record):
                        column.append(value)
            yield out

    return arrow_map(records.select("doc", "target_uri", "date", "headers", "payload"), RECORD, run)


def derived(doc: str | None, url: str, date: str, headers: str, html: str) -> list[tuple]:
    payload = html.encode("utf-8", "surrogatepass")
    block = headers.encode("utf-8", "surrogatepass") + payload
    whole, body = digest(block), digest(payload)
    source = record_id("response", f"{doc} {url} {date}", whole)
    page = Page(html)
    facts, text = _facts(url, page), _text(page).encode("utf-8", "surrogatepass")
    lines = [f"title: {facts['title']}", f"language: {facts['lang']}", f"source-payload-digest: {body}"]
    lines += [f"source-header: {x}" for x in headers.splitlines() if x.strip()] + [f"outlink: {_one_line(x)}" for x in facts["links"]]  # type: ignore[attr-defined]
    fields = ("\r\n".join(lines) + "\r\n").encode("utf-8", "surrogatepass")
    out = [(doc, "response", source, None, url, date, "application/http; msgtype=response", len(block), whole, body, body, headers, block)]
    for kind, content_type, data in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        d = digest(data)
        out.append((doc, kind, record_id(kind, source, d), source, url, date, content_type, len(data), d, d, body, headers, data))
    return out


def _one_line(x: str) -> str:
    return " ".join(x.split())


def serialized(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    return _serialized(record) + b"\r\n\r\n"


def _serialized(record: dict) -> bytes:
    uri = _one_line(record["target_uri"])
    head = ["WARC/1.1", f"WARC-Type: {record['warc_type']}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Date: {record['date']}", f"WARC-Target-URI: {uri}"]
    if record["refers_to"]:
        head += [f"WARC-Refers-To: {record['refers_to']}", f"WARC-Refers-To-Target-URI: {uri}", f"WARC-Refers-To-Date: {record['date']}", f"WARC-Source-Payload-Digest: {record['source_payload_digest']}"]
    head += [f"WARC-Block-Digest: {record['block_digest']}", f"WARC-Payload-Digest: {record['payload_digest']}", f"Content-Type: {record['content_type']}", f"Content-Length: {record['content_length']}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + record["block"]


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records as WARC files, one a task, by Spark's text writer: what ends a line there is what ends a record. Blocks that aren't
    UTF-8 are an error."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"warc": [_serialized(r).decode("utf-8") for r in batch.to_pylist()]}

    arrow_map(records, "warc string", run).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)
