from __future__ import annotations

import base64
import hashlib
import random
import time

import pytest

from portolan.llm import warc as W

HTML = """<!DOCTYPE html><html lang="EN-gb"><head><title>A &amp; B\n C</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- hidden <p>no</p> --><p>One<br>two &eacute;</p><a href="/x?a=1&amp;b=2">x</a><a href='http://o.example/'>y</a><a href=z>z</a><div>three</div></body></html>"""


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_facts():
    assert W.plain_text(HTML).split("\n") == ["A & B", "C", "One", "two é", "xyz", "three"]
    facts = W.page_facts("https://h.example/d/", HTML)
    assert facts == {"title": "A & B C", "lang": "en-gb", "links": ["https://h.example/x?a=1&b=2", "http://o.example/", "https://h.example/d/z"]}
    assert W.plain_text("") == "" and W.plain_text("<script>unclosed") == "" and W.plain_text("a < b") == "a < b"
    assert W.page_facts("http://[bad", "<a href='q'>")["links"]


def test_records_refer_to_the_response_and_keep_headers_and_digests(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", HTML, "x"), (2, None, None, "y"), (1, "https://h.example/", HTML, "x")], "page_id long, url string, html string, block string")
    rows = [r.asDict() for r in W.derivatives(W.responses(pages)).collect()]
    assert len(rows) == 9
    one = {r["warc_type"]: r for r in rows if r["doc"] == "1"}
    response, metadata, conversion = one["response"], one["metadata"], one["conversion"]
    assert metadata["refers_to"] == conversion["refers_to"] == response["record_id"] and response["refers_to"] is None
    payload = HTML.encode()
    assert response["payload_digest"] == metadata["source_payload_digest"] == conversion["source_payload_digest"] == sha1(payload)
    assert all(r["payload_digest"] == sha1(bytes(r["block"])) for r in (metadata, conversion)) and b"source-header: HTTP/1.1 200 OK" in bytes(metadata["block"])
    assert bytes(response["block"]).endswith(payload)
    assert metadata["source_headers"] == conversion["source_headers"] == response["source_headers"] and f"Content-Length: {len(payload)}" in response["source_headers"]
    for r in rows:
        assert r["block_digest"] == sha1(bytes(r["block"])) and r["content_length"] == len(r["block"])
    assert len({r["record_id"] for r in rows}) == 6
    text = W.serialized(conversion)
    head, _, body = text.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: conversion") and f"WARC-Refers-To: {response['record_id']}".encode() in head and body == bytes(conversion["block"]) + b"\r\n\r\n"
    assert {r["content_length"] for r in rows if r["doc"] == "2" and r["warc_type"] == "conversion"} == {0}


def test_written_records_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>t</p>")], "page_id long, url string, html string")
    W.write_warc(W.derivatives(W.responses(pages)), str(tmp_path / "w"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    kinds, at = [], 0
    while at < len(data):  # as a reader of WARC files does it
        head, rest = data[at:].split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Block-Digest"] == sha1(rest[:size]) and rest[size : size + 4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + size + 4
    assert sorted(kinds) == ["conversion", "metadata", "response"]
    assert W.derivatives(W.responses(pages.limit(0))).collect() == []


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<html ", "<!--", "<!", "<p", "<script>", "</script", "<a href=\"", "<a href='x", "&#", "< ", "<html lang ", "\n <br> "])
def test_hostile_pages_take_linear_time(piece):
    began = time.time()
    W.derived("1", "https://h.example/", W.NO_DATE, "", piece * (1_000_000 // len(piece)))
    assert time.time() - began < 5


def test_text_is_that_of_a_plain_reading():
    """Pages of random pieces against a reading by one regular expression over well-formed markup."""
    import re
    from html import unescape

    rng = random.Random(2)
    pieces = ["<p>", "</p>", "<b x='1'>", "</b>", "word", " two  words ", "<!-- no -->", "<script>no</script >", "<STYLE>p{}</STYLE>", "<br/>", "&amp;", "1 < 2", "<td>", "\n\n", "<!doctype html>"]
    for _ in range(300):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        t = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1\s*>|<![^>]*>", " ", html, flags=re.I | re.S)
        t = re.sub(r"</?(?:p|br|td)\b[^>]*>", "\n", t, flags=re.I)
        t = unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", t))
        assert W.plain_text(html).split() == t.split()


def test_odd_pages(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", "", "d", "h", "t"), (None, None, None, None, None, None), (2, "u", long, "d", "h", "t"), (2, "u", long, "d", "h", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, doc string, headers string, payload string")
    got = W.derivatives(W.responses(pages)).collect()
    assert len(got) == 12 and {len(r.block) for r in got if r.warc_type == "conversion"} == {0, 999_999}
