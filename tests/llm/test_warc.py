import gzip
import hashlib
import os
import re
from html.parser import HTMLParser

import pytest

from assetloom.llm.warc import RESPONSE, derivatives, parse_warc, read_warc, responses_of_pages, write_warc

HTML = '<html lang="EN"><head><title>A &amp; b</title></head><body><nav><a href="/x?a=1&amp;b">menu</a></nav><p>Grüße <b>all</b></p><script>no()</script></body></html>'


def test_records_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.example/1", HTML, "x"), (2, None, None, "y"), (3, "https://a.example/3", "", "z"), (1, "https://a.example/1", HTML, "x")], "page_id long, url string, html string, block string")
    responses = responses_of_pages(pages)
    rows = derivatives(responses).collect()
    assert len(rows) == 8 and {r.warc_type for r in rows} == {"metadata", "conversion"}
    ids = {r.record_id: r for r in responses.collect()}
    for r in rows:
        source = ids[r.refers_to]
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}>", r.record_id)
        assert r.content_length == len(r.block.encode()) and r.date == source.date and r.target_uri == source.target_uri
        if r.warc_type == "metadata":
            assert f"source-payload-digest: sha256:{hashlib.sha256(bytes(source.body)).hexdigest()}\r\n" in r.block
            assert "source-header-content-type: text/html; charset=utf-8\r\n" in r.block
    meta = next(r for r in rows if r.warc_type == "metadata" and r.target_uri.endswith("/1"))
    assert "title: A & b\r\n" in meta.block and "language: en\r\n" in meta.block and "outlink: /x?a=1&b\r\n" in meta.block
    assert {r.block for r in rows if r.warc_type == "conversion"} == {"menu\nGrüße all", ""}
    write_warc(derivatives(responses), str(tmp_path / "out"))
    back = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in parse_warc(f.read_bytes())]
    assert sorted((h["warc-record-id"], h["warc-refers-to"], h["warc-block-digest"], b.decode()) for h, b in back) == sorted((r.record_id, r.refers_to, r.block_digest, r.block) for r in rows)
    assert derivatives(responses_of_pages(pages.where("false"))).count() == 0


def test_reading_warc_files(spark, tmp_path):
    body = "<p>Ã©".encode("latin-1") + "<title>x</title>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-Odd: 1\r\n\r\n" + body
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\r\nWARC/1.0\r\n"
    records = [(b"warcinfo", b"x: y\r\n", b""), (b"response", http, b"sha1:ABC"), (b"response", image, b"")]
    out = b""
    for i, (kind, block, payload) in enumerate(records):
        head = b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI: http://e/%d\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" % (i, i)
        head += (b"WARC-Payload-Digest: " + payload + b"\r\n" if payload else b"") + b"Content-Length: %d\r\n\r\n" % len(block)
        out += gzip.compress(head + block + b"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(out)
    rows = derivatives(read_warc(spark, str(tmp_path))).collect()
    assert sorted((r.refers_to, r.warc_type) for r in rows) == [("<urn:uuid:1>", "conversion"), ("<urn:uuid:1>", "metadata"), ("<urn:uuid:2>", "metadata")]
    meta = next(r for r in rows if r.refers_to == "<urn:uuid:1>" and r.warc_type == "metadata").block
    assert "source-payload-digest: sha1:ABC\r\n" in meta and "source-header-x-odd: 1\r\n" in meta and "title: x\r\n" in meta
    assert next(r for r in rows if r.warc_type == "conversion").block == "Ã©"


def test_hostile_charsets_nulls_and_encodings(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={}\r\n{}"
    odd = [("r%d" % i, "u", "d", head.format(c, ""), b"<p>caf\xc3\xa9 ok", "p", "b") for i, c in enumerate(["hex", "base64", "rot13", "idna", "undefined", "nonsense", "zip", "utf-8"])]
    squeezed = gzip.compress("<p>grün".encode())
    chunked = b"3\r\n" + squeezed[:3] + b"\r\n%x;x=y\r\n" % len(squeezed[3:]) + squeezed[3:] + b"\r\n0\r\n\r\n"
    more = [("z1", "u", "d", head.format("utf-8", "Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n"), chunked, "p", "b"), ("z2", "u", "d", head.format("utf-8", "Content-Encoding: br\r\n"), b"\x01\x02", "p", "b"), ("z3", "u", "d", head.format("utf-8", "Content-Encoding: gzip\r\n"), b"<p>no gzip", "p", "b"), (None,) * 7]
    got = derivatives(spark.createDataFrame(odd + more, RESPONSE)).collect()
    text = {r.refers_to: r.block for r in got if r.warc_type == "conversion"}
    assert {x[0] for x in odd} <= set(text) and all("ok" in text[x[0]] for x in odd)
    assert text["r5"] == "café ok" and text["z1"] == "grün" and text[""] == "" and not {"z2", "z3"} & set(text)
    assert len([r for r in got if r.warc_type == "metadata"]) == len(odd) + len(more)


class Plain(HTMLParser):
    """Words, title and links of a page, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.title, self.links, self.hidden, self.in_title = [], [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.words.append(" ")
        self.in_title |= tag == "title"
        self.hidden += tag in ("script", "style", "head", "noscript", "template")
        if tag == "a":
            self.links += [v or "" for k, v in attrs if k == "href"]

    def handle_endtag(self, tag):
        self.words.append(" ")
        self.in_title &= tag != "title"
        self.hidden -= tag in ("script", "style", "head", "noscript", "template")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.words.append(data)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no test data")
def test_all_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.url: r.html for r in pages.collect()}
    for r in derivatives(responses_of_pages(pages)).collect():
        p = Plain()
        p.feed(html[r.target_uri])
        if r.warc_type == "conversion":
            assert re.sub(r"\s", "", r.block) == re.sub(r"\s", "", "".join(p.words))
        else:
            assert re.findall(r"^outlink: (.*?)\r?$", r.block, re.M) == ["".join(x.split()) for x in p.links]
            assert re.findall(r"^title: (.*?)\r?$", r.block, re.M) == [" ".join("".join(p.title).split())] * bool(p.title)
