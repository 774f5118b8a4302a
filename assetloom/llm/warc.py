"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

Each response record gives two records that refer to it (``WARC-Refers-To``) and keep its target
and date: a ``metadata`` record (``application/warc-fields``) with the source's identifier, digests
and HTTP headers, the page's title, language and links; and a ``conversion`` record (``text/plain``)
with the page's visible text. Blocks carry their own length and digests. Record ids are derived
from the source's id, so that a second run gives the same records.

Responses come from WARC files (``read_warc``) or from a table of pages (``responses_of_pages``);
records are rows and can be written as WARC files (``write_warc``): every record ends with two line
ends, which serve as Spark's line separator. Nothing is shuffled.

Cases: a null page is a response with an empty body, and nulls in a table of responses count as empty; bodies that aren't UTF-8 are decoded by
their charset, bad bytes replaced; chunks and gzip or deflate compression are undone first; a response that isn't HTML or text, or whose
compression is unknown or broken, has metadata only; a null url gives an empty target; repeated rows give repeated records; an empty table gives none; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .markup import blocks

RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, block string"
RESPONSE = "record_id string, target_uri string, date string, headers string, body binary, payload_digest string, block_digest string"
#: Crawl date of pages that come without one.
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs
_title = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_lang = re.compile(r"<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_links = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_chunk = re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n")
_charset = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _column_digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def responses_of_pages(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages: the columns of ``RESPONSE``."""
    body = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    h = F.md5(F.concat_ws(" ", F.coalesce(pages[id_col].cast("string"), F.lit("-")), F.coalesce(pages[url_col], F.lit("-"))).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))
    full = F.concat(headers, F.lit("\r\n")).cast("binary")
    return pages.select(urn.alias("record_id"), F.coalesce(pages[url_col], F.lit("")).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), body.alias("body"), _column_digest(body).alias("payload_digest"), _column_digest(F.concat(full, body)).alias("block_digest"))


def _header(headers: str, name: str) -> str:
    m = re.search(rf"^{name}[ \t]*:[ \t]*(.*?)\r?$", headers, re.I | re.M)
    return m.group(1) if m else ""


def _decode(body: bytes, headers: str) -> str:
    """The text of a body by its charset; by UTF-8 if that isn't known, is none for texts or can't replace bad bytes."""
    m = _charset.search(_header(headers, "content-type")) or _charset.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(m.group(1) if m else "utf-8", "replace")
    except (LookupError, ValueError):  # UnicodeError is a ValueError
        return body.decode("utf-8", "replace")


def _plain_body(headers: str, body: bytes) -> bytes | None:
    """The body without chunks and compression; None if it can't be undone."""
    if "chunked" in _header(headers, "transfer-encoding").lower():
        out, at = [], 0
        while m := _chunk.match(body, at):
            size = int(m.group(1), 16)
            if not size:
                break
            out.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
        body = b"".join(out) if out or m else body  # some archives keep the header and undo the chunks
    for coding in reversed([x.strip() for x in _header(headers, "content-encoding").lower().split(",") if x.strip()]):
        if coding == "identity":
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (47, -15):  # by its own header, or bare
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
        else:
            return None
    return body


def plain_text(html: str) -> str:
    """The visible text of a page, a line for each block."""
    return "\n".join(b.text for b in blocks(html))


def derive(record_id: str | None, uri: str | None, date: str | None, headers: str | None, body: bytes | None, payload_digest: str | None, block_digest: str | None) -> list[tuple]:
    """The metadata record and, of HTML and text, the conversion record of a response. Nulls count as empty."""
    record_id, uri, date, headers, body, payload_digest, block_digest = record_id or "", uri or "", date or "", headers or "", body or b"", payload_digest or "", block_digest or ""
    kind = _header(headers, "content-type").lower()
    readable = "html" in kind or kind.startswith("text/") or not kind
    plain = _plain_body(headers, body) if readable else None
    page = None if plain is None else _decode(plain, headers)
    fields = [("source-record-id", record_id), ("source-payload-digest", payload_digest), ("source-block-digest", block_digest)]
    status, _, rest = headers.partition("\r\n")
    fields.append(("source-status", status))
    fields += [(f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in rest.split("\r\n")) if k.strip()]
    if page is not None:
        if m := _title.search(page):
            fields.append(("title", " ".join(unescape(m.group(1)).split())))
        if m := _lang.search(page):
            fields.append(("language", m.group(1).lower()))
        fields += [("outlink", "".join(unescape("".join(x)).split())) for x in _links.findall(page)]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))]
    if page is not None:
        text = plain_text(page) if "html" in kind or not kind else page
        made.append(("conversion", "text/plain; charset=utf-8", text))
    out = []
    for what, content, block in made:
        data = block.encode("utf-8", "replace")
        own = digest(data)
        out.append((f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{what} {record_id}')}>", what, record_id, uri, date, content, own, own, len(data), data.decode()))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Linked metadata and conversion records: the columns of ``RECORD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if n == "content_length" else pa.string() for n in names]
        for b in slices(batches):
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in derive(*r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return responses.select(*(x.split()[0] for x in RESPONSE.split(", "))).mapInArrow(run, RECORD)


def serialised(records: DataFrame) -> DataFrame:
    """``value``: each record as it stands in a WARC file, without the two line ends behind it."""
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in named]
    return records.select(F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one for each partition of the records."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class _Gzip(io.RawIOBase):
    """The content of gzip members one behind the other, read piece by piece."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.left = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.z.eof:
                self.left = self.z.unused_data
                self.z = zlib.decompressobj(31)
            data = self.left or self.raw.read(1 << 20)
            if not data:
                return 0
            made = self.z.decompress(data, len(into))
            self.left = self.z.unconsumed_tail
            if made:
                into[: len(made)] = made
                return len(made)


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file, compressed or not. One record at a time is decompressed."""
    raw = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    f = io.BufferedReader(_Gzip(raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline().strip(b"\r\n")) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        length = head.get("content-length", "")
        yield head, f.read(int(length) if length.isdecimal() else 0)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files; a task reads a file, of at most 2 GB as it is stored (Spark's bound for a binary file; by custom they have 1 GB), and unpacks record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESPONSE.split(", ")]
        kinds = [pa.binary() if n == "body" else pa.string() for n in names]
        for b in slices(batches, 1):
            for head, block in parse_warc(pa.BufferReader(b.column(0)[0].as_buffer())):
                if head.get("warc-type") == "response":
                    http, _, body = block.partition(b"\r\n\r\n")
                    row = [head.get("warc-record-id", ""), head.get("warc-target-uri", "").strip("<>"), head.get("warc-date", ""), http.decode("latin-1") + "\r\n", body, head.get("warc-payload-digest") or digest(body), head.get("warc-block-digest") or digest(block)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    return records
