"""Derivatives of web archive responses: metadata and plain-text conversion records linked to their source.

A response record (WARC/1.1 header, HTTP header, body) gives two records. Both name the response they come from in
WARC-Refers-To, with its target, date and payload digest; the metadata record lists all fields of the source's own WARC and
HTTP headers in their order, repeated ones included, the title, the links and the ids of its siblings as warc-fields, the conversion record is the page's text.
Blocks carry SHA-1 digests in base 32. Each record is a gzip member of its own, so members can be joined into files in
any order and read one by one. Records of a page stay together in one row; rows never depend on each other, so the
work needs no shuffle and a lost task repeats its own pages.

The body is read as its HTTP header says: chunks are joined, gzip and deflate opened, and the text decoded by the charset of
the header, else by the page's own meta tag, else as UTF-8. What can't be opened or decoded so is read as it stands.

Defined results: missing or empty html is a response with an empty body; a missing url leaves the target out; equal rows
give equal records with equal ids; html that is not closed is read as far as it goes; header values never break lines."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarte.llm.common import longs

DATE = "1970-01-01T00:00:00Z"  #: for pages whose capture time is not known
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  #: of names that are URLs
END = b"\r\n\r\n"
HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|head)\b[^>]*>.*?(?:</\1\s*>|\Z)")
NO_TEXT = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)")
LINE = re.compile(
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main"
    r"|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
)
CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([\w.:-]+)")
META = re.compile(rb"(?i)<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)")
TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\Z)")
LINK = re.compile(r"(?is)<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def line(value: str) -> str:
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as bytes; digest and length of the block are added."""
    full = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {line(v)}\r\n" for k, v in full) + "\r\n").encode() + block + END


def fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields of a header in order, after its first line; a line that begins with a space goes on with the one before."""
    found: list[tuple[str, str]] = []
    for row in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if row[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {row.strip()}")
            continue
        name, _, value = row.partition(":")
        if name.strip():
            found.append((name.strip(), value.strip()))
    return found


def first(found: list[tuple[str, str]], name: str) -> str | None:
    """The first field of a name, in any case of letters."""
    return next((v for k, v in found if k.lower() == name.lower()), None)


def opened(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """All header fields and the block of one record; the length given in the header must be there."""
    head, gap, rest = data.partition(END)
    found = fields(head)
    size = first(found, "Content-Length") or "-1"
    if not data.startswith(b"WARC/1.") or not gap or not size.isdigit() or int(size) > len(rest):
        raise ValueError("not a whole record")
    return found, rest[: int(size)]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, the first of each name, and block of one record."""
    found, block = opened(data)
    return dict(reversed(found)), block


def unchunked(body: bytes) -> bytes:
    """Chunks joined; what follows a broken chunk is left as it stands."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) + body[at:]
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def uncoded(body: bytes, coding: str) -> bytes:
    """A body without its content coding; as it is where that is unknown or broken."""
    for kind in reversed([c.strip().lower() for c in coding.split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
            try:
                z = zlib.decompressobj(bits)
                body = z.decompress(body) + z.flush()
                break
            except zlib.error:
                continue
    return body


def text_of(http: list[tuple[str, str]], body: bytes) -> str:
    """The page as text."""
    if "chunked" in (first(http, "Transfer-Encoding") or "").lower():
        body = unchunked(body)
    body = uncoded(body, first(http, "Content-Encoding") or "")
    said = CHARSET.search((first(http, "Content-Type") or "").encode()) or META.search(body[:4096])
    try:
        return body.decode(said[1].decode("ascii", "replace") if said else "utf-8", "replace")
    except (LookupError, ValueError):  # no charset of that name, or one that isn't for text
        return body.decode("utf-8", "replace")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Records of joined gzip members."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """The response record of a page."""
    body = (html or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    target = [("WARC-Target-URI", url)] if url is not None else []
    payload = digest(body)
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", payload)), *target,
         ("WARC-Date", date), ("WARC-Payload-Digest", payload), ("Content-Type", "application/http; msgtype=response")],
        http + body,
    )


def plain_text(html: str) -> str:
    """Visible text, a line for each block."""
    text = TAG.sub("", LINE.sub("\n", NO_TEXT.sub(" ", html)))
    return "\n".join(x for x in (" ".join(part.split()) for part in unescape(text).split("\n")) if x)


def derive(source: bytes) -> tuple[bytes, bytes]:
    """Metadata and conversion record of a response record."""
    every, block = opened(source)
    head = dict(reversed(every))
    http, _, body = block.partition(END)
    html = text_of(fields(http), body)
    own, payload = head["WARC-Record-ID"], digest(body)
    ids = record_id("metadata", own), record_id("conversion", own)
    target = [("WARC-Target-URI", head["WARC-Target-URI"])] if "WARC-Target-URI" in head else []
    refers = [("WARC-Refers-To", own), *((f"WARC-Refers-To-{k[5:]}", v) for k, v in target)]
    refers += [("WARC-Refers-To-Date", head["WARC-Date"]), ("WARC-Refers-To-Payload-Digest", head.get("WARC-Payload-Digest", payload))]
    text = plain_text(html)
    title = TITLE.search(html)
    base = head.get("WARC-Target-URI", "")
    links = [safe_join(base, unescape(m[1] or m[2] or m[3] or "")) for m in LINK.finditer(HIDDEN.sub(" ", html))]
    facts = [(f"source-{k}", v) for k, v in every]
    facts += [("source-HTTP-Status", http.split(b"\r\n")[0].decode("utf-8", "replace"))]
    facts += [(f"source-HTTP-{k}", v) for k, v in fields(http)]
    facts += [("payload-digest", payload), ("digest-matches", str(head.get("WARC-Payload-Digest") == payload).lower())]
    facts += [("title", unescape(TAG.sub("", title[1])) if title else ""), ("conversion-id", ids[1]), ("characters", str(len(text)))]
    facts += [("outlink", x) for x in links]
    described = "".join(f"{k}: {line(v)}\r\n" for k, v in facts).encode()
    common = [*target, ("WARC-Date", head["WARC-Date"]), *refers]
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids[0]), *common, ("WARC-Concurrent-To", ids[1]), ("Content-Type", "application/warc-fields")]
    conversion = [("WARC-Type", "conversion"), ("WARC-Record-ID", ids[1]), *common, ("WARC-Concurrent-To", ids[0]), ("Content-Type", "text/plain; charset=utf-8")]
    return record(metadata, described), record(conversion, text.encode())


def safe_join(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages: page_id, record."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([response(*r) for r in rows], pa.binary())], names=["page_id", "record"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(build, "page_id long, record binary")


def derivatives(sources: DataFrame) -> DataFrame:
    """Per response (page_id, record) the gzip members of its two derivatives."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b"".join(map(member, derive(r.as_py()))) for r in batch.column("record")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "members"])

    return sources.select("page_id", "record").mapInArrow(build, "page_id long, members binary")


READ = "page_id long, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, block_bytes long, intact boolean"


def read_back(stored: DataFrame) -> DataFrame:
    """Every stored derivative with its links and digests, and whether its block still has its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("members"), strict=True):
                for one in members(data.as_py()):
                    head, block = parse(one)
                    named = [head.get(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Refers-To-Payload-Digest", "WARC-Block-Digest")]
                    rows.append((page, *named, len(block), digest(block) == head["WARC-Block-Digest"]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays(
                [longs(cols[0]), *(pa.array(c, pa.string()) for c in cols[1:7]), longs(cols[7]), pa.array(cols[8], pa.bool_())],
                names=[x.split()[0] for x in READ.split(", ")],
            )

    return stored.mapInArrow(read, READ)
