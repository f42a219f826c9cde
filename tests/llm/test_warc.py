"""Web archive derivatives: links, digests and the way back."""

import base64
import gzip
import hashlib
import zlib

import pytest

from quarte.llm import warc
from quarte.llm.common import stage

SCHEMA = "page_id long, url string, html string, record string, kind string"
PAGE = "<html><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><p>One <b>two</b><p>Three&nbsp;four<a href='/x'>x</a><!-- <p>c</p> --></body></html>"


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_of_a_response():
    source = warc.response(7, "http://h.org/a/b", PAGE)
    head, block = warc.parse(source)
    meta, text = (warc.parse(r) for r in warc.derive(source))
    assert head["WARC-Payload-Digest"] == sha(PAGE.encode()) and block.endswith(PAGE.encode())
    assert text[1].decode() == "One two\nThree fourx"
    for h, b in (meta, text):
        assert h["WARC-Refers-To"] == head["WARC-Record-ID"] and h["WARC-Refers-To-Target-URI"] == "http://h.org/a/b"
        assert h["WARC-Refers-To-Payload-Digest"] == head["WARC-Payload-Digest"] and h["WARC-Block-Digest"] == sha(b)
    assert meta[0]["WARC-Concurrent-To"] == text[0]["WARC-Record-ID"] != meta[0]["WARC-Record-ID"] == text[0]["WARC-Concurrent-To"]
    lines = meta[1].decode().split("\r\n")
    for x in ("title: A & B", "outlink: http://h.org/x", "digest-matches: true", "source-HTTP-Content-Type: text/html; charset=utf-8",
              f"source-WARC-Record-ID: {head['WARC-Record-ID']}", "source-HTTP-Status: HTTP/1.1 200 OK"):
        assert x in lines


def test_changed_payload_is_told():
    source = warc.response(1, None, "abc").replace(b"abc", b"abd")
    assert b"digest-matches: false" in warc.derive(source)[0]


def test_members_can_be_joined_and_read_by_gzip():
    records = warc.derive(warc.response(1, "http://x.org/", PAGE))
    data = b"".join(map(warc.member, records))
    assert gzip.decompress(data) == b"".join(records) and list(warc.members(data)) == list(records)


@pytest.mark.parametrize("bad", [b"", b"HTTP/1.1 200", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])
def test_broken_records_fail(bad):
    with pytest.raises(ValueError):
        warc.parse(bad)


def served(body, *http, warc_fields=()):
    """A response record with its own headers, as another program would write it."""
    block = "\r\n".join(["HTTP/1.1 200 OK", *http]).encode() + b"\r\n\r\n" + body
    head = ["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *warc_fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_all_source_headers_are_kept_in_order():
    own = ("WARC-IP-Address: 1.2.3.4", "WARC-Concurrent-To: <urn:uuid:2>", "WARC-Concurrent-To: <urn:uuid:3>", "X-Own: a", "  folded")
    http = ("Set-Cookie: a=1", "Content-Type: text/html", "Set-Cookie: b=2")
    lines = warc.parse(warc.derive(served(b"x", *http, warc_fields=own))[0])[1].decode().split("\r\n")
    got = [x for x in lines if x.startswith("source-")]
    assert got[3:7] == ["source-WARC-IP-Address: 1.2.3.4", "source-WARC-Concurrent-To: <urn:uuid:2>", "source-WARC-Concurrent-To: <urn:uuid:3>", "source-X-Own: a folded"]
    assert got[-3:] == ["source-HTTP-Set-Cookie: a=1", "source-HTTP-Content-Type: text/html", "source-HTTP-Set-Cookie: b=2"]


BODY = "<p>Größe und Ähre</p>"


@pytest.mark.parametrize("body, http", [
    (BODY.encode("latin-1"), ("content-type: text/html; charset=ISO-8859-1",)),
    (b"<meta charset='windows-1252'>" + BODY.encode("cp1252"), ()),
    (BODY.encode(), ("Content-Type: text/html; charset=no-such-one",)),
    (gzip.compress(BODY.encode()), ("Content-Encoding: gzip",)),
    (zlib.compress(BODY.encode("utf-16")), ("Content-Encoding: deflate", "Content-Type: text/html; charset=utf-16")),
    (zlib.compress(BODY.encode())[2:-4], ("Content-Encoding: deflate",)),
    (b"5\r\n" + BODY.encode()[:5] + b"\r\n" + b"%x;x=y\r\n" % (len(BODY.encode()) - 5) + BODY.encode()[5:] + b"\r\n0\r\n\r\n", ("Transfer-Encoding: chunked",)),
])
def test_bodies_are_read_by_their_headers(body, http):
    assert warc.parse(warc.derive(served(body, *http))[1])[1].decode() == "Größe und Ähre"


@pytest.mark.parametrize("http", [("Content-Encoding: gzip",), ("Content-Encoding: br",), ("Transfer-Encoding: chunked",), ("Content-Type: x; charset=base64",)])
def test_broken_bodies_are_read_as_they_stand(http):
    assert warc.parse(warc.derive(served(BODY.encode(), *http))[1])[1].decode() == "Größe und Ähre"


def plain(html):
    """Text of simple pages, by a parser of another kind."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title", "noscript", "template")
            if tag in BLOCKS:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title", "noscript", "template")
            if tag in BLOCKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    r = Reader()
    r.feed(html)
    return "\n".join(x for x in (" ".join(p.split()) for p in "".join(r.out).split("\n")) if x)


BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())


def test_texts_of_the_tables(spark):
    """The given pages' conversion records hold what a parser of another kind shows of them."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        text = warc.parse(warc.derive(warc.response(r.page_id, r.url, r.html))[1])[1].decode()
        assert text == plain(r.html)


def test_pages(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, None, "x"), (3, "http://a.org/\r\nInjected: y", ""), (4, "http://[bad", "<a href='http://[x'>l</a>"),
            (5, "u", None), (None, "u", "<p>z"), (1, "http://a.org/1", PAGE), (6, "u", "<p>" + "long " * 50000)]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    got = warc.read_back(stage(warc.derivatives(warc.responses(df)))).collect()
    assert len(got) == 2 * len(rows) and all(r.intact for r in got)
    for page, url, html in rows:
        own = [r for r in got if r.page_id == page]
        assert {r.kind for r in own} == {"metadata", "conversion"} and len({r.refers_to for r in own}) == 1
        assert {r.source_digest for r in own} == {sha((html or "").encode())}
        text = next(r for r in own if r.kind == "conversion")
        assert text.block_digest == sha(warc.plain_text(html or "").encode())
    assert next(r for r in got if r.page_id == 3).target_uri == "http://a.org/ Injected: y"
    assert warc.read_back(stage(warc.derivatives(warc.responses(spark.createDataFrame([], SCHEMA))))).count() == 0
