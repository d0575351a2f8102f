"""Operator 7, WARC derivative builder.

``responses`` packs crawled pages as WARC/1.1 response records, ``derive``
turns every response into two linked records:

* metadata (application/warc-fields): title, status, the source's HTTP
  headers, its digests and its outlinks;
* conversion (text/plain): the page's visible text.

Both refer to the response (``WARC-Refers-To``) and keep its target URI, date
and any further source header in ``KEPT``; the conversion names the metadata
record as concurrent.  Every record has a block digest, and a payload digest
where it has a payload of its own.  ``serialized`` gives the bytes of a record
(they may be concatenated, or each compressed as a gzip member), ``parse``
reads them back.

All steps work row by row; nothing is shuffled.

Defined results
* null url: a record without target URI, its outlinks stay as written
* null html: an empty payload, an empty text; broken mark-up: an unclosed
  comment, script or style reaches to the end, an unclosed tag is text
* record ids derive from type, key, URI, date and payload, so equal rows get
  equal ids and a task run again gives the same ids
* very long pages: linear time; empty table: no rows; other columns are ignored
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table, slices

VERSION = "WARC/1.1"
#: Date of pages whose crawl date is unknown.
NO_DATE = "1970-01-01T00:00:00Z"
#: Source headers that derived records keep.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID")
#: Elements that end a line of text; elements whose content isn't text.
LINE_ENDS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
SLICE_BYTES = 4 << 20

HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("headers", HEADERS), T.StructField("block", T.BinaryType())])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    name = hashlib.sha1("\n".join(map(str, parts)).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def value_of(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def clean(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1F\x7F]+", " ", value).strip()


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{n}: {v}\r\n" for n, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of a WARC file, plain or gzipped (of any number of members)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)]
        n = int(value_of(headers, "Content-Length") or 0)
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


def response_record(page_id: int | None, url: str | None, page: str | None, date: str) -> tuple[list[tuple[str, str]], bytes]:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    uri, payload_digest = None if url is None else clean(url), digest(payload)
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", page_id, uri, date, payload_digest)),
        *([("WARC-Target-URI", uri)] if uri is not None else []),
        ("WARC-Date", date),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", payload_digest),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


_TAG = re.compile(r"""<(/?[a-zA-Z][^\s/>"']*+|[!?])[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_HREF = re.compile(r"""[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def read_html(page: str) -> tuple[str, str, list[str]]:
    """(title, visible text, link targets as written) in one pass over the page."""
    low, at, n = page.lower(), 0, len(page)
    if len(low) != n:  # a few characters change their length in lower case
        low = page.translate({c: c + 32 for c in range(65, 91)})
    out: list[str] = []
    links: list[str] = []
    title, quotes = "", True
    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        out.append(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, i) if quotes else None
        if m is None:
            nxt = page[i + 1 : i + 2]
            end = page.find(">", i)
            if not (nxt.isalpha() or nxt in "/!?" and nxt) or end < 0:
                out.append("<")
                at = i + 1
                continue
            quotes = False  # a quote stays open to the end: from here tags end at the next bracket
            tag, stop = re.split(r"[\s/>]", page[i + 1 : end].lstrip("/"), maxsplit=1)[0].lower(), end + 1
            closing = nxt == "/"
        else:
            tag, stop = m[1].lower(), m.end()
            closing = tag[:1] == "/"
            tag = tag.lstrip("/")
        at = stop
        if tag in LINE_ENDS:
            out.append("\n")
        if closing:
            continue
        if tag in HIDDEN or tag == "title":
            end = low.find(f"</{tag}", stop)
            end = n if end < 0 else end
            if tag == "title":
                title = title or clean(entities.unescape(page[stop:end]))
            at = end
        elif tag == "a" and (h := _HREF.search(page, i, stop)):
            links.append(entities.unescape(next(x for x in h.groups() if x is not None)).strip())
    out.append(page[at:])
    lines = [" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n")]
    return title, "\n".join(filter(None, lines)), links


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return (lines[0].split(" ", 2) + ["", ""])[1], [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in lines[1:])], payload


def derived_records(key: int | None, headers: list[tuple[str, str]], block: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response."""
    status, http, payload = http_parts(block)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", value_of(http, "Content-Type") or "")
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    title, text, links = read_html(page)
    source, uri = value_of(headers, "WARC-Record-ID") or "", value_of(headers, "WARC-Target-URI")
    about = [(n, v) for n, v in headers if n in KEPT]
    fields = [("title", title), ("status", status), *((f"http-header-{n.lower()}", v) for n, v in http)]
    fields += [(f"source-{n.lower()}", v) for n, v in headers if n in ("WARC-Block-Digest", "WARC-Payload-Digest", "Content-Length")]
    for link in links:
        try:
            fields.append(("outlink", clean(urljoin(uri or "", link))))
        except ValueError:
            fields.append(("outlink", clean(link)))
    meta, plain = "".join(f"{n}: {clean(v)}\r\n" for n, v in fields).encode("utf-8", "replace"), text.encode("utf-8", "replace")
    meta_digest, plain_digest = digest(meta), digest(plain)
    meta_id = record_id("metadata", key, source, meta_digest)

    def record(kind: str, own: str, content: str, data: bytes, data_digest: str, more: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], bytes]:
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *about, *more]
        return [*head, ("WARC-Block-Digest", data_digest), ("Content-Type", content), ("Content-Length", str(len(data)))], data

    yield record("metadata", meta_id, "application/warc-fields", meta, meta_digest, [])
    more = [("WARC-Concurrent-To", meta_id), ("WARC-Payload-Digest", plain_digest)]
    yield record("conversion", record_id("conversion", key, source, plain_digest), "text/plain; charset=UTF-8", plain, plain_digest, more)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _structs(headers: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"name": n, "value": v} for n, v in headers]


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """(page_id, headers, block): a response record of every page."""
    schema = arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", SLICE_BYTES):
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                headers, block = response_record(key, url, page, date)
                rows.append((key, _structs(headers), block))
            yield _batch(rows, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """(page_id, headers, block): the metadata and conversion records of all response records; others give none."""
    schema = arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "block", SLICE_BYTES):
            rows = []
            for key, structs, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                headers = [(h["name"], h["value"]) for h in structs or []]
                if value_of(headers, "WARC-Type") == "response":
                    rows += [(key, _structs(h), d) for h, d in derived_records(key, headers, block or b"")]
            if rows:
                yield _batch(rows, schema)

    return records.select("page_id", "headers", "block").mapInArrow(run, RECORD)


SUMMARY = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("record_type", "record_id", "refers_to", "target_uri", "block_digest", "block_sha256", "record_sha256")],
        T.StructField("content_length", T.LongType()),
        T.StructField("n_lines", T.LongType()),
    ]
)


def read_records(records: DataFrame) -> DataFrame:
    """Serialize every record, parse the bytes again, check the digest, and report what was read."""
    schema = arrow_schema(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "block", SLICE_BYTES):
            rows = []
            for key, structs, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = serialize([(h["name"], h["value"]) for h in structs], block)
                ((headers, data),) = parse(raw)
                get = lambda n: value_of(headers, n)
                if data != block or digest(data) != get("WARC-Block-Digest"):
                    raise ValueError(f"record {get('WARC-Record-ID')} doesn't come back whole")
                names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Block-Digest")
                rows.append((key, *map(get, names), hashlib.sha256(data).hexdigest(), hashlib.sha256(raw).hexdigest(), int(get("Content-Length")), data.count(b"\n")))
            if rows:
                yield _batch(rows, schema)

    return records.select("page_id", "headers", "block").mapInArrow(run, SUMMARY)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion record of every page, as read back from their bytes."""
    return read_records(derive(responses(read_table(spark, sf_dir, "pages"))))
