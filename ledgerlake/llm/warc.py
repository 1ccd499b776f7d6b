"""WARC derivatives: from response records, linked metadata records and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

VERSION = "WARC/1.1"
#: Where a table has no times of capture, records carry this one.
NO_DATE = "1970-01-01T00:00:00Z"
#: The response's named fields that its derivatives carry along.
SOURCE_FIELDS = ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address")
#: Elements that part lines.
_BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer blockquote pre td th dd dt hr".split())
#: Tags that a head may have besides comments, scripts and styles; it ends at its end tag, or where anything else comes.
_IN_HEAD = frozenset("meta link base basefont bgsound noscript template title".split())
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_END_OF = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "title")}
#: Where a noscript or template ends, or shows that it was never closed.
_CLOSING = {"noscript": re.compile(r"(?i)(?P<end></noscript\s*>)|<noscript\b|<body\b"), "template": re.compile(r"(?i)(?P<end></template\s*>)|<body\b")}
_HEAD_PARTS = re.compile(r"(?i)(?P<end></title\s*>)|</?(?:title|head|body)\b")
_TITLE = re.compile(r"(?i)<title\b")
_HREF = re.compile(r"(?i)\bhref\s*=\s*")
_BARE = re.compile(r"""[^\s>"']+""")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A urn:uuid that equal parts always get."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def field_value(text: str) -> str:
    """Named fields are one line: control characters in a value become percent escapes."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", text)


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record; raises if a record is not as its Content-Length says."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        out.append((fields, block))
    return out


def response_record(key: str, url: str, body: str, date: str) -> bytes:
    payload = body.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, body)), ("WARC-Target-URI", field_value(url)), ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(fields, block)


class _Scanner:
    """One walk over a page, from each tag to the next: its shown text, with a line end for each block, and its links.

    A tag goes from "<" to the next ">"; without one, the rest is text. Only comments, scripts and styles run to the end of
    a page that doesn't close them; an unclosed noscript or template hides nothing but its tag. No place is walked over
    twice, but for the search of an end that is not there, which is made once.
    """

    def __init__(self, source: str):
        self.source, self.text, self.links = source, [], []
        self.next_close: dict[str, tuple[int, re.Match | None]] = {}
        self.run()

    def closed(self, kind: str, at: int) -> int | None:
        """Where a noscript or template that opens before `at` ends; None where it is not closed."""
        searched, found = self.next_close.get(kind, (-1, None))
        if searched < 0 or (found is not None and found.start() < at):
            found = _CLOSING[kind].search(self.source, at)
            self.next_close[kind] = (at, found)
        return found.end() if found is not None and found["end"] else None

    def link(self, start: int, end: int) -> None:
        """The href of an a-tag in [start, end); a quoted value may hold a ">"."""
        m = _HREF.search(self.source, start, end)
        if m is None:
            return
        quote = self.source[m.end() : m.end() + 1]
        if quote in ('"', "'") and quote:
            stop = self.source.find(quote, m.end() + 1)
            if stop >= 0:
                self.links.append(self.source[m.end() + 1 : stop])
        elif bare := _BARE.match(self.source, m.end(), end):
            self.links.append(bare[0])

    def run(self) -> None:
        source, text = self.source, self.text
        at, in_head = 0, False
        while True:
            lt = source.find("<", at)
            before = source[at : lt if lt >= 0 else len(source)]
            if in_head and before and not before.isspace():
                in_head = False
            if not in_head:
                text.append(before)
            if lt < 0:
                return
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                text.append(" ")
                if end < 0:
                    return
                at = end + 3
                continue
            m = _NAME.match(source, lt)
            name, opens = (m[1].lower() if m else ""), not source.startswith("</", lt)
            if opens and name in ("script", "style"):
                end = _END_OF[name].search(source, m.end())
                text.append(" ")
                if end is None:
                    return
                at = end.end()
                continue
            gt = source.find(">", lt)
            if gt < 0:
                text.append(source[lt:])
                return
            at = gt + 1
            if opens and name in _CLOSING:
                at = self.closed(name, at) or at
                text.append(" ")
                continue
            if in_head and name in _IN_HEAD:
                if opens and name == "title":
                    stop = _HEAD_PARTS.search(source, at)
                    following = source.find("<", at)
                    at = stop.end() if stop and stop["end"] else following if following >= 0 else len(source)
                continue
            if name == "head":
                in_head = opens
                text.append(" ")
                continue
            in_head = False
            if opens and name == "a":
                self.link(lt, gt)
            if name in _BLOCK:
                text.append("\n")


def _cleaned(text: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def plain_text(source: str) -> str:
    """The text a reader sees: scripts, styles, head and comments go, blocks part lines, runs of blanks are one."""
    return _cleaned("".join(_Scanner(source).text))


def outlinks(source: str) -> list[str]:
    """Targets of links as they are written, first ones first, each once."""
    return _distinct(_Scanner(source).links)


def _distinct(links: list[str]) -> list[str]:
    return list(dict.fromkeys(field_value(html.unescape(x).strip()) for x in links))


def title_of(source: str) -> str:
    """What stands in the first title, in one line; without an end tag it is no title."""
    m = _TITLE.search(source)
    gt = source.find(">", m.end()) if m else -1
    end = _END_OF["title"].search(source, gt + 1) if gt >= 0 else None
    return field_value(_BLANKS.sub(" ", html.unescape(source[gt + 1 : end.start()])).strip()) if end else ""


def derive(response: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of a response record. Both refer to the response by its id and carry its
    source fields and payload digest; each has its own id, made from these, and block digest."""
    (fields, block), *_ = read_records(response)
    head, _, payload = block.partition(b"\r\n\r\n")
    source = payload.decode("utf-8", "replace")
    about = fields["WARC-Record-ID"]
    carried = [(k, fields[k]) for k in SOURCE_FIELDS if k in fields]
    page = _Scanner(source)
    status, *http = head.decode("latin-1").split("\r\n")
    noted = [("http-status", status.split(" ")[1] if " " in status else ""), *(("http-header", field_value(x)) for x in http), ("title", title_of(source)), *(("outlink", x) for x in _distinct(page.links))]
    notes = "".join(f"{k}: {v}\r\n" for k, v in noted).encode("utf-8", "surrogatepass")
    text = _cleaned("".join(page.text)).encode("utf-8", "surrogatepass")

    def record(kind: str, content: str, data: bytes) -> bytes:
        own = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, about)), ("WARC-Refers-To", about), *carried,
            ("WARC-Source-Payload-Digest", fields.get("WARC-Payload-Digest", digest(payload))), ("WARC-Block-Digest", digest(data)), ("Content-Type", content),
        ]
        return write_record(own, data)

    return record("metadata", "application/warc-fields", notes), record("conversion", "text/plain; charset=utf-8", text)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0

        def table(batch=batch):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.binary()) for c in columns[1:])], ["page_id", "response", "metadata", "conversion"])

        for key, url, body, date in zip(*batch.columns, strict=True):
            response = response_record("" if key.as_py() is None else str(key.as_py()), url.as_py() or "", body.as_py() or "", date.as_py() or NO_DATE)
            rows.append((key.as_py(), response, *derive(response)))
            size += 2 * len(response)
            if size > 16_000_000:
                yield table()
                rows, size = [], 0
        if rows:
            yield table()


def build_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """(page_id, response, metadata, conversion): for each page its response record and what is derived from it, as
    bytes of WARC records that a WARC file can be put together from.

    Null urls and pages count as empty, null ids are part of no record id and stay null; rows alike in id, url and
    page get equal records; empty tables give no rows; other columns are ignored. One pass, no shuffle.
    """
    date = F.col(date_col).cast("string") if date_col else F.lit(NO_DATE)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), date.alias("date"))
    return own.mapInArrow(_derive, f"page_id {own.schema['page_id'].dataType.simpleString()}, response binary, metadata binary, conversion binary")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "response_id", "metadata_id", "conversion_id", "refers_to", "target_uri", "payload_digest", "text_digest", "n_outlinks", "text_bytes", "text_sha256", "warc_bytes"]
    for batch in batches:
        out = []
        for key, *records in zip(*batch.columns, strict=True):
            data = b"".join(r.as_py() for r in records)
            (response, _), (metadata, notes), (conversion, text) = read_records(data)
            same = metadata["WARC-Refers-To"] == conversion["WARC-Refers-To"] == response["WARC-Record-ID"]
            out.append((
                key.as_py(), response["WARC-Record-ID"], metadata["WARC-Record-ID"], conversion["WARC-Record-ID"], conversion["WARC-Refers-To"] if same else None, conversion["WARC-Target-URI"],
                conversion["WARC-Source-Payload-Digest"], conversion["WARC-Block-Digest"], sum(x.startswith(b"outlink: ") for x in notes.split(b"\r\n")), len(text), hashlib.sha256(text).hexdigest(), len(data),
            ))
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [batch.schema.field(0).type, *[pa.string()] * 7, pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page, read back from its records: ids, the id referred to, source fields, digests and sizes."""
    built = build_derivatives(read_table(spark, sf_dir, "pages"))
    kind = built.schema["page_id"].dataType.simpleString()
    return built.mapInArrow(
        _summary,
        f"page_id {kind}, response_id string, metadata_id string, conversion_id string, refers_to string, target_uri string, payload_digest string, text_digest string, n_outlinks long, text_bytes long, text_sha256 string, warc_bytes long",
    )


QUERIES = {"op10_warc_derivatives": op10_warc_derivatives}
ORACLES = {}
