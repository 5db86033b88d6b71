"""WARC derivatives: metadata and plain-text conversion records linked to the responses that they come from.

Responses are parsed from their record bytes. Each gives a metadata record (source headers, HTTP headers, title, links,
digests) and, where its payload is text, a conversion record with the plain text. Both name the response in
WARC-Refers-To and carry its target, date and payload digest; the metadata record names the conversion as concurrent.

Files are read as streams of records by Spark's own reader, gzip members unpacked on the way, so that no task holds a file.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.html_extract import Page

CRLF = b"\r\n"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANK = re.compile(rb"\r?\n\r?\n")
_META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", re.I)
# The encodings of the web, by their names here; what names latin-1 or ASCII means windows-1252.
ENCODINGS = frozenset(
    "utf-8 utf-16 utf-16-le utf-16-be cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 cp866 cp874 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 "
    "iso8859-11 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman mac-cyrillic gb2312 gbk gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis cp932 euc_kr cp949".split()
)
LATIN = frozenset("ascii iso8859-1".split())
#: A block may be so long; a header that says more is damaged.
LONGEST = 1 << 30

SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, "
    "block_digest string, source_payload_digest string, source_block_digest string, source_headers map<string,string>, http_status int, truncated string, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    """A record id that depends on the parts alone, so reruns agree."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(10).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def _line(value: str | None) -> str:
    """A header value: line ends can't be part of it."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *[f"{k}: {_line(v)}".encode("utf-8", "surrogatepass") for k, v in headers], f"Content-Length: {len(block)}".encode()]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def response_record(page_id: int, url: str | None, html: str | None, date: str) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]) + CRLF * 2 + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", named_id("response", str(page_id), url or "", digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url or "")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return record_bytes(headers, block)


def parse_headers(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and headers; continuation lines join the one before."""
    lines = head.decode("utf-8", "replace").split("\n")
    out: list[tuple[str, str]] = []
    for line in (x.rstrip("\r") for x in lines[1:]):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return lines[0].rstrip("\r"), out


def split_head(data: bytes) -> tuple[bytes, bytes]:
    found = _BLANK.search(data)
    return (data[: found.start()], data[found.end() :]) if found else (data, b"")


def named_values(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Headers by name; the values of a repeated name are lines, since a value can't hold a line end."""
    out: dict[str, str] = {}
    for k, v in pairs:
        out[k] = f"{out[k]}\n{v}" if k in out else v
    return out


def listed(headers: dict[str, str]) -> dict[str, str | list[str]]:
    """Headers for a JSON record: a list of the values where a name repeats."""
    return {k: v.split("\n") if "\n" in v else v for k, v in headers.items()}


def said_length(low: dict[str, str]) -> int | None:
    """Content-Length, None where it is missing, no number or beyond LONGEST."""
    said = low.get("content-length", "")
    return int(said) if re.fullmatch("[0-9]{1,18}", said) and int(said) <= LONGEST else None


def inflated(data: bytes, window: int) -> bytes | None:
    """Compressed bytes, member after member, as far as they can be read; None where nothing can be."""
    out = []
    while data:
        stream = zlib.decompressobj(window)
        try:
            out.append(stream.decompress(data))
        except zlib.error:
            out.append(_salvaged(data, window))
            break
        data = stream.unused_data
    return b"".join(out) if any(out) or out and stream.eof else None


def _salvaged(data: bytes, window: int) -> bytes:
    """What comes before the damage."""
    stream, out = zlib.decompressobj(window), []
    try:
        for i in range(0, len(data), 256):
            out.append(stream.decompress(data[i : i + 256]))
    except zlib.error:
        pass
    return b"".join(out)


_RECORD = re.compile(rb"(?:^|(?<=[\r\n]))WARC/\d+\.\d+[ \t]*\r?\n")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; gzip members are unpacked. Bytes that are no record are passed over, up to the next line that begins one.

    Values of a repeated header are lines. A block without a valid length, or with one beyond the data, ends at the next such line or with the data.
    """
    if data[:2] == b"\x1f\x8b":
        data = inflated(data, 31) or b""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if data[at : at + 5] != b"WARC/":
            following = _RECORD.search(data, at)
            if not following:
                return
            at = following.start()
        found = _BLANK.search(data, at)
        if not found:
            return
        _, pairs = parse_headers(data[at : found.start()])
        headers = named_values(pairs)
        low = {k.lower(): v for k, v in pairs}
        rest = len(data) - found.end()
        size = said_length(low)
        if size is None or size > rest:
            following = _RECORD.search(data, found.end())
            size = following.start() - found.end() if following else rest
        yield headers, data[found.end() : found.end() + size]
        at = found.end() + size


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size) or int(size, 16) == 0:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + int(size, 16)])
        at = end + 1 + int(size, 16)
        at += 2 if body[at : at + 2] == CRLF else 1


def payload(http: dict[str, str], body: bytes) -> bytes | None:
    """The body without transfer and content codings, as far as it can be read; None under a coding that can't be undone here."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",")]):
        if coding in ("", "identity") or not body:
            continue
        if coding in ("gzip", "x-gzip"):
            plain = inflated(body, 31)
        elif coding == "deflate":  # with or without the wrapper
            plain = inflated(body, 15) or inflated(body, -15)
        else:
            return None
        if plain is None:
            return None
        body = plain
    return body


def decoded(http: dict[str, str], body: bytes) -> str:
    """Text of a body in the encoding that its header or itself names, UTF-8 where that is none of the web's."""
    said = _CHARSET.search(http.get("content-type", ""))
    meta = None if said else _META_CHARSET.search(body[:2048])
    name = said[1] if said else meta[1].decode("ascii", "replace") if meta else "utf-8"
    try:
        name = codecs.lookup(name).name
    except (LookupError, UnicodeError, ValueError):
        name = "utf-8"
    return body.decode("cp1252" if name in LATIN else name if name in ENCODINGS else "utf-8", "replace")


def derive(page_id: int | None, record: bytes | None) -> list[dict]:
    """The derivatives of a record: none unless it is a response."""
    source = next(read_records(record or b""), None)
    if source is None:
        return []
    headers, block = source
    low = {k.lower(): v.rsplit("\n", 1)[-1] for k, v in headers.items()}
    if low.get("warc-type", "").lower() != "response":
        return []
    head, body = split_head(block)
    status_line, pairs = parse_headers(head)
    http = {k.lower(): v for k, v in pairs}
    status = re.match(r"HTTP/\S+\s+(\d{3})", status_line)
    plain = payload(http, body)
    kind = http.get("content-type", "").split(";")[0].strip().lower()
    text = title = None
    links: list[dict[str, str]] = []
    if plain is None:
        pass
    elif kind in ("text/html", "application/xhtml+xml", ""):
        page = Page(decoded(http, plain))
        text, title = page.text(), page.title()
        links = [{"path": f"{tag.upper()}@/{attr}", "url": url} for tag, attr, url in page.links()]
    elif kind.startswith("text/"):
        text = decoded(http, plain)
    source_id = low.get("warc-record-id", "")
    ids = {t: named_id(t, source_id) for t in ("metadata", "conversion")}
    shared = {
        "page_id": page_id, "refers_to": source_id, "target_uri": low.get("warc-target-uri"), "warc_date": low.get("warc-date"), "source_payload_digest": low.get("warc-payload-digest") or digest(body),
        "source_block_digest": low.get("warc-block-digest") or digest(block), "source_headers": headers, "http_status": int(status[1]) if status else None, "truncated": low.get("warc-truncated"),
    }
    about = {
        "Envelope": {
            "WARC-Header-Metadata": listed(headers), "Block-Digest": shared["source_block_digest"], "Actual-Content-Length": str(len(block)),
            "Payload-Metadata": {"Actual-Content-Type": kind, "Payload-Digest": shared["source_payload_digest"], "HTTP-Response-Metadata": {"Response-Message": status_line, "Headers": listed(named_values(pairs)), "Entity-Length": str(len(body)), "HTML-Metadata": {"Head": {"Title": title}, "Links": links}}},
        }
    }
    out = [{"record_type": "metadata", "content_type": "application/json", "block": json.dumps(about, ensure_ascii=False, sort_keys=True), "concurrent_to": ids["conversion"] if text is not None else None}]
    if text is not None:
        out.append({"record_type": "conversion", "content_type": "text/plain; charset=utf-8", "block": text, "concurrent_to": None})
    for x in out:
        data = x["block"].encode("utf-8", "replace")
        x |= shared | {"record_id": ids[x["record_type"]], "block": data.decode(), "content_length": len(data), "block_digest": digest(data)}
    return out


def derivative_bytes(row: dict) -> bytes:
    """A derivative as a WARC record."""
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"] or ""), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"] or "")]
    headers += [("WARC-Concurrent-To", row["concurrent_to"])] if row["concurrent_to"] else []
    headers += [("WARC-Truncated", row["truncated"])] if row["truncated"] else []
    headers += [("WARC-Source-Payload-Digest", row["source_payload_digest"]), ("Content-Type", row["content_type"]), ("WARC-Block-Digest", row["block_digest"])]
    return record_bytes(headers, row["block"].encode())


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record binary): a response record for each page; null urls and bodies are empty."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = map(response_record, *(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), [date] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    return rows.mapInArrow(run, "page_id long, record binary")


BEGIN = "WARC/"
PARTED = "\r\n\r\n" + BEGIN


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record binary) of the records of WARC files, plain or of gzip members; page_id is null.

    Spark's reader unpacks a file and parts it where a line begins a record after a blank line. A record that says it is longer goes on over
    such places in its block; where its file ends before that, its block ends at the first. No more than a record is held.
    """
    parts = spark.read.option("lineSep", PARTED).text(path).select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _whole_records((row["file"], row["start"], row["part"]) for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
            made = [record_bytes([(k, x) for k, v in h.items() if k.lower() != "content-length" for x in v.split("\n")], b) for h, b in read_records(data)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(made), pa.int64()), pa.array(made, pa.binary())], names=["page_id", "record"])

    return parts.mapInArrow(run, "page_id long, record binary")


def _whole_records(parts: Iterator[tuple[str, int, bytes]]) -> Iterator[bytes]:
    """Record bytes from (file, start of its split, part) in the order read: parts are joined until a block is as long as its header says."""
    held: list[bytes] = []
    lacks, of = 0, None
    for file, start, part in parts:
        data = part if start == 0 and (file, start) != of else BEGIN.encode() + part
        if lacks > 0 and (file, start) == of:
            lacks -= len(part) + len(PARTED)
            held.append(data)
            continue
        yield from _joined(held, lacks)
        held, lacks, of = [data], _missing(data), (file, start)
    yield from _joined(held, lacks)


def _joined(held: list[bytes], lacks: int) -> list[bytes]:
    """The record of the parts, or the parts where their file ended before the record did."""
    return held if lacks > 0 or not held else [PARTED[: -len(BEGIN)].encode().join(held)]


def _missing(data: bytes) -> int:
    """How many bytes a block in the data lacks of the length that its record says."""
    at = 0
    while found := _RECORD.search(data, at):
        end = _BLANK.search(data, found.start())
        size = said_length({k.lower(): v for k, v in parse_headers(data[found.start() : end.start() if end else len(data)])[1]})
        if not end:  # a block that begins like a record
            return size + len(CRLF * 2) if size else 0
        at = end.end() + (size or 0)
        if at > len(data):
            return at - len(data)
    return 0


def build_derivatives(responses: DataFrame) -> DataFrame:
    """The metadata and conversion records of (page_id, record binary) rows, with the columns of SCHEMA.

    Null and empty records, other record types and bytes that are no record give nothing. A response that isn't text, or whose
    coding can't be undone, gives a metadata record alone. Null ids stay null. Repeated responses give repeated derivatives with equal
    ids. Records of any length are worked on whole. Other columns are left out. An empty table gives no rows.
    """
    names = [x.strip().split()[0] for x in re.sub(r"<[^>]*>", "", SCHEMA).split(",")]
    kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "http_status": pa.int32(), "source_headers": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, records = batch.column("page_id").to_pylist(), batch.column("record")
            for k in range(0, batch.num_rows, 500):
                made = [x for i, r in zip(ids[k : k + 500], records.slice(k, 500).to_pylist(), strict=True) for x in derive(i, r)]
                columns = [pa.array([list(x[n].items()) if n == "source_headers" else x[n] for x in made], kinds.get(n, pa.string())) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return responses.select("page_id", "record").mapInArrow(run, SCHEMA)
