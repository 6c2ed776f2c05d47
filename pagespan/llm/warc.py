"""WARC derivatives: metadata and plain-text conversion records of response records.

A response gives a ``metadata`` record (application/warc-fields: the response's HTTP status
and headers, its digests, title, language, and links) and a ``conversion`` record (text/plain).
Both name the response in WARC-Refers-To, repeat its target and date, and carry digests of their own
blocks; the conversion also keeps its source's payload digest. Record ids follow from the
response's id, so a task that is run again writes the same records.

Defined results: a response without HTTP headers is all payload; a null or empty one gives
records with empty blocks or without such fields; undecodable bytes become U+FFFD; a record without id gets one from
its target and digest; repeated rows give repeated records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "source_id string, record_id string, refers_to string, warc_type string, target_uri string, warc_date string, content_type string, "
    "source_digest string, block_digest string, content_length long, record binary"
)
SOFTWARE = "pagespan derivatives"
# Patterns for the beginnings of things only; their ends are searched for once, so that no page takes more than linear time.
_OPENING = re.compile(r"<(?:!--|(script|style|noscript|template)\b)", re.I)
_CLOSING = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html|main|aside|blockquote|pre|hr|dt|dd|form)\b", re.I)
_TAG = re.compile(r"<[a-z/!?]", re.I)
_TITLE = re.compile(r"<title\b", re.I)
_HTML, _ANCHOR = re.compile(r"<html\b", re.I), re.compile(r"<a\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
_BLANKS = re.compile(r"[ \t\x0b\x0c\xa0]+")


def digest(block: bytes) -> str:
    """As WARC files write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def without_code(page: str) -> str:
    """``page`` with a blank for each comment and each script, style, noscript and template element; what is not closed stays."""
    out, at, done, open_ended = [], 0, 0, set()
    while m := _OPENING.search(page, at):
        name = (m[1] or "").lower()
        at = m.end()
        if name in open_ended:
            continue
        if name:
            head = page.find(">", at)
            end = _CLOSING[name].search(page, head + 1) if head >= 0 else None
            to = end.end() if end else -1
        else:
            to = page.find("-->", at)
            to = to + 3 if to >= 0 else -1
        if to < 0:
            open_ended.add(name)  # nor does a later one have an end
            continue
        out += [page[done : m.start()], " "]
        at = done = to
    return "".join([*out, page[done:]])


def replaced(page: str, beginning: re.Pattern, by: str) -> str:
    """``page`` with ``by`` for each tag that begins so, up to its ``>``; a tag without one stays."""
    out, at, done = [], 0, 0
    while m := beginning.search(page, at):
        to = page.find(">", m.end())
        if to < 0:
            break
        out += [page[done : m.start()], by]
        at = done = to + 1
    return "".join([*out, page[done:]])


def title_of(page: str) -> str:
    """What stands in the first title element, as written."""
    m = _TITLE.search(page)
    head = page.find(">", m.end()) if m else -1
    end = _CLOSING["title"].search(page, head + 1) if head >= 0 else None
    return page[head + 1 : end.start()] if end else ""


def language_of(page: str) -> str:
    """The lang attribute of the first html tag that has one."""
    at = 0
    while m := _HTML.search(page, at):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        if lang := _LANG.search(page, m.end(), at):
            return lang[1]
    return ""


def links(page: str) -> Iterator[str]:
    """The first href of each a tag, as written."""
    at, tag_end, href = 0, -1, None
    while m := _ANCHOR.search(page, at):
        at = m.end()
        if tag_end < at:
            tag_end = page.find(">", at)
            tag_end = len(page) if tag_end < 0 else tag_end
        if href is None or href.start() < at:
            href = _HREF.search(page, at)
        if href is None:
            return
        if href.start() < tag_end:
            yield next(x for x in href.groups() if x is not None)
            at = href.end()


def plain_text(page: str) -> str:
    """The text of an HTML page: one line a block element, no markup, entities resolved."""
    body = replaced(replaced(without_code(page), _BREAK, "\n"), _TAG, "")
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def one_line(value: str) -> str:
    return " ".join(value.split())


def valid(text: str) -> str:
    """``text`` without lone surrogates, which UTF-8 cannot hold."""
    return text.encode("utf-8", "replace").decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; line ends within values become blanks."""
    head = "".join(f"{k}: {v}\r\n" for k, v in ((k, one_line(v or "")) for k, v in fields) if v)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def unpacked(data: bytes, bits: int) -> bytes:
    """Decompressed members (31: gzip, 15: zlib, -15: raw); of a cut or broken stream, what could be read."""
    out = []
    while data:
        stream = zlib.decompressobj(bits)
        try:
            out.append(stream.decompress(data))
        except zlib.error:
            break
        if not stream.eof:
            break
        data = stream.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; gzip members are read too.

    A cut record has the part that is there; one whose length cannot be read has an empty block, and the search for the next goes on.
    """
    if data[:2] == b"\x1f\x8b":
        data = unpacked(data, 31)
    stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        yield fields, stream.read(int(length)) if length.isascii() and length.isdigit() and len(length) < 19 else b""


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)], payload


def body_of(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The payload without transfer chunks and content encodings; None where an encoding is not known."""
    of = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        parts, at = [], 0
        while m := re.compile(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;[^\r\n]*)?\r\n").match(payload, at):
            size = int(m[1], 16)
            parts.append(payload[m.end() : m.end() + size])
            at = m.end() + size
            if not size:
                break
        payload = b"".join(parts) if at else payload  # else it was not chunked after all
    for coding in reversed([c.strip() for c in of.get("content-encoding", "").split(",") if c.strip()]):
        if coding in ("gzip", "x-gzip"):
            payload = unpacked(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
        elif coding == "deflate":
            payload = unpacked(payload, 15) or unpacked(payload, -15)
        elif coding != "identity":
            return None
    return payload


def decoded(body: bytes, charset: str) -> str:
    """Text of a body; charsets that are unknown or are not for texts are read as UTF-8."""
    try:
        return valid(body.decode(charset, "replace"))
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


#: Headers of the source that the derived records carry as their own.
CARRIED = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "content-length"}


def derive(fields: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response.

    All other headers of the source stand in the metadata as source-<name>; a body in an encoding that
    is not known gives an empty text.
    """
    status, headers, payload = split_http(block)
    payload_digest = fields.get("warc-payload-digest") or digest(payload)
    target, date = one_line(fields.get("warc-target-uri", "")), fields.get("warc-date", "")
    source = fields.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, target + payload_digest)}>"
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html; charset=utf-8")
    body = body_of(payload, headers)
    page = decoded(body or b"", (_CHARSET.search(kind) or [None, "utf-8"])[1])
    about = [("source-block-digest", digest(block)), ("source-payload-digest", payload_digest), ("http-status", status)]
    about += [(f"source-{k}", v) for k, v in sorted(fields.items()) if k and k not in CARRIED]
    about += [(f"http-header-{k.lower()}", v) for k, v in headers if k]
    about += [("title", html.unescape(title_of(page))), ("language", language_of(page)), ("body", "" if body is not None else "unknown content-encoding")]
    about += [("outlink", f"{one_line(html.unescape(x))} L a/@href") for x in links(without_code(page))]
    lines = "".join(f"{one_line(k)}: {v}\r\n" for k, v in ((k, one_line(v)) for k, v in about) if v)
    blocks = {"metadata": ("application/warc-fields", lines.encode("utf-8", "replace")), "conversion": ("text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace"))}
    out = []
    for name, (content_type, own) in blocks.items():
        made = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {source}')}>"
        written = [("WARC-Type", name), ("WARC-Record-ID", made), ("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", content_type)]
        written += [("WARC-Block-Digest", digest(own)), ("X-Source-Payload-Digest", payload_digest)]
        out.append({"record_id": made, "refers_to": source, "warc_type": name, "target_uri": target, "warc_date": date, "content_type": content_type, "source_digest": payload_digest, "block_digest": digest(own), "content_length": len(own), "record": record(written, own)})
    return out


def derivatives(responses: DataFrame, source_id: str = "source_id", data: str = "data") -> DataFrame:
    """Two rows (SCHEMA) for each response record in ``data`` (bytes of WARC records; others are skipped)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"content_length": pa.int64(), "record": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for key, data_ in zip(part.column("k").to_pylist(), part.column("v").to_pylist(), strict=True):
                    for fields, block in parse(data_ or b""):
                        if fields.get("warc-type") == "response":
                            rows += [{"source_id": key, **r} for r in derive(fields, block)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return responses.select(F.col(source_id).cast("string").alias("k"), F.col(data).alias("v")).mapInArrow(run, SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file) and data of WARC files, plain or gzip; a file is one task's, and must be under 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), F.col("content").alias("data"))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` (page_id, url, html) as response records with HTTP headers and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for key, url, page in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True):
                    payload = (page or "").encode("utf-8", "replace")
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>"
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Target-URI", url or ""), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
                    out.append(record(fields, block))
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.string()), pa.array(out, pa.binary())], ["source_id", "data"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "source_id string, data binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, with the digest of each whole record."""
    out = derivatives(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    columns = ["warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest", "content_length"]
    return out.select(F.col("source_id").cast("long").alias("page_id"), *columns, F.sha2("record", 256).alias("record_sha256"))
