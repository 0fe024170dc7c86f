"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

``responses`` makes WARC/1.0 response records of fetched pages; ``parse`` reads record bytes back;
``derive`` turns every response into a metadata and a conversion record that keep the source's
target URI, date and record id (``WARC-Refers-To``) and carry their own digests. Each row is
handled alone, so there is no shuffle. Record ids follow from the content (UUID version 5): a
task that runs again after a lost executor writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches

#: Crawl date of tables that have none; a parameter everywhere.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plumbline:warc")


def digest(data: bytes) -> str:
    """``sha1:`` and the base-32 digest, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.0 record; Content-Length is added last."""
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """Header values stay on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises ValueError if it isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    return headers, rest[:size]


def response(key: str, url: str, body: bytes, date: str = DATE) -> bytes:
    """A response record with an HTTP head around ``body``."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(body)).encode() + b"\r\n\r\n" + body)
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, digest(http))),
        ("WARC-Date", date), ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http))], http)


_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A head ends with its end tag or, where that is left out, before the first thing that can't be in a head.
_HEAD = re.compile(r"<head\b[^>]*>(?:\s++|</?(?:title|meta|link|base|bgsound|object)\b[^>]*>)*+(?:</head\s*>)?", re.I)
_TITLE_TEXT = re.compile(r"<title\b[^>]*>.*?(?:</title\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|td|th|hr|main|aside|form|dl|dt|dd)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def plain_text(markup: str) -> str:
    """Visible text: one line per block element, white space collapsed, entities resolved."""
    body = _HEAD.sub(" ", _TITLE_TEXT.sub(" ", _DROP.sub(" ", markup)))
    text = _TAG.sub("", _BREAK.sub("\n", body))
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derive_record(data: bytes) -> dict[str, object]:
    """The metadata and conversion records of one response record, and their linking fields."""
    headers, block = parse(data)
    http, _, body = block.partition(b"\r\n\r\n")
    status, *received = http.decode("latin-1").split("\r\n")
    markup = body.decode("utf-8", "replace")
    source, url, date = headers["warc-record-id"], headers.get("warc-target-uri", ""), headers["warc-date"]
    text = plain_text(markup)
    title = _TITLE.search(markup)
    lang = _LANG.search(markup)
    links = [a or b or c for a, b, c in _LINK.findall(markup)]
    shown = _BLANKS.sub(" ", html.unescape(title[1])).replace("\n", " ").strip() if title else ""
    fields = [("title", shown), ("language", lang[1].lower() if lang else ""),
              ("source-payload-digest", headers.get("warc-payload-digest", digest(body))),
              ("source-block-digest", digest(block)), ("source-content-type", headers.get("content-type", "")),
              ("http-status", status), *(("http-header", x) for x in received),
              *(("source-header", f"{k}: {v}") for k, v in headers.items()),
              ("outlinks", str(len(links))), *(("outlink", html.unescape(x)) for x in links)]
    meta = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode()
    plain = text.encode("utf-8", "surrogatepass")
    out: dict[str, object] = {"response_id": source, "target_uri": url, "title": shown, "text": text,
                              "n_links": len(links), "source_digest": headers.get("warc-payload-digest", digest(body)),
                              "digest_ok": digest(block) == headers.get("warc-block-digest", digest(block))}
    made = (("metadata", meta, "application/warc-fields"), ("conversion", plain, "text/plain; charset=utf-8"))
    ids = {kind: record_id(kind, source, digest(content)) for kind, content, _ in made}
    for kind, content, mime in made:
        out[f"{kind}_id"], out[f"{kind}_digest"] = ids[kind], digest(content)
        out[f"{kind}_record"] = record([
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", ids["conversion" if kind == "metadata" else "metadata"]),
            ("Content-Type", mime), ("WARC-Block-Digest", digest(content))], content)
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = DATE) -> DataFrame:
    """(id, record binary): a response record for every row.

    Null URL or body counts as empty; a null id keeps its row. Repeated rows give equal records.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            made = [response("" if key is None else str(key), url or "", (body or "").encode("utf-8", "surrogatepass"), date)
                    for key, url, body in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "record"])

    return docs_columns(pages, id_col, url_col, html_col).mapInArrow(run, "id long, record binary")


def docs_columns(pages: DataFrame, id_col: str, *others: str) -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`") for c in others])


DERIVED = ("response_id string, target_uri string, title string, text string, n_links long, source_digest string, "
           "digest_ok boolean, metadata_id string, metadata_digest string, metadata_record binary, "
           "conversion_id string, conversion_digest string, conversion_record binary")
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def derive(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """The derivatives of every response record: (id, the columns of ``DERIVED``).

    The metadata record keeps the source's WARC headers, its HTTP status and headers and both of its
    digests; the two derivatives name each other. A null record gives a row of nulls beside its id.
    Bytes that are no whole WARC record raise an error rather than lose a page. An empty body gives
    an empty conversion record. Pages are handled whole, whatever their length; repeated rows give
    equal records; an empty table gives an empty result; other columns are ignored.
    """
    names = [x.split() for x in DERIVED.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 500):
            rows = [derive_record(x) if x is not None else {} for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in names)],
                names=["id", *(n for n, _ in names)])

    return docs_columns(records, id_col, record_col).mapInArrow(run, f"id long, {DERIVED}")
