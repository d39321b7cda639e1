"""WARC derivatives: linked metadata and plain-text conversion records for response records.

``responses`` gives captured pages the form of WARC response records: a record id, the HTTP header block and payload, and the
digests of payload and whole block. ``derive`` turns each response into two records. The *metadata* record holds the source's
headers and what the page says about itself: title, language, outgoing links in order. The *conversion* record holds the visible text.
Both name the response in ``WARC-Refers-To``, keep its target URI and date, carry their own block digest and the source's payload
digest, and point at each other. ``write_records`` stores records as WARC files.

Record ids are UUIDs made from the MD5 of what they name, so a repeated run, or a task that runs again, gives the same ids.
Everything is row by row; pages of any length pass one at a time, and no shuffle takes place.

Defined cases: a NULL page is an empty payload, a NULL URL leaves the target URI out, a page cut off inside a tag, comment or
script ends there; repeated rows are repeated records with equal ids; an empty table gives no records; other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.batches import as_text

#: The date of captures that come without one.
UNDATED = "1970-01-01T00:00:00Z"
HTML_TYPE = "text/html; charset=utf-8"
RECORD = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, block string"
)
_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_HIDDEN = [re.compile(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|$)", re.S | re.I) for t in ("script", "style", "noscript", "template")]
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|"
    r"main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*(?:>|$)", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*(?:>|$)")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|$)", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def visible_text(page: str) -> str:
    """The text that a reader sees: one line per block, blanks collapsed."""
    page = _COMMENT.sub("", page)
    for hidden in _HIDDEN:
        page = hidden.sub("", page)
    page = _TAG.sub("", _BREAK.sub("\n", page))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(page))).strip(" \n")


def source_fields(page: str) -> list[tuple[str, str]]:
    """What the page says about itself."""
    shown = page
    for hidden in (_COMMENT, *_HIDDEN):
        shown = hidden.sub("", shown)
    flat = lambda s: " ".join(html.unescape(s).split())
    out = []
    if m := _TITLE.search(shown):
        out.append(("title", flat(_TAG.sub("", m[1]))))
    if m := _LANGUAGE.search(shown):
        out.append(("language", m[1].lower()))
    return out + [("outlink", flat(next(x for x in m.groups() if x is not None))) for m in _LINK.finditer(shown)]


def _digest(block: str) -> str:
    return "sha256:" + hashlib.sha256(block.encode("utf-8", "replace")).hexdigest()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(0).join(parts).encode('utf-8', 'replace')).digest())}>"


def record_id(*parts: Column) -> Column:
    """The same id as a column."""
    h = F.md5(F.concat_ws("\u0000", *parts).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Response records of ``pages(page_id, url, html)``."""
    body = F.coalesce("html", F.lit(""))
    length = F.octet_length(body).cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {HTML_TYPE}\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    when = F.lit(UNDATED) if date is None else F.coalesce(date, F.lit(UNDATED))
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    out = pages.select("page_id", F.col("url").alias("target_uri"), when.alias("date"), head.alias("http_header"), body.alias("payload"))
    return out.withColumns(
        {
            "record_id": record_id(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.col("date"), F.col("payload")),
            "payload_digest": sha(F.col("payload")),
            "block_digest": sha(F.concat("http_header", "payload")),
        }
    )


def _derived(row) -> list[tuple]:
    text = visible_text(row.payload)
    conversion, metadata = _id("conversion", row.record_id), _id("metadata", row.record_id)
    headers = [line.split(": ", 1) for line in row.http_header.split("\r\n")[1:] if ": " in line]
    fields = [("source-" + k.lower(), v) for k, v in headers]
    fields += [("source-payload-digest", row.payload_digest), ("source-block-digest", row.block_digest), ("conversion", conversion)]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields + source_fields(row.payload))
    same = (row.target_uri, row.date)
    return [
        ("metadata", metadata, row.record_id, conversion, *same, "application/warc-fields", len(block.encode("utf-8", "replace")), _digest(block), row.payload_digest, block),
        ("conversion", conversion, row.record_id, metadata, *same, "text/plain; charset=utf-8", len(text.encode("utf-8", "replace")), _digest(text), row.payload_digest, text),
    ]


def _derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    for frame in frames:
        for i in range(0, len(frame), 500):
            part = frame.iloc[i : i + 500]
            rows = [(r.page_id, *d) for r in part.itertuples(index=False) for d in _derived(r)]
            yield pd.DataFrame(rows, columns=["page_id", *names])


def derive(found: DataFrame) -> DataFrame:
    """``page_id`` and the fields of ``RECORD``: a metadata and a conversion record for each response record."""
    columns = ["target_uri", "date", "http_header", "payload", "record_id", "payload_digest", "block_digest"]
    out = found.select(as_text("page_id"), *columns).mapInPandas(_derive, f"page_id string, {RECORD}")
    return out.withColumn("page_id", F.col("page_id").cast(found.schema["page_id"].dataType))


def record_text(out: DataFrame) -> Column:
    """A whole WARC record without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    fields = {
        "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to",
        "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type",
        "Content-Length": "content_length",
    }
    return F.concat(F.lit("WARC/1.1\r\n"), *[line(n, c) for n, c in fields.items()], F.lit("\r\n"), F.col("block"))


def write_records(out: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition."""
    text = out.select(record_text(out).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
