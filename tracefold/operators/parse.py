"""Documents to records. Python from the standard library reads bytes in Arrow batches; PDF and image readers are injected."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean confidence of a reading below which a second reader is asked.
READING_LEAST = 75.0
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class ReaderUnavailable(RuntimeError):
    """No reader for scanned pages is at hand; the document is quarantined as ocr_unavailable."""


def looks_like_header(cells: list[str]) -> bool:
    """No filled cell has four digits in a row, none is longer than 40 characters."""
    return all(len(c) <= 40 and not re.search(r"\d{4,}", c) for c in cells if c)


def labelled(header: list[str], cells: list[str]) -> str:
    """Filled cells with their heads: ``Head: cell | Head: cell``."""
    return " | ".join(f"{header[i].strip()}: {c.strip()}" if i < len(header) and header[i].strip() else c.strip() for i, c in enumerate(cells) if c.strip())


def label_row(header: Column, cells: Column) -> Column:
    """B4 as a column expression over two arrays of strings."""
    pairs = F.filter(F.arrays_zip(header.alias("h"), cells.alias("c")), lambda p: F.trim(F.coalesce(p["c"], F.lit(""))) != "")
    return F.array_join(F.transform(pairs, lambda p: F.when(F.trim(F.coalesce(p["h"], F.lit(""))) != "", F.concat(F.trim(p["h"]), F.lit(": "), F.trim(p["c"]))).otherwise(F.trim(p["c"]))), " | ")


def rows_of(table: Iterator[list[str]], prefix: str = "row") -> list[tuple[str, str]]:
    """(record key, text) of the rows that are not blank; the index counts all rows."""
    header: list[str] | None = None
    out = []
    for i, cells in enumerate(table):
        cells = [c or "" for c in cells]
        if not any(c.strip() for c in cells):
            continue
        if header is None and looks_like_header(cells):
            header = cells
            out.append((f"{prefix}:{i}", " | ".join(c.strip() for c in cells if c.strip())))
        else:
            out.append((f"{prefix}:{i}", labelled(header or [], cells)))
    return out


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def html_text(content: bytes) -> str:
    """Visible text nodes joined by `` | ``."""
    p = _Visible()
    p.feed(content.decode("utf-8", errors="replace"))
    return " | ".join(p.out)


def mail_text(content: bytes) -> str:
    """Subject and sender as they stand in the headers, then the plain text parts that are no attachments."""
    m = email.message_from_bytes(content, policy=email.policy.compat32)
    out = [f"Subject: {m.get('Subject', '')}\nFrom: {m.get('From', '')}\n"]
    for p in m.walk():
        if p.get_content_type() == "text/plain" and "attachment" not in str(p.get("Content-Disposition", "")).lower():
            try:
                out.append((p.get_payload(decode=True) or b"").decode(p.get_content_charset() or "utf-8", errors="replace"))
            except LookupError:
                out.append((p.get_payload(decode=True) or b"").decode("utf-8", errors="replace"))
    return "".join(out)


def docx_text(content: bytes) -> str:
    """Paragraphs, then the rows of tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [text(p) for p in body.findall(f"{_W}p")]
    out += [" | ".join(text(c).strip() for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n".join(out)


def xlsx_rows(content: bytes) -> list[tuple[str, str]]:
    """Rows of all sheets, the header found anew in each; behind the first sheet keys name the sheet, so that they do not collide."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, name in enumerate(sheets):
        table = []
        for r in ElementTree.fromstring(z.read(name)).iter(f"{_X}row"):
            cells: list[str] = []
            for c in r.findall(f"{_X}c"):
                ref = re.match(r"[A-Z]+", c.get("r") or "")
                at = 0
                for ch in ref[0] if ref else "":
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{_X}v")
                text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{_X}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells.append(text)
            table.append(cells)
        out += rows_of(iter(table), "row" if k == 0 else f"sheet{k + 1}:row")
    return out


def flat_rows(content: bytes, kind: str) -> str:
    """A table as one text, cells joined by `` | ``."""
    if kind == "xlsx":
        return "\n".join(t for _, t in xlsx_rows(content))
    return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(content.decode("utf-8"), newline="")))


def read_pages(images: list[bytes], first: Callable[[list[bytes]], tuple[list[str], float]] | None, second: Callable[[list[bytes]], list[str]] | None = None) -> list[str]:
    """The first reader gives pages and a mean confidence; below READING_LEAST the second one is asked and kept if it has as many pages."""
    if first is None:
        raise ReaderUnavailable
    pages, mean = first(images)
    if mean >= READING_LEAST or second is None:
        return pages
    try:
        better = second(images)
    except Exception:
        return pages
    return better if len(better) == len(pages) else pages


def page_spans(pages: list[str]) -> list[dict[str, int]]:
    """Half-open spans of pages joined by one newline, counted from 1."""
    out, at = [], 0
    for i, p in enumerate(pages):
        out.append({"page": i + 1, "span_start": at, "span_end": at + len(p)})
        at += len(p) + 1
    return out


Readers = dict[str, Callable]


def records_of(kind: str, content: bytes, readers: Readers) -> list[tuple[str | None, str, list[dict[str, int]]]]:
    """(record key, text, page spans) of one document. ``readers``: pdf_pages(bytes) -> texts, page_images(bytes) -> images, read(images), read_again(images)."""
    if kind == "csv":
        return [(k, t, []) for k, t in rows_of(csv.reader(io.StringIO(content.decode("utf-8"), newline="")))]
    if kind == "xlsx":
        return [(k, t, []) for k, t in xlsx_rows(content)]
    if kind == "pdf_digital":
        if "pdf_pages" not in readers:
            raise ReaderUnavailable
        pages = readers["pdf_pages"](content)
    elif kind in ("pdf_scanned", "png"):
        images = [content] if kind == "png" else readers["page_images"](content) if "page_images" in readers else []
        pages = read_pages(images, readers.get("read"), readers.get("read_again"))
    else:
        one = {"txt": lambda c: c.decode("utf-8"), "html": html_text, "eml": mail_text, "docx": docx_text}.get(kind)
        if one is None:
            raise ValueError(f"no parser for {kind}")
        return [(None, one(content), [])]
    return [(None, "\n".join(pages), page_spans(pages))]


def parse(documents: DataFrame, readers: Readers | None = None) -> DataFrame:
    """doc_id, status, quarantine_reason, record_key, text, page_spans of pending documents, one row a record.

    What cannot be read becomes a row without text: quarantined as ocr_unavailable, or failed with the error's
    first 255 characters. A document without records keeps one row without text, status parsed.
    """
    readers = readers or {}
    schema = "doc_id bigint, status string, quarantine_reason string, record_key string, text string, page_spans array<struct<page:int,span_start:int,span_end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, kind, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                try:
                    got = records_of(kind, content or b"", readers)
                    rows += [(i, "parsed", None, *r) for r in got] or [(i, "parsed", None, None, None, [])]
                except ReaderUnavailable:
                    rows.append((i, "quarantined", "ocr_unavailable", None, None, []))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, "failed", f"parse_error: {type(e).__name__}: {e}"[:255], None, None, []))
            cols = list(zip(*rows)) if rows else [[]] * 6
            span = pa.list_(pa.struct([("page", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), span))], ["doc_id", "status", "quarantine_reason", "record_key", "text", "page_spans"])

    return documents.where("status = 'pending'").select(F.col("doc_id").cast("bigint"), "sniffed_type", "content").mapInArrow(run, schema)


def parsed_documents(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """``documents`` with status, quarantine_reason and parsed_text_chars after parsing."""
    per = parsed.groupBy("doc_id").agg(F.first("status").alias("_s"), F.first("quarantine_reason").alias("_q"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("int").alias("_c"))
    d = documents.join(per, "doc_id", "left")
    return d.withColumns({"status": F.coalesce("_s", "status"), "quarantine_reason": F.coalesce("_q", "quarantine_reason"), "parsed_text_chars": F.coalesce("_c", F.lit(0))}).drop("_s", "_q", "_c")
