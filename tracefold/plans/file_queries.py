"""Queries of the readers of files (A5-A13, B1-B17). The files are made of the driver's tables, one a row, so that the readers themselves run over whole tables."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import ingest, parse
from tracefold.plans.catalogue import _CELLS, query
from tracefold.runtime import table
from tracefold.sources.corpus import upsert_recovered

HEAD = [h for h, _ in _CELLS]


def docx_file(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx_file(rows: list[list[str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def csv_file(rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def made(how, *cols: Column) -> Column:  # noqa: ANN001
    """Bytes of a file made by ``how`` of the columns."""

    @F.pandas_udf("binary")
    def run(*c: pd.Series) -> pd.Series:
        return pd.Series([how(*("" if v is None else v for v in x)) for x in zip(*c)], dtype=object)

    return run(*cols)


def pending(files: DataFrame, kind: str) -> DataFrame:
    return files.select(F.col("doc_id"), F.lit("pending").alias("status"), F.lit(kind).alias("sniffed_type"), "content")


def _texts(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text without characters that XML can't hold."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", _BAD, "").alias("text"))


_BAD = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"
_CLEAN = "regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]', '', 'g')"
_STRIPPED = r"regexp_replace({}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')".format


@query(rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS whole, left(coalesce(text, ''), 4096) AS text FROM documents),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_STRIPPED('x')} <> '')[1:5] AS lines FROM t),
n AS (SELECT doc_id, list_transform(list_transform(lines, lambda x: regexp_replace(x, '(^|,)"(?:[^"]|"")*"', '\1', 'g')), lambda y: length(y) - length(replace(y, ',', '')) + 1) AS fields FROM l)
SELECT t.doc_id, CASE WHEN whole = '' THEN 'unknown' WHEN regexp_matches(lower({_STRIPPED('text')}), '^(<!doctype html|<html)') THEN 'html'
  WHEN len(list_filter(string_split(text, chr(10))[1:6], lambda x: regexp_matches(lower(x), '^(from|to|subject|date|mime-version|content-type):'))) >= 2 THEN 'eml'
  WHEN len(fields) >= 2 AND list_min(fields) > 1 AND list_min(fields) = list_max(fields) THEN 'csv' ELSE 'txt' END AS sniffed_type, CASE WHEN whole = '' THEN 'zero_byte' END AS quarantine_reason
FROM t JOIN n USING (doc_id)
""")
def sniffed_files(s: SparkSession, d: str) -> DataFrame:
    """The bytes of every text."""
    files = table(s, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return ingest.sniff(files).select("doc_id", "sniffed_type", "quarantine_reason")


def _paragraphs(content: bytes) -> list[str]:
    text = content.removeprefix(b"%PDF").decode()
    if not text.strip():
        raise ValueError("no page")
    if text.startswith("Row"):
        raise PermissionError
    return text.split("\n\n")


@query(f"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN {_STRIPPED('text')} = '' OR text LIKE 'Row%' THEN 'unknown' WHEN list_sum(list_transform(p, lambda x: length(x))) / len(p) < 20 THEN 'pdf_scanned' ELSE 'pdf_digital' END AS sniffed_type,
  CASE WHEN {_STRIPPED('text')} = '' THEN 'corrupt_unreadable' WHEN text LIKE 'Row%' THEN 'password_protected' END AS quarantine_reason FROM t
""")
def sniffed_pdfs(s: SparkSession, d: str) -> DataFrame:
    """A7 with a reader that takes paragraphs for pages."""
    files = table(s, d, "documents").where("text is not null").select("doc_id", F.encode(F.concat(F.lit("%PDF"), "text"), "utf-8").alias("content"))
    return ingest.sniff(files, _paragraphs).select("doc_id", "sniffed_type", "quarantine_reason")


def _zip(text: str, n: int) -> bytes:
    if n % 4 == 3:
        return b"PK\x03\x04" + text.encode()
    if n % 4 == 2:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("ppt/slide.xml", text)
        return out.getvalue()
    return docx_file(text) if n % 4 == 0 else xlsx_file([[text]])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'unknown' END AS sniffed_type, CASE doc_id % 4 WHEN 2 THEN 'unrecognized_office_format' WHEN 3 THEN 'corrupt_unreadable' END AS quarantine_reason FROM documents WHERE text IS NOT NULL")
def sniffed_zips(s: SparkSession, d: str) -> DataFrame:
    """Two kinds of office files, one that is neither, and one that is broken."""
    return ingest.sniff(_texts(s, d).select("doc_id", made(_zip, F.col("text"), F.col("doc_id")).alias("content"))).select("doc_id", "sniffed_type", "quarantine_reason")


@query(f"SELECT doc_id, 'parsed' AS status, coalesce(array_to_string(list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: {_STRIPPED('x')}), lambda x: x <> ''), ' | '), '') AS text FROM documents WHERE text IS NOT NULL")
def html_texts(s: SparkSession, d: str) -> DataFrame:
    """A page with a paragraph a line."""
    page = lambda t: ("<html><head><title>none</title><style>p {}</style></head><body><script>none</script>" + "".join(f"<p>{escape(x)}</p>" for x in t.split("\n")) + "</body></html>").encode()
    return parse.parse(pending(_texts(s, d).select("doc_id", made(page, F.col("text")).alias("content")), "html")).select("doc_id", "status", "text")


@query(f"SELECT doc_id, 'parsed' AS status, {_CLEAN} AS text FROM documents WHERE text IS NOT NULL")
def docx_texts(s: SparkSession, d: str) -> DataFrame:
    """A document with a paragraph a line."""
    return parse.parse(pending(_texts(s, d).select("doc_id", made(docx_file, F.col("text")).alias("content")), "docx")).select("doc_id", "status", "text")


def _mails(s: SparkSession, d: str) -> DataFrame:
    part = lambda head: F.concat(F.lit(f"--cut\n{head}\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode("text", "utf-8")), F.lit("\n"))
    named = F.concat(F.lit("--cut\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=\"n"), "doc_id", F.lit(".txt\"\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode("text", "utf-8")), F.lit("\n--cut--\n"))
    head = F.concat(F.lit("Subject: Note "), "doc_id", F.lit("\nFrom: s"), "doc_id", F.lit('@x.example\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="cut"\n\n'))
    return table(s, d, "documents").where("text is not null").select("doc_id", "relpath", F.encode(F.concat(head, part("Content-Type: text/plain; charset=utf-8"), named), "utf-8").alias("content"))


@query("SELECT doc_id, 'Subject: Note ' || doc_id || chr(10) || 'From: s' || doc_id || '@x.example' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL")
def mail_texts(s: SparkSession, d: str) -> DataFrame:
    """Mails with the text as body and as attachment."""
    return parse.parse(pending(_mails(s, d), "eml")).select("doc_id", "text")


@query("SELECT relpath, CAST(0 AS INTEGER) AS attach_idx, regexp_replace(string_split(relpath, '/')[-1], '\\.[^.]*$', '') || '__n' || doc_id || '.txt' AS name, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def mail_attachments(s: SparkSession, d: str) -> DataFrame:
    """Attachments of the same mails; empty ones are skipped."""
    return ingest.attachments(_mails(s, d)).select("relpath", "attach_idx", "name", F.sha2("content", 256).alias("sha256"))


_LABELLED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN '{h}: ' || trim({c}) END" for h, c in _CELLS) + "], lambda x: x IS NOT NULL), ' | ')"
_ROWS = f"SELECT row_id, 'row:0' AS record_key, '{' | '.join(HEAD)}' AS text FROM roster_rows UNION ALL SELECT row_id, 'row:1', {_LABELLED} FROM roster_rows WHERE {_LABELLED} <> ''"


def _table_files(s: SparkSession, d: str, how) -> DataFrame:  # noqa: ANN001
    cells = [F.coalesce(c, F.lit("")) for _, c in _CELLS]
    return table(s, d, "roster_rows").select(F.col("row_id").alias("doc_id"), made(lambda *c: how([HEAD, list(c)]), *cells).alias("content"))


@query(_ROWS)
def csv_records(s: SparkSession, d: str) -> DataFrame:
    """A file of a head and a row for each row of the rosters."""
    return parse.parse(pending(_table_files(s, d, csv_file), "csv")).select(F.col("doc_id").alias("row_id"), "record_key", "text")


@query(_ROWS)
def xlsx_records(s: SparkSession, d: str) -> DataFrame:
    """The same as workbooks."""
    return parse.parse(pending(_table_files(s, d, xlsx_file), "xlsx")).select(F.col("doc_id").alias("row_id"), "record_key", "text")


@query("SELECT row_id, '" + " | ".join(HEAD) + "' || chr(10) || concat_ws(' | ', " + ", ".join(f"coalesce({c}, '')" for _, c in _CELLS) + ") AS text FROM roster_rows")
def flat_tables(s: SparkSession, d: str) -> DataFrame:
    """Tables as one text."""
    flat = F.pandas_udf(lambda c: c.map(lambda x: parse.flat_rows(x, "csv")), "string")
    return _table_files(s, d, csv_file).select(F.col("doc_id").alias("row_id"), flat("content").alias("text"))


def _first(images: list[bytes]) -> tuple[list[str], float]:
    text = images[0].decode()
    return text.split("\n\n"), 50.0 if len(text) % 2 else 90.0


def _second(images: list[bytes]) -> list[str]:
    text = images[0].decode()
    pages = ["+" + p for p in text.split("\n\n")]
    return pages[:-1] if len(text) % 4 == 1 else pages


@query("""
WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10) || chr(10)), lambda x: CASE WHEN length(text) % 4 = 3 THEN '+' || x ELSE x END) AS p FROM documents WHERE text <> '')
SELECT doc_id, array_to_string(p, chr(10)) AS text, array_to_string(list_transform(range(1, len(p) + 1), lambda i: i || ':' || CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) || '-' || CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) + length(p[i]) AS BIGINT)), ' ') AS pages FROM t
""")
def scanned_records(s: SparkSession, d: str) -> DataFrame:
    """An unsure first reading is read again, and the second one kept if it has as many pages."""
    files = table(s, d, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("content"))
    p = parse.parse(pending(files, "png"), {"read": _first, "read_again": _second})
    return p.select("doc_id", "text", F.array_join(F.transform("page_spans", lambda x: F.format_string("%d:%d-%d", x["page"], x["span_start"], x["span_end"])), " ").alias("pages"))


@query("""
SELECT doc_id, CASE WHEN sniffed_type IN ('pdf_digital', 'pdf_scanned', 'png') THEN 'quarantined' WHEN sniffed_type IN ('docx', 'xlsx', 'unknown') THEN 'failed' ELSE 'parsed' END AS status,
  CASE WHEN sniffed_type IN ('pdf_digital', 'pdf_scanned', 'png') THEN 'ocr_unavailable' WHEN sniffed_type IN ('docx', 'xlsx') THEN 'parse_error: BadZipFile: File is not a zip file' WHEN sniffed_type = 'unknown' THEN 'parse_error: ValueError: no parser for unknown' END AS quarantine_reason,
  CASE WHEN sniffed_type = 'txt' THEN text END AS text FROM documents WHERE sniffed_type NOT IN ('csv', 'eml', 'html') AND text IS NOT NULL
""")
def parse_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Plain bytes under every type that gives one record: read, without a reader, or failed."""
    docs = table(s, d, "documents").where("sniffed_type not in ('csv', 'eml', 'html') and text is not null").select("doc_id", F.lit("pending").alias("status"), "sniffed_type", F.encode("text", "utf-8").alias("content"))
    return parse.parse(docs).select("doc_id", "status", "quarantine_reason", "text")


@query("""
SELECT doc_id, relpath, CASE WHEN quarantine_reason IN ('password_protected', 'ocr_unavailable') THEN 'pending' ELSE status END AS status, CASE WHEN coalesce(quarantine_reason, '') NOT IN ('password_protected', 'ocr_unavailable') THEN quarantine_reason END AS quarantine_reason FROM documents
""")
def recovered_documents(s: SparkSession, d: str) -> DataFrame:
    """Recovered copies take the place of locked and unread files."""
    docs = table(s, d, "documents").select("doc_id", "relpath", "status", "quarantine_reason")
    again = docs.where("quarantine_reason in ('password_protected', 'ocr_unavailable')").select("doc_id", "relpath", F.lit("pending").alias("status"))
    return upsert_recovered(docs, again)
