import io
import zipfile
from email.message import EmailMessage

from tracefold.operators import ingest, parse
from tracefold.plans.pipeline import Pipeline
from tracefold.sources import corpus


def mail(attach=True):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@x.example", "b@x.example"
    m.set_content("Patient: Jane Okafor\nSSN 755-98-4598\n")
    if attach:
        m.add_attachment(b"Name: Max Ruler, dob 1980-01-02", maintype="text", subtype="plain", filename="../evil.txt")
        m.add_attachment(b"", maintype="text", subtype="plain", filename="empty.txt")
    return m.as_bytes()


def office(folder):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{folder}document.xml", "<x/>")
    return out.getvalue()


def test_types_by_content():
    sniff = ingest.sniff_bytes
    assert sniff(b"") == ("unknown", "zero_byte")
    assert sniff(None) == ("unknown", "zero_byte")
    assert sniff(b"\x89PNG....") == ("png", None)
    assert sniff(b"\xff\xfe\x00") == ("unknown", "corrupt_unreadable")
    assert sniff(b"  <!DOCTYPE HTML><p>") == ("html", None)
    assert sniff(mail()) == ("eml", None)
    assert sniff(b'a,"b,c"\n1,2\n') == ("csv", None)
    assert sniff(b"a,b\n1,2,3\n") == ("txt", None)
    assert sniff(office("word/")) == ("docx", None)
    assert sniff(office("ppt/")) == ("unknown", "unrecognized_office_format")
    assert sniff(b"PK\x03\x04broken") == ("unknown", "corrupt_unreadable")
    assert sniff("é".encode() * 6000 + b"\xff") == ("txt", None) and sniff(b"a" * 4000 + b"\xff" + b"a" * 4000)[1] == "corrupt_unreadable"
    assert sniff(b"a" * 16383 + "é".encode()) == ("txt", None)
    assert sniff(b"%PDF-1.4") == ("unknown", "parser_unavailable")
    assert sniff(b"%PDF-1.4", lambda c: ["x" * 100]) == ("pdf_digital", None)
    assert sniff(b"%PDF-1.4", lambda c: ["x"]) == ("pdf_scanned", None)

    def locked(c):
        raise PermissionError

    assert sniff(b"%PDF-1.4", locked) == ("unknown", "password_protected")


def test_rows_and_headers():
    table = [["Full Name", "SSN"], ["", ""], ["Ann Lee", "123-45-6789"], ["Bob"]]
    assert parse.rows_of(iter(table)) == [("row:0", "Full Name | SSN"), ("row:2", "Full Name: Ann Lee | SSN: 123-45-6789"), ("row:3", "Full Name: Bob")]
    assert parse.rows_of(iter([["12345", "x"]])) == [("row:0", "12345 | x")]


def test_texts_of_html_mail_and_pages():
    assert parse.html_text(b"<html><head><title>t</title></head><td>Full name</td><td> Dennis Rose </td>") == "Full name | Dennis Rose"
    t = parse.mail_text(mail())
    assert t.startswith("Subject: Hello\nFrom: a@x.example\n") and "Jane Okafor" in t and "Max Ruler" not in t
    assert parse.page_spans(["ab", "c"]) == [{"page": 1, "span_start": 0, "span_end": 2}, {"page": 2, "span_start": 3, "span_end": 4}]


def test_second_reader_is_asked_when_unsure():
    sure, unsure = (lambda i: (["a"], 80.0)), (lambda i: (["a"], 10.0))
    assert parse.read_pages([b""], sure, lambda i: ["b"]) == ["a"]
    assert parse.read_pages([b""], unsure, lambda i: ["b"]) == ["b"]
    assert parse.read_pages([b""], unsure, lambda i: ["b", "c"]) == ["a"]


def test_xlsx_round_trip(spark):
    df = spark.createDataFrame([("Ann & Co", 3), (None, 4)], "name string, n int")
    assert parse.xlsx_rows(corpus.xlsx({"one": df, "two": df})) == [("row:0", "name | n"), ("row:1", "name: Ann & Co | n: 3"), ("row:2", "n: 4"), ("sheet2:row:0", "name | n"), ("sheet2:row:1", "name: Ann & Co | n: 3"), ("sheet2:row:2", "n: 4")]


def test_folder_to_exposure(spark, tmp_path):
    letter = mail()
    files = {"a.eml": letter, "b.eml": letter, "c.csv": b"Full Name,SSN,Email\nAnn Lee,755-98-4599,ann@x.example\nBob Ray,755-98-4600,bob@x.example\n", "d.txt": b"Employee: Ann Lee\nSSN 755-98-4599", "e.txt": b"", "f.pdf": b"%PDF-1", "manifest.json": b"{}", "_recovered/x.txt": b"x"}
    for n, c in files.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(c)
    p = Pipeline(spark).run(str(tmp_path))
    docs = {r["relpath"]: r for r in p.documents.collect()}
    assert "manifest.json" not in docs and "_recovered/x.txt" not in docs
    assert docs["b.eml"]["quarantine_reason"] == f"duplicate_of_document_{docs['a.eml']['doc_id']}"
    assert docs["e.txt"]["quarantine_reason"] == "zero_byte" and docs["f.pdf"]["quarantine_reason"] == "parser_unavailable"
    att = docs["_extracted_attachments/a__.._evil.txt"]
    assert att["parent_document_id"] == docs["a.eml"]["doc_id"] and att["doc_id"] == docs["a.eml"]["doc_id"] + 1
    assert {r["record_key"] for r in p.extractions.where("raw_value = '755-98-4599'").collect()} == {"row:1", None}
    owner = {r["normalized_value"]: r["person_id"] for r in p.links.join(p.extractions.withColumnRenamed("id", "extraction_id"), "extraction_id").where("category in ('ssn', 'email')").collect()}
    assert owner["755-98-4599"] == owner["ann@x.example"] != owner["755-98-4600"]
    assert p.flags.where("category = 'ssn'").count() == 3
    again = Pipeline(spark).ingest(str(tmp_path), p.documents)
    assert again.files.count() == 0


def test_reader_errors_are_rows(spark):
    d = spark.createDataFrame([(1, "pending", "png", b"x"), (2, "pending", "txt", b"\xff"), (3, "pending", "unknown", b"x"), (4, "parsed", "txt", b"x"), (5, "pending", "csv", b"")], "doc_id long, status string, sniffed_type string, content binary")
    got = {r["doc_id"]: (r["status"], (r["quarantine_reason"] or "")[:30]) for r in parse.parse(d).collect()}
    assert got == {1: ("quarantined", "ocr_unavailable"), 2: ("failed", "parse_error: UnicodeDecodeErro"), 3: ("failed", "parse_error: ValueError: no pa"), 5: ("parsed", "")}
