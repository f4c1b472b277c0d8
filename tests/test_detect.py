import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.functions import spans, values
from tracefold.operators import detect
from tracefold.operators.profile import Profile, alternation


def found(spark, text, *names):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.asDict() for r in detect.detect(df, names=list(names) or None).collect()]


CASES = [
    ("ssn", "his number is 755-98-4598.", [("755-98-4598", False)]),
    ("ssn", "Order 755-98-4598 was sent", [("755-98-4598", True)]),
    ("ssn", "Order Ref (not PII): 709-69-4713", [("709-69-4713", True)]),
    ("ssn", "ID 000-00-0000", [("000-00-0000", True)]),
    ("ssn_partial", "on file XXX-XX-1234", [("1234", False)]),
    ("email", "a.b@x.example and support@x.example", [("a.b@x.example", False), ("support@x.example", True)]),
    ("phone", "card 4111111111111111", []),
    ("phone", "number 2125551234", []),
    ("phone", "call 2125551234", [("2125551234", False)]),
    ("phone", "(212) 555-1234 x12", [("(212) 555-1234 x12", False)]),
    ("card", "4539 1488 0343 6467; 4111-1111-1111-1111, 4539148803436468", [("4539 1488 0343 6467", False), ("4111-1111-1111-1111", True)]),
    ("card_masked", "**** 5332", [("5332", False)]),
    ("drivers_license", "license K12345678", [("K12345678", False)]),
    ("passport", "Passport no.\n123456789", [("123456789", False)]),
    ("name", "Patient: A. Perez DOB: 1990-01-01", [("A. Perez", False)]),
    ("name", "Best,\nA. Carter", [("A. Carter", False)]),
    ("name", "employee Morales, Christopher, date of birth", [("Morales, Christopher", False)]),
    ("name", "Name: John Doe", []),
    ("address", "Address: 123 Main St. Apt 4, Town", [("123 Main St. Apt 4, Town", False)]),
    ("address", "Address: 12 Oak Ave. The patient came", [("12 Oak Ave", False)]),
    ("account", "Account number: 123456789.", [("123456789", False)]),
    ("login", "Login username: jason.yates14", [("jason.yates14", False)]),
    ("ending_in", "paid to account ending in 2991", [("2991", False)]),
]


@pytest.mark.parametrize("name,text,want", CASES)
def test_rules(spark, name, text, want):
    assert [(h["raw_value"], h["suppressed"]) for h in found(spark, text, name)] == want


def test_ending_in_takes_the_word_before(spark):
    assert [h["category"] for h in found(spark, "card ending in 1234", "ending_in")] == ["card_number"]
    assert [h["category"] for h in found(spark, "account ending in 1234", "ending_in")] == ["financial_account"]


def test_birth_dates(spark):
    rows = [("2030-01-01", True), ("2015-06-01", False), ("2015-06-01", True), ("1890-01-01", True), ("1990-02-30", True), ("1990-02-28", False)]
    df = spark.createDataFrame(rows, "d string, c boolean")
    got = [r[0] for r in df.select(F.coalesce(values.plausible_birth(F.col("d"), F.col("c"), F.to_date(F.lit("2026-01-01"))), F.lit(False))).collect()]
    assert got == [False, False, True, False, False, True]


def test_phones_written_differently_are_equal(spark):
    df = spark.createDataFrame([("+1 212 555 1234",), ("001-212-555-1234",), ("(212)555-1234 x9",), ("212.555.1234",)], "p string")
    assert {r[0] for r in df.select(values.phone(F.col("p"))).collect()} == {"2125551234"}


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 é🙂\n @.", max_size=40), min_size=1, max_size=5))
def test_offsets_are_those_of_finditer(spark, texts):
    p = r"a(b|1)+"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for f in (spans.matches, spans.matches_between):
        got = {r["i"]: [(m["raw"], m["value"], m["start"], m["end"]) for m in r["m"]] for r in df.select("i", f(F.col("t"), p, 1).alias("m")).collect()}
        assert got == {i: [(m[0], m[1], m.start(), m.end()) for m in re.finditer(p, t)] for i, t in enumerate(texts)}


def test_marks_in_the_text_do_no_harm(spark):
    t = f"x{spans.OPEN}ab y{spans.CLOSE}ab"
    df = spark.createDataFrame([(t,)], "t string")
    assert [(m["start"], m["end"]) for m in df.select(spans.matches(F.col("t"), "ab").alias("m")).first()["m"]] == [(2, 4), (7, 9)]


def test_null_empty_and_long_texts_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 50_000 + "a@b.example", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, category string")
    assert [(r["doc_id"], r["category"]) for r in detect.detect(df, names=["email"]).collect()] == [(3, "email")]
    assert detect.detect(df.limit(0)).count() == 0


def test_profile_adds_to_the_defaults(tmp_path):
    f = tmp_path / "p.json"
    f.write_text('{"name_labels": ["worker", "patient"]}')
    p = Profile.load(str(f))
    assert p.name_labels[0] == "patient" and p.name_labels[-1] == "worker" and p.name_labels.count("patient") == 1
    assert alternation(["to", "bill to"]) == r"bill\ to|to"


def test_registered_detectors_run_last(spark):
    detect.register_detector(detect.Detector("badge", "badge", r"\bB-\d{3}\b", confidence=0.5))
    try:
        assert [h["category"] for h in found(spark, "mail a@b.example badge B-123")] == ["email", "badge"]
    finally:
        detect._registered.clear()


def test_labels(spark):
    df = spark.createDataFrame([(i, "Case  No: 12\nOwner = Kim\nplain text") for i in range(3)] + [(9, None)], "doc_id long, text string")
    assert [(r["label"], r["occurrences"], r["example"]) for r in detect.discover_labels(df).collect()] == [("case no", 3, "12"), ("owner", 3, "Kim")]


def test_pages(spark):
    df = spark.createDataFrame([(["ab", "", "cde"],)], "p array<string>").select(spans.page_map(F.col("p")).alias("s"))
    s = [tuple(x) for x in df.first()["s"]]
    assert s == [(1, 0, 2), (2, 3, 3), (3, 4, 7)]
    at = spark.createDataFrame([(o,) for o in (-1, 0, 2, 4, 9)], "o int").crossJoin(df)
    assert [r[0] for r in at.select(spans.page_of(F.col("s"), F.col("o"))).collect()] == [None, 1, 1, 3, 3]
    assert [r[0] for r in at.select(spans.page_of(F.col("s"), F.col("o"), preceding=False)).collect()] == [None, 1, 3, 3, 3]
