"""Small cases of the operators for training data: brute force, round trips, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tracefold.llm import names, p1_names, p2_groups, p3_scans, p4_places, p5_copies, p6_matching, p7_pii, p8_tokens, p9_mixing, p10_repetition

EX = "id long, document_id long, record_key string, category string, raw_value string, normalized_value string, passage string, is_partial boolean, suppressed_as_false_positive boolean"


def ex(spark, rows):
    return spark.createDataFrame([(i, d, k, c, v, v, v, False, False) for i, d, k, c, v in rows], EX)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- 1

PERSONS = "id long, best_known_full_name string, dob string, extra string"


def test_p1_variants(spark):
    groups = [
        ["björn lascuby", "lascuby, björn", "bjorn lascuby", "b. lascuby", "björn i. lascuby", "dr. björn lascuby", "bjjörn lascuby", "björn lasscuby"],
        ["william gurbilund", "bill gurbilund", "gurbilund, w."],
        ["crultecor consulting s.a.", "crultecor cons. s a", "crultecor consulting"],
        ["mei drescamont jr.", "drescamont mei jr."], ["drescamont, mei sr."],
        ["amina bastiburn-jendomann", "bastiburn - jendomann, amina"],
    ]
    filler = [f"{g} {f}" for g in ("björn", "william", "mei", "amina", "clara", "hugo") for f in ("horbulisle", "kantavor", "wistenard", "poldemar", "grithaling", "zestakis")]
    every = [n for g in groups for n in g] + filler
    e = ex(spark, [(i, 1, None, "full_name", n.upper() if i % 2 else f" {n} ".replace(" ", "  ")) for i, n in enumerate(every)] + [(900, 1, None, "full_name", None), (901, 1, None, "full_name", ""), (902, 1, None, "email", "x@y.example"), (903, 1, None, "full_name", every[0])])
    persons = spark.createDataFrame([(1, "Unknown", None, "x"), (2, "BJÖRN LASCUBY", None, "x"), (3, None, None, "x")], PERSONS)
    got = set(pairs(p1_names.variants(e, persons)))
    fam = [g for g in groups]
    want = {tuple(sorted(p)) for g in fam for p in itertools.combinations(g, 2)}
    assert want <= got and got == want, (sorted(want - got), sorted(got - want))
    assert p1_names.variants(e.limit(0), persons.limit(0)).count() == 0


def test_p1_initials_of_several_people_follow_the_links(spark):
    filler = [f"{g} {f}" for g in ("marta", "mario", "clara", "hugo", "petra") for f in ("horbulisle", "kantavor", "wistenard", "poldemar", "grithaling")]
    e = ex(spark, [(i, i, None, "full_name", n) for i, n in enumerate([*filler, "marta drunkolock", "mario drunkolock", "m. drunkolock"])])
    links = spark.createDataFrame([(25, 7), (27, 7)], "extraction_id long, person_id long")
    persons = spark.createDataFrame([(7, "Marta Drunkolock", None, "x"), (8, "Mario Drunkolock", None, "x")], PERSONS)
    assert ("m. drunkolock", "marta drunkolock") in pairs(p1_names.variants(e, persons, links))
    assert ("m. drunkolock", "mario drunkolock") not in pairs(p1_names.variants(e, persons, links))


def test_p1_short_family_names_and_both_parts_misspelt(spark):
    filler = [f"{g} {f}" for g in ("marta", "omar", "john") for f in ("horbulisle", "kantavor", "wistenard", "poldemar", "grithaling", "khan", "lee", "smith")]
    e = ex(spark, [(i, i, None, "full_name", n) for i, n in enumerate([*filler, "omar kahn", "john lew", "jhon smtih", "jhon smith"])])
    got = pairs(p1_names.variants(e, spark.createDataFrame([], PERSONS)))
    assert ("omar kahn", "omar khan") in got and ("jhon smith", "john smith") in got and ("jhon smtih", "john smith") in got
    assert not any("marta khan" in p and "omar" in "".join(p) for p in got)
    members = p1_names.entities(p1_names.materialize(p1_names.spellings(e, spark.createDataFrame([], PERSONS))))
    assert members.where("name in ('jhon smtih', 'john smith', 'jhon smith')").select("entity").distinct().count() == 1


def test_names_near_a_word():
    r = random.Random(2)
    some = ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(80)]
    index = names.Index(some)
    assert all(index.near(w) == sorted({x for x in some if names.near(w, x)}) for w in some)


def test_names_taken_apart():
    given = {"marta": 9, "hugo": 9, "johannes": 9, "manuel": 9}
    assert names.taken_apart("Drunkolock, Marta H.", given) == ("person", "drunkolock", "marta", "h", "")
    assert names.taken_apart("Johannes, Klilvenes L.", given)[:4] == ("person", "klilvenes", "l", "johannes")
    assert names.taken_apart("Prof. Hugo van Kantavor Jr", given) == ("person", "kantavor", "hugo", "", "jr")
    assert names.taken_apart("The Fankagen Bros. and Partners Corp", given) == ("org", "fankagen", "brothers partners", "", "corp")
    assert names.taken_apart("x", given)[2] == "x"


# ---------------------------------------------------------------- 2


def groups_of(edges):
    p = {}

    def root(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        p[b] = a
    return {x: root(x) for x in p}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_p2_components(spark, seed):
    r = random.Random(seed)
    chain = [(1000 + i, 1001 + i) for i in range(130)]
    ring = [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    star = [(3000, 3001 + i) for i in range(40)] + [(3001 + i, 4001 + i) for i in range(40)]
    lolly = ring + [(2003, 5000), (5000, 5001), (5001, 5002)]
    mesh = [(6000 + r.randrange(25), 6000 + r.randrange(25)) for _ in range(60)]
    edges = chain + lolly + star + mesh + [(7, 7), (8, 9), (8, 9), (9, 8)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    got = {x["x"]: x["root"] for x in p2_groups.components(df).collect()}
    want = groups_of(edges)
    assert got.keys() == want.keys()
    by = collections.defaultdict(set)
    for x in got:
        by[got[x]].add(want[x])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))
    assert p2_groups.components(df.limit(0)).count() == 0


def test_p2_records(spark):
    e = ex(spark, [(1, 10, "row:1", "x", "a"), (2, 10, "row:1", "x", "b"), (3, 10, None, "x", "c"), (4, 11, None, "x", "d"), (5, 12, None, "x", "e"), (6, None, None, "x", "f")])
    links = spark.createDataFrame([(1, 5, "k"), (2, 4, "k"), (3, 5, "k"), (4, 9, "k"), (4, 9, "k"), (99, 1, "k"), (5, None, "k"), (6, 4, "k")], "extraction_id long, person_id long, document_id string")
    assert pairs(p2_groups.record_groups(links, e)) == [(10, "", 4), (10, "row:1", 4), (11, "", 9)]
    assert p2_groups.record_groups(links.limit(0), e).count() == 0


# ---------------------------------------------------------------- 3


def test_p3_damage(spark):
    words = "the courier delivered several boxes and the register was complete because nobody had opened the cabinet since the audit of confidential papers".split()
    clean = [(i, " ".join(words * 3) + " read-only entries were escalated.", "txt") for i in range(5)]
    page1 = ["Records Office - CASE-1", "  The courier delivered several boxes and thc register was", "complete because nobody had opened the read-", "only cabinet. The papers were esca-", "lated since the audit.", "1"]
    page2 = ["Records Office - CASE-1", "Nobody had opened the cabinet since the audit of papers and", "the courier delivered several boxes.", "", "Boxes counted:", "14", "were complete. The register was complete since the audit.", "2"]
    a, b = "\n".join(page1), "\n".join(page2)
    text = a + "\n" + b
    docs = spark.createDataFrame([*clean, (50, None, "pdf_scanned"), (51, None, "png"), (52, None, "txt")], "doc_id long, text string, sniffed_type string")
    spans = [(1, 0, len(a)), (2, len(a) + 1, len(text))]
    rec = spark.createDataFrame([(1, 50, text, spans), (2, 51, "", []), (3, 51, None, None), (4, 52, text, spans), (5, 51, "x " * 60_000, None)], "record_id long, document_id long, text string, page_spans array<struct<page:int,span_start:int,span_end:int>>")
    got = pairs(p3_scans.damaged(rec, docs))
    assert [g for g in got if g[0] == 1] == [(1, 1, "header"), (1, 2, "misread"), (1, 4, "hyphen"), (1, 6, "page_number"), (1, 7, "header"), (1, 14, "page_number")]
    assert {g[0] for g in got} == {1}
    fixed = {r["record_id"]: r["text"] for r in p3_scans.repaired(rec, docs).collect()}
    assert "the register was complete because nobody had opened the read-only cabinet. The papers were escalated since the audit." in fixed[1].replace("read- only", "read-only")
    assert "Records Office" not in fixed[1] and fixed[2] == ""
    assert p3_scans.damaged(rec.limit(0), docs).count() == 0


def test_p3_a_cut_word_is_misread_where_it_differs(spark):
    clean = [(i, "nobody escalated the confidential papers of the audit", "txt") for i in range(5)]
    filler = ["The confidential papers of the audit nobody escalated the", "confidential papers of the audit nobody escalated the papers"]
    lines = [*filler, "of the audit nobody escalated. The papers nobody had esca-", "latcd the papers of the audit. Confidential papers were cscal-", "ated the confidential papers of the audit nobody escalated", *filler, "of the audit."]
    docs = spark.createDataFrame([*clean, (50, None, "png")], "doc_id long, text string, sniffed_type string")
    rec = spark.createDataFrame([(1, 50, "\n".join(lines), [])], "record_id long, document_id long, text string, page_spans array<struct<page:int,span_start:int,span_end:int>>")
    got = pairs(p3_scans.damaged(rec, docs).where("kind in ('misread', 'hyphen')"))  # the first word errs in its second part, the second in its first
    assert got == [(1, 3, "hyphen"), (1, 4, "hyphen"), (1, 4, "misread")]


def test_p3_codes_round_trip():
    import numpy as np

    obs = np.array(list(itertools.product(*[range(s) for s in p3_scans.SIZES])), dtype=np.int8)
    assert (p3_scans.decode(np.array(p3_scans.encode(obs))) == obs).all()


# ---------------------------------------------------------------- 4

SAME = [
    ["7417 South Nasilanger Hwy, Apartment 108, Ironbury, CO 61487", "#108, 7417 S. Nasilanger Highway, Ironbury, Colorado", "7417 s. nassilanger highway, suite 108, 61487", "Ironbury, CO 61487, 7417 South Nasilanger Hwy, Unit 108"],
    ["7417 S Nasilanger Hwy, Apt 109, Ironbury, CO 61487", "7417 S Nasilanger Hwy, Apt 109, Ironbury, CO 61487"],
    ["7417 South Nasilanger Hwy, Apt 108, Coldbury, MI 42416", "Coldbury, Michigan 42416, 7417 S Nasilanger Highway, #108"],
    ["PO Box 8588, Ciwenide Station, Fairfield, KS 89232", "POB 8588 (Ciwenide Stn) Kansas 89232"],
    ["Gruyoresterstrasse 14, 61352 Altheim", "Gruyorester-Str. 14, Altheim, Deutschland"],
    ["81, rue Klevarester; 95287 Valbrune", "81 r. Klevarester, 95287 Valbrune"],
    ["Calle Drequaelin, nº 125, Villa Serena, 87596", "C/ Drequaelin 125, 87596 Villa Serena"],
]


def test_p4_pairs(spark):
    rows = [(i, a) for i, a in enumerate(a for g in SAME for a in g)]
    roster = spark.createDataFrame([(i, a, "x") for i, a in rows[:5]] + [(100, None, "x"), (101, "", "x"), (102, " ", "x"), (103, "no number here", "x"), (104, "No Number, here", "x")], "row_id long, home_address string, place string")
    e = ex(spark, [(i, 1, None, "home_address", a) for i, a in rows[5:]] + [(200, 1, None, "home_address", None), (201, 1, None, "email", "7417 S Nasilanger Hwy, Apt 108, Ironbury")])
    at = {}
    n = 0
    for k, g in enumerate(SAME):
        for _ in g:
            at[n] = k
            n += 1
    want = {(a, b) for a, b in itertools.combinations(sorted(at), 2) if at[a] == at[b]} | {(101, 102), (103, 104)}
    assert set(pairs(p4_places.pairs(p4_places.address_records(roster, e)))) == want
    assert p4_places.pairs(p4_places.address_records(roster.limit(0), e.limit(0))).count() == 0


def test_p4_what_is_ambiguous_stays_open(spark):
    r = spark.createDataFrame([(1, "9467 Dikirash Hwy, Lakefield, OR 17601", "x"), (2, "9467 Dikirash Highway, Oakbury, OH 65265", "x"), (3, "9467 Dikirash Hwy", "x"), (4, "9467 Dikirash Hwy, 17601", "x")], "row_id long, home_address string, x string")
    every = p4_places.address_records(r, ex(spark, []).limit(0))
    assert pairs(p4_places.pairs(every)) == [(1, 4)]
    at = {x["address_id"]: x["location"] for x in p4_places.locations(every).collect()}
    assert {(x["address_id"], x["location"]) for x in p4_places.candidates(every).collect()} == {(3, at[1]), (3, at[2])}
    assert p4_places.candidates(every.limit(0)).count() == 0


def test_p4_house_numbers_of_any_length_and_with_letters(spark):
    assert p4_places.parse("12345 Oak Street, Denver, CO 80202") == ("us", "12345", "", "", "oak", "street", "denver", "co", "80202")
    assert p4_places.parse("12345 N Main St, Springfield, IL")[1:9] == ("12345", "", "n", "main", "street", "springfield", "il", "")
    assert p4_places.parse("221B Baker Street, Denver, CO 80202")[1] == "221b" and p4_places.parse("1234567 Long Rd, Denver, CO")[1] == "1234567"
    assert p4_places.parse("12-34 Oak St, Denver, CO 80202")[1] == "12-34" and p4_places.parse("80202 Denver, CO, 17 Oak St")[8] == "80202"
    r = spark.createDataFrame([(1, "12345 Oak Street, Denver, CO 80202", "x"), (2, "CO 80202 Denver; 12345 Oak St", "x"), (3, "12346 Oak Street, Denver, CO 80202", "x"), (4, "221B Baker St, Denver, CO 80202", "x"), (5, "221b baker street, Denver CO", "x"), (6, "221 Baker Street, Denver, CO 80202", "x")], "row_id long, home_address string, x string")
    assert pairs(p4_places.pairs(p4_places.address_records(r, ex(spark, []).limit(0)))) == [(1, 2), (4, 5)]


def test_p4_gathers_alike_with_and_without_index(monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("aeilnorst") for _ in range(r.randint(3, 8))) for _ in range(12)]
    spell = lambda w: w if r.random() < 0.5 else w[:2] + w[3:] if r.random() < 0.5 else w[:1] + r.choice("xyz") + w[1:]
    for _ in range(20):
        s = sorted({(spell(r.choice(words)), r.choice(["", "n", "s"]), r.choice(["", "street"]), r.choice(["", "co"])): r.randint(1, 9) for _ in range(40)}.items())
        s = [(*k, n) for k, n in s]
        monkeypatch.setattr(p4_places, "FEW", 10**6)
        a = p4_places.gather(s)
        monkeypatch.setattr(p4_places, "FEW", 0)
        assert p4_places.gather(s) == a


# ---------------------------------------------------------------- 5


def test_p5_copies(spark):
    rows = [
        (5, 1, None, "full_name", "Lee, Ann"), (3, 1, None, "full_name", "ANN  LEE"), (9, 1, None, "full_name", "ann ann lee"), (4, 2, None, "full_name", "Ann Lee"),
        (6, 1, None, "phone", "(212) 555-1234"), (7, 1, None, "phone", "212.555.1234"), (8, 1, None, "full_name", "Änn Lee"), (10, 1, None, "phone", None), (11, None, None, "phone", "1"), (12, 1, None, "medical", "x"), (13, 1, None, "medical", "x"),
    ]
    e = ex(spark, rows).withColumn("keep_id", F.lit("clash"))
    assert pairs(p5_copies.copies(e)) == [(3, 5), (6, 7)]
    assert pairs(p5_copies.collapsed(e).select("id", "n_copies")) == [(3, 2), (4, 1), (6, 2), (8, 1), (9, 1)]
    assert p5_copies.copies(e.limit(0)).count() == 0


def test_p5_hot_keys_give_the_same(spark):
    rows = [(i, 1, None, "full_name", "Ann Lee" if i % 3 else f"Bob {i}") for i in range(300)]
    e = ex(spark, rows)
    assert pairs(p5_copies.copies(e)) == pairs(p5_copies.copies(e, hot_rows=10)) == [(1, i) for i in range(2, 300) if i % 3]
    assert pairs(p5_copies.collapsed(e)) == pairs(p5_copies.collapsed(e, hot_rows=10))


# ---------------------------------------------------------------- 6


def test_p6_matches(spark):
    filler = [f"{g} {f}" for g in ("marta", "clara", "hugo", "petra", "joseph") for f in ("horbulisle", "kantavor", "wistenard", "poldemar", "grithaling")]
    persons = spark.createDataFrame([(1, "Cethadek, Joseph", "1988-05-15", "x"), (2, "Dr. Joseph Cethadek", None, "x"), (3, "Joseph Cethadek", "1950-01-01", "x"), (4, "Unknown", None, "x"), (5, "Relvilux Medical Group Co.", None, "x"), (6, None, None, "x"), (7, "Hugo Zestakis", "1952-12-23", "x"), *[(100 + i, n, None, "x") for i, n in enumerate(filler)]], "id long, best_known_full_name string, dob string, types string")
    subjects = spark.createDataFrame([(11, "Joseph Cethadek", "05/15/1988", ["birth date"]), (12, "relvilux med. group company", None, None), (13, "H. Zestakis", "23 Dec 1952", None), (14, None, None, None), (15, "Petra Novak", None, []), (16, "Joseph Cethadek", "1950", None)], "subject_id long, listed_name string, birth_date string, data_types array<string>")
    flags = spark.createDataFrame([(1, "dob"), (1, "dob"), (2, "email"), (9, None)], "person_id long, category string")
    got = set(pairs(p6_matching.matches(persons, flags, subjects).select("person_id", "subject_id")))
    assert {(1, 11), (5, 12), (7, 13), (3, 16)} <= got <= {(1, 11), (2, 11), (5, 12), (7, 13), (3, 16), (2, 16)}
    assert p6_matching.matches(persons.limit(0), flags, subjects).count() == 0


def test_p6_common_name_against_brute_force(spark):
    iso = lambda i: f"{1930 + i}-{i % 9 + 1:02d}-{i % 18 + 10:02d}"
    near_ = lambda i: f"{1930 + i}-{i % 9 + 1:02d}-{i % 18 + 11:02d}"
    slashed = lambda i: f"{i % 9 + 1:02d}/{i % 9 + 2:02d}/{1930 + i}"
    persons = spark.createDataFrame([(i, "John Smithson", iso(i)) for i in range(60)] + [(100 + i, "Mary Smithson", f"{1930 + i}-{i % 9 + 2:02d}-{i % 9 + 1:02d}") for i in range(60)], "id long, best_known_full_name string, dob string")
    flags = spark.createDataFrame([(1, 1, "dob")], "id long, person_id long, category string")
    rows = [("John Smithson", near_(i)) for i in range(0, 60, 7)] + [("J. Smithson", iso(i)) for i in range(3, 60, 9)] + [("Smithson, John", None), ("John Smithsen", None), ("John Smithsno", None)] + [("Mary Smithson", slashed(i)) for i in range(1, 60, 7)] + [("Mary Smitshon", slashed(i)) for i in range(2, 60, 9)]
    subjects = spark.createDataFrame([(500 + i, n, d, ["birth date"]) for i, (n, d) in enumerate(rows)], "subject_id long, listed_name string, birth_date string, data_types array<string>")
    forms, _ = p6_matching._forms(persons, flags, subjects)
    keyed = p6_matching.materialize(p6_matching._keyed(forms))
    got = set(pairs(p6_matching._edges(keyed, p6_matching.WINDOW).select("s", "p")))
    sides = {"p": [], "s": []}
    for r in keyed.collect():
        r = r.asDict() | {"dates": p6_matching.dates(r["born"])}
        sides[r["side"]].append(r | {"types": set(r["types"]) if r["side"] == "p" else r["types"]})
    want = {(s["form"], p["form"]): s for s in sides["s"] for p in sides["p"] if p6_matching.points(p, s) >= p6_matching.LEAST}
    lost = [want[x] for x in want.keys() - got]
    assert got <= want.keys() and not lost, f"{len(lost)} of {len(want)} pairs lost"


def test_p6_dates():
    d = p6_matching.dates
    assert d("1988-05-15") == [(1988, 5, 15)] and d("05/15/1988")[0] == (1988, 5, 15) and d("25.05.78")[0] == (1978, 5, 25) and d("23 Feb 1961") == [(1961, 2, 23)]
    assert d("May 1978") == [(1978, 5, 0)] and d("1988") == [(1988, 0, 0)] and d(None) == [] and d("soon") == [] and d("99/99/1999") == []


@pytest.mark.parametrize("seed", range(5))
def test_p6_assignment_is_the_best(seed):
    r = random.Random(seed)
    edges = [(f"s{i}", f"p{j}", r.randrange(1, 1000) / 1000) for i in range(4) for j in range(4) if r.random() < 0.7]
    value = {(s, p): c for s, p, c in edges}
    best = 0.0
    for perm in itertools.permutations([f"p{j}" for j in range(4)]):
        best = max(best, sum(value.get((f"s{i}", p), 0) for i, p in enumerate(perm)))
    got = p6_matching.assign(edges)
    assert len(set(got.values())) == len(got) and abs(sum(value[s, p] for s, p in got.items()) - best) < 0.002


# ---------------------------------------------------------------- 7

LETTERS = [
    ("Notes mention asthma; the patient, Dr. K. van Stonkifield, lives at 9227 S Ninorell Av, Apt. 277, IA 62246.", [("Dr. K. van Stonkifield", "name"), ("9227 S Ninorell Av, Apt. 277, IA 62246", "address")]),
    ("It is closed. H. Mardelac can be reached on 001-227-555-1405 x12 after five.", [("H. Mardelac", "name"), ("001-227-555-1405 x12", "phone")]),
    ("Parcel number 933-22-4604 was logged. SSN 912-81-7110 is his.", [("912-81-7110", "id_number")]),
    ("Write to josef22 [at] inbox[.]example or info@corvane.example.", [("josef22 [at] inbox[.]example", "email"), ("info@corvane.example", "email")]),
    ("Records list asthma, with follow-up by J. Lee at j_lee5 at postbox dot example. Shared with raul (at) meridow dot example by mistake.", [("J. Lee", "name"), ("j_lee5 at postbox dot example", "email"), ("raul (at) meridow dot example", "email")]),
    ("Escribir a Briltuvuer, Dorothy, 1056 Drorosell Ln., 21238 Northmere, MT, o a d@x.example.", [("Briltuvuer, Dorothy", "name"), ("1056 Drorosell Ln., 21238 Northmere, MT", "address"), ("d@x.example", "email")]),
    ("Full name | Henry Horbodal | Date of birth | 1984-09-16", [("Henry Horbodal", "name")]),
    ("Best,\nBjörn Grisceholm\nDirect: (696)555-2453", [("Björn Grisceholm", "name"), ("(696)555-2453", "phone")]),
    ("Statement for card ** 7955 was mailed to 4461 Hofenelm Ct. The hold stays. Account number 432100504886.", [("4461 Hofenelm Ct", "address")]),
    ("Reisepass 160495436 wurde für Hélène Muggostein hinterlegt.", [("160495436", "id_number"), ("Hélène Muggostein", "name")]),
    ("", []), (None, []), ("nothing to see " * 20_000, []),
]


@pytest.mark.parametrize("text,want", LETTERS)
def test_p7_finds(text, want):
    assert [(text[a:b], k) for a, b, k in p7_pii.find(text)] == want


def test_p7_replaces(spark):
    rows = spark.createDataFrame([("passage", i, t, "x") for i, (t, _) in enumerate(LETTERS) if t is not None] + [("passage", 99, LETTERS[1][0].upper(), "x")], "origin string, row_id long, text string, canon string")
    got = {r["row_id"]: r["text"] for r in p7_pii.redact(rows, "k").collect()}
    for i, (t, want) in enumerate(LETTERS):
        if t is not None:
            at = 0
            for a, b, k in p7_pii.find(t):
                assert got[i].startswith(t[at:a] + f"[{k.upper()} ") or t[at:a] in got[i]
                assert t[a:b] not in got[i]
                at = b
            if not want:
                assert got[i] == t
    assert p7_pii.spans(rows.limit(0)).count() == 0 and p7_pii.redact(rows.limit(0), "k").count() == 0


def test_p7_no_written_surrogate_is_shared(spark):
    values = [("name", f"Bruno{i % 150} Alma{i // 150}".translate(str.maketrans("0123456789", "bcdfghklmn"))) for i in range(25_000)] + [("id_number", f"{i:03d}") for i in range(300)]
    rows = [(k, p7_pii.canonical(k, v), v) for k, v in values]
    assert len({r[:2] for r in rows}) == len(rows) > len({(k, p7_pii.surrogate(k, v, b"k")) for k, v in values[:25_000]}) + 300
    ranks = {(r["pii_type"], r["canon"]): r["rank"] for r in p7_pii.distinct_ranks(spark.createDataFrame(rows, "pii_type string, canon string, value string"), b"k").collect()}
    out = [(k, p7_pii.canonical(k, p7_pii.surrogate(k, v, b"k", ranks.get((k, c), 0)))) for k, c, v in rows]
    assert ranks and len(set(out)) == len(rows)


def test_p7_extensions_keep_their_form():
    forms = ["212-555-0143" + e for e in ("", " x12", " X12", ", Ext. 12", " ext 12", " extension 12")]
    assert {p7_pii.canonical("phone", v) for v in forms} == {"2125550143"}
    new = [p7_pii.surrogate("phone", v, b"k") for v in forms]
    assert len({v[:12] for v in new}) == 1 and all(re.sub(r"\d", "0", v[12:]) == re.sub(r"\d", "0", f[12:]) for v, f in zip(new, forms))
    assert new[0] != forms[0] and not new[0].startswith(forms[0][:3]) and len({re.sub(r"\D", "", v[12:]) for v in new[1:]}) == 1


def test_p7_surrogates_keep_form_and_identity():
    s = lambda k, v, r=0: p7_pii.surrogate(k, v, b"key", r)
    assert s("name", "Mrs. Ann Lee").startswith("Mrs. ") and s("name", "LEE, ANN").isupper() and "," in s("name", "Lee, Ann")
    assert s("name", "Lee, Ann").split(",")[0] == s("name", "Ann Lee").split()[-1] == s("name", "A. Lee").split()[-1]
    assert s("name", "John Smith")[0] == s("name", "J. Smith")[0] and s("name", "J. Smith")[1:3] == ". "
    assert s("name", "George Lee").split()[0][-1] == s("name", "Luke Lee").split()[0][-1] == "o" and s("name", "Alice Lee").split()[0][-1] == s("name", "Mrs Kim Lee").split()[1][-1] == "a"
    assert all("\u0400" <= c <= "\u04ff" or c == " " for c in s("name", "Иван Петров")) and all("\u4e00" <= c <= "\u9fff" for c in s("name", "王小明"))
    assert s("name", "Corvane Partners Ltd.").endswith(" Partners Ltd.") and s("name", "Dr. van Houten").startswith("Dr. van ")
    assert s("phone", "(212) 555-1234")[0] == "(" and s("phone", "(212) 555-1234") != s("phone", "(212) 555-1235") and s("phone", "+1 212 555 1234").startswith("+1 ")
    assert s("id_number", "K12345678")[0].isalpha() and s("id_number", "912-81-7110").count("-") == 2
    assert s("name", "Ann Lee", 1) != s("name", "Ann Lee") and p7_pii.surrogate("name", "Ann Lee", b"other") != s("name", "Ann Lee")


def test_p7_needs_a_key(spark):
    with pytest.raises(ValueError):
        p7_pii.redact(spark.createDataFrame([("passage", 1, "x")], "origin string, row_id long, text string"), "")


# wordings that stand in no list of the operator; « » around names and addresses
UNSEEN = """
My neighbour «Robert Miller» drove to the clinic with «Jane Cooper» in May.
Dear «Robert Miller», we regret the delay.
I spoke with «Dr. Alice Brown» yesterday; her address is «12 Oak Street, Springfield, IL 62701».
Customer: «Maria Lopez», «45 Elm Ave, Denver CO 80202»
The parcel was handed to «Thomas Weaver» at «918 North Ridge Road, Apt 4, Salem, OR 97301» on Monday.
Yesterday «Mr. Grantham» complained about the noise.
Our attorney «Priya Natarajan» will call back.
Forwarded on behalf of «Susan O'Neill» and «Peter Chang».
Attention: «Karen Whitfield»
It was «Kevin Hart» who signed the form.
According to «Mrs. Delgado» nobody was home.
The tenant «Joseph Abiola» moved out of «77 Sunset Boulevard, Los Angeles, CA 90028».
«Nancy Drummond» asked for a refund.
A copy went to «PO Box 4410, Reno, NV 89501».
Bitte senden Sie alles an Frau «Petra Hoffmann», «Lindenstraße 12, 10969 Berlin».
Le colis de «Sophie Marchand» est resté au «14 rue des Lilas, 75011 Paris».
La señora «Carmen Ibáñez» vive en «Calle Mayor 23, Madrid».
Interview with «Daniel K. Osei», conducted by phone.
Please forward the invoice to «Brightwater Logistics Inc.», attention «Mark Tully».
The visitors were «Emily Stone», «George Pappas» and «Ruth Adler».
«Stephen Marsh» has lived at «5 Kings Court, Boise, ID 83702» since 1999.
Her brother «Aaron Feld» can confirm it.
Delivered to «1600 West Harbor Drive, Suite 210, Tampa, FL 33602».
Signed: «Laura Benedetti»
"""


def test_p7_finds_names_and_addresses_in_wordings_it_was_not_given():
    hit = total = wrong = 0
    for line in UNSEEN.strip().split("\n"):
        text, want, at = "", [], 0
        for part in re.split("([«»])", line):
            if part == "«":
                at = len(text)
            elif part == "»":
                want.append((at, len(text)))
            else:
                text += part
        got = [(a, b) for a, b, k in p7_pii.find(text) if k in ("name", "address")]
        inside = [w for w in want if any(a <= w[0] and w[1] <= b and b - a <= w[1] - w[0] + 6 for a, b in got)]
        hit, total = hit + len(inside), total + len(want)
        wrong += sum(not any(a < y and x < b for x, y in want) for a, b in got)
    assert hit >= 0.9 * total and wrong <= 0.1 * total, (hit, total, wrong)


def test_p7_words_learned_from_names_are_known(spark):
    e = ex(spark, [(i, 1, None, "full_name", n) for i, n in enumerate(["zorvane quillby", "Zorvane Tarn", "Quillby, Z."])])
    persons = spark.createDataFrame([(1, "Unknown", None, "x"), (2, None, None, "x")], PERSONS)
    rows = spark.createDataFrame([("passage", 1, "Then Zorvane Quillby left. Later Marble Counter fell and the marble counter broke."), ("passage", 2, None), ("passage", 3, "")], "origin string, row_id long, text string")
    got = pairs(p7_pii.spans(rows.where("text is not null"), p7_pii.name_words(e, persons)))
    assert [g[2:] for g in got] == [(5, 20, "name")]
    assert p7_pii.spans(rows.where("text is not null"), p7_pii.name_words(e.limit(0), persons.limit(0))).where("pii_type = 'address'").count() == 0


# ---------------------------------------------------------------- 8


def test_p8_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(p8_tokens.VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p8_tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "é", "12", "aaaa", "!?", " ", "🙂", "\r\n", "the", "'ll", "́", "客户", "\x1c", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)] + ["ab" * 5_000, "", None, "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x["ids"] for x in p8_tokens.encode(df).collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert p8_tokens.encode(df.limit(0)).count() == 0
    n = {x["doc_id"]: x["n_tokens"] for x in p8_tokens.lengths(df, ["doc_id"]).collect()}
    assert all(n[i] == len(got[i]) for i in got)


def test_p8_table_of_pieces_may_overflow(monkeypatch):
    m = p8_tokens.PairIndexBPE()
    want = [m.encode([f"some words {i} and more"])[0].tolist() for i in range(40)]
    monkeypatch.setattr(p8_tokens, "REMEMBERED", 5)
    m = p8_tokens.PairIndexBPE()
    assert [m.encode([f"some words {i} and more"])[0].tolist() for i in range(40)] == want


# ---------------------------------------------------------------- 9


def test_p9_schedule_stays_within_a_block():
    made = p9_mixing.slots(p9_mixing.weights({"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}))
    q = {g: n for g, _, n, _, _ in made}
    assert q == {"a": 50, "b": 30, "c": 17, "d": 3} and {m[3] for m in made} == {100}
    seen = collections.Counter()
    for s, i, slot in p9_mixing.schedule(q, 100):
        assert i == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - q[x] * (slot + 1) / 100) < 1 for x in q)
    assert seen == collections.Counter(q) and p9_mixing.slots({}) == []


def place(made, source, b):
    at = {g: (up, q, whole, xs) for g, up, q, whole, xs in made}
    while source is not None:
        source, q, whole, xs = at[source]
        b = b // q * whole + xs[b % q]
    return b


@pytest.mark.parametrize("shares", [{f"s{i}": 1 / 1001 for i in range(1001)}, {"big": 1.0, "tiny": 3e-9}, {"a": 0.7123457, "b": 0.2876541, **{f"t{i}": 1e-8 * (i + 1) for i in range(30)}}, {f"s{i}": 1.0 for i in range(130)}])
def test_p9_any_number_of_sources_and_any_share(shares):
    w = p9_mixing.weights(shares)
    made = p9_mixing.slots(w, period=1000, fine=10)
    taken = collections.Counter()
    for s in list(w)[:40]:
        for n in (1, 7, 50):
            slot = place(made, s, n - 1)  # by then the source should have had slot * w blocks, give or take one of its bundle's and the rounding
            assert n - 1 - 0.2 * n <= float(w[s]) * slot <= n + 1 + 0.2 * n
            taken[slot] += 1
    assert max(taken.values()) == 1


def test_p9_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), "big") for i in range(200)] + [(500 + i, "small text here", "small") for i in range(5)] + [(900, None, "small"), (901, "", "big"), (902, "x", None), (903, "x", "other")], "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = p9_mixing.mix(docs, targets, block=16, period=20)
    rows = m.collect()
    used = collections.Counter((r["source"], r["doc_id"]) for r in rows)
    assert max(v for (s, _), v in used.items() if s == "small") <= 3 and max(v for (s, _), v in used.items() if s == "big") == 1
    share = {r["source"]: r for r in p9_mixing.shares(docs, targets).collect()}
    assert abs(share["small"]["actual_share"] - 0.2) < 0.1 and share["none"]["tokens"] == 0 and share["small"]["max_used"] == 3
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert p9_mixing.mix(docs.limit(0), targets).count() == 0 and p9_mixing.mix(docs, targets.limit(0)).count() == 0
    assert p9_mixing.shares(docs.limit(0), targets).agg(F.sum("tokens")).first()[0] == 0


def test_p9_running_sums(spark):
    sized = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 11 + 1) for i in range(300)], "doc_id long, source string, n_tokens long")
    rows = p9_mixing.running(sized, docs_in_range=20).collect()
    for s in "ab":
        mine = sorted((r["before"], r["n_tokens"]) for r in rows if r["source"] == s)
        at = 0
        for before, n in mine:
            assert before == at
            at += n


# ---------------------------------------------------------------- 10


def brute(text):
    w = [x.group() for x in p10_repetition.WORD.finditer(text.lower())]
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            hit[i : i + 5] = [True] * 5
        seen.add(g)
    return sum(hit) / len(w) if w else 0.0


def test_p10_shares_and_verdicts(spark):
    r = random.Random(5)
    voc = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "pa") for b in ("ban", "dor", "fel", "gim", "hut", "jas", "wen")]
    plain = [" ".join(r.choice(voc) for _ in range(150)) + "." for _ in range(60)]
    spam = ["Call 1 the desk about our file now. call 22 THE desk - about our file now! " * 8 for _ in range(3)] + ["only this sentence is told again and again. " * 30, "three words here\n" * 50]
    texts = plain + spam + ["", None, "ok ok", "a b c d e", ("never ending words " * 60_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("share", F.lit("clash"))
    q = {x["doc_id"]: x for x in p10_repetition.quality(df).collect()}
    assert all(abs(q[i]["repeated_share"] - brute(t or "")) < 1e-9 for i, t in enumerate(texts))
    assert {x["doc_id"] for x in p10_repetition.repetitive(df).collect()} == {60, 61, 62, 63, 64, 69}
    assert p10_repetition.repetitive(df.limit(0)).count() == 0
