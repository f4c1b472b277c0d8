import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import components, exposure, model_tier, resolve, review, score
from tracefold.runtime import salted_join

E = "id long, document_id long, record_key string, category string, normalized_value string, raw_value string, passage string, confidence double, is_partial boolean, suppressed_as_false_positive boolean, method string, page_number int"


def extractions(spark, rows):
    return spark.createDataFrame([(i + 1, d, k, c, v, v, v, 0.9, False, False, "deterministic_regex", None) for i, (d, k, c, v) in enumerate(rows)], E)


def union_find(edges, n):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {x: root(x) for x in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    n = 120
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(70)] + [(i, i + 1) for i in range(90, 119)] + [(0, i) for i in range(1, 30)] + [(5, 5)]
    v = spark.range(n).withColumnRenamed("id", "x")
    got = {x["x"]: x["root"] for x in components.components(v, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find(edges, n)
    assert components.components(v.limit(0), spark.createDataFrame([], "u long, v long")).count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 7)], "k int, x int")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 2)] + [(1, 5)], "k int, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, salted_join(left, right, ["k"], how, at_least=20, salts=4).collect()))
        assert got == sorted(map(str, left.join(right, ["k"], how).collect())), how


def test_threshold_is_the_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 5, 9)], "docs long")
    assert resolve.threshold(df, "docs", 3, 4).first()[0] == 20
    assert resolve.threshold(df.limit(0), "docs", 12, 4).first()[0] == 12


def test_who_is_who(spark):
    rows = [
        (1, "row:1", "full_name", "Ann Lee"), (1, "row:1", "ssn", "1"), (1, "row:2", "full_name", "Bob Ray"), (1, "row:2", "ssn", "2"),
        (2, None, "full_name", "Lee, Ann M."), (2, None, "ssn", "1"),
        (3, None, "full_name", "Kim Poe"), (3, None, "dob", "1990-01-01"), (4, None, "full_name", "POE, KIM"), (4, None, "dob", "1990-01-01"),
        (5, None, "full_name", "Kim Poe"), (5, None, "dob", "1991-01-01"),
        (6, None, "dob", "1970-01-01"), (6, None, "full_name", "A. B."), (7, None, "dob", "1970-01-01"), (7, None, "full_name", "C. D."),
    ]
    people, links = resolve.resolve(extractions(spark, rows), chrome=False)
    who = {r["extraction_id"]: r["person_id"] for r in links.collect()}
    assert who[1] == who[2] == who[5] == who[6] != who[3]
    assert who[7] == who[9] and who[11] not in (who[7], who[1]) and who[13] != who[15]
    p = {r["person_id"]: r for r in people.collect()}
    assert p[1]["best_known_full_name"] == "Lee, Ann M." and p[1]["person_uid"] == "RP-00001" and sorted(p) == list(range(1, len(p) + 1))


def test_keys_of_organisations_tie_nobody(spark):
    rows = [(d, None, "phone", "555") for d in range(15)] + [(d, None, "ssn", str(d)) for d in range(15)]
    people, links = resolve.resolve(extractions(spark, rows), chrome=False)
    assert people.count() == 15 and links.count() == 15


def test_words_of_furniture_are_cut(spark):
    chrome = F.array(F.lit("page"), F.lit("header"))
    df = spark.createDataFrame([("Page Ann Lee Header",), ("Page Header",), ("Ann Page",), ("Given Okonkwo",), ("Ann Page Lee",)], "n string").select(resolve.trimmed(F.col("n"), chrome).alias("t"))
    assert [(r["t"]["name"], r["t"]["suppressed"]) for r in df.collect()] == [("Ann Lee", False), ("Page Header", True), ("Ann Page", False), ("Given Okonkwo", False), ("Ann Page Lee", False)]


def test_chrome_of_many_documents(spark):
    rows = [(d, None, "full_name", f"Page Header Name{d} Family{d}") for d in range(20)] + [(50 + d, None, "full_name", "Page Header") for d in range(3)] + [(99, None, "full_name", "Ann Lee"), (98, None, "ssn", "1")]
    e = resolve.record_ids(extractions(spark, rows))
    assert sorted(r["token"] for r in resolve.chrome_tokens(e).collect()) == ["header", "page"]
    got = [r["normalized_value"] for r in resolve.trim_chrome(e).orderBy("id").collect()]
    assert got == [f"Name{d} Family{d}" for d in range(20)] + ["Ann Lee", "1"]


def test_role_names(spark):
    e = spark.createDataFrame([(r, "full_name", "Claims Desk") for r in range(3)] + [(r, "dob", f"19{r}0-01-01") for r in range(3)] + [(0, "full_name", "Ann Lee")], "root long, category string, normalized_value string")
    assert [r["name"] for r in resolve.role_names(e).collect()] == ["Claims Desk"]


def test_merges_pairs_and_rules(spark):
    people = spark.createDataFrame([(1, "Ann Lee", "1990-01-01"), (2, "lee, ann", None), (3, "Bob Ray", "1980-01-01"), (4, "Unknown", None)], "person_id long, best_known_full_name string, dob string")
    ex = extractions(spark, [(1, None, "home_address", "1 A St"), (2, None, "home_address", "1 A St"), (3, None, "ssn", "9"), (4, None, "ssn", "8")])
    links = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x"), (4, 3, "x")], "extraction_id long, person_id long, method string")
    pairs = resolve.candidate_pairs(people, links, ex)
    assert [(r["a"], r["b"], r["signal"]) for r in pairs.collect()] == [(2, 3, "shared_address"), (1, 2, "same_name")]
    ruled = spark.createDataFrame([(3, 2)], "a long, b long")
    assert [(r["a"], r["b"]) for r in resolve.candidate_pairs(people, links, ex, ruled).collect()] == [(1, 2)]
    verdict = {(r["a"], r["b"]): r["decision"] for r in resolve.adjudicate(spark.createDataFrame([(1, 3, "s"), (1, 2, "s"), (2, 3, "s")], "a long, b long, signal string"), resolve.dossiers(people, links, ex)).collect()}
    assert verdict[1, 3] == "split" and verdict[2, 3] == "escalate"
    merged, left = resolve.apply_merges(links, people, spark.createDataFrame([(1, 2), (2, 3)], "keep long, merge long"))
    assert {r["person_id"] for r in merged.collect()} == {1} and {r["person_id"] for r in left.collect()} == {1, 4}
    with pytest.raises(ValueError):
        resolve.apply_merges(links, people, spark.createDataFrame([(1, 1)], "keep long, merge long"))


def test_all_pairs_of_a_value_that_many_share(spark):
    n = 450
    people = spark.createDataFrame([(i, "Ann Lee" if i % 2 else "lee, ann", None) for i in range(n)] + [(n, "Bob Ray", None)], "person_id long, best_known_full_name string, dob string")
    ex = extractions(spark, [(i, None, "home_address", "1 A St") for i in range(n - 200, n + 1)])
    links = spark.createDataFrame([(i + 1, n - 200 + i) for i in range(201)], "extraction_id long, person_id long")
    pairs = resolve.candidate_pairs(people, links, ex, most=None)
    want = {(a, b, "shared_address" if a >= n - 200 else "same_name") for b in range(n + 1) for a in range(b) if b < n or a >= n - 200}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert resolve.adjudicate(pairs, resolve.dossiers(people, links, ex)).count() == len(want)


def test_review_flow(spark):
    flags = spark.createDataFrame([(1, 1, "ssn", 0.5, 1, "needs_review"), (2, 1, "dob", 0.4, 1, "needs_review"), (3, 2, "ssn", 0.9, 1, "auto_accepted")], "id long, person_id long, category string, confidence double, evidence_count long, review_status string")
    people = spark.createDataFrame([(1, "RP-1", "Ann"), (2, "RP-2", "Bob"), (3, "RP-3", "Cid")], "id long, person_uid string, best_known_full_name string")
    assert [r["id"] for r in review.queue(flags, people, 1).collect()] == [2]
    dec = spark.createDataFrame([(1, "exposure_flag", 1, "reject", "n", 1), (2, "exposure_flag", 1, "accept", "n", 2), (3, "exposure_flag", 2, "reject", "n", 1)], "id long, target_type string, target_id long, decision string, notes string, decided_at long")
    assert {r["id"]: r["review_status"] for r in review.decide(flags, dec).collect()} == {1: "human_reviewed", 2: "needs_review", 3: "auto_accepted"}
    with pytest.raises(ValueError):
        review.decide(flags, dec.withColumn("target_type", F.lit("person")))
    state = review.sign_off_state(people, flags).first().asDict()
    assert state == {"persons": 3, "flags": 3, "flags_needing_review": 2}
    assert review.sign_off(state)["may_sign"] is False and review.sign_off(state, {**state, "flags": 2})["superseded"]


def test_proposals_go_stale(spark):
    ex = extractions(spark, [(1, None, "ssn", "1"), (2, "row:1", "ssn", "2"), (3, None, "ssn", "3")])
    links = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "extraction_id long, person_id long")
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    fp = review.fingerprints(links, ex)
    f = {r["person_id"]: r["fingerprint"] for r in fp.collect()}
    assert len(f[1]) == 16 and f == {r["person_id"]: r["fingerprint"] for r in review.fingerprints(links.orderBy(F.desc("person_id")), ex).collect()}

    def note(a, b, other, c=0.95):
        return f'{{"other_person_id": {other}, "confidence": {c}, "person_a_fingerprint": "{a}", "person_b_fingerprint": "{b}"}}'

    d = spark.createDataFrame(
        [(1, 1, "agent_proposed_merge", note(f[1], f[2], 2)), (2, 2, "agent_proposed_merge", note(f[2], f[3], 3)), (3, 1, "agent_proposed_merge", note("old", f[3], 3)), (4, 3, "agent_proposed_merge", '{"other_person_id": 1}'), (5, 1, "agent_proposed_merge", note(f[1], f[3], 3, 0.2)), (6, 1, "rejected", '{"original_decision_id": 9}'), (9, 1, "agent_proposed_merge", note(f[1], f[2], 2))],
        "id long, target_id long, decision string, notes string",
    )
    p = review.proposals(d, people, fp)
    got = {r["id"]: r["stale_reason"] for r in p.collect()}
    assert got == {1: None, 2: None, 3: "changed", 4: "unstamped", 5: None}
    assert review.approve(p, 1) == (1, 2)
    with pytest.raises(ValueError):
        review.approve(p, 3)
    with pytest.raises(KeyError):
        review.approve(p, 9)
    assert {r["id"]: r["outcome"] for r in review.approve_bulk(p).collect()} == {1: "approved", 2: "stale: changed", 3: "stale: changed", 4: "below_confidence", 5: "below_confidence"}


def test_audit(spark):
    ex = extractions(spark, [(1, None, "ssn", "1"), (2, None, "phone", "2125551234")]).withColumn("passage", F.when(F.col("id") == 2, "(212) 555-1234").otherwise(F.col("passage")))
    flags = spark.createDataFrame([(1, 1, "ssn"), (2, 1, "phone"), (3, 1, "dob")], "id long, person_id long, category string")
    ev = spark.createDataFrame([(1, 1), (2, 2)], "exposure_flag_id long, extraction_id long")
    a = review.audit(flags, ev, ex)
    assert {r["id"]: r["verdict"] for r in a.collect()} == {1: "verified", 2: "unsupported", 3: "unsupported"}
    assert abs(review.error_rate(a).first()[0] - 2 / 3) < 1e-9 and review.error_rate(a.limit(0)).first()[0] == 0.0


def test_labels_of_the_screen(spark):
    df = spark.createDataFrame([("ssn", None, "row:4"), ("card_number", 75.0, None), ("dob", 3700.0, "x")], "c string, s double, k string")
    got = [tuple(r) for r in df.select(exposure.category_label(F.col("c")), exposure.duration_label(F.col("s")), exposure.row_label(F.col("k"))).collect()]
    assert got == [("SSN", "—", "row 5"), ("Card number", "1m 15s", None), ("DOB", "1h 1m", None)]


def test_search_takes_wildcards_as_they_are(spark):
    people = spark.createDataFrame([(1, "100% Ann"), (2, "Ann")], "id long, best_known_full_name string")
    flags = spark.createDataFrame([], "person_id long, category string")
    assert [r["id"] for r in exposure.list_persons(people, flags, "%").collect()] == [1]


def test_model_answers():
    assert model_tier.first_object('x {"a": 1} {"b"') == {"a": 1}
    assert model_tier.first_object("none") is None and model_tier.first_object(None) is None
    labels = ["name"]
    assert model_tier.element({"type": "Medical", "text_value": "name: Flu."}, "has Flu", labels) == {"category": "medical", "value": "Flu", "passage": "Flu", "confidence": 0.5}
    assert model_tier.element({"category": "medical", "value": "absent"}, "text", labels) is None
    with pytest.raises(ValueError):
        model_tier.scope(["ssn"])


def test_model_tier_is_repeatable_and_keeps_what_was_sure(spark):
    docs = spark.createDataFrame([(i, f"Patient: Jane Okafor\nUsername: jane.o{i}\nAssessment: flu season {i}") for i in range(12)] + [(99, None)], "doc_id long, text string")
    a = sorted(map(str, model_tier.rows(model_tier.tier(docs, model_tier.ALLOWED)).collect()))
    assert a == sorted(map(str, model_tier.rows(model_tier.tier(docs.repartition(5), model_tier.ALLOWED)).collect())) and len(a) == 36

    def broken(i, t, c):
        raise RuntimeError("no")

    t = model_tier.tier(docs, model_tier.ALLOWED, strong=broken)
    assert model_tier.rows(t).count() == 36 and t.where("error is not null").count() > 0


def test_scores_of_a_small_manifest(spark):
    m = spark.createDataFrame([([("P1",), ("P2",)], [("a.txt", [("ssn", "1", "P1", False, False, 1, "prose"), ("email", "x", "P1", False, False, None, None), ("ssn", "9", "NONE", False, False, None, None), ("ssn", "2", "P2", False, True, 2, None), ("ssn", "3", "P2", True, False, None, None)])])], score.MANIFEST)
    t = score.plants(m)
    assert t.count() == 3
    docs = spark.createDataFrame([(1, "a.txt")], "doc_id long, relpath string")
    ex = extractions(spark, [(1, None, "ssn", "1"), (1, None, "ssn", "2"), (1, None, "dob", "z")]).withColumn("page_number", F.lit(2))
    links = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "extraction_id long, person_id long")
    v = score.votes(t, score.predicted(links, ex))
    s = score.person_scores(t, v, 1).first().asDict()
    assert s["matched"] == 2 and s["merge_errors"] == 1 and s["people_lost"] == 1 and s["recall"] == 1.0 and s["precision"] == 1.0
    assert {r["page_offset"]: r["n"] for r in score.page_scores(t, ex, docs).collect()} == {1: 1, 0: 1}
    assert tuple(score.contamination(t, links, ex, docs).first()) == (1, 1)
    assert {r["context_style"]: (r["planted"], r["found"]) for r in score.style_recall(t, ex, docs).collect()} == {"prose": (1, 1), "unlabelled": (2, 1)}
    vp = {r["category"]: r.asDict() for r in score.value_precision(links, ex, t).collect()}
    assert vp["_overall"]["linked"] == 3 and vp["_overall"]["corroborated"] == 2 and vp["dob"]["uncorroborated"] == ["z"]
    flags = spark.createDataFrame([(7, "ssn"), (7, "dob")], "person_id long, category string")
    cs = {r["category"]: (r["tp"], r["fn"], r["fp"]) for r in score.category_scores(t, v, flags).collect()}
    assert cs == {"ssn": (1, 0, 0), "email": (0, 1, 0), "dob": (0, 0, 1)}
