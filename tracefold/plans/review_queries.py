"""Queries of merging, review, the model tier and scoring (D4-D6, D14-D17, F11, G2-G9, H1, H7, H8, L1-L11), with decisions and manifests made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import exposure, ingest, model_tier, resolve, review, score
from tracefold.operators.profile import Profile, alternation
from tracefold.plans import catalogue as c
from tracefold.plans.catalogue import query, text_of
from tracefold.runtime import materialize, table

# ---------------------------------------------------------------- names with the words of a document's furniture

_FURNITURE = """
f AS (SELECT * REPLACE (CASE WHEN category = 'full_name' AND document_id % 3 = 0 THEN 'Records ' || normalized_value || ' Department' WHEN category = 'full_name' AND document_id % 7 = 0 THEN 'Records Department' ELSE normalized_value END AS normalized_value) FROM extractions),
"""


def _furnished(s: SparkSession, d: str) -> DataFrame:
    name = F.col("category") == "full_name"
    new = F.when(name & (F.col("document_id") % 3 == 0), F.concat(F.lit("Records "), "normalized_value", F.lit(" Department"))).when(name & (F.col("document_id") % 7 == 0), "Records Department").otherwise(F.col("normalized_value"))
    return table(s, d, "extractions").withColumn("normalized_value", new)


_E = _FURNITURE + c._E.replace("FROM extractions", "FROM f")
_CHROME = f"""
{_E}, tok AS (SELECT id, document_id, unnest({c._TOKENS}) AS token FROM e WHERE category = 'full_name'),
docs AS (SELECT token, count(DISTINCT document_id) AS docs FROM tok GROUP BY 1),
cand AS (SELECT token FROM docs WHERE docs >= (SELECT greatest(12, 6 * list_sort(list(docs))[len(list(docs)) // 2 + 1]) FROM docs)),
hit AS (SELECT DISTINCT id, token FROM tok JOIN cand USING (token)), size AS (SELECT id, count(*) AS n FROM hit GROUP BY 1),
chrome AS (SELECT token FROM hit JOIN size USING (id) GROUP BY 1 HAVING count(*) FILTER (n >= 2) > count(*) FILTER (n < 2))
"""
_TRIMMED = _CHROME + r""",
w AS (SELECT *, list_filter(regexp_split_to_array(normalized_value, '\s+'), lambda x: x <> '') AS words FROM e WHERE category = 'full_name' AND normalized_value IS NOT NULL),
g AS (SELECT w.*, list_transform(words, lambda x: coalesce(list_contains(ct.ts, lower(regexp_replace(x, '^[.,]+|[.,]+$', '', 'g'))), false)) AS flags FROM w CROSS JOIN (SELECT list(token) AS ts FROM chrome) ct),
p AS (SELECT *, len(list_filter(flags, lambda x: x)) AS n, list_position(flags, false) AS first, len(flags) - list_position(list_reverse(flags), false) + 1 AS last FROM g),
trimmed AS (SELECT id, CASE WHEN n > 0 AND first > 0 AND last - first + 1 >= 2 AND NOT (len(flags) - n < 2 AND n > len(flags) - n) THEN array_to_string(words[first:last], ' ') ELSE normalized_value END AS name, n > 0 AND len(flags) - n < 2 AND n > len(flags) - n AS gone FROM p)
"""


@query(f"WITH {_CHROME} SELECT token FROM chrome")
def chrome_found(s: SparkSession, d: str) -> DataFrame:
    """Names that carry words of a letterhead."""
    return resolve.chrome_tokens(resolve.record_ids(_furnished(s, d)))


@query(f"WITH {_TRIMMED} SELECT id, name AS normalized_value FROM trimmed WHERE NOT gone")
def chrome_trimmed(s: SparkSession, d: str) -> DataFrame:
    """D6"""
    return resolve.trim_chrome(resolve.record_ids(_furnished(s, d))).where("category = 'full_name' and normalized_value is not null").select("id", "normalized_value")


_GRAPH = c._GRAPH.replace(c._E, "e AS (SELECT e0.* REPLACE (coalesce(t.name, e0.normalized_value) AS normalized_value) FROM e0 LEFT JOIN trimmed t USING (id) WHERE NOT coalesce(t.gone, false))")


@query(f"""
WITH RECURSIVE {_TRIMMED.replace("e AS (SELECT *, coalesce", "e0 AS (SELECT *, coalesce").replace("FROM e WHERE", "FROM e0 WHERE")}, {_GRAPH}, {c._ROLES},
ps AS (SELECT root, min(id) AS f, arg_min(normalized_value, id) FILTER (category = 'dob') AS dob,
  (list(normalized_value ORDER BY length(normalized_value) DESC, id) FILTER (category = 'full_name' AND normalized_value NOT IN (SELECT name FROM roles)))[1] AS best FROM er GROUP BY 1)
SELECT row_number() OVER (ORDER BY f) AS person_id, printf('RP-%05d', row_number() OVER (ORDER BY f)) AS person_uid, coalesce(best, 'Unknown') AS best_known_full_name, dob, CASE WHEN best IS NULL THEN 'needs_review' ELSE 'auto_accepted' END AS review_status FROM ps
""")
def resolved_trimmed(s: SparkSession, d: str) -> DataFrame:
    """D1-D13 with the words of document furniture cut off first."""
    return resolve.resolve(_furnished(s, d))[0]


@query(c.SQL["resolved_persons"])
def resolved_untouched(s: SparkSession, d: str) -> DataFrame:
    """Names without such words stay as they are (none has them here)."""
    return resolve.resolve(table(s, d, "extractions"))[0]


# ---------------------------------------------------------------- merging

_PAIRS = f"pairs AS ({c.SQL['candidate_pairs']})"
_FILES = """
named AS (SELECT DISTINCT l.person_id, e.normalized_value AS v FROM entity_links l JOIN extractions e ON e.id = l.extraction_id WHERE e.category = 'full_name'),
shown AS (SELECT * FROM (SELECT l.person_id, l.extraction_id, e.category, e.normalized_value AS v, row_number() OVER (PARTITION BY l.person_id, e.category ORDER BY l.extraction_id) AS k FROM entity_links l JOIN extractions e ON e.id = l.extraction_id WHERE e.category <> 'full_name') WHERE k <= 3)
"""


@query(f"""
WITH {_FILES}, a AS (SELECT person_id, string_agg(v, '|' ORDER BY v) AS variants FROM named GROUP BY 1), b AS (SELECT person_id, string_agg(category || ':' || extraction_id || ':' || coalesce(v, ''), '|' ORDER BY category, extraction_id) AS evidence FROM shown GROUP BY 1)
SELECT p.id AS person_id, p.best_known_full_name AS name, p.dob, a.variants, b.evidence FROM persons p LEFT JOIN a ON a.person_id = p.id LEFT JOIN b ON b.person_id = p.id
""")
def dossiers(s: SparkSession, d: str) -> DataFrame:
    """D16"""
    f = resolve.dossiers(c._people(s, d), table(s, d, "entity_links"), table(s, d, "extractions"))
    ev = F.transform("evidence", lambda e: F.concat_ws(":", e["category"], e["extraction_id"].cast("string"), F.coalesce(e["value"], F.lit(""))))
    return f.select("person_id", "name", "dob", text_of(F.col("variants")).alias("variants"), text_of(ev).alias("evidence"))


@query(rf"""
WITH {_PAIRS}, {_FILES},
cv AS (SELECT person_id, category, list(DISTINCT v) AS vs FROM shown WHERE category <> 'home_address' AND v IS NOT NULL GROUP BY 1, 2),
bad AS (SELECT DISTINCT p.a, p.b FROM pairs p JOIN cv x ON x.person_id = p.a JOIN cv y ON y.person_id = p.b AND y.category = x.category WHERE NOT list_has_any(x.vs, y.vs)),
last AS (SELECT person_id, list(DISTINCT regexp_split_to_array(trim(lower(v)), '\s+')[-1]) AS ws FROM named WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY 1)
SELECT p.a, p.b, p.signal, CASE WHEN bad.a IS NOT NULL OR x.dob <> y.dob THEN 'split' WHEN list_has_any(m.ws, n.ws) THEN 'merge' ELSE 'escalate' END AS decision,
  CAST(CASE WHEN bad.a IS NOT NULL THEN 0.85 WHEN x.dob <> y.dob THEN 0.8 WHEN list_has_any(m.ws, n.ws) THEN 0.65 ELSE 0.3 END AS DOUBLE) AS confidence
FROM pairs p JOIN persons x ON x.id = p.a JOIN persons y ON y.id = p.b LEFT JOIN bad ON bad.a = p.a AND bad.b = p.b LEFT JOIN last m ON m.person_id = p.a LEFT JOIN last n ON n.person_id = p.b
""")
def adjudicated_pairs(s: SparkSession, d: str) -> DataFrame:
    """D15-D17, S6"""
    people, links, ex = c._people(s, d), table(s, d, "entity_links"), table(s, d, "extractions")
    return resolve.adjudicate(resolve.candidate_pairs(people, links, ex, most=None), resolve.dossiers(people, links, ex))


@query(f"""
WITH RECURSIVE {_PAIRS}, edge AS (SELECT a, b FROM pairs WHERE signal = 'same_name' UNION SELECT b, a FROM pairs WHERE signal = 'same_name'),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, x.b FROM reach r JOIN edge x ON x.a = r.b), keep AS (SELECT a AS person_id, min(b) AS keep FROM reach GROUP BY 1)
SELECT l.extraction_id, least(coalesce(k.keep, l.person_id), l.person_id) AS person_id, CASE WHEN k.keep < l.person_id THEN 'agent_adjudicated' ELSE l.method END AS method FROM entity_links l LEFT JOIN keep k USING (person_id)
""")
def merged_links(s: SparkSession, d: str) -> DataFrame:
    """Links after all pairs of one name are merged."""
    people, links, ex = c._people(s, d), table(s, d, "entity_links"), table(s, d, "extractions")
    pairs = resolve.candidate_pairs(people, links, ex, most=None).where("signal = 'same_name'")
    return resolve.apply_merges(links, people, pairs.select(F.col("a").alias("keep"), F.col("b").alias("merge")))[0].select("extraction_id", "person_id", "method")


# ---------------------------------------------------------------- review

_DECISIONS = """
decisions AS (SELECT id, 'exposure_flag' AS target_type, id AS target_id, CASE WHEN id % 3 = 0 THEN 'accept' ELSE 'reject' END AS decision, 1 AS decided_at FROM exposure_flags
  UNION ALL SELECT -id, 'exposure_flag', id, 'reject', 2 FROM exposure_flags WHERE id % 6 = 0 UNION ALL SELECT id + 1, 'exposure_flag', id, 'accept', 1 FROM exposure_flags WHERE id % 5 = 0)
"""


@query(f"""
WITH {_DECISIONS}, last AS (SELECT target_id, arg_max(decision, (decided_at, id)) AS decision FROM decisions GROUP BY 1)
SELECT f.id, f.person_id, f.category, CASE WHEN last.decision = 'accept' THEN 'human_reviewed' ELSE f.review_status END AS review_status FROM exposure_flags f LEFT JOIN last ON last.target_id = f.id
""")
def decided_flags(s: SparkSession, d: str) -> DataFrame:
    """Every flag with a decision, some with a later one."""
    f = table(s, d, "exposure_flags")
    row = lambda df, id_, decision, at: df.select(id_.alias("id"), F.lit("exposure_flag").alias("target_type"), F.col("id").alias("target_id"), decision.alias("decision"), F.lit(at).alias("decided_at"))
    dec = row(f, F.col("id"), F.when(F.col("id") % 3 == 0, "accept").otherwise("reject"), 1)
    dec = dec.unionByName(row(f.where("id % 6 = 0"), -F.col("id"), F.lit("reject"), 2)).unionByName(row(f.where("id % 5 = 0"), F.col("id") + 1, F.lit("accept"), 1))
    return review.decide(f, dec).select("id", "person_id", "category", "review_status")


_PROPOSED = f"""
{_PAIRS}, fp AS ({c.SQL['fingerprints']}),
made AS (SELECT row_number() OVER (ORDER BY p.a, p.b) AS id, p.a, p.b, fa.fingerprint AS fa, fb.fingerprint AS fb FROM pairs p LEFT JOIN fp fa ON fa.person_id = p.a LEFT JOIN fp fb ON fb.person_id = p.b),
props AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'agent_proposed_split' ELSE 'agent_proposed_merge' END AS decision, a, b, CASE WHEN id % 6 = 0 THEN 0.65 ELSE 0.95 END AS confidence, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'old' ELSE fa END AS sa, CASE WHEN id % 7 = 0 THEN NULL ELSE fb END AS sb, fa, fb FROM made),
open AS (SELECT id, decision, a, b, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN sa IS NULL OR sb IS NULL THEN 'unstamped' WHEN sa IS DISTINCT FROM fa OR sb IS DISTINCT FROM fb THEN 'changed' END AS stale_reason FROM props WHERE id % 4 <> 0)
"""


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """A proposal for each candidate pair; some closed by an approval or a rejection, some without stamp or with an old one."""
    pairs = c.candidate_pairs(s, d).select("a", "b")
    p = materialize(ingest.numbered(pairs, ["a", "b"], column="id"))
    fp = materialize(c.fingerprints(s, d))
    for x in "ab":
        p = p.join(fp.select(F.col("person_id").alias(x), F.col("fingerprint").alias(f"f{x}")), x, "left")
    stamp = lambda x, old: F.when(F.col("id") % 7 == 0, None).when((F.col("id") % 5 == 0) & F.lit(old), "old").otherwise(F.col(x))
    notes = F.to_json(F.struct(F.col("b").alias("other_person_id"), F.when(F.col("id") % 6 == 0, 0.65).otherwise(0.95).alias("confidence"), F.lit("same name").alias("rationale"), stamp("fa", True).alias("person_a_fingerprint"), stamp("fb", False).alias("person_b_fingerprint")))
    made = p.select("id", F.when(F.col("id") % 11 == 0, "agent_proposed_split").otherwise("agent_proposed_merge").alias("decision"), F.col("a").alias("target_id"), notes.alias("notes"))
    done = p.where("id % 4 = 0").select((F.col("id") + 10_000_000_000).alias("id"), F.when(F.col("id") % 8 == 0, "merge_approved").otherwise("merge_rejected").alias("decision"), F.col("a").alias("target_id"), F.to_json(F.struct(F.col("id").alias("original_decision_id"))).alias("notes"))
    return materialize(made.unionByName(done))


def _open(s: SparkSession, d: str) -> DataFrame:
    return review.proposals(_decisions(s, d), table(s, d, "persons"), c.fingerprints(s, d))


@query(f"WITH {_PROPOSED} SELECT id FROM props WHERE id % 4 = 0")
def actioned_proposals(s: SparkSession, d: str) -> DataFrame:
    """Proposals that an approval or a rejection closed."""
    return review.actioned(_decisions(s, d))


@query(f"WITH {_PROPOSED} SELECT id, decision, a, b, confidence, stale_reason, stale_reason IS NOT NULL AS stale FROM open")
def open_proposals(s: SparkSession, d: str) -> DataFrame:
    """G4, G9"""
    return _open(s, d).select("id", "decision", "a", "b", "confidence", "stale_reason", "stale")


@query(f"WITH {_PROPOSED} SELECT a AS keep, b AS merge FROM open WHERE id = (SELECT min(id) FROM open WHERE decision = 'agent_proposed_merge' AND stale_reason IS NULL)")
def approved_proposal(s: SparkSession, d: str) -> DataFrame:
    """The first fresh proposal."""
    o = materialize(_open(s, d))
    first = o.where("decision = 'agent_proposed_merge' and not stale").agg(F.min("id")).first()[0]
    return s.createDataFrame([review.approve(o, first)] if first is not None else [], "keep bigint, merge bigint")


@query(f"""
WITH RECURSIVE {_PROPOSED}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM open WHERE decision = 'agent_proposed_merge'),
fold AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS touched, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome
  UNION ALL SELECT rn, CASE WHEN outcome = 'approved' THEN list_concat(touched, [a, b]) ELSE touched END, id, outcome FROM (SELECT o.rn, f.touched, o.id, o.a, o.b,
    CASE WHEN o.confidence < 0.9 THEN 'below_confidence' WHEN o.stale_reason IS NOT NULL THEN 'stale: ' || o.stale_reason WHEN list_has_any(f.touched, [o.a, o.b]) THEN 'stale: changed' ELSE 'approved' END AS outcome FROM fold f JOIN o ON o.rn = f.rn + 1))
SELECT id, outcome FROM fold WHERE id IS NOT NULL
""")
def approved_in_bulk(s: SparkSession, d: str) -> DataFrame:
    """In the order of ids, a merge making the other proposals of its persons stale."""
    return review.approve_bulk(_open(s, d)).select("id", "outcome")


@query("SELECT doc_id, relpath, status FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def document_detail(s: SparkSession, d: str) -> DataFrame:
    """F11"""
    docs = table(s, d, "documents").select("doc_id", "relpath", "status")
    return exposure.document(docs, docs.agg(F.max("doc_id")).first()[0])


# ---------------------------------------------------------------- model tier

_LABELS = ", ".join("'" + w.replace("'", "''") + "'" for w in Profile().label_words)
_LEAD = alternation(Profile().label_words).replace("'", "''")


def _found(chars: int, confidence: str) -> str:
    """Elements of the stand-in over the pieces of a text."""
    step = chars - model_tier.OVERLAP
    quoted = {k: p.replace("'", "''") for k, p in model_tier.HINTS.items()}
    hints = " UNION ALL ".join(f"SELECT doc_id, text, piece, '{k}' AS category, regexp_extract(piece, '{p}', 1) AS m, regexp_extract(piece, '{p}', 0) AS passage FROM pieces WHERE regexp_matches(piece, '{p}')" for k, p in quoted.items())
    return f"""
    WITH pieces AS (SELECT doc_id, text, substring(text, i + 1, {chars}) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - {model_tier.OVERLAP}), {step})) AS i FROM docs)),
    h AS ({hints}),
    v AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(m), '[.,;:]+$', '')), '(?i)^(?:{_LEAD})\\s*[:=]\\s*', '')) AS value FROM h)
    SELECT DISTINCT doc_id, text, category, value, passage, {confidence} AS confidence FROM v WHERE value <> '' AND lower(value) NOT IN ({_LABELS}) AND contains(lower(text), lower(value))
    QUALIFY row_number() OVER (PARTITION BY doc_id, category, lower(trim(value)) ORDER BY length(passage)) = 1
    """


def _unit(extra: str = "") -> str:
    return f"(CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || category{extra}), 14) AS BIGINT) / 72057594037927936.0)"


_CHEAP = f"round(0.55 + 0.42 * {_unit()}, 2)"
_STRONG_EXTRA = " || chr(0) || 'strong'"
_STRONG = f"round(least(0.99, 0.55 + 0.42 * {_unit()} + 0.15 + 0.15 * {_unit(_STRONG_EXTRA)}), 2)"


@query(f"""
WITH docs AS (SELECT doc_id, text FROM documents WHERE status = 'parsed' AND text IS NOT NULL),
one AS ({_found(model_tier.CHEAP_CHARS, _CHEAP)}),
unsure AS (SELECT DISTINCT doc_id FROM one WHERE confidence < {model_tier.ESCALATE_BELOW}),
two AS ({_found(model_tier.STRONG_CHARS, _STRONG)}),
sure AS (SELECT * FROM one WHERE confidence >= {model_tier.ESCALATE_BELOW} OR doc_id NOT IN (SELECT doc_id FROM unsure)),
every AS (SELECT *, 0 AS r FROM sure UNION ALL SELECT two.*, 1 FROM two WHERE doc_id IN (SELECT doc_id FROM unsure) AND NOT EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = two.doc_id AND s.category = two.category AND lower(s.value) = lower(two.value)))
SELECT doc_id AS document_id, CAST(position(value IN text) - 1 AS INTEGER) AS char_start, CAST(position(value IN text) - 1 + length(value) AS INTEGER) AS char_end, category, value AS raw_value, confidence, CASE WHEN doc_id IN (SELECT doc_id FROM unsure) THEN 'llm_strong' ELSE 'llm_cheap' END AS method
FROM every WHERE position(value IN text) > 0 AND NOT EXISTS (SELECT 1 FROM extractions e WHERE e.document_id = every.doc_id AND e.category = every.category AND lower(trim(e.normalized_value)) = lower(trim(every.value)))
""")
def model_rows(s: SparkSession, d: str) -> DataFrame:
    """L1-L11 with the stand-in: cheap model, escalation, offsets, rows that are not stored yet."""
    docs = table(s, d, "documents").where("status = 'parsed' and text is not null")
    found = model_tier.new_rows(model_tier.rows(model_tier.tier(docs, model_tier.ALLOWED)), table(s, d, "extractions"))
    return found.where("char_start is not null").select("document_id", "char_start", "char_end", "category", "raw_value", "confidence", "method")


# ---------------------------------------------------------------- scoring

_MANIFEST = {"ssn": "ssn", "dob": "dob", "home_address": "home_address", "phone": "phone", "email": "email", "card_number": "card_on_file", "full_name_variant": "full_name"}


@query(" UNION ALL ".join(f"SELECT d.relpath, '{score.FIELDS[f]}' AS category, r.{x} AS value, r.ssn AS person_id, r.card_on_file IS NULL AS is_third_party FROM roster_rows r JOIN documents d ON d.doc_id = r.document_id WHERE r.ssn IS NOT NULL" for f, x in _MANIFEST.items()))
def manifest_plants(s: SparkSession, d: str) -> DataFrame:
    """H1: a manifest made of the rosters, with traps and values of nobody."""
    r = table(s, d, "roster_rows").join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "relpath"), "document_id")
    plant = lambda field, value, trap: F.struct(F.lit(field).alias("field"), value.alias("value"), F.coalesce("ssn", F.lit("NONE")).alias("person_id"), F.lit(trap).alias("is_false_positive_trap"), F.col("card_on_file").isNull().alias("is_third_party"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("context_style"))
    plants = F.array(*[plant(f, F.col(x), False) for f, x in _MANIFEST.items()], plant("ssn", F.col("order_ref"), True))
    return score.plants(r.select(F.array(F.struct("relpath", plants.alias("plants"))).alias("documents"))).select("relpath", "category", "value", "person_id", "is_third_party")


@query("""
WITH e AS (SELECT d.relpath, e.* FROM extractions e JOIN documents d ON d.doc_id = e.document_id),
t AS (SELECT DISTINCT relpath, CASE WHEN category IN ('phone', 'email') THEN normalized_value ELSE raw_value END AS value, coalesce(page_number, 1) AS page FROM e),
r AS (SELECT relpath, raw_value AS value, arg_min(struct_pack(p := page_number), id) AS p FROM e GROUP BY 1, 2), n AS (SELECT relpath, normalized_value AS value, arg_min(struct_pack(p := page_number), id) AS p FROM e GROUP BY 1, 2)
SELECT coalesce(r.p, n.p).p - t.page AS page_offset, count(*) AS n FROM t LEFT JOIN r USING (relpath, value) LEFT JOIN n USING (relpath, value) WHERE r.p IS NOT NULL OR n.p IS NOT NULL GROUP BY 1
""")
def page_attribution(s: SparkSession, d: str) -> DataFrame:
    """H7"""
    ex, docs = table(s, d, "extractions"), table(s, d, "documents")
    e = ex.join(docs.select(F.col("doc_id").alias("document_id"), "relpath"), "document_id")
    truth = e.select("relpath", F.when(F.col("category").isin("phone", "email"), F.col("normalized_value")).otherwise(F.col("raw_value")).alias("value"), F.coalesce("page_number", F.lit(1)).alias("page"))
    return score.page_scores(truth, ex, docs)


@query("WITH p AS (SELECT DISTINCT relpath, category, value FROM (" + " UNION ALL ".join(f"SELECT d.relpath, '{score.FIELDS[f]}' AS category, r.{x} AS value FROM roster_rows r JOIN documents d ON d.doc_id = r.document_id WHERE r.ssn IS NOT NULL AND r.card_on_file IS NULL" for f, x in _MANIFEST.items()) + """)),
x AS (SELECT DISTINCT e.id FROM extractions e JOIN documents d ON d.doc_id = e.document_id JOIN entity_links l ON l.extraction_id = e.id JOIN p ON p.relpath = d.relpath AND p.category = e.category AND (p.value = e.normalized_value OR p.value = e.raw_value))
SELECT (SELECT count(*) FROM p) AS planted, (SELECT count(*) FROM x) AS linked
""")
def third_party_links(s: SparkSession, d: str) -> DataFrame:
    """H8: rows without a card are taken for third parties."""
    return score.contamination(manifest_plants(s, d), table(s, d, "entity_links"), table(s, d, "extractions"), table(s, d, "documents"))
