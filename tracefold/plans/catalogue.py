"""Queries of the engine's operators over the driver's tables, and SQL that gives the same rows. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import names, spans, values
from tracefold.operators import detect, exposure, ingest, model_tier, parse, resolve, review, score
from tracefold.operators.profile import SHARED_MAILBOXES, Profile
from tracefold.plans import detector_sql
from tracefold.runtime import materialize, table
from tracefold.sources.corpus import skip_existing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text_of(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


# ---------------------------------------------------------------- exposure

_FLAGS = """
flags AS (SELECT l.person_id, e.category, max(e.confidence) AS confidence, count(*) AS evidence_count,
                 CASE WHEN max(e.confidence) >= 0.75 THEN 'auto_accepted' ELSE 'needs_review' END AS review_status
          FROM entity_links l JOIN extractions e ON e.id = l.extraction_id
          WHERE e.category <> 'full_name' AND NOT coalesce(e.suppressed_as_false_positive, false) GROUP BY ALL)
"""
_REFS = """
refs AS (SELECT l.person_id, e.category, e.normalized_value, l.confidence,
                CASE WHEN e.page_number IS NOT NULL THEN d.relpath || '#p' || e.page_number ELSE d.relpath END AS ref
         FROM entity_links l JOIN extractions e ON e.id = l.extraction_id JOIN documents d ON d.doc_id = e.document_id
         WHERE NOT coalesce(e.suppressed_as_false_positive, false))
"""


@query(f"WITH {_FLAGS} SELECT * FROM flags")
def exposure_flags(s: SparkSession, d: str) -> DataFrame:
    """F1"""
    return exposure.flags(table(s, d, "entity_links"), table(s, d, "extractions"))


@query("SELECT l.person_id, e.category, l.extraction_id FROM entity_links l JOIN extractions e ON e.id = l.extraction_id WHERE e.category <> 'full_name' AND NOT coalesce(e.suppressed_as_false_positive, false)")
def flag_evidence(s: SparkSession, d: str) -> DataFrame:
    """F1"""
    return exposure.flag_evidence(table(s, d, "entity_links"), table(s, d, "extractions"))


@query("""
WITH page AS (SELECT * FROM persons p WHERE best_known_full_name ILIKE '%an%' AND EXISTS (SELECT 1 FROM exposure_flags f WHERE f.person_id = p.id AND f.category = 'ssn') ORDER BY id LIMIT 50 OFFSET 5)
SELECT id, best_known_full_name, array_to_string(list_sort(list_distinct((SELECT list(category) FROM exposure_flags f WHERE f.person_id = page.id))), '|') AS flag_categories FROM page
""")
def persons_list(s: SparkSession, d: str) -> DataFrame:
    """the page is the feature."""
    return exposure.list_persons(table(s, d, "persons"), table(s, d, "exposure_flags"), "an", "ssn", 5, 50).select("id", "best_known_full_name", text_of(F.col("flag_categories")).alias("flag_categories"))


@query("""
SELECT 'flags_by_category' AS measure, category AS key, count(*) AS n FROM exposure_flags GROUP BY 2
UNION ALL SELECT 'persons_by_status', review_status, count(*) FROM persons GROUP BY 2
UNION ALL SELECT 'persons', 'all', count(*) FROM persons
UNION ALL SELECT 'persons_to_review', 'all', count(DISTINCT person_id) FROM exposure_flags WHERE review_status = 'needs_review'
""")
def persons_summary(s: SparkSession, d: str) -> DataFrame:
    """F3"""
    return exposure.summary(table(s, d, "persons"), table(s, d, "exposure_flags"))


@query(f"WITH {_REFS} SELECT * FROM refs")
def source_refs(s: SparkSession, d: str) -> DataFrame:
    """F4"""
    return exposure.source_refs(table(s, d, "entity_links"), table(s, d, "extractions"), table(s, d, "documents"))


@query(f"""
WITH {_REFS}
SELECT p.id, string_agg(DISTINCT r.normalized_value, '; ' ORDER BY r.normalized_value) AS aliases
FROM refs r JOIN persons p ON p.id = r.person_id WHERE r.category = 'full_name' AND r.normalized_value <> p.best_known_full_name GROUP BY p.id
""")
def aliases(s: SparkSession, d: str) -> DataFrame:
    """F4"""
    return exposure.aliases(source_refs(s, d), table(s, d, "persons"))


_COUNTS = ", ".join(f"max(CASE WHEN f.category = '{c}' THEN coalesce(n.n, 0) END) AS {c}_evidence_count" for c in exposure.CATEGORIES)


@query(f"""
WITH {_REFS},
al AS (SELECT r.person_id AS id, string_agg(DISTINCT r.normalized_value, '; ' ORDER BY r.normalized_value) AS a FROM refs r JOIN persons p ON p.id = r.person_id WHERE r.category = 'full_name' AND r.normalized_value <> p.best_known_full_name GROUP BY 1),
low AS (SELECT person_id AS id, round(min(confidence), 3) AS c, count(DISTINCT split_part(ref, '#', 1)) FILTER (category <> 'full_name') AS docs FROM refs GROUP BY 1),
n AS (SELECT person_id, category, count(DISTINCT ref) AS n FROM refs GROUP BY ALL),
w AS (SELECT f.person_id AS id, {_COUNTS} FROM (SELECT DISTINCT person_id, category FROM exposure_flags) f LEFT JOIN n USING (person_id, category) GROUP BY 1)
SELECT p.id, p.person_uid, p.best_known_full_name, coalesce(al.a, '') AS known_aliases, p.dob, p.review_status, low.c AS resolution_confidence, coalesce(low.docs, 0) AS source_documents, w.* EXCLUDE (id)
FROM persons p LEFT JOIN al USING (id) LEFT JOIN low USING (id) LEFT JOIN w USING (id)
""")
def export_wide(s: SparkSession, d: str) -> DataFrame:
    """F5"""
    return exposure.export_wide(table(s, d, "persons"), table(s, d, "exposure_flags"), source_refs(s, d))


@query(f"""
WITH {_REFS}
SELECT p.person_uid, p.best_known_full_name, f.category, f.confidence, f.evidence_count, f.review_status,
  coalesce((SELECT string_agg(DISTINCT r.ref, '; ' ORDER BY r.ref) FROM refs r WHERE r.person_id = f.person_id AND r.category = f.category), '') AS refs
FROM exposure_flags f JOIN persons p ON p.id = f.person_id
""")
def export_long(s: SparkSession, d: str) -> DataFrame:
    """F6"""
    return exposure.export_long(table(s, d, "persons"), table(s, d, "exposure_flags"), source_refs(s, d))


@query("""
SELECT p.id, p.best_known_full_name, (SELECT count(*) FROM exposure_flags f WHERE f.person_id = p.id) AS n_flags FROM persons p WHERE p.id = (SELECT min(person_id) FROM exposure_flags)
""")
def person_detail(s: SparkSession, d: str) -> DataFrame:
    """F7"""
    f = table(s, d, "exposure_flags")
    first = f.agg(F.min("person_id")).first()[0]
    return exposure.person(table(s, d, "persons"), f, first).select("id", "best_known_full_name", F.size("flags").cast("bigint").alias("n_flags"))


@query("""
SELECT l.person_id, l.extraction_id, d.relpath, e.record_key, e.page_number, e.raw_value, e.method LIKE 'llm\\_%' ESCAPE '\\' AS page_is_approximate
FROM entity_links l JOIN extractions e ON e.id = l.extraction_id JOIN documents d ON d.doc_id = e.document_id WHERE e.category <> 'full_name' AND NOT coalesce(e.suppressed_as_false_positive, false)
""")
def evidence_places(s: SparkSession, d: str) -> DataFrame:
    """F8"""
    ev = flag_evidence(s, d)
    return exposure.evidence(ev, table(s, d, "extractions"), table(s, d, "documents")).select("person_id", "extraction_id", "relpath", "record_key", "page_number", "raw_value", "page_is_approximate")


@query("SELECT doc_id, relpath FROM documents WHERE status = 'quarantined' ORDER BY doc_id LIMIT 500 OFFSET 3")
def documents_list(s: SparkSession, d: str) -> DataFrame:
    """the page is the feature."""
    return exposure.list_documents(table(s, d, "documents").select("doc_id", "relpath", "status"), "quarantined", 3, 500).select("doc_id", "relpath")


@query("""
SELECT 'status' AS measure, status AS key, count(*) AS n FROM documents WHERE status IS NOT NULL GROUP BY 2
UNION ALL SELECT 'quarantine_reason', quarantine_reason, count(*) FROM documents WHERE quarantine_reason IS NOT NULL GROUP BY 2
""")
def documents_summary(s: SparkSession, d: str) -> DataFrame:
    """F10"""
    return exposure.document_summary(table(s, d, "documents"))


@query("SELECT id, status, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM runs ORDER BY id DESC LIMIT 50")
def runs_list(s: SparkSession, d: str) -> DataFrame:
    """F12"""
    return exposure.list_runs(table(s, d, "runs")).select("id", "status", "duration_seconds")


@query("SELECT quarantine_reason AS reason, sniffed_type AS file_type, count(*) AS n FROM documents WHERE quarantine_reason IS NOT NULL GROUP BY ALL")
def campaign_snapshot(s: SparkSession, d: str) -> DataFrame:
    """F13"""
    return exposure.snapshot(table(s, d, "documents"))


@query("""
SELECT CASE WHEN count(*) FILTER (quarantine_reason = 'password_protected') > 0 THEN 'exception_investigator' WHEN count(*) FILTER (status = 'parsed') > 0 THEN 'qa_auditor' ELSE 'none' END AS next_agent,
  coalesce(string_agg(DISTINCT sniffed_type || '/' || quarantine_reason, '|' ORDER BY sniffed_type || '/' || quarantine_reason) FILTER (quarantine_reason SIMILAR TO '(ocr_unavailable|corrupt_unreadable|zero_byte).*'), '') AS infra_escalations FROM documents
""")
def next_step(s: SparkSession, d: str) -> DataFrame:
    """F14"""
    return exposure.next_step(table(s, d, "documents")).select("next_agent", text_of(F.col("infra_escalations")).alias("infra_escalations"))


@query("""
WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, n, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, source) AS rank FROM g
""")
def share_of_total(s: SparkSession, d: str) -> DataFrame:
    """F15"""
    return exposure.shares(table(s, d, "documents"), "source")


@query("""
WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, greatest(v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], 1.0) AS scale FROM v
""")
def latency_scale(s: SparkSession, d: str) -> DataFrame:
    """F15"""
    return exposure.scale(table(s, d, "events"), "event_type", "value")


@query("""
SELECT DISTINCT category, CASE category WHEN 'ssn' THEN 'SSN' WHEN 'dob' THEN 'DOB' ELSE upper(category[1]) || replace(category[2:], '_', ' ') END AS label FROM extractions
""")
def category_labels(s: SparkSession, d: str) -> DataFrame:
    """F16"""
    return table(s, d, "extractions").select("category").distinct().withColumn("label", exposure.category_label(F.col("category")))


# ---------------------------------------------------------------- detection

_MAILBOXES = ", ".join(f"'{m}'" for m in SHARED_MAILBOXES)


def _hits(s: SparkSession, d: str, *which: str) -> DataFrame:
    return detect.detect(table(s, d, "documents").select("doc_id", "text"), names=list(which))


@query(f"""
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{detect.EMAIL}')) AS raw_value FROM documents)
SELECT doc_id, raw_value, lower(raw_value) AS normalized_value, lower(split_part(raw_value, '@', 1)) IN ({_MAILBOXES}) AS suppressed FROM h
""")
def detect_email(s: SparkSession, d: str) -> DataFrame:
    """C3"""
    return _hits(s, d, "email").select("doc_id", "raw_value", "normalized_value", "suppressed")


@query(f"""
WITH s AS (SELECT doc_id, text, string_split_regex(text, '{detect.EMAIL}') AS p, regexp_extract_all(text, '{detect.EMAIL}') AS m FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM s)
SELECT doc_id, m[i] AS raw_value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS char_start FROM r
""")
def match_offsets(s: SparkSession, d: str) -> DataFrame:
    """E1"""
    return _hits(s, d, "email").select("doc_id", "raw_value", "char_start")


_LUHN = "(list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 1 THEN CASE WHEN CAST(v[i] AS INT) > 4 THEN 2 * CAST(v[i] AS INT) - 9 ELSE 2 * CAST(v[i] AS INT) END ELSE CAST(v[i] AS INT) END)) % 10 = 0)"


@query(f"""
WITH h AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{detect.CARD}')), '[ -]', '', 'g') AS v FROM documents)
SELECT doc_id, v AS normalized_value, v IN ({", ".join(f"'{c}'" for c in detect.TEST_CARDS)}) AS suppressed FROM h WHERE length(v) IN (15, 16) AND {_LUHN}
""")
def detect_card(s: SparkSession, d: str) -> DataFrame:
    """C8, C9"""
    return _hits(s, d, "card").select("doc_id", "normalized_value", "suppressed")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{detect.LICENSE}')) AS raw_value FROM documents")
def detect_license(s: SparkSession, d: str) -> DataFrame:
    """C12"""
    return _hits(s, d, "drivers_license").select("doc_id", "raw_value")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{detect.PASSPORT}', 1)) AS raw_value FROM documents")
def detect_passport(s: SparkSession, d: str) -> DataFrame:
    """C13"""
    return _hits(s, d, "passport").select("doc_id", "raw_value")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{detect.CARD_MASKED}', 1)) AS raw_value, 'card_masked' AS detector FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{detect.SSN_PARTIAL}', 1)), 'ssn_partial' FROM documents")
def detect_partial(s: SparkSession, d: str) -> DataFrame:
    """C2, C10"""
    return _hits(s, d, "card_masked", "ssn_partial").select("doc_id", "raw_value", "detector")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{detect.SSN}')) AS raw_value FROM documents")
def detect_ssn(s: SparkSession, d: str) -> DataFrame:
    """C1; its suppression is held against a brute-force version in the tests."""
    return _hits(s, d, "ssn").select("doc_id", "raw_value")


_HIT = ["doc_id", "detector", "category", "raw_value", "normalized_value", "passage", "confidence", "method", "is_partial", "suppressed", "char_start", "char_end"]


def _detector(name: str, what: str) -> None:
    @query(f"WITH {detector_sql.every('documents', names=[name])} SELECT * FROM hits")
    def one(s: SparkSession, d: str) -> DataFrame:
        return _hits(s, d, name).select(*_HIT)

    QUERIES[f"hits_{name}"], SQL[f"hits_{name}"] = QUERIES.pop("one"), SQL.pop("one")
    QUERIES[f"hits_{name}"].__doc__ = what


for _name, _what in {"ssn": "C1 with suppression", "phone": "C4, C5", "dob": "C6, C7", "ending_in": "C11", "name": "C14", "address": "C15", "account": "C16", "login": "C17, C18"}.items():
    _detector(_name, _what)


@query(f"WITH {detector_sql.every('documents')} SELECT * FROM hits")
def detect_all(s: SparkSession, d: str) -> DataFrame:
    """All detectors in one pass over documents."""
    return _hits(s, d, *[x.name for x in detect.detectors()]).select(*_HIT)


@query(f"WITH {detector_sql.every('documents')} SELECT source, lang, category, count(*) AS n, count(*) FILTER (suppressed) AS suppressed FROM hits JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id) GROUP BY 1, 2, 3")
def hits_by_source(s: SparkSession, d: str) -> DataFrame:
    """Hits by source, language and category."""
    docs = table(s, d, "documents").select("doc_id", "source", "lang", "text")
    return detect.detect(docs).groupBy("source", "lang", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("suppressed").alias("suppressed"))


_MORE = '{"name_labels": ["alternate spelling", "patient"], "login_labels": ["login username"], "shared_mailboxes": ["privacy"]}'


@query(f"WITH {detector_sql.every('documents', Profile.parse(_MORE), ['name', 'login', 'email'])} SELECT * FROM hits")
def detect_profiled(s: SparkSession, d: str) -> DataFrame:
    """A profile adds labels and mailboxes to the built-in ones."""
    return detect.detect(table(s, d, "documents").select("doc_id", "text"), profile=Profile.parse(_MORE), names=["name", "login", "email"]).select(*_HIT)


@query(r"""
WITH h AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l, v FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^[ \t]*([A-Za-z][A-Za-z /''&-]{2,40}?)[ \t]*(?::|\.{2,}|=)[ \t]*(\S.*)$', 1) AS l, regexp_extract_all(text, '(?m)^[ \t]*([A-Za-z][A-Za-z /''&-]{2,40}?)[ \t]*(?::|\.{2,}|=)[ \t]*(\S.*)$', 2) AS v FROM documents)),
r AS (SELECT doc_id, i, lower(regexp_replace(trim(l[i]), '\s+', ' ', 'g')) AS label, left(trim(v[i]), 60) AS example FROM h),
g AS (SELECT label, count(*) AS occurrences, arg_min(example, doc_id * 100000 + i) AS example, min(doc_id * 100000 + i) AS f FROM r WHERE length(label) >= 3 GROUP BY 1 ORDER BY 2 DESC, 4 LIMIT 60)
SELECT label, occurrences, example FROM g WHERE occurrences >= 3
""")
def discover_labels(s: SparkSession, d: str) -> DataFrame:
    """The top is the feature."""
    return detect.discover_labels(table(s, d, "documents"))


@query(r"""
WITH p AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(raw_value, '(?i)\s?(?:x|ext\.?)\s?\d+\s*$', ''), '\D', '', 'g'), '^00', '') AS d FROM extractions WHERE category = 'phone')
SELECT id, CASE WHEN length(d) > 10 AND d LIKE '1%' THEN d[2:] ELSE d END AS digits FROM p
""")
def phone_normalize(s: SparkSession, d: str) -> DataFrame:
    """C5"""
    return table(s, d, "extractions").where("category = 'phone'").select("id", values.phone(F.col("raw_value")).alias("digits"))


@query("""
WITH b AS (SELECT id, try_cast(normalized_value AS DATE) AS day, lower(passage) SIMILAR TO '.*(dob|birth|born).*' OR regexp_matches(lower(passage), 'dob|birth|born') AS ctx FROM extractions WHERE category = 'dob')
SELECT id, coalesce(day IS NOT NULL AND day <= DATE '2026-01-01' AND date_diff('day', day, DATE '2026-01-01') / 365.2425 <= 120 AND (date_diff('day', day, DATE '2026-01-01') / 365.2425 >= 16 OR ctx), false) AS plausible FROM b
""")
def birth_plausible(s: SparkSession, d: str) -> DataFrame:
    """C7"""
    e = table(s, d, "extractions").where("category = 'dob'")
    return e.select("id", F.coalesce(values.plausible_birth(F.col("normalized_value"), F.lower("passage").rlike("dob|birth|born"), F.to_date(F.lit("2026-01-01"))), F.lit(False)).alias("plausible"))


# ---------------------------------------------------------------- triage and records


@query("""
WITH f AS (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS first FROM documents),
r AS (SELECT doc_id, CASE WHEN sha256 = '' THEN 'zero_byte' WHEN first < doc_id THEN 'duplicate_of_document_' || first END AS reason, quarantine_reason, status FROM f)
SELECT doc_id, coalesce(reason, quarantine_reason) AS quarantine_reason, CASE WHEN coalesce(reason, quarantine_reason) IS NOT NULL THEN 'quarantined' ELSE coalesce(status, 'pending') END AS status FROM r
""")
def dedup_quarantine(s: SparkSession, d: str) -> DataFrame:
    """A4, A5"""
    return ingest.quarantine_duplicates(table(s, d, "documents").select("doc_id", "sha256", "quarantine_reason", "sniffed_type", "status")).select("doc_id", "quarantine_reason", "status")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT h AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY 1
""")
def content_hash(s: SparkSession, d: str) -> DataFrame:
    """A3"""
    return table(s, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, relpath FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.relpath = d.relpath AND e.run_id <= 20)")
def skip_known(s: SparkSession, d: str) -> DataFrame:
    """A2: what a run finds new if the documents of earlier runs are known."""
    docs = table(s, d, "documents").select("doc_id", "relpath", "run_id")
    return skip_existing(docs, docs.where("run_id <= 20")).select("doc_id", "relpath")


@query("""
SELECT doc_id, regexp_matches(lower(ltrim(text)), '^(<!doctype html|<html)') AS html, len(list_filter(string_split(text, chr(10))[1:6], lambda x: regexp_matches(lower(x), '^(from|to|subject|date|mime-version|content-type):'))) >= 2 AS mail FROM documents WHERE text IS NOT NULL
""")
def sniff_text(s: SparkSession, d: str) -> DataFrame:
    """A9, A11"""
    return table(s, d, "documents").where("text is not null").select("doc_id", ingest.html_like(F.col("text")).alias("html"), ingest.mail_like(F.col("text")).alias("mail"))


_CELLS = [("Full Name", "full_name"), ("SSN", "ssn"), ("DOB", "dob"), ("Home Address", "home_address"), ("Phone", "phone"), ("Email", "email"), ("Card on File", "card_on_file"), ("Order Ref (not PII)", "order_ref")]


@query("SELECT row_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN '{h}: ' || trim({c}) END" for h, c in _CELLS) + "], lambda x: x IS NOT NULL), ' | ') AS text FROM roster_rows")
def row_labels(s: SparkSession, d: str) -> DataFrame:
    """B4"""
    return table(s, d, "roster_rows").select("row_id", parse.label_row(F.array(*[F.lit(h) for h, _ in _CELLS]), F.array(*[F.col(c) for _, c in _CELLS])).alias("text"))


@query("""
SELECT e.id, CASE WHEN e.char_start >= 0 AND len(p.page_spans) > 0 THEN coalesce(list_filter(p.page_spans, lambda x: x.span_start <= e.char_start AND e.char_start < x.span_end)[1].page, list_filter(p.page_spans, lambda x: x.span_start <= e.char_start)[-1].page, p.page_spans[-1].page) END AS page
FROM extractions e JOIN parsed_records p ON p.document_id = e.document_id AND coalesce(p.record_key, '') = coalesce(e.record_key, '')
""")
def page_lookup(s: SparkSession, d: str) -> DataFrame:
    """B15"""
    p = table(s, d, "parsed_records").select("document_id", F.coalesce("record_key", F.lit("")).alias("key"), "page_spans")
    e = table(s, d, "extractions").select("id", "document_id", F.coalesce("record_key", F.lit("")).alias("key"), "char_start")
    return e.join(p, ["document_id", "key"]).select("id", spans.page_of(F.col("page_spans"), F.col("char_start")).alias("page"))


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS pages FROM documents WHERE text IS NOT NULL AND text <> ''), r AS (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS page, CAST(coalesce(list_sum(list_transform(pages[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS span_start, CAST(coalesce(list_sum(list_transform(pages[1:i - 1], lambda x: length(x) + 1)), 0) + length(pages[i]) AS INTEGER) AS span_end FROM r
""")
def page_maps(s: SparkSession, d: str) -> DataFrame:
    """Each paragraph taken as a page."""
    p = table(s, d, "documents").where("text <> ''").select("doc_id", F.explode(spans.page_map(F.split("text", "\n\n", -1))).alias("p"))
    return p.select("doc_id", "p.*")


# ---------------------------------------------------------------- resolution

_TOKENS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(trim(lower(replace(normalized_value, ',', ' ')), E' \t\n\r'), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^\.+', ''), '\.+$', '')), lambda w: length(w) > 1)))"
_E = "e AS (SELECT *, coalesce(record_key, '') AS k, min(id) OVER (PARTITION BY document_id, coalesce(record_key, '')) AS rid FROM extractions WHERE NOT coalesce(suppressed_as_false_positive, false) AND document_id IS NOT NULL)"
_KEYS = "keys AS (SELECT category, normalized_value AS value, count(DISTINCT document_id) AS docs FROM e WHERE category IN ('ssn', 'card_number', 'email', 'phone', 'drivers_license', 'passport') AND NOT coalesce(is_partial, false) AND normalized_value IS NOT NULL GROUP BY 1, 2)"
_DEMOTED = "demoted AS (SELECT category, value FROM keys WHERE docs >= (SELECT greatest(12, 4 * list_sort(list(docs))[len(list(docs)) // 2 + 1]) FROM keys))"
_GRAPH = f"""
{_E}, {_KEYS}, {_DEMOTED},
named AS (SELECT DISTINCT rid, array_to_string({_TOKENS}, ' ') AS t FROM e WHERE category = 'full_name'),
ties AS (SELECT DISTINCT category || chr(1) || normalized_value AS key, rid FROM e WHERE category IN ('ssn', 'card_number', 'email', 'phone', 'drivers_license', 'passport') AND NOT coalesce(is_partial, false) AND NOT EXISTS (SELECT 1 FROM demoted d WHERE d.category = e.category AND d.value = e.normalized_value)
         UNION SELECT DISTINCT 'n' || n.t || chr(1) || b.normalized_value, n.rid FROM named n JOIN e b ON b.rid = n.rid AND b.category = 'dob' WHERE n.t <> ''),
low AS (SELECT key, min(rid) AS low FROM ties GROUP BY 1),
edge AS (SELECT DISTINCT rid AS a, low AS b FROM ties JOIN low USING (key) UNION SELECT DISTINCT low, rid FROM ties JOIN low USING (key)),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, x.b FROM reach r JOIN edge x ON x.a = r.b),
root AS (SELECT rid, coalesce((SELECT min(b) FROM reach WHERE a = rid), rid) AS root FROM (SELECT DISTINCT rid FROM e))
"""


def _e(s: SparkSession, d: str) -> DataFrame:
    return resolve.record_ids(table(s, d, "extractions"))


@query(f"SELECT DISTINCT normalized_value, array_to_string({_TOKENS}, ' ') AS tokens FROM extractions WHERE category = 'full_name'")
def name_tokens(s: SparkSession, d: str) -> DataFrame:
    """D2"""
    return table(s, d, "extractions").where("category = 'full_name'").select("normalized_value", text_of(names.tokens(F.col("normalized_value")), " ").alias("tokens")).distinct()


@query(f"WITH {_E}, {_KEYS} SELECT greatest(12, 4 * list_sort(list(docs))[len(list(docs)) // 2 + 1]) AS \"limit\" FROM keys")
def upper_median_threshold(s: SparkSession, d: str) -> DataFrame:
    """D7"""
    return resolve.threshold(resolve.strong_keys(_e(s, d)), "docs", 12, 4)


@query(f"WITH {_E}, {_KEYS}, {_DEMOTED} SELECT * FROM demoted")
def demoted_keys(s: SparkSession, d: str) -> DataFrame:
    """D7"""
    return resolve.demoted_keys(_e(s, d))


@query(f"""
WITH {_E}, tok AS (SELECT id, document_id, unnest({_TOKENS}) AS token FROM e WHERE category = 'full_name'),
docs AS (SELECT token, count(DISTINCT document_id) AS docs FROM tok GROUP BY 1),
cand AS (SELECT token FROM docs WHERE docs >= (SELECT greatest(12, 6 * list_sort(list(docs))[len(list(docs)) // 2 + 1]) FROM docs)),
hit AS (SELECT DISTINCT id, token FROM tok JOIN cand USING (token)), size AS (SELECT id, count(*) AS n FROM hit GROUP BY 1)
SELECT token FROM hit JOIN size USING (id) GROUP BY 1 HAVING count(*) FILTER (n >= 2) > count(*) FILTER (n < 2)
""")
def chrome_tokens(s: SparkSession, d: str) -> DataFrame:
    """D4, D5"""
    return resolve.chrome_tokens(_e(s, d))


@query(f"WITH RECURSIVE {_GRAPH} SELECT rid, root FROM root")
def connected_records(s: SparkSession, d: str) -> DataFrame:
    """D7-D10"""
    return resolve.clusters(_e(s, d))[0]


_ROLES = "er AS (SELECT e.*, root.root FROM e JOIN root USING (rid)), roles AS (SELECT n.v AS name FROM (SELECT DISTINCT normalized_value AS v, root FROM er WHERE category = 'full_name') n LEFT JOIN (SELECT DISTINCT root, normalized_value AS dob FROM er WHERE category = 'dob') b USING (root) GROUP BY 1 HAVING count(DISTINCT n.root) >= 3 AND count(DISTINCT b.dob) >= 3)"


@query(f"WITH RECURSIVE {_GRAPH}, {_ROLES} SELECT name FROM roles")
def role_names(s: SparkSession, d: str) -> DataFrame:
    """D11"""
    e = materialize(_e(s, d))
    return resolve.role_names(e.join(resolve.clusters(e)[0], "rid"))


@query(f"""
WITH RECURSIVE {_GRAPH}, {_ROLES},
p AS (SELECT root, min(id) AS f, arg_min(normalized_value, id) FILTER (category = 'dob') AS dob,
  (list(normalized_value ORDER BY length(normalized_value) DESC, id) FILTER (category = 'full_name' AND normalized_value NOT IN (SELECT name FROM roles)))[1] AS best FROM er GROUP BY 1)
SELECT row_number() OVER (ORDER BY f) AS person_id, printf('RP-%05d', row_number() OVER (ORDER BY f)) AS person_uid, coalesce(best, 'Unknown') AS best_known_full_name, dob, CASE WHEN best IS NULL THEN 'needs_review' ELSE 'auto_accepted' END AS review_status FROM p
""")
def resolved_persons(s: SparkSession, d: str) -> DataFrame:
    """D1, D12"""
    return resolve.resolve(table(s, d, "extractions"), chrome=False)[0]


@query(f"""
WITH RECURSIVE {_GRAPH}, er AS (SELECT e.*, root.root FROM e JOIN root USING (rid)), p AS (SELECT root, row_number() OVER (ORDER BY min(id)) AS person_id FROM er GROUP BY 1)
SELECT er.id AS extraction_id, p.person_id, er.confidence FROM er JOIN p USING (root) WHERE NOT EXISTS (SELECT 1 FROM demoted d WHERE d.category = er.category AND d.value = er.normalized_value)
""")
def resolved_links(s: SparkSession, d: str) -> DataFrame:
    """D13"""
    return resolve.resolve(table(s, d, "extractions"), chrome=False)[1].select("extraction_id", "person_id", "confidence")


def _people(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "persons").withColumnRenamed("id", "person_id")


@query(r"""
WITH k AS (SELECT DISTINCT e.normalized_value AS v, l.person_id AS p, 0 AS r, 'shared_address' AS signal FROM entity_links l JOIN extractions e ON e.id = l.extraction_id WHERE e.category = 'home_address' AND e.normalized_value IS NOT NULL
  UNION ALL SELECT array_to_string(list_sort(list_filter(regexp_split_to_array(lower(replace(best_known_full_name, ',', ' ')), '\s+'), lambda w: w <> '')), ' '), id, 1, 'same_name' FROM persons WHERE best_known_full_name <> 'Unknown')
SELECT x.p AS a, y.p AS b, arg_min(x.signal, x.r) AS signal FROM k x JOIN k y ON x.v = y.v AND x.signal = y.signal AND x.p < y.p GROUP BY 1, 2
""")
def candidate_pairs(s: SparkSession, d: str) -> DataFrame:
    """D15"""
    return resolve.candidate_pairs(_people(s, d), table(s, d, "entity_links"), table(s, d, "extractions"), most=None)


# ---------------------------------------------------------------- review


@query("SELECT id, person_id, category, confidence FROM exposure_flags WHERE review_status = 'needs_review' AND person_id IN (SELECT id FROM persons) ORDER BY confidence, id LIMIT 100")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    """G1: the top is the feature."""
    return review.queue(table(s, d, "exposure_flags"), table(s, d, "persons")).select("id", "person_id", "category", "confidence")


@query("""
WITH r AS (SELECT DISTINCT l.person_id, e.document_id, coalesce(e.record_key, '') AS k FROM entity_links l JOIN extractions e ON e.id = l.extraction_id)
SELECT person_id, left(sha256(string_agg(document_id || ':' || k, '|' ORDER BY document_id, k)), 16) AS fingerprint FROM r GROUP BY 1
""")
def fingerprints(s: SparkSession, d: str) -> DataFrame:
    """G8"""
    return review.fingerprints(table(s, d, "entity_links"), table(s, d, "extractions"))


@query("SELECT (SELECT count(*) FROM persons) AS persons, count(*) AS flags, count(*) FILTER (review_status = 'needs_review') AS flags_needing_review FROM exposure_flags")
def sign_off_state(s: SparkSession, d: str) -> DataFrame:
    """G10"""
    return review.sign_off_state(table(s, d, "persons"), table(s, d, "exposure_flags"))


def _flag_evidence(s: SparkSession, d: str) -> DataFrame:
    first = table(s, d, "exposure_flags").groupBy("person_id", "category").agg(F.min("id").alias("exposure_flag_id"))
    return flag_evidence(s, d).join(first, ["person_id", "category"])


_AUDIT = """
WITH ev AS (SELECT l.person_id, e.category, coalesce(contains(e.passage, e.normalized_value), false) AS ok FROM entity_links l JOIN extractions e ON e.id = l.extraction_id WHERE e.category <> 'full_name' AND NOT coalesce(e.suppressed_as_false_positive, false)),
first AS (SELECT min(id) AS id, person_id, category FROM exposure_flags GROUP BY 2, 3),
a AS (SELECT f.id, f.person_id, f.category, CASE WHEN bool_and(ev.ok) THEN 'verified' ELSE 'unsupported' END AS verdict FROM exposure_flags f LEFT JOIN first USING (id) LEFT JOIN ev ON ev.person_id = first.person_id AND ev.category = first.category GROUP BY 1, 2, 3)
"""


def _audit(s: SparkSession, d: str) -> DataFrame:
    flags = table(s, d, "exposure_flags")
    return review.audit(flags, _flag_evidence(s, d), table(s, d, "extractions"), sample=2**31 - 1)


@query(_AUDIT + "SELECT id, person_id, category, verdict FROM a")
def audit_flags(s: SparkSession, d: str) -> DataFrame:
    """G11, G12 for all flags"""
    return _audit(s, d)


@query(_AUDIT + "SELECT avg(CASE WHEN verdict <> 'verified' THEN 1.0 ELSE 0.0 END) AS error_rate FROM a")
def audit_error_rate(s: SparkSession, d: str) -> DataFrame:
    """G13"""
    return review.error_rate(_audit(s, d))


@query("SELECT doc_id, quarantine_reason, CASE quarantine_reason WHEN 'ocr_unavailable' THEN 'ocr_retry' WHEN 'password_protected' THEN 'password_recovery' ELSE 'escalate_unrecoverable' END AS strategy FROM documents WHERE status = 'quarantined' ORDER BY doc_id LIMIT 25")
def investigation(s: SparkSession, d: str) -> DataFrame:
    """The sample is the feature."""
    return review.investigate(table(s, d, "documents").select("doc_id", "quarantine_reason", "status")).select("doc_id", "quarantine_reason", "strategy")


# ---------------------------------------------------------------- model tier


@query("""
WITH done AS (SELECT document_id FROM extractions WHERE category IN ('medical', 'login_credentials') GROUP BY 1 HAVING count(DISTINCT category) = 2)
SELECT doc_id FROM documents WHERE status = 'parsed' AND doc_id NOT IN (SELECT document_id FROM done WHERE document_id IS NOT NULL)
""")
def model_candidates(s: SparkSession, d: str) -> DataFrame:
    """L2"""
    return model_tier.candidates(table(s, d, "documents"), table(s, d, "extractions"), ["medical", "login_credentials"]).select("doc_id")


@query("""
SELECT id, document_id, category, normalized_value, confidence FROM extractions WHERE method LIKE 'llm%' QUALIFY row_number() OVER (PARTITION BY document_id, category, lower(trim(normalized_value)) ORDER BY confidence DESC, id) = 1
""")
def surest_values(s: SparkSession, d: str) -> DataFrame:
    """L4"""
    e = table(s, d, "extractions").where("method like 'llm%'").select("id", "document_id", "category", "normalized_value", "confidence")
    return model_tier.surest(e, ["document_id", "category"], F.col("normalized_value"), "id")


@query("SELECT model, sum(tokens_in) AS tokens_in, sum(cost_usd) AS cost_usd FROM (SELECT model_used AS model, length(passage) AS tokens_in, CASE model_used WHEN 'model-large' THEN (length(passage) * 3.0 + 35 * 15.0) / 1e6 WHEN 'model-small' THEN (length(passage) * 0.5 + 35 * 1.5) / 1e6 ELSE 0 END AS cost_usd FROM extractions WHERE model_used IS NOT NULL) GROUP BY 1")
def model_cost(s: SparkSession, d: str) -> DataFrame:
    """L7"""
    steps = table(s, d, "extractions").where("model_used is not null").select(F.col("model_used").alias("model"), F.length("passage").alias("tokens_in"), F.lit(35).alias("tokens_out"))
    return model_tier.cost(steps, {"model-large": (3.0, 15.0), "model-small": (0.5, 1.5)}).groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("cost_usd").alias("cost_usd"))


@query(f"SELECT doc_id, left(text, {model_tier.CHEAP_CHARS}) AS text FROM documents WHERE text IS NOT NULL")
def truncated_text(s: SparkSession, d: str) -> DataFrame:
    """The cut is the feature."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.substring("text", 1, model_tier.CHEAP_CHARS).alias("text"))


# ---------------------------------------------------------------- scoring: the cells of rosters as planted values

_PLANTED = [("ssn", "ssn"), ("dob", "dob"), ("home_address", "home_address"), ("phone", "phone"), ("email", "email"), ("card_number", "card_on_file"), ("full_name", "full_name")]
_TRUTH = "t AS (" + " UNION ALL ".join(f"SELECT d.relpath, '{c}' AS category, r.{x} AS value, coalesce(r.ssn, 'row ' || r.row_id) AS person_id, d.lang AS context_style FROM roster_rows r JOIN documents d ON d.doc_id = r.document_id WHERE r.{x} IS NOT NULL" for c, x in _PLANTED) + ")"
_PRED = "p AS (SELECT DISTINCT l.person_id AS pred, e.category, v.value FROM entity_links l JOIN extractions e ON e.id = l.extraction_id, unnest([e.normalized_value, e.raw_value]) AS v(value))"
_VOTES = "n AS (SELECT tt.person_id, p.pred, count(*) AS hits FROM (SELECT DISTINCT person_id, category, value FROM t WHERE category <> 'full_name') tt JOIN p USING (category, value) GROUP BY 1, 2), m AS (SELECT person_id, pred, hits FROM n QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY hits DESC, pred) = 1)"


def _truth(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "roster_rows").join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "relpath", "lang"), "document_id")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(x).alias("value")) for c, x in _PLANTED])).alias("c")
    return r.select("relpath", F.coalesce("ssn", F.concat(F.lit("row "), "row_id")).alias("person_id"), F.col("lang").alias("context_style"), cells).select("relpath", "c.category", "c.value", "person_id", "context_style").where("value is not null")


@query(f"WITH {_TRUTH}, {_PRED}, {_VOTES} SELECT * FROM m")
def plurality_votes(s: SparkSession, d: str) -> DataFrame:
    """H2, H3"""
    return score.votes(_truth(s, d), score.predicted(table(s, d, "entity_links"), table(s, d, "extractions")))


@query(f"""
WITH {_TRUTH}, {_PRED}, {_VOTES}, g AS (SELECT pred, count(*) AS n FROM m GROUP BY 1)
SELECT coalesce(sum(n), 0)::BIGINT AS matched, count(*) FILTER (n > 1) AS merge_errors, coalesce(sum(n - 1), 0)::BIGINT AS people_lost, (SELECT count(DISTINCT person_id) FROM t) AS people,
  coalesce(sum(n), 0) / (SELECT count(DISTINCT person_id) FROM t) AS recall, (coalesce(sum(n), 0) - coalesce(sum(n - 1), 0)) / (SELECT count(*) FROM persons) AS precision FROM g
""")
def person_scores(s: SparkSession, d: str) -> DataFrame:
    """H4"""
    return score.person_scores(_truth(s, d), plurality_votes(s, d), table(s, d, "persons").count())


@query(f"""
WITH {_TRUTH}, {_PRED}, {_VOTES},
w AS (SELECT DISTINCT coalesce(CAST(m.pred AS VARCHAR), '?' || t.person_id) AS p, t.category FROM t LEFT JOIN m USING (person_id) WHERE t.category <> 'full_name'),
h AS (SELECT DISTINCT CAST(person_id AS VARCHAR) AS p, category FROM exposure_flags WHERE person_id IN (SELECT pred FROM m))
SELECT category, count(*) FILTER (w.p IS NOT NULL AND h.p IS NOT NULL) AS tp, count(*) FILTER (h.p IS NULL) AS fn, count(*) FILTER (w.p IS NULL) AS fp FROM w FULL JOIN h USING (p, category) GROUP BY 1
""")
def confusion_by_category(s: SparkSession, d: str) -> DataFrame:
    """H5"""
    return score.category_scores(_truth(s, d), plurality_votes(s, d), table(s, d, "exposure_flags")).select("category", "tp", "fn", "fp")


@query(rf"""
WITH {_TRUTH}, tv AS (SELECT DISTINCT category, value FROM t UNION SELECT DISTINCT category, CASE WHEN length(x) > 10 AND x LIKE '1%' THEN x[2:] ELSE x END FROM (SELECT category, regexp_replace(regexp_replace(regexp_replace(value, '(?i)\s?(?:x|ext\.?)\s?\d+\s*$', ''), '\D', '', 'g'), '^00', '') AS x FROM t WHERE category = 'phone')),
v AS (SELECT e.category, e.normalized_value AS value, bool_or((e.category, e.normalized_value) IN (SELECT (category, value) FROM tv) OR (e.category, e.raw_value) IN (SELECT (category, value) FROM tv)) AS ok FROM extractions e WHERE e.id IN (SELECT extraction_id FROM entity_links) GROUP BY 1, 2)
SELECT coalesce(category, '_overall') AS category, count(*) AS linked, count(*) FILTER (ok) AS corroborated FROM v GROUP BY ROLLUP (category)
""")
def value_precision(s: SparkSession, d: str) -> DataFrame:
    """H6"""
    return score.value_precision(table(s, d, "entity_links"), table(s, d, "extractions"), _truth(s, d)).select("category", "linked", "corroborated")


@query(f"""
WITH {_TRUTH}, x AS (SELECT DISTINCT d.relpath, e.category, v.value FROM extractions e JOIN documents d ON d.doc_id = e.document_id, unnest([e.normalized_value, e.raw_value]) AS v(value))
SELECT coalesce(context_style, 'unlabelled') AS context_style, count(*) AS planted, count(x.value) AS found FROM t LEFT JOIN x USING (relpath, category, value) GROUP BY 1
""")
def recall_by_style(s: SparkSession, d: str) -> DataFrame:
    """H9"""
    return score.style_recall(_truth(s, d), table(s, d, "extractions"), table(s, d, "documents"))


from tracefold.plans import file_queries, review_queries  # noqa: E402, F401  they add their queries
