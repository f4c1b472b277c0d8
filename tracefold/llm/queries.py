"""Queries of the problems, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import p1_names, p2_groups, p3_scans, p4_places, p5_copies, p6_matching, p7_pii, p8_tokens, p9_mixing, p10_repetition
from tracefold.runtime import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_names.variants(table(spark, d, "extractions"), table(spark, d, "persons"), table(spark, d, "entity_links"))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    ex, people = table(spark, d, "extractions"), table(spark, d, "persons")
    return p1_names.entities(materialize(p1_names.spellings(ex, people)), ex, table(spark, d, "entity_links"), people)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_groups.record_groups(table(spark, d, "entity_links"), table(spark, d, "extractions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scans.damaged(table(spark, d, "parsed_records"), table(spark, d, "documents"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return p3_scans.repaired(table(spark, d, "parsed_records"), table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_places.pairs(p4_places.address_records(table(spark, d, "roster_rows"), table(spark, d, "extractions")))


def p4_locations(spark: SparkSession, d: str) -> DataFrame:
    return p4_places.locations(p4_places.address_records(table(spark, d, "roster_rows"), table(spark, d, "extractions")))


def p4_candidates(spark: SparkSession, d: str) -> DataFrame:
    return p4_places.candidates(p4_places.address_records(table(spark, d, "roster_rows"), table(spark, d, "extractions")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_copies.copies(table(spark, d, "extractions"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return p5_copies.collapsed(table(spark, d, "extractions"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8_tokens.encode(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_scored(spark, d).select("person_id", "subject_id")


def p6_scored(spark: SparkSession, d: str) -> DataFrame:
    return p6_matching.matches(table(spark, d, "persons"), table(spark, d, "exposure_flags"), table(spark, d, "intake_subjects"))


def _p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return p7_pii.texts(table(spark, d, "parsed_records"), table(spark, d, "documents"), table(spark, d, "extractions"))


def _p7_names(spark: SparkSession, d: str) -> DataFrame:
    return p7_pii.name_words(table(spark, d, "extractions"), table(spark, d, "persons"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pii.spans(_p7_texts(spark, d), _p7_names(spark, d))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """The key is that of the tests; for data of one's own a secret one is passed to ``redact``."""
    return p7_pii.redact(_p7_texts(spark, d), "key of the tests", _p7_names(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return p9_mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return p9_mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_repetition.repetitive(table(spark, d, "documents"))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return p10_repetition.quality(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_text": p3_text,
    "p4_found": p4_found,
    "p4_locations": p4_locations,
    "p4_candidates": p4_candidates,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_found": p6_found,
    "p6_scored": p6_scored,
    "p7_found": p7_found,
    "p7_text": p7_text,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}

_P5_KEYED = """
WITH k AS (
  SELECT id, document_id, category,
         CASE WHEN category IN ('phone', 'ssn', 'card_number') THEN regexp_replace(raw_value, '[^\\p{Nd}]', '', 'g')
              ELSE array_to_string(list_sort(regexp_extract_all(lower(raw_value), '[\\p{L}\\p{N}]+')), ' ') END AS ckey
  FROM extractions
  WHERE category IN ('phone', 'ssn', 'card_number', 'full_name', 'home_address', 'email') AND NOT is_partial
    AND id IS NOT NULL AND document_id IS NOT NULL AND raw_value IS NOT NULL),
g AS (SELECT *, min(id) OVER w AS keep_id, count(*) OVER w AS n_copies FROM k WINDOW w AS (PARTITION BY document_id, category, ckey))
"""

SQL: dict[str, str] = {
    "p2_found": """
WITH RECURSIVE
pairs AS (SELECT DISTINCT e.document_id, coalesce(e.record_key, '') AS record_key, l.person_id
          FROM entity_links l JOIN extractions e ON e.id = l.extraction_id
          WHERE l.person_id IS NOT NULL AND e.document_id IS NOT NULL),
near AS (SELECT DISTINCT a.person_id AS a, b.person_id AS b FROM pairs a JOIN pairs b USING (document_id, record_key)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
low AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a)
SELECT DISTINCT document_id, record_key, group_id FROM pairs JOIN low ON low.a = person_id
""",
    "p5_found": _P5_KEYED + "SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p5_collapsed": _P5_KEYED + "SELECT id, document_id, category, n_copies FROM g WHERE id = keep_id",
}
