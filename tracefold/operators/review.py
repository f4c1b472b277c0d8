"""Review queue, merge proposals and their freshness, sign-off, audits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTES = "other_person_id long, confidence double, rationale string, person_a_fingerprint string, person_b_fingerprint string, person_a_name_at_proposal string, person_b_name_at_proposal string, original_decision_id long"
APPROVE_LEAST = 0.9


def queue(flags: DataFrame, people: DataFrame, limit: int = 100) -> DataFrame:
    """G1: the least certain flags to review with their persons; ties by id."""
    top = flags.where("review_status = 'needs_review'").orderBy("confidence", "id").limit(limit)
    return top.join(people.select(F.col("id").alias("person_id"), "person_uid", "best_known_full_name"), "person_id")


def decide(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """``flags`` with the latest decision on each: accepted ones are human_reviewed, others keep their status. Decisions on other things are refused."""
    if not decisions.where("target_type <> 'exposure_flag'").isEmpty():
        raise ValueError("only exposure flags can be decided on")
    last = latest(decisions).select(F.col("target_id").alias("id"), "decision")
    return flags.join(last, "id", "left").withColumn("review_status", F.when(F.col("decision") == "accept", "human_reviewed").otherwise(F.col("review_status"))).drop("decision")


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision on each target; of equally late ones that of the highest id."""
    return decisions.groupBy("target_type", "target_id").agg(F.max_by(F.struct(*[c for c in decisions.columns if c not in ("target_type", "target_id")]), F.struct("decided_at", "id")).alias("_d")).select("target_type", "target_id", "_d.*")


def actioned(decisions: DataFrame) -> DataFrame:
    """Ids of proposals that were approved or rejected, from a column or, in old rows, from the notes."""
    named = F.coalesce(F.col("original_decision_id"), F.get_json_object("notes", "$.original_decision_id").cast("bigint")) if "original_decision_id" in decisions.columns else F.get_json_object("notes", "$.original_decision_id").cast("bigint")
    return decisions.where(F.col("decision").rlike("(approved|rejected)")).select(named.alias("id")).where("id is not null").distinct()


def fingerprints(links: DataFrame, extractions: DataFrame) -> DataFrame:
    """person_id, fingerprint: 16 hex digits of the sha256 of ``document:key`` of the person's records, in order, joined by ``|``."""
    r = links.select("extraction_id", "person_id").join(extractions.select(F.col("id").alias("extraction_id"), "document_id", F.coalesce("record_key", F.lit("")).alias("key")), "extraction_id").select("person_id", "document_id", "key").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", "key"))), lambda x: F.concat(x["document_id"].cast("string"), F.lit(":"), x["key"])), "|")
    return r.groupBy("person_id").agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def proposals(decisions: DataFrame, people: DataFrame, prints: DataFrame) -> DataFrame:
    """Open merge proposals, the latest first, with stale and the reason: unstamped, a person missing, or changed since."""
    p = decisions.where(F.col("decision").startswith("agent_proposed_")).join(actioned(decisions), "id", "left_anti")
    p = p.withColumn("n", F.from_json("notes", NOTES)).select("*", F.col("target_id").alias("a"), F.col("n.other_person_id").alias("b"))
    have = people.select(F.col("id").alias("_id"))
    for s in ("a", "b"):
        p = p.join(have.select(F.col("_id").alias(s), F.lit(True).alias(f"{s}_here")), s, "left").join(prints.select(F.col("person_id").alias(s), F.col("fingerprint").alias(f"{s}_now")), s, "left")
    reason = (
        F.when(F.col("n.person_a_fingerprint").isNull() | F.col("n.person_b_fingerprint").isNull(), "unstamped")
        .when(F.col("a_here").isNull() | F.col("b_here").isNull(), "person missing")
        .when(~F.col("n.person_a_fingerprint").eqNullSafe(F.col("a_now")) | ~F.col("n.person_b_fingerprint").eqNullSafe(F.col("b_now")), "changed")
    )
    return p.select("id", "decision", "a", "b", F.col("n.confidence").alias("confidence"), F.col("n.rationale").alias("rationale"), reason.alias("stale_reason"), reason.isNotNull().alias("stale")).orderBy(F.col("id").desc())


def approve(open_: DataFrame, proposal_id: int) -> tuple[int, int]:
    """Keep and merge of an open, fresh merge proposal; KeyError if it is not open, ValueError if it is stale or proposes something else."""
    r = open_.where(F.col("id") == proposal_id).first()
    if r is None:
        raise KeyError(proposal_id)
    if r["decision"] != "agent_proposed_merge" or r["b"] is None or r["stale"]:
        raise ValueError(r["stale_reason"] or "not a merge")
    return r["a"], r["b"]


def approve_bulk(open_: DataFrame, least: float = APPROVE_LEAST) -> DataFrame:
    """``open_`` merges with outcome: approved, or why not. A merge changes both persons, so of proposals that touch one person only the first one (by id) is still fresh.

    Decided as a fold in the order of ids: repeated rounds approve every proposal that is the first of both its
    persons, and make the others of these persons stale. As many rounds as the longest chain of waiting proposals.
    """
    from tracefold.runtime import materialize

    m = open_.where("decision = 'agent_proposed_merge'")
    outcome = F.when(F.coalesce("confidence", F.lit(0.0)) < least, "below_confidence").when(F.col("stale"), F.concat(F.lit("stale: "), "stale_reason"))
    m = materialize(m.withColumn("outcome", outcome))
    while True:
        waiting = m.where("outcome is null")
        if waiting.isEmpty():
            return m
        first = waiting.select("id", F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.min("id").alias("first"))
        m = materialize(
            m.join(first.select(F.col("p").alias("a"), F.col("first").alias("fa")), "a", "left").join(first.select(F.col("p").alias("b"), F.col("first").alias("fb")), "b", "left")
            .withColumn("outcome", F.when(F.col("outcome").isNull() & (F.col("fa") == F.col("id")) & (F.col("fb") == F.col("id")), "approved").otherwise(F.col("outcome"))).drop("fa", "fb")
        )
        gone = m.where("outcome = 'approved'").select(F.explode(F.array("a", "b")).alias("p")).distinct()
        m = materialize(
            m.join(gone.select(F.col("p").alias("a"), F.lit(True).alias("ga")), "a", "left").join(gone.select(F.col("p").alias("b"), F.lit(True).alias("gb")), "b", "left")
            .withColumn("outcome", F.when(F.col("outcome").isNull() & (F.coalesce("ga", F.lit(False)) | F.coalesce("gb", F.lit(False))), "stale: changed").otherwise(F.col("outcome"))).drop("ga", "gb")
        )


def sign_off_state(people: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: persons, flags, flags_needing_review."""
    p = people.agg(F.count(F.lit(1)).alias("persons"))
    f = flags.agg(F.count(F.lit(1)).alias("flags"), F.count_if(F.col("review_status") == "needs_review").alias("flags_needing_review"))
    return p.crossJoin(f)  # two single rows


def sign_off(state: dict, before: dict | None = None) -> dict:
    """Whether the state may be signed (nothing left to review), and whether an earlier signature is superseded, with the counts that changed."""
    changed = {k: (before.get(k), v) for k, v in state.items() if before is not None and before.get(k) != v}
    return {"may_sign": state["flags_needing_review"] == 0, "superseded": bool(changed), "changed": changed}


def audit(flags: DataFrame, evidence: DataFrame, extractions: DataFrame, sample: int = 20, value: str = "normalized_value") -> DataFrame:
    """Verdict on the first ``sample`` flags by id: unsupported without evidence or if a value does not stand in its passage, else verified. ``value`` raw_value compares what was written."""
    some = flags.orderBy("id").limit(sample)
    e = evidence.join(extractions.select(F.col("id").alias("extraction_id"), F.contains("passage", value).alias("stands")), "extraction_id")
    v = e.groupBy(F.col("exposure_flag_id").alias("id")).agg(F.every(F.coalesce("stands", F.lit(False))).alias("all"))
    return some.join(v, "id", "left").select("id", "person_id", "category", F.when(F.col("all"), "verified").otherwise("unsupported").alias("verdict"))


def error_rate(audited: DataFrame) -> DataFrame:
    """Share of flags that are not verified; 0 if none was audited."""
    return audited.agg(F.coalesce(F.avg((F.col("verdict") != "verified").cast("double")), F.lit(0.0)).alias("error_rate"))


def strategy(reason: Column) -> Column:
    """What to do about a quarantine reason."""
    return F.when(reason == "ocr_unavailable", "ocr_retry").when(reason == "password_protected", "password_recovery").otherwise("escalate_unrecoverable")


def investigate(documents: DataFrame, limit: int = 25) -> DataFrame:
    """The first quarantined documents with a strategy and whether it is likely to succeed."""
    q = documents.where("status = 'quarantined'").orderBy("doc_id").limit(limit)
    return q.withColumn("strategy", strategy(F.col("quarantine_reason"))).withColumn("will_likely_succeed", F.col("strategy") != "escalate_unrecoverable")


def ranked(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
