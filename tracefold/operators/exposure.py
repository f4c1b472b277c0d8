"""F1-F16: the table of people and categories, and the lists, counts and exports made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.runtime import salted_join

CATEGORIES = ["ssn", "dob", "drivers_license", "passport", "financial_account", "card_number", "medical", "login_credentials", "home_address", "phone", "email"]
ACCEPT = 0.75


def flags(links: DataFrame, extractions: DataFrame) -> DataFrame:
    """person_id, category, confidence (the highest), evidence_count, review_status."""
    e = extractions.where("category <> 'full_name' and not coalesce(suppressed_as_false_positive, false)").select(F.col("id").alias("extraction_id"), "category", "confidence")
    g = links.select("extraction_id", "person_id").join(e, "extraction_id").groupBy("person_id", "category").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence_count"))
    return g.withColumn("review_status", F.when(F.col("confidence") >= ACCEPT, "auto_accepted").otherwise("needs_review"))


def flag_evidence(links: DataFrame, extractions: DataFrame) -> DataFrame:
    """person_id, category, extraction_id: what each flag rests on."""
    e = extractions.where("category <> 'full_name' and not coalesce(suppressed_as_false_positive, false)").select(F.col("id").alias("extraction_id"), "category")
    return links.select("extraction_id", "person_id").join(e, "extraction_id").select("person_id", "category", "extraction_id")


def overlay_decisions(flags_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rebuilt flags keep what people decided: accepted ones are human_reviewed. ``decisions``: person_id, category, decision, decided_at, id."""
    last = decisions.groupBy("person_id", "category").agg(F.max_by("decision", F.struct("decided_at", "id")).alias("_d"))
    return flags_.join(last, ["person_id", "category"], "left").withColumn("review_status", F.when(F.col("_d") == "accept", "human_reviewed").otherwise(F.col("review_status"))).drop("_d")


def like(c: Column, search: str) -> Column:
    """Part of a text, in any case; ``%`` and ``_`` of the search are plain characters."""
    return F.ilike(c, F.lit("%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """A page of a list in a total order; a page has at most ``most`` rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def list_persons(people: DataFrame, flags_: DataFrame, search: str | None = None, category: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """a page of persons by id with their flag categories; the filters come before the page."""
    p = people
    if search:
        p = p.where(like(F.col("best_known_full_name"), search))
    if category:
        p = p.join(flags_.where(F.col("category") == category).select(F.col("person_id").alias("id")), "id", "left_semi")
    p = page(p, ["id"], offset, limit)
    c = flags_.join(F.broadcast(p.select(F.col("id").alias("person_id"))), "person_id", "left_semi").groupBy("person_id").agg(F.array_sort(F.collect_set("category")).alias("flag_categories"))  # a page has 500 rows at most
    return p.join(c.withColumnRenamed("person_id", "id"), "id", "left")


def summary(people: DataFrame, flags_: DataFrame) -> DataFrame:
    """measure, key, n: flags by category, persons by status and in all, persons with flags to review."""
    row = lambda df, m: df.select(F.lit(m).alias("measure"), F.col("k").alias("key"), F.col("n").cast("bigint").alias("n"))
    return (
        row(flags_.groupBy(F.col("category").alias("k")).agg(F.count(F.lit(1)).alias("n")), "flags_by_category")
        .unionByName(row(people.groupBy(F.col("review_status").alias("k")).agg(F.count(F.lit(1)).alias("n")), "persons_by_status"))
        .unionByName(row(people.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("all")), "persons"))
        .unionByName(row(flags_.where("review_status = 'needs_review'").agg(F.count_distinct("person_id").alias("n")).withColumn("k", F.lit("all")), "persons_to_review"))
    )


def source_refs(links: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """person_id, category, ref (path, with #pN if the page is known), confidence of each link."""
    e = extractions.where("not coalesce(suppressed_as_false_positive, false)").select(F.col("id").alias("extraction_id"), "document_id", "category", "normalized_value", "page_number")
    d = documents.select(F.col("doc_id").alias("document_id"), "relpath")
    ref = F.when(F.col("page_number").isNotNull(), F.concat("relpath", F.lit("#p"), "page_number")).otherwise(F.col("relpath"))
    found = links.select("extraction_id", "person_id", "confidence").join(e, "extraction_id")
    return salted_join(found, d, ["document_id"]).select("person_id", "category", "normalized_value", ref.alias("ref"), "confidence")


def aliases(refs: DataFrame, people: DataFrame) -> DataFrame:
    """id, aliases: the other spellings of a person, sorted, joined by ``; ``."""
    a = refs.where("category = 'full_name'").select(F.col("person_id").alias("id"), "normalized_value").distinct().join(people.select("id", "best_known_full_name"), "id").where("normalized_value <> best_known_full_name")
    return a.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("normalized_value")), "; ").alias("aliases"))


def export_wide(people: DataFrame, flags_: DataFrame, refs: DataFrame) -> DataFrame:
    """a row a person: uid, name, aliases, dob, status, lowest confidence (3 digits), source documents, and per category ``<category>_evidence_count``: the distinct references if flagged (0 if there are none), else null."""
    lowest = refs.groupBy(F.col("person_id").alias("id")).agg(F.bround(F.min("confidence"), 3).alias("resolution_confidence"), F.count_distinct(F.when(F.col("category").isin(CATEGORIES), F.substring_index("ref", "#", 1))).alias("source_documents"))
    counted = refs.where(F.col("category").isin(CATEGORIES)).groupBy("person_id", "category").agg(F.count_distinct("ref").alias("n"))
    flagged = flags_.select("person_id", "category").distinct().join(counted, ["person_id", "category"], "left")
    each = [F.max(F.when(F.col("category") == c, F.coalesce("n", F.lit(0)))).alias(f"{c}_evidence_count") for c in CATEGORIES]
    wide = flagged.groupBy(F.col("person_id").alias("id")).agg(*each)
    p = people.select("id", "person_uid", "best_known_full_name", "dob", "review_status").join(aliases(refs, people), "id", "left").join(lowest, "id", "left").join(wide, "id", "left")
    return p.select("id", "person_uid", "best_known_full_name", F.coalesce("aliases", F.lit("")).alias("known_aliases"), "dob", "review_status", "resolution_confidence", F.coalesce("source_documents", F.lit(0)).alias("source_documents"), *[f"{c}_evidence_count" for c in CATEGORIES])


def export_long(people: DataFrame, flags_: DataFrame, refs: DataFrame) -> DataFrame:
    """a row a flag with its sorted references."""
    r = refs.groupBy("person_id", "category").agg(F.array_join(F.array_sort(F.collect_set("ref")), "; ").alias("refs"))
    return flags_.join(people.select(F.col("id").alias("person_id"), "person_uid", "best_known_full_name"), "person_id").join(r, ["person_id", "category"], "left").select("person_uid", "best_known_full_name", "category", "confidence", "evidence_count", "review_status", F.coalesce("refs", F.lit("")).alias("refs"))


def person(people: DataFrame, flags_: DataFrame, person_id: int) -> DataFrame:
    """one person with its flags; no row if there is none (the caller's 404)."""
    f = flags_.where(F.col("person_id") == person_id).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("category", "confidence", "evidence_count", "review_status"))).alias("flags"))
    return people.where(F.col("id") == person_id).join(f.withColumnRenamed("person_id", "id"), "id", "left")


def evidence(evidence_: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """F8: evidence of flags with passage and place; the page is approximate if a model found the value."""
    e = extractions.select(F.col("id").alias("extraction_id"), "document_id", "record_key", "page_number", "raw_value", "passage", "method")
    d = documents.select(F.col("doc_id").alias("document_id"), "relpath", "sniffed_type")
    return salted_join(evidence_.join(e, "extraction_id"), d, ["document_id"]).withColumn("page_is_approximate", F.col("method").startswith("llm_"))


def list_documents(documents: DataFrame, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """a page of documents by id."""
    return page(documents.where(F.col("status") == status) if status else documents, ["doc_id"], offset, limit)


def document_summary(documents: DataFrame) -> DataFrame:
    """measure, key, n: documents by status, and by quarantine reason where there is one, in one pass."""
    rows = documents.select(F.explode(F.array(F.struct(F.lit("status").alias("measure"), F.col("status").alias("key")), F.struct(F.lit("quarantine_reason").alias("measure"), F.col("quarantine_reason").alias("key")))).alias("x"))
    return rows.select("x.*").where("key is not null").groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))


def document(documents: DataFrame, doc_id: int) -> DataFrame:
    """one document, or no row."""
    return documents.where(F.col("doc_id") == doc_id)


def duration(runs: DataFrame) -> DataFrame:
    """``runs`` with duration_seconds, null while a run has not finished."""
    return runs.withColumn("duration_seconds", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6)


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """the latest runs."""
    return duration(runs).orderBy(F.col("id").desc()).limit(limit)


def snapshot(documents: DataFrame) -> DataFrame:
    """reason, file_type, n of quarantined documents."""
    return documents.where("quarantine_reason is not null").groupBy(F.col("quarantine_reason").alias("reason"), F.col("sniffed_type").alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


NO_RETRY = ["ocr_unavailable", "corrupt_unreadable", "zero_byte"]


def next_step(documents: DataFrame) -> DataFrame:
    """one row: next_agent, target_scope, infra_escalations (type/reason of what no retry repairs, sorted)."""
    stuck = F.lit(False)
    for r in NO_RETRY:
        stuck = stuck | F.col("quarantine_reason").startswith(r)
    one = documents.agg(
        F.count_if(F.col("quarantine_reason") == "password_protected").alias("locked"), F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.array_sort(F.collect_set(F.when(stuck, F.concat_ws("/", "sniffed_type", "quarantine_reason")))).alias("infra_escalations"),
    )
    agent = F.when(F.col("locked") > 0, "exception_investigator").when(F.col("parsed") > 0, "qa_auditor").otherwise("none")
    scope = F.when(F.col("locked") > 0, F.format_string("password_protected (%d docs)", "locked")).when(F.col("parsed") > 0, "sample of completed exposure flags").otherwise("")
    return one.select(agent.alias("next_agent"), scope.alias("target_scope"), "infra_escalations")


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n, share of the total, ranked."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), key)))  # a row a key


def scale(values: DataFrame, key: str, column: str, share: float = 0.95, least: float = 1.0) -> DataFrame:
    """key, scale: the value at floor(n x share) of the sorted values (0-based), ``least`` at least. By ranks, not by collecting values."""
    v = values.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    r = v.withColumn("upto", F.sum("c").over(w.orderBy(column))).withColumn("n", F.sum("c").over(w))
    return r.where(F.col("upto") > F.floor(F.col("n") * share)).groupBy(key).agg(F.greatest(F.min(column), F.lit(least)).alias("scale"))


ACRONYMS = {"ssn": "SSN", "dob": "DOB", "id": "ID"}


def category_label(c: Column) -> Column:
    """F16: readable name of a category, acronyms in capitals, else the first word capitalised."""
    words = F.transform(F.split(c, "_"), lambda w, i: F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in ACRONYMS.items()], F.when(i == 0, F.initcap(w)).otherwise(w)))
    return F.array_join(words, " ")


def duration_label(seconds: Column) -> Column:
    """F16: ``Ns``, ``Nm Ns`` or ``Nh Nm``; a dash while unknown."""
    s = F.round(seconds).cast("bigint")
    return F.when(seconds.isNull(), "—").when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def row_label(key: Column) -> Column:
    """F16: ``row N`` counted from 1 of a record key ``row:n``."""
    return F.when(key.rlike(r"row:\d+$"), F.concat(F.lit("row "), (F.regexp_extract(key, r"(\d+)$", 1).cast("bigint") + 1).cast("string")))
