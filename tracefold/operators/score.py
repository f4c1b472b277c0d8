"""H1-H9: results held against a manifest of planted values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import values

# Fields of the manifest and their categories.
FIELDS = {"ssn": "ssn", "ssn_partial": "ssn", "dob": "dob", "drivers_license": "drivers_license", "passport": "passport", "bank_account": "financial_account", "financial_account_partial": "financial_account", "card_number": "card_number", "card_number_partial": "card_number", "medical": "medical", "login_credentials": "login_credentials", "home_address": "home_address", "phone": "phone", "email": "email", "full_name_variant": "full_name"}
MANIFEST = "people array<struct<person_id:string>>, documents array<struct<relpath:string,plants:array<struct<field:string,value:string,person_id:string,is_false_positive_trap:boolean,is_third_party:boolean,page:int,context_style:string>>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """H1: relpath, category, value, person_id, page, context_style, is_third_party of the plants, without traps and those of nobody."""
    return plants(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def plants(manifest: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in chain.from_iterable(FIELDS.items())])
    p = manifest.select(F.explode("documents").alias("d")).select("d.relpath", F.explode("d.plants").alias("p"))
    return p.where("not coalesce(p.is_false_positive_trap, false) and p.person_id <> 'NONE'").select("relpath", kinds[F.col("p.field")].alias("category"), "p.value", "p.person_id", "p.page", "p.context_style", F.coalesce("p.is_third_party", F.lit(False)).alias("is_third_party"))


def predicted(links: DataFrame, extractions: DataFrame) -> DataFrame:
    """H2: predicted person, category and value of linked extractions, by normalized and by raw value."""
    e = extractions.select(F.col("id").alias("extraction_id"), "category", F.explode(F.array_distinct(F.array("normalized_value", "raw_value"))).alias("value"))
    return links.select("extraction_id", F.col("person_id").alias("pred")).join(e, "extraction_id").select("pred", "category", "value").distinct()


def votes(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """H3: person_id, pred, hits: for each true person the predicted one with most of its values; ties go to the smallest."""
    t = truth.where("category <> 'full_name'").select("person_id", "category", "value").distinct()
    n = t.join(pred, ["category", "value"]).groupBy("person_id", "pred").agg(F.count(F.lit(1)).alias("hits"))
    best = n.groupBy("person_id").agg(F.max(F.struct("hits", (-F.col("pred")).alias("k"))).alias("b"))
    return best.select("person_id", (-F.col("b.k")).alias("pred"), F.col("b.hits").alias("hits"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def person_scores(truth: DataFrame, matched: DataFrame, n_predicted: int) -> DataFrame:
    """H4: matched, merge_errors (predicted persons that stand for several), people_lost, recall, precision."""
    per = matched.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    m = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), F.count_if(F.col("n") > 1).alias("merge_errors"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("people_lost"))
    t = truth.agg(F.count_distinct("person_id").alias("people"))
    right = F.col("matched") - F.col("people_lost")
    return m.crossJoin(t).select("matched", "merge_errors", "people_lost", "people", ratio(F.col("matched"), F.col("people")).alias("recall"), ratio(right, F.lit(n_predicted)).alias("precision"))  # two single rows


def category_scores(truth: DataFrame, matched: DataFrame, flags: DataFrame) -> DataFrame:
    """H5: per category true and false positives and misses of (person, category), recall and precision (3 digits)."""
    want = truth.where("category <> 'full_name'").select("person_id", "category").distinct().join(matched.select("person_id", "pred"), "person_id", "left").select(F.coalesce(F.col("pred").cast("string"), F.concat(F.lit("?"), "person_id")).alias("p"), "category", F.lit(True).alias("w")).distinct()
    have = flags.select(F.col("person_id").cast("string").alias("p"), "category", F.lit(True).alias("h")).join(matched.select(F.col("pred").cast("string").alias("p")).distinct(), "p", "left_semi").distinct()
    j = want.join(have, ["p", "category"], "full_outer")
    g = j.groupBy("category").agg(F.count_if(F.col("w") & F.col("h")).alias("tp"), F.count_if(F.col("w").isNotNull() & F.col("h").isNull()).alias("fn"), F.count_if(F.col("w").isNull() & F.col("h").isNotNull()).alias("fp"))
    return g.withColumns({"recall": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 3), "precision": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3)})


def _truth_values(truth: DataFrame) -> DataFrame:
    forms = F.when(F.col("category") == "phone", F.array("value", values.phone(F.col("value")))).otherwise(F.array("value"))
    return truth.select("category", F.explode(F.array_distinct(forms)).alias("value")).distinct()


def value_precision(links: DataFrame, extractions: DataFrame, truth: DataFrame, samples: int = 3) -> DataFrame:
    """H6: linked and corroborated values by category and over all (_overall), with up to three of those nothing was planted for (the first by code point)."""
    e = links.select("extraction_id").distinct().join(extractions.select(F.col("id").alias("extraction_id"), "category", "normalized_value", "raw_value"), "extraction_id").select("category", "normalized_value", "raw_value").distinct()
    t = _truth_values(truth).withColumn("ok", F.lit(True))
    e = e.join(t.select("category", F.col("value").alias("normalized_value"), F.col("ok").alias("ok1")), ["category", "normalized_value"], "left").join(t.select("category", F.col("value").alias("raw_value"), F.col("ok").alias("ok2")), ["category", "raw_value"], "left")
    v = e.groupBy("category", F.col("normalized_value").alias("value")).agg(F.max(F.coalesce("ok1", "ok2", F.lit(False))).alias("ok"))
    r = v.rollup("category").agg(F.count(F.lit(1)).alias("linked"), F.count_if("ok").alias("corroborated"))
    first = v.where("not ok").groupBy("category").agg(F.min("value").alias("s0"))
    bad = v.where("not ok").join(first, "category")
    for i in range(1, samples):
        nxt = bad.where(F.col("value") > F.col(f"s{i - 1}")).groupBy("category").agg(F.min("value").alias(f"s{i}"))
        bad = bad.join(nxt, "category", "left")
    some = bad.select("category", F.array_compact(F.array(*[f"s{i}" for i in range(samples)])).alias("uncorroborated")).distinct()
    r = r.withColumn("category", F.coalesce("category", F.lit("_overall"))).join(some, "category", "left")
    return r.withColumn("precision", F.bround(ratio(F.col("corroborated"), F.col("linked")), 3))


def page_scores(truth: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """H7: page_offset (found page less planted page; null if none is cited) and n, over planted values with a page; by raw value first, then by normalized value."""
    d = documents.select(F.col("doc_id").alias("document_id"), "relpath")
    e = extractions.join(d, "document_id").select("relpath", "raw_value", "normalized_value", "page_number", "id")
    t = truth.where("page is not null").select("relpath", "value", "page").distinct()
    raw = e.groupBy("relpath", F.col("raw_value").alias("value")).agg(F.min_by(F.struct("page_number"), "id").alias("r"))
    norm = e.groupBy("relpath", F.col("normalized_value").alias("value")).agg(F.min_by(F.struct("page_number"), "id").alias("m"))
    j = t.join(raw, ["relpath", "value"], "left").join(norm, ["relpath", "value"], "left").where("r is not null or m is not null")
    return j.select((F.coalesce("r", "m")["page_number"] - F.col("page")).alias("page_offset")).groupBy("page_offset").agg(F.count(F.lit(1)).alias("n"))


def contamination(truth: DataFrame, links: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """H8: planted third-party values, and how many extractions of them are linked to a person, each once."""
    third = truth.where("is_third_party").select("relpath", "category", "value").distinct()
    d = documents.select(F.col("doc_id").alias("document_id"), "relpath")
    e = links.select("extraction_id").distinct().join(extractions.select(F.col("id").alias("extraction_id"), "document_id", "category", "normalized_value", "raw_value"), "extraction_id").join(d, "document_id")
    hit = e.select("extraction_id", "relpath", "category", F.explode(F.array_distinct(F.array("normalized_value", "raw_value"))).alias("value")).join(third, ["relpath", "category", "value"], "left_semi").select("extraction_id").distinct()
    return third.agg(F.count(F.lit(1)).alias("planted")).crossJoin(hit.agg(F.count(F.lit(1)).alias("linked")))  # two single rows


def style_recall(truth: DataFrame, extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """H9: context_style, planted, found."""
    d = documents.select(F.col("doc_id").alias("document_id"), "relpath")
    e = extractions.join(d, "document_id").select("relpath", "category", F.explode(F.array_distinct(F.array("normalized_value", "raw_value"))).alias("value")).distinct().withColumn("ok", F.lit(True))
    t = truth.select("relpath", "category", "value", F.coalesce("context_style", F.lit("unlabelled")).alias("context_style"))
    return t.join(e, ["relpath", "category", "value"], "left").groupBy("context_style").agg(F.count(F.lit(1)).alias("planted"), F.count_if("ok").alias("found"))
