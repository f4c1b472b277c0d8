"""Extractions to people.

A record (document_id, record_key) is a vertex; it is named by the smallest extraction id in it,
so that ids are exact and orders follow the first extraction. Keys shared by too many documents
are set aside before edges are made; a key's records are tied to its smallest record (a star,
never pairs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import names
from tracefold.operators.components import components
from tracefold.runtime import materialize, salted_join

# The rules of resolution.
STRONG = ["ssn", "card_number", "email", "phone", "drivers_license", "passport"]
KEY_LEAST, KEY_TIMES = 12, 4
CHROME_LEAST, CHROME_TIMES = 12, 6
ROLE_LEAST = 3


def threshold(counts: DataFrame, column: str, least: int, times: int) -> DataFrame:
    """One row, ``limit``: max(least, times x upper median of ``column``).

    The median comes from a histogram of the (few different) counts, not from a sorted collection of all of them.
    """
    h = counts.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(column)  # over different counts, a few thousand at most
    r = h.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return r.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.greatest(F.lit(least), F.coalesce(F.min(column) * times, F.lit(0))).alias("limit"))


def record_ids(extractions: DataFrame) -> DataFrame:
    """Extractions that are not suppressed (null: kept) with key ('' for null) and rid, the smallest id of the record."""
    e = extractions.where("not coalesce(suppressed_as_false_positive, false) and document_id is not null and id is not null")
    e = e.select("id", "document_id", F.coalesce("record_key", F.lit("")).alias("key"), "category", "normalized_value", "confidence", "is_partial")
    first = e.groupBy("document_id", "key").agg(F.min("id").alias("rid"))
    return salted_join(e, first, ["document_id", "key"])


def strong_keys(e: DataFrame) -> DataFrame:
    """category, value, docs: the identifying keys and their number of documents."""
    return e.where(F.col("category").isin(STRONG) & ~F.coalesce("is_partial", F.lit(False)) & F.col("normalized_value").isNotNull()).groupBy("category", F.col("normalized_value").alias("value")).agg(F.count_distinct("document_id").alias("docs"))


def demoted_keys(e: DataFrame, least: int = KEY_LEAST, times: int = KEY_TIMES) -> DataFrame:
    """Category, value of keys in so many documents that they belong to an organisation."""
    k = strong_keys(e)
    return k.crossJoin(F.broadcast(threshold(k, "docs", least, times))).where("docs >= limit").select("category", "value")  # the threshold is one row


def key_edges(e: DataFrame, demoted: DataFrame) -> DataFrame:
    """U, v from each record of a key to the key's smallest record."""
    k = e.where(F.col("category").isin(STRONG) & ~F.coalesce("is_partial", F.lit(False)) & F.col("normalized_value").isNotNull()).select("category", F.col("normalized_value").alias("value"), "rid").distinct()
    k = materialize(k.join(demoted, ["category", "value"], "left_anti"))
    low = k.groupBy("category", "value").agg(F.min("rid").alias("low"))
    return salted_join(k, low, ["category", "value"]).where("rid <> low").select(F.col("rid").alias("u"), F.col("low").alias("v"))


def birth_edges(e: DataFrame, need_token: bool = True) -> DataFrame:
    """U, v of records that hold the same name words and the same birth date; with ``need_token`` a name of initials only ties nothing."""
    n = e.where("category = 'full_name' and normalized_value is not null").select("rid", names.tokens(F.col("normalized_value")).alias("tokens")).distinct()
    n = n.where(F.size("tokens") > 0) if need_token else n
    d = e.where("category = 'dob' and normalized_value is not null").select("rid", F.col("normalized_value").alias("dob")).distinct()
    k = materialize(n.join(d, "rid").select(F.array_join("tokens", " ").alias("name"), "dob", "rid").distinct())
    low = k.groupBy("name", "dob").agg(F.min("rid").alias("low"))
    return salted_join(k, low, ["name", "dob"]).where("rid <> low").select(F.col("rid").alias("u"), F.col("low").alias("v"))


def chrome_tokens(e: DataFrame, least: int = CHROME_LEAST, times: int = CHROME_TIMES) -> DataFrame:
    """Token of name words that are furniture of the documents: in very many documents, and more often beside another such word than alone."""
    n = e.where("category = 'full_name' and normalized_value is not null").select("id", "document_id", F.explode(names.tokens(F.col("normalized_value"))).alias("token"))
    n = materialize(n)
    docs = n.groupBy("token").agg(F.count_distinct("document_id").alias("docs"))
    some = docs.crossJoin(F.broadcast(threshold(docs, "docs", least, times))).where("docs >= limit").select("token")
    hit = materialize(salted_join(n, materialize(some), ["token"]).select("id", "token").distinct())
    size = hit.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(size, "id").groupBy("token").agg(F.count_if(F.col("n") >= 2).alias("together"), F.count_if(F.col("n") < 2).alias("alone")).where("together > alone").select("token")


def trimmed(name: Column, chrome: Column) -> Column:
    """struct<name, suppressed>: chrome words cut from both ends of a name if two words stay; suppressed if fewer than two words and fewer than the chrome words are left."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    flags = F.transform(words, lambda w: F.array_contains(chrome, F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))))
    n = F.size(F.filter(flags, lambda x: x))
    first, last = F.array_position(flags, False), F.size(flags) - F.array_position(F.reverse(flags), False) + 1
    left = F.size(flags) - n
    gone = (n > 0) & (left < 2) & (n > left)
    cut = F.array_join(F.slice(words, first, last - first + 1), " ")
    return F.struct(F.when((n > 0) & ~gone & (first > 0) & (last - first + 1 >= 2), cut).otherwise(name).alias("name"), F.coalesce(gone, F.lit(False)).alias("suppressed"))


def trim_chrome(e: DataFrame) -> DataFrame:
    """D6 for all full_name extractions: normalized_value trimmed, suppressed names dropped; the stored table is not changed. Each name meets only the chrome words that stand in it."""
    n = e.where("category = 'full_name' and normalized_value is not null").select("id", F.explode(names.tokens(F.col("normalized_value"))).alias("token"))
    own = salted_join(n, materialize(chrome_tokens(e)), ["token"]).groupBy("id").agg(F.collect_set("token").alias("chrome"))
    d = e.join(own, "id", "left").withColumn("_t", F.when(F.col("chrome").isNotNull(), trimmed(F.col("normalized_value"), F.col("chrome"))))
    return d.where("_t is null or not _t.suppressed").withColumn("normalized_value", F.coalesce("_t.name", "normalized_value")).drop("_t", "chrome")


def clusters(e: DataFrame, need_token: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records with their cluster (rid, root), and the demoted keys. A record without a tie is a cluster of its own."""
    demoted = materialize(demoted_keys(e))
    edges = key_edges(e, demoted).unionByName(birth_edges(e, need_token))
    return components(e.select(F.col("rid").alias("x")), edges).withColumnRenamed("x", "rid"), demoted


def role_names(e: DataFrame, least: int = ROLE_LEAST) -> DataFrame:
    """Name: names in several clusters that have several birth dates between them. ``e`` has root."""
    n = e.where("category = 'full_name'").select(F.col("normalized_value").alias("name"), "root").distinct()
    d = e.where("category = 'dob'").select("root", F.col("normalized_value").alias("dob")).distinct()
    return n.join(d, "root", "left").groupBy("name").agg(F.count_distinct("root").alias("c"), F.count_distinct("dob").alias("d")).where((F.col("c") >= least) & (F.col("d") >= least)).select("name")


def persons(e: DataFrame) -> DataFrame:
    """Root, person_id, person_uid, best_known_full_name, dob, review_status of the clusters, numbered by their first extraction.

    The name is the longest that is no role name (the first of equally long ones) or Unknown; the date the first one.
    """
    from tracefold.operators.ingest import numbered

    roles = role_names(e).withColumn("role", F.lit(True))
    n = salted_join(e.where("category = 'full_name'").select("root", "id", F.col("normalized_value").alias("name")), roles, ["name"], "left").where("role is null")
    best = n.groupBy("root").agg(F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("best"))
    dob = e.where("category = 'dob'").groupBy("root").agg(F.min_by("normalized_value", "id").alias("dob"))
    first = e.groupBy("root").agg(F.min("id").alias("first"))
    p = numbered(materialize(first.join(best, "root", "left").join(dob, "root", "left")), ["first"], column="person_id")
    name = F.coalesce("best", F.lit("Unknown"))
    return p.select("root", "person_id", F.format_string("RP-%05d", "person_id").alias("person_uid"), name.alias("best_known_full_name"), "dob", F.when(name == "Unknown", "needs_review").otherwise("auto_accepted").alias("review_status"))


def entity_links(e: DataFrame, people: DataFrame, demoted: DataFrame) -> DataFrame:
    """A link for each extraction except those of demoted keys."""
    own = e.join(demoted.select("category", F.col("value").alias("normalized_value")), ["category", "normalized_value"], "left_anti")
    return salted_join(own, people.select("root", "person_id"), ["root"]).select(F.col("id").alias("extraction_id"), "person_id", "confidence", F.lit("deterministic_exact").alias("method"), F.lit("resolver").alias("decided_by"))


def resolve(extractions: DataFrame, chrome: bool = True) -> tuple[DataFrame, DataFrame]:
    """Persons and links, built anew from all extractions."""
    e = record_ids(extractions)
    e = materialize(trim_chrome(e) if chrome else e)
    roots, demoted = clusters(e)
    e = materialize(salted_join(e, roots, ["rid"]))
    people = materialize(persons(e))
    return people.drop("root"), materialize(entity_links(e, people, demoted))


def merge_map(merges: DataFrame) -> DataFrame:
    """person_id, keep of approved merges (keep, merge): chains end at their smallest person; a merge of a person with itself is refused."""
    if not merges.where("keep = merge").isEmpty():
        raise ValueError("a person can't be merged with itself")
    from tracefold.operators.components import stars

    return stars(merges.select(F.col("keep").alias("u"), F.col("merge").alias("v"))).select(F.col("x").alias("person_id"), F.col("root").alias("keep"))


def apply_merges(links: DataFrame, people: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and persons after merges: links repointed, merged persons gone. Flags are built again from the links."""
    m = materialize(merge_map(merges))
    moved = salted_join(links, m, ["person_id"], "left").withColumn("method", F.when(F.col("keep").isNotNull(), "agent_adjudicated").otherwise(F.col("method"))).withColumn("person_id", F.coalesce("keep", "person_id")).drop("keep")
    return moved, people.join(m.select("person_id"), "person_id", "left_anti")


def candidate_pairs(people: DataFrame, links: DataFrame, extractions: DataFrame, ruled: DataFrame | None = None, most: int | None = 20, block: int = 200) -> DataFrame:
    """A, b, signal of people that may be the same: of one address, or of one name. The ``most`` first of a fixed order (null: all).

    Pairs are the feature here: all pairs of a value are made, however many people share it. The people of a value
    are dealt into blocks of about ``block``; each two blocks, and each block with itself, meet under a key of their
    own, so that a value in very many rows is no single task.
    """
    a = links.join(extractions.where("category = 'home_address'").select(F.col("id").alias("extraction_id"), F.col("normalized_value").alias("value")), "extraction_id").select("value", "person_id", F.lit(0).alias("rank"), F.lit("shared_address").alias("signal"))
    n = people.where("best_known_full_name <> 'Unknown'").select(names.sorted_words(F.col("best_known_full_name")).alias("value"), "person_id", F.lit(1).alias("rank"), F.lit("same_name").alias("signal"))
    k = materialize(a.unionByName(n).where("value is not null").distinct())
    size = k.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    g = salted_join(k, size, ["signal", "value"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    g = materialize(g.withColumn("x", F.pmod(F.xxhash64("person_id"), F.col("blocks")).cast("int")))
    one = g.select("signal", "value", "rank", F.col("person_id").alias("p"), "x", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)).alias("y"))
    other = g.select("signal", "value", F.col("person_id").alias("q"), F.explode(F.sequence(F.lit(0), F.col("x"))).alias("x"), F.col("x").alias("y"))
    met = one.join(other, ["signal", "value", "x", "y"]).where("x < y or p < q")
    best = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "rank", "signal", "value").groupBy("a", "b").agg(F.min(F.struct("rank", "value", "signal")).alias("s"))
    if ruled is not None:
        best = best.join(ruled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    out = best.select("a", "b", "s.signal", "s.rank", "s.value").orderBy("rank", "value", "a", "b")
    return (out.limit(most) if most is not None else out).select("a", "b", "signal")


def dossiers(people: DataFrame, links: DataFrame, extractions: DataFrame, per_flag: int = 3) -> DataFrame:
    """person_id, name, dob, variants (sorted), evidence: up to ``per_flag`` (category, value, passage) of each category, the first ones."""
    e = links.select("extraction_id", "person_id").join(extractions.select(F.col("id").alias("extraction_id"), "category", "normalized_value", "passage"), "extraction_id")
    variants = e.where("category = 'full_name'").select("person_id", "normalized_value").distinct().groupBy("person_id").agg(F.array_sort(F.collect_list("normalized_value")).alias("variants"))
    top = e.where("category <> 'full_name'").withColumn("k", F.row_number().over(Window.partitionBy("person_id", "category").orderBy("extraction_id"))).where(F.col("k") <= per_flag)
    ev = top.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("category", "extraction_id", F.col("normalized_value").alias("value"), "passage"))).alias("evidence"))
    return people.select("person_id", F.col("best_known_full_name").alias("name"), "dob").join(variants, "person_id", "left").join(ev, "person_id", "left")


def adjudicate(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Decision and confidence of each pair by rule: values of one category (addresses aside) that have none in common split, so do different birth dates; a last word that any two spellings share merges, all else is for a person to decide."""
    from tracefold.operators.exposure import CATEGORIES

    side = lambda p: files.select(F.col("person_id").alias(p), F.col("dob").alias(f"{p}_dob"), F.coalesce("variants", F.array().cast("array<string>")).alias(f"{p}_names"), F.coalesce("evidence", F.array().cast(files.schema["evidence"].dataType)).alias(f"{p}_ev"))
    d = pairs.join(side("a"), "a").join(side("b"), "b")

    def values(ev: Column, c: str) -> Column:
        return F.transform(F.filter(ev, lambda x: (x["category"] == c) & x["value"].isNotNull()), lambda x: x["value"])

    def last(names_: Column) -> Column:
        return F.transform(F.filter(names_, lambda n: F.trim(n) != ""), lambda n: F.element_at(F.split(F.trim(F.lower(n)), r"\s+"), -1))

    differ = F.lit(False)
    for c in CATEGORIES:
        if c != "home_address":
            x, y = values(F.col("a_ev"), c), values(F.col("b_ev"), c)
            differ = differ | ((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y))
    said = lambda decision, confidence: F.struct(F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"))
    decision = F.when(differ, said("split", 0.85)).when(F.col("a_dob") != F.col("b_dob"), said("split", 0.8)).when(F.arrays_overlap(last(F.col("a_names")), last(F.col("b_names"))), said("merge", 0.65)).otherwise(said("escalate", 0.3))
    return d.withColumn("_d", decision).select("a", "b", "signal", "_d.decision", "_d.confidence")
