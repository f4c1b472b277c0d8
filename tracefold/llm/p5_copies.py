"""Problem 5: records that differ in formatting only, collapsed with the number of their copies.

Canonical keys are counted exactly with partial counts. Keys holding many rows are
salted and aggregated in two levels, all others in one shuffle; the smallest id stands
for a set of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.runtime import HOT_ROWS, SALTS, hot_keys, materialize

DIGIT_CATEGORIES = ["phone", "ssn", "card_number"]
WORD_CATEGORIES = ["full_name", "home_address", "email"]


def digits_key(value: Column) -> Column:
    """The digits of a value in their order."""
    return F.regexp_replace(value, r"[^\p{Nd}]", "")


def words_key(value: Column) -> Column:
    """The lower-case words (runs of letters and digits) of a value, sorted, repeats kept, accents kept."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), " ")


def canonical(extractions: DataFrame) -> DataFrame:
    """id, document_id, category and the 128-bit digest ``ckey`` of the canonical value.

    Only complete values of the six categories. A null id, document_id or raw_value
    has no copies and is left out; a value without a word or digit has the empty key.
    """
    cat = F.col("category")
    key = F.when(cat.isin(DIGIT_CATEGORIES), digits_key(F.col("raw_value"))).otherwise(words_key(F.col("raw_value")))
    return (
        extractions.where(cat.isin(DIGIT_CATEGORIES + WORD_CATEGORIES) & ~F.col("is_partial"))
        .select("id", "document_id", "category", F.md5(key).alias("ckey"))
        .where(F.col("id").isNotNull() & F.col("document_id").isNotNull() & F.col("ckey").isNotNull())
    )


def group_copies(rows: DataFrame, keys: list[str], id_col: str = "id", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``rows`` with keep_id (smallest id of the key) and n_copies (rows of the key).

    Hot keys: salted partial minima, then the total; at most 1000 such keys, which
    are joined back by broadcast. All other keys: one shuffle.
    """
    hot = materialize(hot_keys(rows, keys, hot_rows).withColumn("_hot", F.lit(True)))
    marked = rows.join(F.broadcast(hot), keys, "left")
    w = Window.partitionBy(*keys)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").withColumns({"keep_id": F.min(id_col).over(w), "n_copies": F.count(F.lit(1)).over(w)})
    if hot.isEmpty():
        return rest
    many = marked.where(F.col("_hot")).drop("_hot")
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    first = salted.groupBy(*keys, "_salt").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    total = first.groupBy(*keys).agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    return rest.unionByName(many.join(F.broadcast(total), keys))


KEYS = ["document_id", "category", "ckey"]


def copies(extractions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """keep_id, copy_id: one row for every record that repeats another one. A row repeated under one id is no copy of itself."""
    g = group_copies(canonical(extractions), KEYS, hot_rows=hot_rows)
    return g.where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))


def collapsed(extractions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct value of a document: id, document_id, category, n_copies (itself included)."""
    g = group_copies(canonical(extractions), KEYS, hot_rows=hot_rows)
    return g.where(F.col("id") == F.col("keep_id")).select("id", "document_id", "category", "n_copies")
