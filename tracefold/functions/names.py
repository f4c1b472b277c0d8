"""Name tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(name: Column) -> Column:
    """The set of name words, sorted: commas as blanks, lower case, periods around words off, single letters left out."""
    words = F.split(F.regexp_replace(F.lower(F.replace(name, F.lit(","), F.lit(" "))), r"^\s+|\s+$", ""), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: F.length(w) > 1)))


def normalized(name: Column) -> Column:
    """D3: lower case with single blanks."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def sorted_words(name: Column) -> Column:
    """Key of names that hold the same words: lower case, commas out, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.replace(name, F.lit(","), F.lit(" "))), r"\s+"), lambda w: w != "")), " ")
