"""Normal forms and checks of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions.names import tokens  # noqa: F401


def phone(raw: Column) -> Column:
    """Digits of a phone number without extension, international prefix and country code 1."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"(?i)\s?(?:x|ext\.?)\s?\d+\s*$", ""), r"\D", "")
    digits = F.regexp_replace(digits, r"^00", "")
    return F.when((F.length(digits) > 10) & digits.startswith("1"), F.substring(digits, 2, 100)).otherwise(digits)


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    return F.call_function("luhn_check", digits)


def plausible_birth(iso: Column, in_context: Column, as_of: Column) -> Column:
    """A real day, not after ``as_of``, at most 120 years before it, and under 16 years only in a birth context."""
    day = F.try_to_date(iso, "yyyy-MM-dd")
    age = F.datediff(as_of, day) / F.lit(365.2425)
    return day.isNotNull() & (day <= as_of) & (age <= 120) & ((age >= 16) | in_context)


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values: the upper median of an even number. For small aggregates only; see ``resolve.threshold``."""
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)
