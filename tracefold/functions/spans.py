"""All matches of a pattern with their offsets, made of built-in functions (code points, half-open)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Code points that stand for no character mark the matches; a text that holds one nevertheless takes the slower way.
OPEN, VALUE, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"

MATCHES = "array<struct<raw:string,value:string,start:int,end:int>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<raw, value, start, end>> of the matches of ``pattern``; value is the group. Null for a null text.

    One pass of the pattern puts marks around each match and its group; cutting at the marks gives values and offsets.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{VALUE}${group}{CLOSE}"))
    pieces = F.split(marked, OPEN, -1)
    hits = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _cut)
    found = _placed(hits, F.length(pieces[0]))
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(VALUE)) | F.contains(text, F.lit(CLOSE)), matches_between(text, pattern, group)).otherwise(found)


def _cut(piece: Column) -> Column:
    raw = F.substring_index(piece, VALUE, 1)
    rest = F.substring_index(piece, VALUE, -1)
    return F.struct(raw.alias("raw"), F.substring_index(rest, CLOSE, 1).alias("value"), F.length(F.substring_index(rest, CLOSE, -1)).alias("after"), F.length(raw).alias("n"))


def _placed(hits: Column, first: Column) -> Column:
    """Offsets of ``hits`` by running sums, in blocks of about the root of their number: an array that grows by one element is copied each time, so that a text with very many matches would take the square of them in one go."""
    block = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(hits))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hits) / block).cast("int")), lambda k: F.slice(hits, k * block + 1, block))

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + m["n"]
        hit = F.struct(m["raw"].alias("raw"), m["value"].alias("value"), acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + m["after"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    def many(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(acc["at"].alias("at"), F.array().cast(MATCHES).alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    return F.flatten(F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast(f"array<{MATCHES}>").alias("out")), many, lambda acc: acc["out"]))


def matches_between(text: Column, pattern: str, group: int = 0) -> Column:
    """The same by the pieces between the matches; needs no marks but three passes of the pattern."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    hits = F.zip_with(
        F.arrays_zip(whole.alias("raw"), value.alias("value")), F.slice(between, 2, F.size(whole)),
        lambda m, gap: F.struct(m["raw"].alias("raw"), m["value"].alias("value"), F.length(gap).alias("after"), F.length(m["raw"]).alias("n")),
    )
    return _placed(hits, F.length(between[0]))


def around(text: Column, start: Column, end: Column, width: int = 60) -> Column:
    """The passage around a match: ``width`` characters on both sides, trimmed, newlines as blanks."""
    a = F.greatest(F.lit(0), start - width)
    cut = F.substring(text, a + 1, end + width - a)
    return F.replace(F.regexp_replace(cut, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))


def before(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters in front of a match."""
    a = F.greatest(F.lit(0), start - width)
    return F.substring(text, a + 1, start - a)


def page_of(spans: Column, offset: Column, preceding: bool = True) -> Column:
    """The page that holds ``offset``; between pages the one before it, or with ``preceding`` false the last one. Null without spans or for an offset below 0."""
    inside = F.filter(spans, lambda s: (s["span_start"] <= offset) & (offset < s["span_end"]))
    earlier = F.filter(spans, lambda s: s["span_start"] <= offset)
    other = F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["page"]) if preceding else F.element_at(spans, -1)["page"]
    return F.when((offset >= 0) & (F.size(spans) > 0), F.when(F.size(inside) > 0, inside[0]["page"]).otherwise(other if not preceding else F.coalesce(other, F.element_at(spans, -1)["page"])))


def page_map(pages: Column) -> Column:
    """Spans of pages that are joined by one newline: array<struct<page, span_start, span_end>>, pages from 1."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,span_start:int,span_end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p)
        span = F.struct((F.size(acc["out"]) + 1).alias("page"), acc["at"].alias("span_start"), (acc["at"] + n).alias("span_end"))
        return F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pages, start, step, lambda acc: acc["out"])
