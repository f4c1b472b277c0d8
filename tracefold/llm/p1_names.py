"""Problem 1: spellings of one person or organisation linked by merging and matching again.

A spelling is taken apart into family name, given names, initials and suffix; which words are
given names is learned from all spellings and joined to their words. Spellings of one family
name form a block; in it, profiles merge (nicknames, misspelt given names, order), their given
names, middle names and initials are united, and spellings with initials only are matched with
the richer profiles. Merged profiles enter blocking again with all their given names: one whose
family name is a misspelling of a more frequent one moves to its block, and the blocks that
changed are merged again, until no profile moves. Initials that fit several people go to those
that the links of their records name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.names import NICKNAMES, PARTICLES, Index, deleted, full_names, near, taken_apart, words
from tracefold.runtime import materialize, salted_join

#: Words of a spelling that count as neighbours: those up to this many places apart.
REACH = 3
#: A given name has at least this share of the neighbours of the twentieth most common one, and this share of places before a comma at most.
GIVEN_SHARE, GIVEN_BEFORE_COMMA = 0.1, 0.08
#: A family name moves to one that is this many times as frequent, or, if it has few spellings, to any that has more.
TIMES, FEW = 3, 3
#: Letters of a family name below which it moves to a more frequent one only, and for a changed letter only if it is written once.
SHORT = 5

PARTS = ["kind", "family", "first", "middle", "suffix"]


def spelling(c: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def spellings(extractions: DataFrame, persons: DataFrame) -> DataFrame:
    """name: the different spellings of full_name extractions that are not suppressed and of persons not named Unknown; null and empty ones are left out."""
    e = extractions.where("category = 'full_name' and not coalesce(suppressed_as_false_positive, false)").select(spelling(F.col("normalized_value")).alias("name"))
    p = persons.where("best_known_full_name <> 'Unknown'").select(spelling(F.col("best_known_full_name")).alias("name"))
    return e.unionByName(p).where("name <> ''").distinct()


def _words(names: DataFrame) -> DataFrame:
    """name, word, near, alone of the words of two letters and more of people's names: the words up to REACH places away, and whether it is the only one before a comma."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in b.column(0).to_pylist():
                head, tail, _, _, org = words(s)
                long = [] if org else [w for w in head + tail if len(w) > 1]
                alone = bool(tail) and len(head) == 1
                rows += [(s, a, [c for c in long[max(0, i - REACH) : i + REACH + 1] if c != a], alone and a == head[0]) for i, a in enumerate(long)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()))], ["name", "word", "near", "alone"])

    return names.select("name").mapInArrow(run, "name string, word string, near array<string>, alone boolean")


def _nicknames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((k, x) for k, v in NICKNAMES.items() for x in v.split(",")), "word string, full string")


def given_names(found: DataFrame) -> DataFrame:
    """word, partners: words with many different neighbours that seldom stand alone before a comma, and the nicknames with their full forms. A table, however many there are. ``found``: see :func:`_words`."""
    spark = found.sparkSession
    pairs = found.select(F.col("word").alias("a"), F.explode("near").alias("b"), F.col("alone").alias("before"))
    per = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("before").alias("before")).groupBy("a").agg(F.count(F.lit(1)).alias("partners"), (F.sum("before") / F.sum("n")).alias("share"))
    often = materialize(per.where(F.col("share") <= GIVEN_BEFORE_COMMA).select(F.col("a").alias("word"), "partners"))
    top = often.orderBy(F.col("partners").desc()).limit(21).collect()  # the twentieth commonest alone is needed
    least = max(5.0, GIVEN_SHARE * top[min(20, len(top) - 1)]["partners"]) if top else 5.0
    learned = often.where(F.col("partners") >= least)
    nick = _nicknames(spark)
    full = nick.join(learned.select(F.col("word").alias("full"), "partners"), "full", "left").select(F.explode(F.array("word", "full")).alias("word"), F.coalesce("partners", F.lit(1)).alias("partners"))
    return learned.unionByName(full).groupBy("word").agg(F.max("partners").alias("partners"))


def _near_words(found: DataFrame, given: DataFrame) -> DataFrame:
    """word of those that are one letter off a given name: both are met by what is left of them without a letter."""

    @F.pandas_udf("boolean")
    def close(a, b):  # noqa: ANN001, ANN202
        return a.combine(b, near)

    def shorter(df: DataFrame, name: str) -> DataFrame:
        c = F.col(name)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return df.select(name, F.explode(F.array_distinct(F.concat(F.array(c), cut))).alias("v"))

    tried = shorter(found.where(F.length("word") > 2), "word").join(shorter(given.select(F.col("word").alias("g")), "g"), "v").select("word", "g").distinct()
    return tried.where(close("word", "g")).select("word").distinct()


def parsed(names: DataFrame) -> DataFrame:
    """name, its parts, and whether its first name is a known given name. Nicknames are given names as well. Every spelling meets what is known of its own words by joins."""
    found = materialize(_words(names))
    given = materialize(given_names(found))
    word = found.select("name", "word").distinct()
    strange = materialize(word.select("word").distinct().join(given, "word", "left_anti"))
    known = materialize(given.select("word", "partners").unionByName(_near_words(strange, given).select("word", F.lit(0).cast("bigint").alias("partners"))))
    per = salted_join(word, known, ["word"]).groupBy("name").agg(F.collect_list(F.struct("word", "partners")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                here = {x["word"]: x["partners"] for x in k or () if x["partners"]}
                parts = taken_apart(s, here, {x["word"] for x in k or () if not x["partners"]})
                rows.append((*parts, parts[2] in here))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols[:5]), pa.array(cols[5], pa.bool_())], ["name", *PARTS, "sure"])

    return names.select("name").join(per, "name", "left").mapInArrow(run, "name string, " + ", ".join(f"{p} string" for p in PARTS) + ", sure boolean")


def _variants(word: str) -> list[str]:
    """``word``, what is left of it without one character, and without a particle written to it: spellings one error apart share one."""
    return sorted({*deleted(word), *(word[len(p) :] for p in PARTICLES if word.startswith(p) and len(word) - len(p) > 4)})


def moves(profiles: DataFrame) -> DataFrame:
    """kind, family, first -> better: family names that are a misspelling of a more frequent one with the same given name.

    ``profiles``: kind, family, first, n, also (further given names of the merged profile it belongs to, may be
    null). Candidates share a deletion of the family name and the stem or initial of a given name; of several
    the most frequent wins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, f, g, n, also, m in zip(*(b.column(i).to_pylist() for i in range(6))):
                if len(f) < 2:
                    continue
                stems = [g] if k == "org" or len(g) <= 1 else sorted({x for y in (g, *(also or ())) for x in full_names(y)})
                rows += [(k, v, s, f, g, n, m) for v in _variants(f) for s in stems]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.string(),) * 5 + (pa.int64(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "v", "stem", "family", "first", "n", "m"])

    size = profiles.groupBy("kind", "family").agg(F.sum("n").alias("m"))
    spread = profiles.join(size, ["kind", "family"]).select("kind", "family", "first", "n", "also", "m").mapInArrow(run, "kind string, v string, stem string, family string, first string, n bigint, m bigint")
    spread = materialize(spread)

    @F.pandas_udf("boolean")
    def close(a, b):  # noqa: ANN001, ANN202
        return a.combine(b, lambda x, y: near(x, y) or x.endswith(y) and x[: -len(y)] in PARTICLES)

    long = (F.length("family") >= SHORT) & (F.length("better") >= SHORT)
    swap = F.array_sort(F.split("family", "")) == F.array_sort(F.split("better", ""))
    larger = (F.col("size") >= TIMES * F.col("m")) & (long | (F.length("family") != F.length("better")) | swap | (F.col("m") == 1)) | long & (F.col("m") <= FEW) & (F.struct("size", "better") > F.struct(F.col("m").alias("size"), F.col("family").alias("better")))
    big = spread.select("kind", "v", "stem", F.col("family").alias("better"), F.col("m").alias("size"))
    tried = spread.where(F.length("first") > 1).join(big, ["kind", "v", "stem"]).where((F.col("better") != F.col("family")) & larger).select("kind", "family", "first", "better", "size").distinct()
    full = tried.where(close("family", "better")).groupBy("kind", "family", "first").agg(F.max_by("better", F.struct("size", "better")).alias("better"))
    # initials: the family name has no full given name of its own left, and a single neighbour has one with that initial
    rich = spread.where((F.length("first") > 1) & (F.col("kind") == "person")).select("v", F.substring("stem", 1, 1).alias("stem"), F.col("family").alias("better"), F.col("m").alias("size"))
    poor = spread.where((F.length("first") == 1) & (F.col("kind") == "person"))
    some = poor.join(rich, ["v", "stem"]).where((F.col("better") != F.col("family")) & long & (F.col("size") >= TIMES * F.col("m"))).select("kind", "family", "first", "better").distinct()
    single = some.where(close("family", "better")).groupBy("kind", "family", "first").agg(F.count(F.lit(1)).alias("k"), F.min("better").alias("better")).where("k = 1").drop("k")
    return full.unionByName(single)


NICKNAME_INDEX = Index(k for k in NICKNAMES if len(k) > 3)


def merged(rows: list[tuple[str, str, str, int, list[str]]], kind: str, given: Collection[str]) -> list[list[str]]:
    """Entities of each profile (first, middle, suffix, how many spellings, given names its links tell) of one family name.

    Profiles merge into entities until no further merge: full given names first, then misspelt ones, then
    initials, which the united middle names and initials of the merged entities decide. ``given``: the first
    names of the rows that are known given names. Near names and initials are looked up, not searched for.
    """
    if kind == "org":
        return _merged_orgs(rows)
    out: list[list[str]] = [[] for _ in rows]
    count: dict[str, int] = defaultdict(int)
    for first, _, _, n, _ in rows:
        if len(first) > 1 and (first in given or first in NICKNAMES):
            for x in full_names(first):
                count[x] += n * (2 if x == first else 1)
    plain = {first for first, *_ in rows if len(first) > 1 and first not in NICKNAMES}
    counted, whole = Index(count), Index(k for k in plain if k in given)
    entity: dict[int, list[str]] = {}
    waiting = []
    for i, (first, middle, suffix, n, told) in enumerate(rows):
        if len(first) <= 1:
            waiting.append(i)
        elif first in NICKNAMES:
            names = full_names(first)
            here = [x for x in names if x in plain] or [x for x in names if x in told]
            entity[i] = here or names[:1]
        elif first in given:
            entity[i] = [first]
        else:
            close = sorted(counted.near(first), key=lambda x: (-count[x], x))
            close = close or sorted((full_names(k)[0] for k in whole.near(first)), key=lambda x: (-count[x], x))
            nick = sorted({full_names(k)[0] for k in NICKNAME_INDEX.near(first) if any(x in count for x in full_names(k))})
            entity[i] = close[:1] or nick[:1] or [first]
    # misspelt twice over: what is left merges with what it is near to, larger ones first
    held: dict[str, int] = defaultdict(int)
    for i, es in entity.items():
        for e in es:
            held[e] += rows[i][3]
    loose = sorted((e for e in held if e not in count), key=lambda e: (-held[e], e))
    root: dict[str, str] = {}
    beside, place = Index(loose), {e: k for k, e in enumerate(loose)}
    for e in loose:
        root[e] = root[min((x for x in beside.near(e) if x in root), key=lambda x: place[x], default=e)] if any(x in root for x in beside.near(e)) else e
    for i in entity:
        entity[i] = sorted({root.get(e, e) for e in entity[i]})
    middles: dict[str, set[str]] = defaultdict(set)
    suffixes: dict[str, set[str]] = defaultdict(set)
    for i, es in entity.items():
        for e in es:
            if rows[i][1]:
                middles[e].add(rows[i][1][0])
            if rows[i][2]:
                suffixes[e].add(rows[i][2])
    by_initial: dict[str, list[str]] = defaultdict(list)
    for e in sorted(middles.keys() | {x for es in entity.values() for x in es}):
        by_initial[e[0]].append(e)
        by_initial[""].append(e)
    changed = True
    while changed and waiting:
        changed = False
        for i in list(waiting):
            first, middle, suffix, _, told = rows[i]
            fits = by_initial[first]
            if middle:
                same = [e for e in fits if middle[0] in middles[e]]
                fits = same or [e for e in fits if not middles[e]]
            if len(middle) > 1 and not first:
                fits = []
            named = [e for e in fits if e in told]
            fits = named or fits
            if fits:
                entity[i] = sorted(fits)
                waiting.remove(i)
                if len(fits) == 1:
                    changed = True
                    if middle:
                        middles[fits[0]].add(middle[0])
                    if suffix:
                        suffixes[fits[0]].add(suffix)
    for i in waiting:
        first, middle, suffix, *_ = rows[i]
        entity[i] = [f"{first}."]
    for i, es in entity.items():
        suffix = rows[i][2]
        for e in es:
            some = suffixes.get(e, set())
            out[i] += [f"{e}/{s}" for s in ([suffix] if suffix else sorted(some) if len(some) > 1 else [""])] if len(some) > 1 else [f"{e}/"]
    return out


def _merged_orgs(rows: list[tuple]) -> list[list[str]]:
    """Organisations of one brand: the business words must not contradict each other, nor the legal forms if both are given."""
    out: list[list[str]] = [[] for _ in rows]
    kinds = sorted({r[0] for r in rows}, key=lambda b: (-len(b), b))
    lead: dict[str, str] = {}
    for b in kinds:
        lead[b] = next((k for k in lead if set(b.split()) <= set(k.split())), b)
    forms: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        if r[2]:
            forms[lead[r[0]]].add(r[2])
    for i, r in enumerate(rows):
        b = lead[r[0]]
        some = sorted(forms[b])
        out[i] = [f"{b}/{s}" for s in ([r[2]] if r[2] else some)] if len(some) > 1 else [f"{b}/"]
    return out


def evidence(extractions: DataFrame, links: DataFrame, persons: DataFrame, parts: DataFrame) -> DataFrame:
    """family, first (an initial) -> told: full given names of the same family name linked to the same person row."""
    named = extractions.where("category = 'full_name' and not coalesce(suppressed_as_false_positive, false)").select(F.col("id").alias("extraction_id"), spelling(F.col("normalized_value")).alias("name"))
    linked = named.join(links.select("extraction_id", "person_id"), "extraction_id").select("person_id", "name")
    own = persons.where("best_known_full_name <> 'Unknown'").select(F.col("id").alias("person_id"), spelling(F.col("best_known_full_name")).alias("name"))
    who = linked.unionByName(own).where("person_id is not null and name <> ''").distinct()
    p = materialize(salted_join(who, parts.where("kind = 'person'"), ["name"]).select("person_id", "family", "first", "middle").distinct())
    short = p.where(F.length("first") == 1)
    full = p.where(F.length("first") > 1).select("person_id", "family", F.col("first").alias("full"))
    return short.join(full, ["person_id", "family"]).groupBy("family", "first", "middle").agg(F.collect_set("full").alias("told"))


def _merge(profiles: DataFrame) -> DataFrame:
    """PARTS -> entity of the profiles (PARTS, n, told, sure), a family name at a time. A block holds different profiles only, however many spellings they have."""
    blocks = profiles.groupBy("kind", "family").agg(F.collect_list(F.struct("first", "middle", "suffix", "n", "told", "sure")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, f, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                sure = {x["first"] for x in p if x["sure"]}
                p = sorted(((x["first"], x["middle"], x["suffix"], x["n"], [y for t in x["told"] or () for y in full_names(t)]) for x in p), key=lambda x: x[:4])
                for x, es in zip(p, merged(p, k, sure)):
                    rows += [(k, f, x[0], x[1], x[2], f"{k}/{f}/{e}") for e in es]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], [*PARTS, "entity"])

    return blocks.mapInArrow(run, ", ".join(f"{c} string" for c in [*PARTS, "entity"]))


def _profiles(now: DataFrame, told: DataFrame | None) -> DataFrame:
    p = now.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n"), F.max("sure").alias("sure"))
    return p.join(told, ["family", "first", "middle"], "left") if told is not None else p.withColumn("told", F.lit(None).cast("array<string>"))


def entities(names: DataFrame, extractions: DataFrame | None = None, links: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """name, entity: the entities (several, if its initials fit several people) that each spelling means."""
    parts = materialize(parsed(names))
    told = materialize(evidence(extractions, links, persons, parts)) if links is not None else None
    now, profiles = parts, materialize(_profiles(parts, told))
    found = materialize(_merge(profiles))
    while True:
        # the merged profiles with all their given names enter blocking again
        full = found.where((F.length("first") > 1) & (F.col("kind") == "person"))
        united = full.groupBy("entity").agg(F.collect_set("first").alias("also")).where(F.size("also") > 1)
        also = full.select("kind", "family", "first", "entity").distinct().join(united, "entity").groupBy("kind", "family", "first").agg(F.flatten(F.collect_set("also")).alias("also"))
        each = profiles.groupBy("kind", "family", "first").agg(F.sum("n").alias("n")).join(also, ["kind", "family", "first"], "left")
        change = materialize(moves(each))
        if change.isEmpty():
            return salted_join(now, found, PARTS).select("name", "entity")
        now = materialize(salted_join(now, change, ["kind", "family", "first"], "left").withColumn("family", F.coalesce("better", "family")).drop("better"))
        profiles = materialize(_profiles(now, told))
        touched = materialize(change.select("kind", F.explode(F.array("family", "better")).alias("family")).distinct())
        again = _merge(profiles.join(touched, ["kind", "family"], "left_semi"))
        found = materialize(found.join(touched, ["kind", "family"], "left_anti").unionByName(again))


def pairs(at: DataFrame) -> DataFrame:
    """name_a, name_b: every two spellings of one entity, as the problem asks for."""
    at = materialize(at.distinct())
    a, b = at.select(F.col("name").alias("name_a"), "entity"), at.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def variants(extractions: DataFrame, persons: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """name_a, name_b of the spellings that mean the same person or organisation."""
    return pairs(entities(materialize(spellings(extractions, persons)), extractions, links, persons))
