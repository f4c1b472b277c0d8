"""Problem 6: people and organisations matched across two tables without a common key.

Sorted neighbourhood: both tables, different forms only, are sorted by several composite keys;
in each order every row is compared with the WINDOW rows before it. Forms that agree in the part
of a key before the date, be it but for a misspelt letter, are all compared, in blocks, as no window is
sure to reach over a common name. Weighted similarities of name, date of birth and kinds of data give a confidence. A one-to-one assignment with the
largest total confidence (auction algorithm, exact up to the rounding of confidences) picks
the leading person form of each subject; further forms of the same person follow it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import p1_names
from tracefold.llm.names import full_names, near
from tracefold.llm.p2_groups import components
from tracefold.runtime import materialize, salted_join

#: Rows of a sort order that a row is compared with.
WINDOW = 24
#: Rows of a piece of a sort order that one task goes through.
PIECE = 20_000
#: Points that a pair needs: family name and initial and nothing that speaks against it, say, or family name and given name.
LEAST = 3.1
#: Letters that two family names which may be one can have in only one of them.
LETTERS_APART = 6

# Wordings of the other office and the categories they mean.
TYPES = {
    "birth date": ["dob"], "postal address": ["home_address"], "health data": ["medical"], "contact data": ["email", "phone"],
    "payment data": ["card_number", "financial_account"], "credentials": ["login_credentials"], "government id": ["ssn", "passport", "drivers_license"],
}
MONTHS = {m: i + 1 for i, ms in enumerate("jan,ene,janv feb,feb,fév mar,mär,mars apr,abr,avr may,mai,mayo jun,juin jul,juil aug,ago,août sep,sept oct,okt nov dec,dez,dic,déc".split()) for m in ms.split(",")}

KEYS = ("k1", "k2", "k3", "k4", "k5")
#: Parts of k3 and k4 without the date: forms that are equal in that of k1 are equal in both.
RUNS = ("r3", "r4")
#: Forms of one side that a block of a run holds, about.
BLOCK = 500


def dates(text: str | None) -> list[tuple[int, int, int]]:
    """(year, month, day) that a notation may mean, the likelier first; 0 for what is missing; empty if it can't be read."""
    if not text:
        return []
    t = text.strip().lower()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        return [(int(m[1]), int(m[2]), int(m[3]))]
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?", t):
        return [(int(m[1]), int(m[2] or 0), 0)]
    if m := re.fullmatch(r"(\d{1,2})([./ -])(\d{1,2})\2(\d{4}|\d{2})", t):
        a, b, y = int(m[1]), int(m[3]), int(m[4])
        y += 0 if y > 99 else 1900 if y > 25 else 2000
        both = [(y, a, b), (y, b, a)] if m[2] == "/" else [(y, b, a), (y, a, b)]
        return [x for x in both if 1 <= x[1] <= 12 and 1 <= x[2] <= 31]
    if m := re.fullmatch(r"(?:(\d{1,2})\.?\s+)?([^\W\d_]{3,})\.?,?\s+(?:(\d{1,2}),?\s+)?(\d{4})", t):
        month = MONTHS.get(m[2][:4]) or MONTHS.get(m[2][:3])
        return [(int(m[4]), month, int(m[1] or m[3] or 0))] if month else []
    return []


def date_points(person: list[tuple[int, int, int]], subject: list[tuple[int, int, int]]) -> float:
    if not person or not subject:
        return 0.0
    p, best = person[0], -5.0
    for i, s in enumerate(subject):
        if s[1] == 0 or s[2] == 0:
            got = 3.0 if s[1] and p[:2] == s[:2] else 2.0 if not s[1] and p[0] == s[0] else -5.0
        elif p == s:
            got = 5.0 - i
        elif p == (s[0], s[2], s[1]):
            got = 3.0 - i
        else:
            got = 1.5 - i if sum(x == y for x, y in zip(p, s)) == 2 else -5.0
        best = max(best, got)
    return best


def points(p: dict, s: dict) -> float:
    """Weighted similarity of a person form and a subject form; what contradicts scores far below zero."""
    if p["kind"] != s["kind"] or p["suffix"] and s["suffix"] and p["suffix"] != s["suffix"]:
        return -9.0
    a, b = p["family"], s["family"]
    if a == b:
        total = 3.0
    elif near(a, b) and len(a) > 4:
        total = 2.0
    elif p["kind"] == "person" and min(len(a), len(b)) > 6 and (abs(len(a) - len(b)) < 3 and sum(x != y for x, y in zip(a, b)) < 3 or a in b.split("-") or b in a.split("-")):
        total = 0.5
    else:
        return -9.0
    if p["kind"] == "org":
        x, y = set(p["first"].split()), set(s["first"].split())
        total += 2.5 if x == y else 2.0 if x <= y or y <= x else -9.0
    else:
        x, y = p["first"], s["first"]
        if not x or not y:
            pass
        elif len(x) == 1 or len(y) == 1:
            initials = {z[0] for z in (*full_names(x), x)} & {z[0] for z in (*full_names(y), y)}
            total += 0.7 if initials else -9.0
        elif set(full_names(x)) & set(full_names(y)):
            total += 2.5
        elif any(near(v, w) for v in (*full_names(x), x) for w in (*full_names(y), y)) and len(x) > 2:
            total += 2.0 if not p["sure"] or not s["sure"] else -9.0  # two names of their own
        else:
            return -9.0
        x, y = p["middle"], s["middle"]
        if x and y:
            same = x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0] or near(x, y)
            total += 0.7 if same else -1.5
    total += date_points(p["dates"], s["dates"])
    want = [TYPES[t] for t in s["types"] if t in TYPES]
    if want and p["types"]:
        total += 2.0 * (sum(any(c in p["types"] for c in w) for w in want) / len(want) - 0.75)
    return total


def confidence(score: float) -> float:
    return 1 / (1 + math.exp(-(score - LEAST)))


def _forms(persons: DataFrame, flags: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different forms of both tables (form, side, name, born, types) and the rows of each (form, id, side)."""
    cats = flags.where("category is not null").groupBy("person_id").agg(F.array_sort(F.collect_set("category")).alias("types"))
    p = persons.where("id is not null and best_known_full_name <> 'Unknown'").select("id", F.trim("best_known_full_name").alias("name"), F.col("dob").alias("born")).join(cats.withColumnRenamed("person_id", "id"), "id", "left").select(F.lit("p").alias("side"), "id", "name", "born", "types")
    s = subjects.where("subject_id is not null and listed_name is not null").select(F.lit("s").alias("side"), F.col("subject_id").alias("id"), F.trim("listed_name").alias("name"), F.col("birth_date").alias("born"), F.array_sort("data_types").alias("types"))
    rows = p.unionByName(s).where("name <> ''").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    # equal persons of different categories are one form; its categories are united
    key = F.md5(F.concat_ws("\0", "side", "name", F.coalesce("born", F.lit("")), F.when(F.col("side") == "s", F.array_join("types", ",")).otherwise(F.lit(""))))
    rows = materialize(rows.withColumn("form", key))
    kinds = rows.select("form", F.explode_outer("types").alias("t")).groupBy("form").agg(F.collect_set("t").alias("types"))
    forms = rows.groupBy("form").agg(F.first("side").alias("side"), F.first("name").alias("name"), F.first("born").alias("born")).join(kinds, "form")
    return forms, rows.select("form", "side", "id")


def _keyed(forms: DataFrame) -> DataFrame:
    """Forms with their sort keys: family and given name and year; date and given name; reversed family; given name and consonants; date in its last reading. And with their runs."""
    parts = materialize(p1_names.parsed(forms.select("name").distinct()))
    forms = salted_join(forms, parts, ["name"])
    names = ["form", "side", "kind", "family", "first", "middle", "suffix", "sure", "born", "types", "letters", *KEYS, *RUNS]
    kinds = {"types": "array<string>", "letters": "bigint", "sure": "boolean"}
    arrow = {"array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for form, side, kind, family, first, middle, suffix, sure, born, types in zip(*(b.column(i).to_pylist() for i in range(10))):
                stem = full_names(first)[0] if kind == "person" else first
                d = dates(born)
                ymd, other = ("%04d%02d%02d" % d[i] if d else "9999" for i in (0, -1))
                bones = re.sub(r"[aeiouy\W]|(.)(?=\1)", "", family)
                k = (f"{family} {stem} {ymd}", f"{ymd} {stem} {family}", f"{family[::-1]} {stem[:1]} {ymd}", f"{stem} {bones} {ymd}", f"{other} {stem} {family}")
                r = (f"{kind} {family} {stem[:1]}", f"{kind} {stem} {bones}")
                rows.append((form, side, kind, family, first, middle, suffix, sure, born, types, letters(family), *k, *r))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow.get(kinds.get(n), pa.string())) for n, c in zip(names, cols)], names)

    return forms.select("form", "side", "kind", "family", "first", "middle", "suffix", "sure", "born", "types").mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def letters(word: str) -> int:
    """The letters of a word as bits, other characters but hyphens by their code."""
    out = 0
    for c in word:
        if c != "-":
            out |= 1 << (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 37)
    return out


def _side(r: dict) -> dict:
    """A form made ready for ``points``."""
    r["dates"] = dates(r["born"])
    r["types"] = set(r["types"] or ()) if r["side"] == "p" else list(r["types"] or ())
    return r


def _ordered(keyed: DataFrame, key: str) -> DataFrame:
    """``keyed`` with its position in the order of ``key``: partitions of a range sort, numbered one behind the other."""
    spark = keyed.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = keyed.drop(*RUNS).repartitionByRange(n, key, "form").sortWithinPartitions(key, "form").withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = materialize(sorted_)
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    at, starts = 0, []
    for p in range(n):
        starts.append((p, at))
        at += sizes.get(p, 0)
    return rows.join(F.broadcast(spark.createDataFrame(starts, "_p int, _start bigint")), "_p").withColumn("pos", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def _window(ordered: DataFrame, window: int) -> DataFrame:
    """s, p, score of the pairs within the window that have enough points. Pieces of equal length overlap by the window, so that no key makes a task long."""
    piece = F.floor(F.col("pos") / PIECE)
    rows = ordered.withColumn("piece", F.explode(F.when(F.col("pos") % PIECE >= PIECE - window, F.array(piece, piece + 1)).otherwise(F.array(piece)))).repartition("piece").sortWithinPartitions("piece", "pos")

    fields = ["form", "side", "kind", "family", "first", "middle", "suffix", "sure", "born", "types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([before, t]) if before is not None else t
            new = len(t) - len(b)  # rows from here on meet those within the window before them
            before = t.slice(max(0, len(t) - window))
            side, piece, bits = (t[c].to_numpy() for c in ("is_p", "piece", "letters"))
            near_ = [[np.zeros(0, np.int64)] * 2]
            for k in range(1, min(window, len(t) - 1) + 1):
                a, z = np.arange(max(0, new - k), len(t) - k), np.arange(max(k, new), len(t))
                apart = bits[a] ^ bits[z]
                ok = (side[a] != side[z]) & (piece[a] == piece[z])
                ok &= (np.bitwise_count(apart) <= LETTERS_APART) | ((bits[a] & bits[z]) == np.minimum(bits[a], bits[z])) | ((bits[a] & bits[z]) == np.maximum(bits[a], bits[z]))
                near_.append([a[ok], z[ok]])
            first, second = (np.concatenate([x[i] for x in near_]) for i in (0, 1))
            rows = np.unique(np.concatenate([first, second]))
            made = {int(i): _side(r) for i, r in zip(rows, t.select(fields).take(pa.array(rows)).to_pylist())}
            found = []
            for x, y in zip(first.tolist(), second.tolist()):
                p, s = (made[x], made[y]) if side[x] else (made[y], made[x])
                score = points(p, s)
                if score >= LEAST:
                    found.append((s["form"], p["form"], score))
            cols = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["s", "p", "score"])

    return rows.select(*fields, "letters", (F.col("side") == "p").alias("is_p"), "piece").mapInArrow(run, "s string, p string, score double")


def _runs(keyed: DataFrame, run: str, block: int = BLOCK) -> DataFrame:
    """s, p, score of all pairs of one ``run`` that have enough points. Each side of a run is dealt into blocks; a block of persons and one of subjects meet under a key of their own, so that no name makes a task long."""
    keyed = keyed.select("form", "side", "kind", "family", "first", "middle", "suffix", "sure", "born", "types", run)
    count = lambda side: F.ceil(F.count_if(F.col("side") == side) / block).cast("int")
    size = keyed.groupBy(run).agg(count("p").alias("np"), count("s").alias("ns")).where("np > 0 and ns > 0")
    own = lambda n: F.pmod(F.xxhash64("form"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = salted_join(keyed, size, [run])
    p = sized.where("side = 'p'").withColumn("x", own("np")).withColumn("y", every("ns"))
    s = sized.where("side = 's'").withColumn("y", own("ns")).withColumn("x", every("np"))
    rows = p.unionByName(s).repartition(run, "x", "y").sortWithinPartitions(run, "x", "y", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        people: list[dict] = []
        last = None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if (cell := (r[run], r["x"], r["y"])) != last:
                    last, people = cell, []
                r = _side(r)
                if r["side"] == "p":
                    people.append(r)
                    continue
                for q in people:
                    if run == "r4" and q["family"] == r["family"]:
                        continue  # of one r3
                    score = points(q, r)
                    if score >= LEAST:
                        found.append((r["form"], q["form"], score))
            cols = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["s", "p", "score"])

    return rows.select("form", "side", "kind", "family", "first", "middle", "suffix", "sure", "born", "types", run, "x", "y").mapInArrow(compare, "s string, p string, score double")


def _near_runs(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``r5``, once for each pair of family names a letter apart, one of a person and one of a subject, of the same initial: what the names are without a letter brings them together."""
    c = F.col("family")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    families = keyed.select("side", "r3", "kind", "family", F.substring_index("r3", " ", -1).alias("initial")).distinct()
    v = materialize(families.withColumn("v", F.explode(F.array_distinct(F.concat(F.array(c), cut)))))
    p, s = (v.where(F.col("side") == x).select("kind", "initial", "v", F.col("r3").alias(f"{x}3"), F.col("family").alias(f"{x}f")) for x in "ps")
    pairs = materialize(p.join(s, ["kind", "initial", "v"]).where("pf <> sf").select("p3", "s3").distinct())
    run = F.concat("p3", F.lit("|"), "s3").alias("r5")
    mine = [salted_join(keyed.where(F.col("side") == x), pairs.select(F.col(f"{x}3").alias("r3"), run), ["r3"]) for x in "ps"]
    return mine[0].unionByName(mine[1])


def _edges(keyed: DataFrame, window: int) -> DataFrame:
    """s, p, score of the pairs of all orders and runs."""
    edges = None
    for found in [*(_window(_ordered(keyed, k), window) for k in KEYS), *(_runs(keyed, r) for r in RUNS), _runs(_near_runs(keyed), "r5")]:
        edges = found if edges is None else edges.unionByName(found)
    return edges.groupBy("s", "p").agg(F.max("score").alias("score"))


def assign(edges: list[tuple[str, str, float]]) -> dict[str, str]:
    """One-to-one assignment of s to p with the largest total, by the auction algorithm on confidences rounded to thousandths; everyone may stay alone at value 0."""
    values: dict[str, dict[str, int]] = defaultdict(dict)
    for s, p, c in sorted(edges):
        values[s][p] = max(values[s].get(p, 0), round(1000 * c))
    n = len(values) + 1
    price: dict[str, int] = defaultdict(int)
    owner: dict[str, str] = {}
    waiting = deque(sorted(values))
    while waiting:
        s = waiting.popleft()
        offers = sorted(((v * n - price[p], p) for p, v in values[s].items()), key=lambda x: (-x[0], x[1]))
        best, p = offers[0]
        if best <= 0:
            continue  # nothing is worth its price: stays alone
        second = max(0, offers[1][0] if len(offers) > 1 else 0)
        price[p] += best - second + 1
        if p in owner:
            waiting.append(owner[p])
        owner[p] = s
    return {s: p for p, s in owner.items()}


def _assigned(edges: DataFrame) -> DataFrame:
    """s, p of the assignment. Pairs that compete with no other are taken at once; the rest is solved by connected part.

    A part holds subjects and persons of like names, so its size follows the number of different people of one
    name, not the number of rows.
    """
    ds = edges.groupBy("s").agg(F.count(F.lit(1)).alias("ns"))
    dp = edges.groupBy("p").agg(F.count(F.lit(1)).alias("np"))
    e = materialize(edges.join(ds, "s").join(dp, "p"))
    alone = e.where("ns = 1 and np = 1").select("s", "p")
    rest = materialize(e.where("ns > 1 or np > 1").select("s", "p", "score"))
    if rest.isEmpty():
        return alone
    # vertices as longs: numbers of a sorted table would need one task; positions in the edge table are enough
    ids = rest.select(F.explode(F.array("s", "p")).alias("form")).distinct()
    ids = materialize(ids.withColumn("v", F.monotonically_increasing_id()))
    v = rest.join(ids.select(F.col("form").alias("s"), F.col("v").alias("u")), "s").join(ids.select(F.col("form").alias("p"), "v"), "p")
    v = materialize(v)
    part = components(v.select("u", "v")).select(F.col("x").alias("u"), "root")
    groups = v.join(part, "u").groupBy("root").agg(F.collect_list(F.struct("s", "p", "score")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for e in b.column(0).to_pylist() for x in assign([(x["s"], x["p"], confidence(x["score"])) for x in e]).items()]
            cols = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], ["s", "p"])

    return alone.unionByName(groups.select("e").mapInArrow(run, "s string, p string"))


def matches(persons: DataFrame, flags: DataFrame, subjects: DataFrame, window: int = WINDOW) -> DataFrame:
    """person_id, subject_id, confidence. Rows without a name and persons named Unknown match nothing; equal rows match alike."""
    forms, rows = _forms(persons, flags, subjects)
    forms = materialize(forms)
    keyed = materialize(_keyed(forms))
    edges = materialize(_edges(keyed, window))
    lead = materialize(_assigned(edges))
    # further forms of the person: their best subject is this one, and they fit the leading form
    best = edges.groupBy("p").agg(F.max("score").alias("top"))
    more = edges.join(best, "p").where("score = top").drop("top").join(lead.select("s", F.col("p").alias("lead")), "s").join(lead.select("p", F.col("s").alias("taken")), "p", "left").where("taken is null or taken = s")
    side = keyed.select(F.col("form").alias("p"), "kind", "family", "first", "middle", "suffix", "sure", "born")
    pair = more.join(side, "p").join(side.select(F.col("p").alias("lead"), *(F.col(c).alias(f"l_{c}") for c in ("kind", "family", "first", "middle", "suffix", "sure", "born"))), "lead")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in b.to_pylist():
                p = {c: r[c] for c in ("kind", "family", "first", "middle", "suffix", "sure")} | {"dates": dates(r["born"]), "types": set()}
                q = {c: r[f"l_{c}"] for c in ("kind", "family", "first", "middle", "suffix", "sure")} | {"dates": dates(r["l_born"]), "types": []}
                if r["p"] == r["lead"] or points(p, q) >= 2.4:
                    keep.append((r["s"], r["p"], confidence(r["score"])))
            cols = list(zip(*keep)) if keep else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["s", "p", "confidence"])

    # the leading form itself always belongs to its subject, whatever its best one is
    own = edges.join(lead, ["s", "p"]).select("s", "p", "score")
    sure = own.select("s", "p", (1 / (1 + F.exp(-(F.col("score") - LEAST)))).alias("confidence"))
    every = materialize(sure.unionByName(pair.mapInArrow(fits, "s string, p string, confidence double")).groupBy("s", "p").agg(F.max("confidence").alias("confidence")))
    sid = rows.where("side = 's'").select(F.col("form").alias("s"), F.col("id").alias("subject_id"))
    pid = rows.where("side = 'p'").select(F.col("form").alias("p"), F.col("id").alias("person_id"))
    return salted_join(sid, every, ["s"]).join(pid, "p").select("person_id", "subject_id", "confidence")
